"""Options of a digest job."""

from __future__ import annotations

import dataclasses
import enum

from gistmill import fixed_values as fv


#: The largest file that becomes a row with its content, in bytes.
LARGEST_ROW = 1024 * 1024 * 1024


class DigestMode(str, enum.Enum):
    """How files at or above the token threshold are turned into entries."""

    AI = "ai"
    MOCK = "mock"
    COPY = "copy"

    @classmethod
    def choose(cls, mock: bool = False, copy: bool = False) -> "DigestMode":
        """The mode for two switches: mock wins over copy, the model is the default."""
        if mock:
            return cls.MOCK
        return cls.COPY if copy else cls.AI


@dataclasses.dataclass(frozen=True)
class DigestOptions:
    """Scalars that enter the plans as literals; ``api_url`` is for the caller's client."""

    mode: DigestMode = DigestMode.AI
    api_key: str | None = None
    api_url: str | None = None
    model: str | None = None
    token_threshold: int = fv.TOKEN_THRESHOLD
    timeout: float = fv.TIMEOUT_SECONDS
    retry_attempts: int = fv.RETRY_ATTEMPTS
    retry_pause: float = fv.RETRY_PAUSE_SECONDS
    calls_per_task: int = 8
    max_file_size_mb: float = fv.MAX_FILE_SIZE_MB
    output_file: str = fv.DIGEST_FILE
    ignore_file: str = fv.IGNORE_FILE

    def __post_init__(self):
        object.__setattr__(self, "mode", DigestMode(self.mode))
        if self.max_file_size_mb * 1024 * 1024 > LARGEST_ROW:
            raise ValueError(f"the size limit cannot exceed {LARGEST_ROW // 1024 // 1024} MB")

    def require_key(self) -> None:
        """Fail before anything is read when the model is needed but cannot be called."""
        if self.mode is DigestMode.AI and not self.api_key:
            raise ValueError("summarising with a model needs an API key; set api_key or use mock mode")
        if self.mode is DigestMode.AI and not self.model:
            raise ValueError("summarising with a model needs the name of the model")
