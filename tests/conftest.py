import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gistmill.session import build_session  # noqa: E402

LARGE = "import os\n\n" + "".join(
    f"def step_{i}(items):\n    return [item + {i} for item in items]\n\n" for i in range(40)
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("gistmill-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("staging")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tree(tmp_path):
    """A small project: source, Markdown with headings, JSON, a binary file."""
    root = tmp_path / "project"
    root.mkdir()
    (root / "small.py").write_text('print("hello")')
    (root / "large.py").write_text(LARGE)
    (root / "binary_file.bin").write_bytes(b"\x00\x01\x02\x03\xff")
    (root / "README.md").write_text("# Project\n\nText.\n\n## Features\n- one\n\n## Usage\n```\nrun\n```\n")
    (root / "config.json").write_text('{"name": "project"}\n')
    return root
