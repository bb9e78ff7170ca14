"""Token ids of many texts, exactly as the tokenizers library gives them."""

from __future__ import annotations

import json
import os
import re
from array import array

#: Words whose ids one worker remembers, and the longest that it does.
REMEMBERED_WORDS, REMEMBERED_LENGTH = 1_000_000, 64

# Characters whose class is the same for every Unicode version and every regex library:
# printable ASCII, its white space, and the letters of the Latin-1 and Extended-A blocks.
_UNUSUAL = re.compile("[^\t\n\x0b\x0c\r -~À-ÖØ-öø-įĲ-ň]")
_BEYOND_LATIN_1 = re.compile("[^\t\n\x0b\x0c\r -~À-ÖØ-öø-ÿ]")

# How the two kinds of pre-tokenizers split texts of such characters (fixed values); what
# stands for letters is filled in, because a class within Latin-1 is searched faster.
_BYTE_LEVEL = r" ?{letter}+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
_WORD_END = r"{letter}+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+"
_LETTERS = ["[A-Za-zÀ-ÖØ-öø-ÿ]", r"[^\W\d_]"]
_WORD_END_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# How byte-level models show bytes (fixed values): printable ones as they are, the others
# as the characters from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = dict(zip(_PLAIN, map(chr, _PLAIN))) | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def load(path: str):
    """The library's tokenizer of a file, on one thread: Spark has the other cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, one byte string a text.

    The library never merges across the words its pre-tokenizer cuts, so the ids of a text
    are those of its words in a row.  Ids of words come from the library's model and are remembered;
    texts with unusual characters or special strings go to the library whole, as does
    everything if the file describes a pre-tokenizer not known here.
    """

    def __init__(self, path: str):
        self.library = load(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.special = [token["content"] for token in described.get("added_tokens", [])]
        self.words, self.lower = _words_of(described)
        self.merge = self.library.model.tokenize
        self.known: dict[str, bytes] = {}

    def _ids_of_word(self, word: str) -> bytes:
        """Ids of what the pre-tokenizer would hand to the model as one word."""
        if word[0] == " " and word.isascii() and word[1:].isalnum():
            shown = _SHOWN[32] + word[1:]
        else:
            shown = word.encode().decode("latin-1").translate(_SHOWN)
        return array("I", [token.id for token in self.merge(shown)]).tobytes()

    def _from_library(self, texts: list[str]) -> list[bytes]:
        done = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", one.ids).tobytes() for one in done]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        known, out, open_, whole, missing = self.known.get, [b""] * len(texts), [], [], set()
        for i, text in enumerate(texts):
            plain = not _BEYOND_LATIN_1.search(text)
            if self.words is None or not plain and _UNUSUAL.search(text) or any(s in text for s in self.special):
                whole.append(i)
                continue
            words = self.words[0 if plain else 1](text.lower() if self.lower else text)
            parts = list(map(known, words))
            if None in parts:
                holes = [k for k, part in enumerate(parts) if part is None]
                missing.update([words[k] for k in holes])
                open_.append((i, words, parts, holes))
            else:
                out[i] = b"".join(parts)
        if missing:
            found = {word: self._ids_of_word(word) for word in missing}
            self.known.update((word, ids) for word, ids in found.items() if len(word) <= REMEMBERED_LENGTH)
            for i, words, parts, holes in open_:
                for k in holes:
                    parts[k] = found[words[k]]
                out[i] = b"".join(parts)
        if whole:
            for i, ids in zip(whole, self._from_library([texts[i] for i in whole])):
                out[i] = ids
        return out


def _words_of(described: dict):
    """Functions that cut words as the described pre-tokenizer does, and whether it lower-cases.

    The first function is for texts within Latin-1, the second for the other usual ones.
    """
    def cutters(pattern):
        return [re.compile(pattern.format(letter=letter)).findall for letter in _LETTERS]

    before, split = described.get("normalizer"), described.get("pre_tokenizer") or {}
    if described["model"].get("dropout") or described["model"].get("type") != "BPE":
        return None, False
    if before is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space"):
        return cutters(_BYTE_LEVEL), False
    kinds = [step.get("type") for step in (before or {}).get("normalizers", [])]
    parts = split.get("pretokenizers", [])
    if (
        kinds == ["NFC", "Replace", "Lowercase"]
        and [part.get("type") for part in parts] == ["Split", "ByteLevel"]
        and parts[0]["pattern"] == {"Regex": _WORD_END_SPLIT}
        and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
        and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]
    ):
        return cutters(_WORD_END), True
    return None, False


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
