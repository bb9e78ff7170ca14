"""Ignore rules as two regular expressions.

A rule list becomes one expression that decides whether a path itself is hit and one that
decides whether a directory above it is.  Both look at the whole path once, so a scan needs
two ``rlike`` per file however long the list is, and no arrays of path prefixes.  The
fragments are plain enough for both the JVM's and Python's engine.
"""

from __future__ import annotations

import dataclasses
import functools
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

_SLASH = ord("/")
NOTHING = "(?!)"


@dataclasses.dataclass(frozen=True)
class _Piece:
    """A literal, any one character, any run of characters, or a character class."""

    kind: str
    text: str = ""
    negated: bool = False
    ranges: tuple[tuple[int, int], ...] = ()


def _class_ranges(body: str) -> tuple[tuple[int, int], ...]:
    found, at = [], 0
    while at < len(body):
        if at + 2 < len(body) and body[at + 1] == "-":
            found.append((ord(body[at]), ord(body[at + 2])))
            at += 3
        else:
            found.append((ord(body[at]), ord(body[at])))
            at += 1
    return tuple((low, high) for low, high in found if low <= high)


def _pieces(pattern: str) -> Iterator[_Piece]:
    # A class ends at the first "]" that is not its first member.
    for token in re.finditer(r"\*+|\?|\[(!?)(\]?[^\]]*)\]|.", pattern, re.DOTALL):
        text = token.group()
        if text[0] == "*":
            yield _Piece("run")
        elif text == "?":
            yield _Piece("one")
        elif token.group(2):
            yield _Piece("class", negated=bool(token.group(1)), ranges=_class_ranges(token.group(2)))
        else:
            yield _Piece("text", text=text)


def _escape(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_/" or ord(c) > 126 else "\\" + c for c in text)


def _class_regex(piece: _Piece, within_name: bool) -> str:
    ranges = list(piece.ranges)
    if within_name and not piece.negated:
        ranges = [
            part
            for low, high in ranges
            for part in (
                [(low, _SLASH - 1), (_SLASH + 1, high)] if low <= _SLASH <= high else [(low, high)]
            )
            if part[0] <= part[1]
        ]
    if within_name and piece.negated:
        ranges.append((_SLASH, _SLASH))
    if not ranges:
        return "." if piece.negated else NOTHING
    body = "".join(
        _escape(chr(low)) if low == high else f"{_escape(chr(low))}-{_escape(chr(high))}"
        for low, high in ranges
    )
    return f"[{'^' if piece.negated else ''}{body}]"


def glob_regex(pattern: str, within_name: bool = False) -> str:
    """Unanchored regex for a glob.

    ``*`` and ``?`` match any character, the slash included, because rules are held against
    whole paths; with ``within_name`` nothing but a literal slash matches a slash.
    """
    any_char = "[^/]" if within_name else "."
    parts = []
    for piece in _pieces(pattern):
        if piece.kind == "run":
            parts.append(any_char + "*")
        elif piece.kind == "one":
            parts.append(any_char)
        elif piece.kind == "class":
            parts.append(_class_regex(piece, within_name))
        else:
            parts.append(_escape(piece.text))
    return "".join(parts)


def rule_fragments(rule: str) -> tuple[str | None, str | None]:
    """Regex fragments of one rule: for whole paths and for single names.

    A rule ending in ``/*`` is a directory rule.  It hits a path that equals the glob before
    the ``/*`` and every path that starts with it literally.  Any other rule hits when the
    whole path or the last name matches.
    """
    if rule.endswith("/*"):
        directory = rule[:-2]
        glob, literal = glob_regex(directory), _escape(directory)
        return (f"{glob}(?:/.*)?" if glob == literal else f"{glob}|{literal}/.*"), None
    if any(piece.kind == "text" and piece.text == "/" for piece in _pieces(rule)):
        by_name = None
    else:
        by_name = glob_regex(rule, within_name=True)
    # "*.log" and "Thumbs.db" hit no whole path whose last name they do not hit as well.
    tail = rule.lstrip("*")
    if by_name is not None and not any(c in tail for c in "*?["):
        return None, by_name
    return glob_regex(rule), by_name


@dataclasses.dataclass(frozen=True)
class RuleRegex:
    """``itself`` decides on a path, ``ancestor`` on the directories above it."""

    itself: str
    ancestor: str

    def hits(self, relative_path: str) -> bool:
        """The decision in Python, for listing readers that skip ignored directories."""
        return re.search(self.itself.replace(r"\z", r"\Z"), relative_path) is not None


def combine(paths: Iterable[str], names: Iterable[str]) -> RuleRegex:
    full = "|".join(paths) or NOTHING
    name = "|".join(names) or NOTHING
    return RuleRegex(
        itself=rf"(?s)\A(?:{full})\z|(?:\A|/)(?:{name})\z",
        ancestor=rf"(?s)\A(?:{full})/|(?:\A|/)(?:{name})/",
    )


def _by_first_character(texts: Iterable[str]) -> str:
    """Alternation of literal texts that looks at one character before it tries any of them."""
    groups: dict[str, list[str]] = {}
    for text in texts:
        groups.setdefault(text[0], []).append(_escape(text[1:]))
    return "|".join(f"{_escape(first)}(?:{'|'.join(rest)})" for first, rest in groups.items())


@functools.lru_cache(maxsize=64)
def compile_rules(rules: tuple[str, ...], own_output: str | None = None) -> RuleRegex:
    """Both expressions for a rule list; the digest's own name is always ignored."""
    paths, names, suffixes = [], [], []
    if own_output is not None:
        names.append(_escape(own_output))
    for rule in sorted(set(rules)):
        path, name = rule_fragments(rule)
        if path is not None:
            paths.append(path)
        tail = rule.lstrip("*")
        if path is None and tail != rule and tail:
            suffixes.append(tail)
        elif name is not None:
            names.append(name)
    if suffixes:
        names.append(f"[^/]*(?:{_by_first_character(suffixes)})")
    return combine(paths, names)


# ---- the same for rules in a column ----

_TOKENS = r"(?s)(\*+|\?|\[!?\]?[^\]]*\]|.)"


def _tokens(pattern: Column) -> Column:
    return F.regexp_extract_all(pattern, F.lit(_TOKENS), F.lit(1))


def has_literal_slash(pattern: Column) -> Column:
    """Whether a glob has a slash outside character classes."""
    return F.array_contains(_tokens(pattern), "/")


def _escaped(character: Column) -> Column:
    return F.when(F.rlike(character, F.lit(r"\A[A-Za-z0-9_/]")) | (F.ascii(character) > 126), character).otherwise(
        F.concat(F.lit("\\"), character)
    )


def _class_column(token: Column, any_char: str, guard: str) -> Column:
    """Regex for a token ``[…]``; one without members is plain text."""
    negated = F.startswith(token, F.lit("[!"))
    body = F.when(negated, F.substr(token, F.lit(3), F.length(token) - 3)).otherwise(F.substr(token, F.lit(2), F.length(token) - 2))
    members = F.regexp_extract_all(body, F.lit("(?s)(.-.|.)"), F.lit(1))

    def end(member: Column, place: int) -> Column:
        return F.substr(member, F.lit(place), F.lit(1))

    # a range that runs backward has no members
    forward = F.filter(members, lambda m: (F.length(m) < 3) | (end(m, 1) <= end(m, 3)))
    inside = F.array_join(F.transform(forward, lambda m: F.when(F.length(m) < 3, _escaped(m)).otherwise(
        F.concat(_escaped(end(m, 1)), F.lit("-"), _escaped(end(m, 3)))
    )), "")
    found = F.concat(F.lit(guard + "["), F.when(negated, F.lit("^")).otherwise(F.lit("")), inside, F.lit("]"))
    plain = F.array_join(F.transform(F.split(token, ""), _escaped), "")
    return F.when(body == "", plain).when(inside != "", found).when(negated, F.lit(any_char)).otherwise(F.lit(NOTHING))


def glob_regex_column(pattern: Column, within_name: bool = False) -> Column:
    """Unanchored regex for a column of globs; the counterpart of :func:`glob_regex`."""
    any_char, guard = ("[^/]", "(?!/)") if within_name else (".", "")

    def piece(token: Column) -> Column:
        return (
            F.when(F.startswith(token, F.lit("*")), F.lit(any_char + "*"))
            .when(token == "?", F.lit(any_char))
            .when(F.length(token) > 1, _class_column(token, any_char, guard))
            .otherwise(_escaped(token))
        )

    return F.array_join(F.transform(_tokens(pattern), piece), "")
