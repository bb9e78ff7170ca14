"""Functions on file contents: decoding, newlines, binary test, token estimate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill import fixed_values as fv

# The few code points above Latin-1 are tried only within their common range, and control
# characters only below the blank: character classes cost one look at most characters.
_LATIN = "".join(c for c in fv.WHITESPACE if ord(c) < 256)
_WIDE = "".join(c for c in fv.WHITESPACE if ord(c) >= 256)
_BLANK = f"{_LATIN}[{_WIDE[0]}-{_WIDE[-1]}&&[{_WIDE}]]"
_CONTROL = "[\\x00-\\x1F&&[^\\t\\n\\r]]"


def checksum(content: Column) -> Column:
    """SHA-256 of the bytes in lower hex; content that could not be read has a marker."""
    return F.coalesce(F.sha2(content, 256), F.lit(fv.UNREADABLE))


def decode(content: Column) -> Column:
    """Bytes as text: strict UTF-8, and Latin-1, which never fails, where that is invalid."""
    return F.coalesce(
        F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1")
    )


def normalise_newlines(text: Column) -> Column:
    """CR LF and lone CR become LF, as reading in text mode does."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def read_text(content: Column) -> Column:
    """Content as it is seen when a file is opened as text."""
    return normalise_newlines(decode(content))


def is_binary(text: Column) -> Column:
    """NUL present, or more than a tenth of the characters are control characters."""
    without = F.translate(text, fv.CONTROL_CHARACTERS, "")
    too_many = (F.length(text) - F.length(without)) * 10 > F.length(text)
    return F.when(~text.rlike(_CONTROL), F.lit(False)).otherwise(
        F.contains(text, F.lit("\x00")) | too_many
    )


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words."""
    # Each word with the blanks around it shrinks to one character; the result's length is
    # the count.  Collecting the words in an array would hold every text twice.
    shrunk = F.regexp_replace(text, f"[{_BLANK}]*[^{_BLANK}]+[{_BLANK}]*", "w")
    return F.when(text.rlike(f"[^{_BLANK}]"), F.length(shrunk)).otherwise(F.lit(0))


def token_estimate(text: Column) -> Column:
    """Words plus a quarter of the characters, rounded down."""
    return word_count(text).cast("long") + F.floor(F.length(text) / 4).cast("long")


def strip(text: Column) -> Column:
    """Without leading and trailing whitespace."""
    return F.btrim(text, F.lit(fv.WHITESPACE))


def strip_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(fv.WHITESPACE))


def size_label(size: Column) -> Column:
    """Bytes below 1 KiB, whole KiB below 1 MiB, whole MiB above."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit("B")))
        .when(size < 1024 * 1024, F.concat(F.shiftright(size, 10).cast("string"), F.lit("K")))
        .otherwise(F.concat(F.shiftright(size, 20).cast("string"), F.lit("M")))
    )


def modified_label(modified_time: Column) -> Column:
    return F.date_format(modified_time, fv.MODIFIED_FORMAT)


def exceeds_limit(size: Column, max_file_size_mb: float) -> Column:
    """Strictly more than the limit.  Written on the bare column, so that scans take it."""
    return size > F.lit(float(max_file_size_mb) * 1024 * 1024)


def oversize_message(size: Column, max_file_size_mb: float) -> Column:
    """Size in MiB with one decimal, ties to even, beside the limit."""
    mib = 1024 * 1024
    scaled = size * 10
    whole = F.shiftright(scaled, 20)
    rest = scaled.bitwiseAND(F.lit(mib - 1))
    round_up = (rest > mib // 2) | ((rest == mib // 2) & (whole.bitwiseAND(F.lit(1)) == 1))
    tenths = whole + round_up.cast("long")
    return F.concat(
        F.lit("File size ("),
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"),
        F.lit(f"MB) exceeds limit ({max_file_size_mb}MB)"),
    )
