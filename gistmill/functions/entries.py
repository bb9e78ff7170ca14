"""Functions on digest entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill import fixed_values as fv
from gistmill.functions.text import strip, strip_left


def strip_header(content: Column, relative_path: Column) -> Column:
    """Drop a first line that repeats the file header, and the blanks after it."""
    first_break = F.locate("\n", content)
    has_header = F.startswith(content, F.concat(F.lit("## File: "), relative_path))
    return F.when(
        has_header & (first_break > 0),
        strip_left(F.substring(content, first_break + 1, F.length(content))),
    ).otherwise(content)


def entry_text(
    relative_path: Column, summary_date: Column, checksum: Column, content: Column
) -> Column:
    """One entry of the digest text; the checksum is named only where there is one."""
    return F.concat(
        F.lit("## "), relative_path,
        F.lit("\n\nSummarized on "), F.date_format(summary_date, fv.STAMP_FORMAT),
        F.when(F.coalesce(checksum, F.lit("")) != "",
               F.concat(F.lit(" (checksum: "), checksum, F.lit(")"))).otherwise(F.lit("")),
        F.lit("\n\n"), strip_header(content, relative_path),
    )


def entry_path(entry: Column) -> Column:
    """Path named by an entry's first line; NULL for text that is no entry."""
    return F.when(
        F.startswith(entry, F.lit("## ")),
        strip(F.substring(F.substring_index(entry, "\n", 1), F.lit(4), F.length(entry))),
    )


def closed_entry(entry: Column) -> Column:
    """Entry as it stands in a file: ended by a newline, then one empty line."""
    return F.concat(
        entry, F.when(F.endswith(entry, F.lit("\n")), F.lit("\n")).otherwise(F.lit("\n\n"))
    )


def digest_header(run_time: Column, total: Column) -> Column:
    return F.concat(
        F.lit("# Project Summary\n\nGenerated by gistmill on "),
        F.date_format(run_time, fv.STAMP_FORMAT),
        F.lit("\n\nTotal files processed: "), total.cast("string"),
        F.lit("\n\n---\n\n"),
    )
