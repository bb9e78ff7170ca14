"""Merging digests and laying them out as text."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.functions import entries as en
from gistmill.operators.cuts import part_cuts, with_part
from gistmill.schemas import ENTRY, KEY

#: Length of a part of a digest text.
PART_BYTES = 64 << 20


def stamp(run_time: datetime.datetime) -> Column:
    """Run time as a literal without zone, in whole seconds as digests keep it."""
    return F.lit(run_time.replace(microsecond=0).isoformat(sep=" ")).cast("timestamp_ntz")


def _entry(alias: str) -> Column:
    return F.struct(*ENTRY.fieldNames()).alias(alias)


def _flat(merged: DataFrame) -> DataFrame:
    return merged.where(F.col("entry").isNotNull()).select(*KEY, "entry.*")


def merge_current(current: DataFrame, fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """Digest for the current files: the fresh entry, else the previous one, else none.

    An entry is taken whole, so a failed refresh keeps the old checksum and is due again
    next time.  Entries whose file is gone are dropped.  All three sides shuffle once, on
    the same key.
    """
    return _flat(
        current.select(*KEY)
        .join(fresh.select(*KEY, _entry("fresh")), KEY, "left")
        .join(previous.select(*KEY, _entry("previous")), KEY, "left")
        .select(*KEY, F.coalesce("fresh", "previous").alias("entry"))
    )


def merge_all(fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """Digest for callers without a file list: every entry, the fresh one where there are two."""
    return _flat(
        fresh.select(*KEY, _entry("fresh"))
        .join(previous.select(*KEY, _entry("previous")), KEY, "full")
        .select(*KEY, F.coalesce("fresh", "previous").alias("entry"))
    )


def rendered(digest: DataFrame) -> DataFrame:
    """``corpus_id, relative_path, entry`` with each entry as text."""
    return digest.select(
        *KEY,
        en.entry_text(*[F.col(c) for c in ("relative_path", "summary_date", "checksum", "content")])
        .alias("entry"),
    )


def digest_lines(digest: DataFrame, totals: DataFrame, run_time: datetime.datetime) -> DataFrame:
    """Pieces of the digest texts: ``corpus_id, relative_path, value``.

    Each corpus has its header, under the empty path, and one piece per entry; joined in
    path order they are its document.  ``totals`` has ``corpus_id, total``, the number of
    current files, which may exceed the number of entries.
    """
    headers = totals.select(
        "corpus_id", F.lit("").alias("relative_path"),
        en.digest_header(stamp(run_time), F.col("total")).alias("value"),
    )
    bodies = rendered(digest).select(*KEY, en.closed_entry(F.col("entry")).alias("value"))
    return headers.unionByName(bodies)


def digest_documents(lines: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Digest texts as ``corpus_id, part, document``: the parts of a corpus in order are its text.

    A part takes the entries that begin in its ``part_bytes`` bytes of the text, so none is twice
    as long unless a single entry is longer.  Every text crosses the shuffle to its part once;
    the cuts are found from paths and lengths.
    """
    weighed = lines.select(*KEY, F.octet_length("value").cast("long").alias("weight"))
    return with_part(lines, part_cuts(weighed, part_bytes)).groupBy("corpus_id", "part").agg(
        F.expr("listagg(value, '') within group (order by relative_path)").alias("document")
    )
