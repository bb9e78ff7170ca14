"""What a file's content deserves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.functions import text as tx
from gistmill.operators.once import add_once
from gistmill.options import DigestMode, DigestOptions

SKIP, OVERSIZE, RAW, SUMMARISE = "skip", "oversize", "raw", "summarise"


def below_threshold(text: Column, token_threshold: int) -> Column:
    """Whether the token estimate is below the threshold.

    A quarter of the characters alone already settles it for longer texts, whose words
    are then not counted.
    """
    return F.when(F.floor(F.length(text) / 4) >= token_threshold, F.lit(False)).otherwise(
        tx.token_estimate(text) < token_threshold
    )


def route(options: DigestOptions) -> Column:
    """Route over the columns ``text`` and ``size``.

    Unreadable and binary files come first: an oversized binary gets no entry either.
    """
    text = F.col("text")
    chain = F.when(text.isNull() | tx.is_binary(text), F.lit(SKIP)).when(
        tx.exceeds_limit(F.col("size"), options.max_file_size_mb), F.lit(OVERSIZE)
    )
    if options.mode is DigestMode.COPY:
        return chain.otherwise(F.lit(RAW))
    return chain.when(
        below_threshold(text, options.token_threshold), F.lit(RAW)
    ).otherwise(F.lit(SUMMARISE))


def with_text(files: DataFrame) -> DataFrame:
    """Replace ``content`` by ``text``, as a file reads when opened as text."""
    return add_once(files, text=tx.read_text(F.col("content"))).drop("content")


def with_route(files: DataFrame, options: DigestOptions) -> DataFrame:
    """Replace ``content`` by ``route`` and ``payload``.

    ``payload`` is the entry content already known here: the text of raw copies, the
    message of oversized files.  It is NULL for skipped files and for those to be
    summarised, so that joins further on do not carry their contents.
    """
    routed = add_once(with_text(files), route=route(options))
    payload = (
        F.when(F.col("route") == RAW, F.col("text"))
        .when(F.col("route") == OVERSIZE,
              tx.oversize_message(F.col("size"), options.max_file_size_mb))
    )
    return routed.withColumn("payload", payload).drop("text")
