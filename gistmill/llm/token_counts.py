"""Token counts of whole texts, huge ones by overlapping chunks.

A text of up to ``chunk`` code points is encoded as it is.  Longer ones are cut into chunks
that overlap their right neighbour, every chunk is a row of its own, and the library gives
ids with offsets.  Neighbours are spliced where both begin a pre-token at the same place:
pre-tokens are found from left to right and look only forward, so two scans that agree on
one beginning agree on all that follows.  The left chunk's own end misleads only what lies
within a few code points of it, and those are not used (``_margin``).  Where the overlap has
no such place, e.g. in a very long run of letters, the text is taken up again with chunk and
overlap eight times as long, up to the whole text as one chunk.

Defined results: null text counts as empty (0 tokens); repeated rows and ids give a row
each; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import chunked, small_batches
from gistmill.llm.encoding import encoder
from gistmill.session import staged

CHUNK, OVERLAP, WIDER = 65_536, 512, 8

#: Code points that a pre-token's end may look ahead, besides the longest special string.
LOOK_AHEAD = 3


def count_column(path: str, text: Column) -> Column:
    """Tokens of a text in one piece."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode, counts = encoder(path).encode, []
        for held in chunked(texts, 64):
            counts.extend(len(ids) // 4 for ids in encode(held))
        return pd.Series(counts, dtype="int64")

    return count(text)


def token_counts(
    documents: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text",
    limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every row."""
    small_batches(documents.sparkSession)
    rows = documents.select(
        F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("_text")
    ).withColumn("_huge", F.length("_text") > chunk)
    n_bytes = F.octet_length("_text").cast("bigint").alias("n_bytes")
    over = (F.col("n_tokens") > limit).alias("over_limit")
    short = rows.where(~F.col("_huge")).select(id_column, n_bytes, count_column(path, F.col("_text")).alias("n_tokens"))
    huge = rows.where("_huge").withColumn("_digest", F.sha2("_text", 256))
    counts = huge_counts(huge.select("_digest", "_text"), path, chunk, overlap)
    long = huge.select(id_column, n_bytes, "_digest").join(counts, "_digest").select(id_column, "n_bytes", "n_tokens")
    return short.unionByName(long).select("*", over)


def huge_counts(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """``_digest, n_tokens`` of every different text; the loop ends with texts in one chunk."""
    longest = None
    texts, done = texts.dropDuplicates(["_digest"]), None
    while True:
        pieces = staged(encoded_chunks(texts, path, chunk, overlap), "token-chunks")
        spliced = staged(splice(pieces), "token-splices")
        good = spliced.where("n_tokens IS NOT NULL")
        done = good if done is None else done.unionByName(good)
        if longest is None:
            longest = texts.agg(F.max(F.length("_text"))).first()[0] or 0
        if chunk >= longest or spliced.where("n_tokens IS NULL").isEmpty():
            return done
        left = spliced.where("n_tokens IS NULL").select("_digest")
        texts = texts.join(left, "_digest", "left_semi")
        chunk, overlap = chunk * WIDER, overlap * WIDER


def encoded_chunks(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """A row for each chunk: tokens, and where pre-tokens begin in the overlaps on both sides.

    ``left`` and ``right`` hold the places (code points of the text) and the number of the
    chunk's tokens before them.
    """
    places = "array<struct<place:bigint,before:bigint>>"
    starts = F.sequence(F.lit(0), F.greatest(F.length("_text") - 1, F.lit(0)), F.lit(chunk))
    cut = texts.select("_digest", "_text", F.size(starts).alias("n_chunks"), F.posexplode(starts).alias("chunk", "start")).select(
        "_digest", "n_chunks", "chunk", "start", F.substring(F.col("_text"), F.col("start") + 1, F.lit(chunk + overlap)).alias("piece")
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = encoder(path)
        margin = max([0, *map(len, known.special)]) + LOOK_AHEAD
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                one = known.library.encode(row.piece, add_special_tokens=False)
                begins = pre_token_starts(one)
                right = [
                    {"place": row.start + p, "before": n} for p, n in begins
                    if chunk <= p <= len(row.piece) - margin
                ] if row.chunk + 1 < row.n_chunks else []
                left = [{"place": row.start + p, "before": n} for p, n in begins if p < overlap] if row.chunk else []
                out.append((row._0, row.n_chunks, row.chunk, len(one.ids), left, right))
            yield pd.DataFrame(out, columns=["_digest", "n_chunks", "chunk", "n", "left", "right"])

    return cut.repartition("_digest", "chunk").mapInPandas(
        encode, f"_digest string, n_chunks int, chunk int, n bigint, left {places}, right {places}"
    )


def pre_token_starts(one) -> list[tuple[int, int]]:
    """Places where a pre-token begins, and the tokens before each.

    Tokens of one pre-token share a word number.  Only the first token after a change counts,
    and only if it begins where the one before has ended, so that no place is inside a
    character or a special string.
    """
    begins, words, offsets = [], one.word_ids, one.offsets
    for i in range(len(offsets)):
        if i == 0 or words[i] != words[i - 1] or words[i] is None:
            if i and offsets[i][0] != offsets[i - 1][1]:
                continue
            begins.append((offsets[i][0], i))
    return begins


def splice(pieces: DataFrame) -> DataFrame:
    """Tokens of each text from its chunks; null if two neighbours share no place."""
    right = pieces.select("_digest", (F.col("chunk") + 1).alias("chunk"), F.explode("right").alias("r"))
    left = pieces.select("_digest", "chunk", F.explode("left").alias("l"))
    first = (
        right.join(left, ["_digest", "chunk"]).where("r.place = l.place")
        .groupBy("_digest", "chunk").agg(F.min(F.struct("r.place", "r.before", F.col("l.before").alias("skip"))).alias("s"))
    )
    sums = pieces.groupBy("_digest").agg(F.sum("n").alias("_all"), F.max("n_chunks").alias("_chunks"))
    # a chunk that is followed keeps its tokens before the splice; one that follows, those after
    whole = pieces.select("_digest", "chunk", "n")
    cuts = first.join(whole.select("_digest", (F.col("chunk") + 1).alias("chunk"), "n"), ["_digest", "chunk"]).groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_found"), F.sum(F.col("n") - F.col("s.before") + F.col("s.skip")).alias("_twice")
    )
    found = F.coalesce(F.col("_found"), F.lit(0)) == F.col("_chunks") - 1
    return sums.join(cuts, "_digest", "left").select(
        "_digest", F.when(found, F.col("_all") - F.coalesce(F.col("_twice"), F.lit(0))).alias("n_tokens")
    )
