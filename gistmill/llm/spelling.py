"""Spelling variants: words within one edit, joined on asymmetric chunks.

Two words that differ by one inserted, deleted or replaced letter (code point) share one of two
disjoint chunks of the shorter word: the half before the edit stays in its place, the half
behind it moves by the difference in length.  So the shorter word (or, of words of equal length,
either) contributes its first and its last half, the other one its positional grams of that
length, and they are joined on gram and place within a shift of one.  An edit between words of
equal length shifts nothing, and an insertion shifts only what lies behind it, so grams at other
places meet no chunk and are not sent.  What meets is verified by edit distance inside the join,
so only true pairs leave it.

A chunk that more than ``HOT`` words share is not joined as it is: the rests of its words are
again within one edit, so they are chunked in turn and the key grows by half of the rest, until
lists are short or a single letter is left.

Words are counted in tasks before the shuffle.  Forms have at least twice their word's count,
so chains are short, and roots are found by doubling the steps.

Defined results: null and empty texts have no words; a null id reads as an empty one in the
hash; repeated rows count again; ties between forms go to the smaller in code-point order; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.session import staged

#: Letters of a word, and how many a word needs.
LETTERS, LEAST_LENGTH, LEAST_COUNT = r"[A-Za-zÀ-ÿ]+", 5, 3

#: Words that may share a chunk before the chunk is extended.
HOT = 256

#: A word is a form if it occurs this many times as often.
TIMES = 2


def lettered_runs(text: Column) -> Column:
    """All maximal runs of letters of a text, A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(f"({LETTERS})"), F.lit(0))


def with_slips(run: Column, ident: Column, one_in: int = 97) -> Column:
    """The run, less one letter where the hash of id and run is divisible by ``one_in``."""
    h = F.crc32(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


def word_counts(words: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of a column ``word``: those long and frequent enough."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def _piece(rest: Column, at: Column, size: Column) -> Column:
    return rest.substr(at + 1, size)


def _without(rest: Column, at: Column, size: Column) -> Column:
    return F.concat(rest.substr(F.lit(1), at), rest.substr(at + size + 1, F.length(rest)))


def _sent(words: DataFrame, as_chunks: bool) -> DataFrame:
    """Keys of the rests of words; both sides name length and place as in the shorter rest."""
    rest, sent = F.col("rest"), []
    for longer in [0] if as_chunks else [0, 1]:
        length = F.length(rest) - longer
        size = F.floor(length / 2).cast("int")
        for shift, place in ((0, F.lit(0)), (longer, length - size)):
            sent.append(F.struct(
                F.concat_ws(" ", "key", length.cast("string"), place.cast("string"), _piece(rest, place + shift, size)).alias("key"),
                _without(rest, place + shift, size).alias("rest"),
            ))
    return words.select("word", "n", F.explode(F.array(*sent)).alias("_s")).select("word", "n", "_s.key", "_s.rest")


def near_words(counted: DataFrame, hot: int = HOT) -> DataFrame:
    """``word, n, near, near_n``: every pair of words at edit distance one, once (shorter or smaller word first)."""
    start = counted.select("word", "n", F.lit("").alias("key"), F.col("word").alias("rest"))
    chunks, grams, found, level = _sent(start, True), _sent(start, False), [], 0
    while True:
        chunks, grams = (staged(side, f"spelling-{level}") for side in (chunks, grams))
        full = staged(chunks.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.length("rest")).alias("left")).where(
            (F.col("size") > hot) & (F.col("left") > 1)
        ).select("key"), f"spelling-hot-{level}")
        c = chunks.join(full, "key", "left_anti").select("key", "word", "n")
        g = grams.join(full, "key", "left_anti").select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
        order = (F.length("word") < F.length("near")) | (F.col("word") < F.col("near"))
        found.append(staged(
            c.join(g, (c.key == g.key) & order & (F.levenshtein("word", "near", 1) == 1)).select("word", "n", "near", "near_n").distinct(),
            f"spelling-pairs-{level}",
        ))
        if full.isEmpty():
            break
        chunks, grams = (_sent(side.join(full, "key"), as_chunks) for side, as_chunks in ((chunks, True), (grams, False)))
        level += 1
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct() if len(found) > 1 else pairs


def spelling_forms(counted: DataFrame, hot: int = HOT, times: int = TIMES) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of the words of ``word_counts``."""
    counted = staged(counted.select("word", "n"), "spelling-words")
    pairs = near_words(counted, hot)
    both = pairs.unionByName(pairs.select(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")
    ))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    enough = -F.col("best.less") >= times * F.col("n")
    formed = staged(counted.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    ), "spelling-forms")
    roots = _roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(steps: DataFrame) -> DataFrame:
    """``word, root`` of words that have a form; every round doubles the steps taken."""
    ahead = staged(steps.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        beyond = ahead.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = staged(ahead.join(beyond, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")
        ), "spelling-roots")
        ahead = after.select("word", "root")
        if after.where("moved").isEmpty():
            return ahead


def spelling_variants(
    documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", one_in: int = 97, hot: int = HOT,
) -> DataFrame:
    """Forms and roots of the words of whole texts, after the slips of ``with_slips``."""
    runs = documents.select(F.col(id_column).alias("_id"), F.explode(lettered_runs(F.col(text_column))).alias("_run"))
    return spelling_forms(word_counts(runs.select(with_slips(F.col("_run"), F.col("_id"), one_in).alias("word"))), hot)
