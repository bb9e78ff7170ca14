"""Document fingerprints by spot signatures.

Common words of a language stand everywhere in running text and hardly in menus or lists.
Each such word (an anchor) starts a signature: itself and the chain of the next content
words, anchors between them left out; anchors in a row start one signature together.  The
fingerprint of a text is the set of its different signatures, the likeness of two texts the
Jaccard similarity of their sets.  A text without any anchor has a chain from each word, so
only a text without words has an empty set.

Everything is column expressions and joins.  The hashes of signatures are computed once, in
the scan; texts cross one shuffle.

Defined results: null and blank texts have the empty fingerprint, two empty sets are alike
(1) and an empty set is unlike any other (0); rows that repeat an id follow each other by
hash of their text; equal rows are one document for the order and each gets its row; a null
id comes first; the only document is followed by itself; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.operators.once import add_once
from gistmill.session import staged

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from he in is it of on or that the this to was were with "
    "auf aus das dem den der des die ein eine für im ist mit nicht sich sie und von zu "
    "au avec ce dans de du elle en est et il la le les ne par pas pour que qui sur un une "
    "al como con del el ella es la las lo los no para por se su sus una y"
).split()

#: Content words in a chain.
CHAIN = 2

#: Likeness from which ``near_pairs`` links.
LEAST = 0.8

_MARK = "\u0001"


def signatures(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the array of different signature hashes of ``text``, in ascending order."""
    plain = F.concat(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    # every anchor is tied to the word behind it
    anchors = "|".join(dict.fromkeys(ANCHORS))
    tied = F.trim(F.regexp_replace(plain, rf"(?<![^ ])({anchors}) ", f"$1{_MARK}"))
    marked = add_once(rows, _words=F.split(tied, " "))
    anchored = add_once(marked, _any=F.exists("_words", lambda word: word.contains(_MARK)))

    def content(at: Column) -> Column:
        return F.substring_index(F.coalesce(F.get("_words", at), F.lit("")), _MARK, -1)

    def chain(word: Column, at: Column) -> Column:
        starts = F.col("_any").eqNullSafe(F.lit(False)) | word.contains(_MARK)
        return F.when(starts & (word != ""), F.hash(word, *[content(at + step) for step in range(1, CHAIN)]))

    found = F.array_sort(F.array_distinct(F.array_compact(F.transform("_words", chain))))
    return anchored.withColumn(name, found).drop("_words", "_any")


def fingerprint_text(found: Column) -> Column:
    """Signatures as text: eight hexadecimal digits each, in order."""
    return F.array_join(F.transform(found, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity; 0 without counting where the sizes alone keep it below ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    exact = shared / (F.size(a) + F.size(b) - shared)
    return F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < large * least), F.lit(0.0)).otherwise(exact)


def neighbours(rows: DataFrame) -> DataFrame:
    """``_key, _before, _n_before``: for each different row the one before it, the last for the first.

    ``rows`` has ``_id, _hash, _key, _n``.  Rows are dealt by range of the order; only the last
    row of each range meets in one window.
    """
    files = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("_id").asc_nulls_first(), F.col("_hash")]
    thin = rows.select("_id", "_hash", "_key", "_n").dropDuplicates(["_key"])
    ranged = staged(thin.repartitionByRange(files, *order).withColumn("_part", F.spark_partition_id()), "spot-order")
    this = F.struct(F.col("_id"), F.col("_hash"), F.col("_key"), F.col("_n"))
    inside = Window.partitionBy("_part").orderBy(*order)
    across = Window.partitionBy(F.lit(0))
    ends = ranged.groupBy("_part").agg(F.max(this).alias("_last"))
    ends = ends.select(
        "_part", F.coalesce(F.lag("_last").over(across.orderBy("_part")), F.max("_last").over(across)).alias("_outside")
    )
    lagged = ranged.withColumn("_inside", F.lag(this).over(inside))
    return lagged.join(F.broadcast(ends), "_part").select(  # a row a range
        "_key", F.coalesce("_inside", "_outside").alias("_prior")
    ).select("_key", F.col("_prior._key").alias("_before"), F.col("_prior._n").alias("_n_before"))


def edited_fingerprints(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", share: int = 4) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text's are.

    The edited text has its last ``n div share`` code points replaced by as many from the
    beginning of the next document, in ascending order of id, the first following the last.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = documents.select(F.col(id_column).alias("_id"), text.alias("_text"))
    # the key is the row itself, nulls included
    rows = rows.select("*", F.xxhash64("_text").alias("_hash"), F.length("_text").alias("_n")).withColumn(
        "_key", F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("-")), F.lit(":"), F.hex("_hash"))
    )
    before = staged(neighbours(rows), "spot-neighbours")
    files = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = signatures(rows, F.col("_text"), "_found").select("_key", "_id", "_text", "_n", "_found").repartition(files, "_key")
    heads = found.join(before, "_key").groupBy("_before").agg(F.first(F.struct(
        F.substring(F.col("_text"), F.lit(1), F.floor(F.col("_n_before") / share).cast("int")).alias("head"), F.col("_found").alias("found"),
        F.col("_id").alias("id"), F.col("_n").alias("n"),
    )).alias("next"))
    joined = found.join(heads, F.col("_key") == F.col("_before"))
    cut = F.floor(F.col("_n") / share).cast("int")
    edited = add_once(joined, _edited=F.concat(F.substring(F.col("_text"), F.lit(1), F.col("_n") - cut), F.col("next.head")))
    both = signatures(edited, F.col("_edited"), "_found_edited")
    return both.select(
        F.col("_id").alias(id_column), F.col("_n").cast("bigint").alias("n_chars"), F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("_found")).alias("fingerprint"), fingerprint_text(F.col("_found_edited")).alias("edited_fingerprint"),
        likeness(F.col("_found"), F.col("_found_edited")).alias("near_edited"),
        likeness(F.col("_found"), F.col("next.found")).alias("near_next"),
        F.size("_found").cast("bigint").alias("n_signatures"), F.col("next.id").alias("next_doc_id"), F.col("next.n").cast("bigint").alias("next_n_chars"),
    )


def near_pairs(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Pairs of different fingerprints with a likeness of at least ``least``, and who has which.

    Returns ``a, b, likeness`` over fingerprints' hashes and ``id, fingerprint``: texts with the
    same fingerprint are one.  Sets are partitioned by length so that alike ones share a
    partition; within it they meet only in the rarest signatures, of which alike sets must
    share one, and only if their lengths allow it.
    """
    rows = documents.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    found = signatures(rows, F.col("_text"), "_found")
    members = staged(found.select(id_column, F.sha2(fingerprint_text(F.col("_found")), 256).alias("fingerprint"), "_found"), "spot-members")
    sets = staged(members.groupBy("fingerprint").agg(F.first("_found").alias("found")).where("size(found) > 0"), "spot-sets")
    each = sets.select("fingerprint", F.size("found").alias("n"), F.explode("found").alias("signature"))
    often = each.groupBy("signature").agg(F.count(F.lit(1)).alias("often"))
    rank = Window.partitionBy("fingerprint").orderBy("often", "signature")
    first = each.join(often, "signature").withColumn("at", F.row_number().over(rank)).where(
        F.col("at") <= F.col("n") - F.ceil(F.col("n") * least) + 1
    )
    group = F.floor(F.log(F.col("n")) / -math.log(least)).cast("int")
    posted = staged(first.select("signature", "fingerprint", "n", "at", group.alias("group")), "spot-posted")
    # alike sets are in the same group of lengths or in neighbouring ones
    own = posted.select("signature", "group", F.col("fingerprint").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    other = posted.select("signature", F.explode(F.array("group", F.col("group") + 1)).alias("group"), F.col("fingerprint").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    reach = F.ceil((F.col("n_a") + F.col("n_b")) * least / (1 + least) - 1e-9)
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + F.least("at_a", "at_b")
    longer = (F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("a") < F.col("b")))
    candidates = own.join(other, ["signature", "group"]).where(longer & (F.col("n_b") >= F.col("n_a") * least) & (left >= reach)).select("a", "b").distinct()
    a, b = sets.select(F.col("fingerprint").alias("a"), F.col("found").alias("x")), sets.select(F.col("fingerprint").alias("b"), F.col("found").alias("y"))
    pairs = candidates.join(a, "a").join(b, "b").select("a", "b", likeness(F.col("x"), F.col("y"), least).alias("likeness")).where(F.col("likeness") >= least)
    return pairs, members.select(id_column, "fingerprint")
