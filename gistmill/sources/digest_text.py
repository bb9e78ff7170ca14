"""Digest texts: reading existing ones, writing new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gistmill.functions.text import normalise_newlines, strip
from gistmill.operators.once import add_once
from gistmill.schemas import KEY, STATE
from gistmill.sources.objects import path_exists
from gistmill.sources.owned_text import read_owned_texts

# ---- Fixed values: what an entry looks like in a digest text ----
_MARK = r"\n\nSummarized on (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(?: \(checksum: ([a-f0-9]{64}|unreadable)\))?\n\n"
_ENTRY = rf"(?s)## .+?{_MARK}.*?(?=\n## |\z)"
_BEFORE_DATE, _BEFORE_CHECKSUM = "\n\nSummarized on ", " (checksum: "
_FIELDS = rf"(?s)\A## (.+?){_MARK}(.*)\z"
# everything up to the end of the last entry
_LAST = rf"(?s)\A.*## .+?{_MARK}.*?(?=\n## |\z)"
# digest texts are read in pieces between these
_HEADING = "\n## "

#: Sections of a part that is read, as a power of two.
PIECE_BITS = 10


def read_digest_texts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Digest files ``{corpus_id: path}`` as ``corpus_id, part, document``, in parts that follow each other.

    Parts, but for the first, begin with the newline before a heading; joined in order they are
    the text, of whatever length, in which only a carriage return at the very end is left out.
    They have at most ``2 ** PIECE_BITS`` sections and come from one byte range, as long as
    ``spark.sql.files.maxPartitionBytes`` says.  A corpus whose file is not there, as before its
    first run, has no row.
    """
    there = {corpus: path for corpus, path in paths.items() if path_exists(spark, path)}
    # ranges stay together in one shuffle, so that their parts can be counted, but not in one row
    pieces = read_owned_texts(spark, there, _HEADING).repartition("corpus_id", "start")
    parts = pieces.groupBy("corpus_id", "start", F.shiftright("at", PIECE_BITS).alias("piece")).agg(
        F.expr("listagg(value, '\\n## ') within group (order by at)").alias("value")
    )
    # a section takes several bytes, so the parts of a range have numbers below the next one's start
    number = F.row_number().over(Window.partitionBy("corpus_id", "start").orderBy("piece"))
    parts = parts.select("corpus_id", (F.col("start") + number - 1).alias("part"), "value")
    # the separator may have taken the second half of a newline
    value = F.regexp_replace("value", r"\r\z", "")
    begun = F.when(F.col("part") > 0, F.concat(F.lit(_HEADING), value)).otherwise(value)
    return parts.select("corpus_id", "part", normalise_newlines(begun).alias("document"))


def import_digest(documents: DataFrame) -> DataFrame:
    """Entries of digest texts as stored rows.

    Content ends at the next second-level heading, even one inside copied text.  Entries
    with an impossible date are dropped; of entries with the same path the last one stays.

    ``documents`` may have a ``part``: then a text is in pieces that begin with entries, as
    ``digest_documents`` makes them, and the result is that of the whole text.
    """
    if "part" not in documents.columns:
        documents = documents.withColumn("part", F.lit(0))
    documents = _with_carried(documents)
    found = documents.select(
        "corpus_id", "part", F.posexplode(F.regexp_extract_all("document", F.lit(_ENTRY), F.lit(0)))
    )
    # one search an entry: what follows its path has fixed lengths up to the content
    entry = add_once(found, relative_path=F.regexp_extract("col", _FIELDS, 1))
    after = F.substr("col", F.length("relative_path") + 4)
    date, tail = F.substr(after, F.lit(len(_BEFORE_DATE) + 1), F.lit(19)), F.substr(after, F.lit(len(_BEFORE_DATE) + 20))
    has = F.startswith(tail, F.lit(_BEFORE_CHECKSUM))
    checksum = F.when(has, F.substring_index(F.substr(tail, F.lit(len(_BEFORE_CHECKSUM) + 1)), ")", 1))
    start = F.when(has, F.length(checksum) + len(_BEFORE_CHECKSUM) + 1).otherwise(0) + 3
    fields = entry.select(
        "corpus_id", "part", "pos", "relative_path",
        F.when(~F.startswith(date, F.lit("0000")), date).try_cast("timestamp_ntz").alias("summary_date"),
        checksum.alias("checksum"), strip(F.substr(tail, start)).alias("content"),
    ).where(F.col("summary_date").isNotNull())
    last = fields.groupBy(*KEY).agg(
        F.max_by(F.struct("summary_date", "checksum", "content"), F.struct("part", "pos")).alias("entry")
    )
    return last.select(*KEY, "entry.*").select(*STATE.fieldNames())


def _with_carried(documents: DataFrame) -> DataFrame:
    """Put before each piece what the pieces before it leave open.

    Sections behind a piece's last entry belong, in the whole text, to the path of the next
    entry, wherever that is.  Only these rests meet in a window, never the pieces.
    """
    marked = F.rlike("document", F.lit(_LAST))
    rest = F.when(marked, F.regexp_replace("document", _LAST, "")).otherwise(F.col("document"))
    rests = documents.select("corpus_id", "part", marked.alias("marked"), rest.alias("rest"))
    before = Window.partitionBy("corpus_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = rests.withColumn("group", F.coalesce(F.count_if("marked").over(before), F.lit(0)))
    within = Window.partitionBy("corpus_id", "group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.concat(
        F.coalesce(F.last(F.when(F.col("marked"), F.col("rest")), ignorenulls=True).over(before), F.lit("")),
        F.array_join(F.collect_list("rest").over(within), ""),
    )
    carried = counted.select("corpus_id", "part", carried.alias("carried")).where("carried <> ''")
    return documents.join(carried, ["corpus_id", "part"], "left").withColumn(
        "document", F.concat(F.coalesce("carried", F.lit("")), "document")
    )


def write_digest_texts(lines: DataFrame, path: str) -> None:
    """Write digest texts below ``path``, one folder ``corpus_id=…`` per corpus.

    Rows are dealt out by ranges of corpus and path, whatever the size of a corpus.  The
    files of a folder, one unless the corpus is large, make up its text in name order.
    """
    (
        lines.repartitionByRange("corpus_id", "relative_path")
        .sortWithinPartitions("corpus_id", "relative_path")
        # every piece ends in a newline, and so does every row of a text file
        .select("corpus_id", F.regexp_replace("value", r"\n\z", "").alias("value"))
        .write.partitionBy("corpus_id").mode("errorifexists").text(path)
    )
