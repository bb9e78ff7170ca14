"""The test tables seen as corpora, deterministically.

Documents become files in directories that meet the ignore rules in known ways, with
contents that meet every branch of the text functions; a digest from an earlier run is
derived from the same table, and conversations serve as model responses.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill import fixed_values as fv
from gistmill.schemas import KEY
from gistmill.session import staged, staging_path
from gistmill.sources.stores import connect

RUN_TIME = datetime.datetime(2024, 9, 1, 12, 0, 0)

# Length of a part of a digest text, so that the small tables have several.
PART_BYTES = 1 << 14

DIRECTORIES = ["src", "node_modules", "src/node_modules", "docs/_build", "pkg.egg-info", ".git"]
EXTENSIONS = [".py", ".md", ".log", ".txt", ".tmp", ".js", ".rs", ".json"]

# Given schemas spare every query a look into the tables' footers.
_SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

_PATH = f"""concat(
  element_at(array({", ".join(f"'{d}'" for d in DIRECTORIES)}), cast(doc_id % 6 + 1 AS int)), '/', source, '/doc_', doc_id,
  element_at(array({", ".join(f"'{e}'" for e in EXTENSIONS)}), cast(doc_id div 6 % 8 + 1 AS int)))"""

# Text of a document with newline, header, heading and control-character variants.
_CONTENT = r"""encode(concat(
  if(doc_id % 13 = 0, concat('## File: ', relative_path, '\n\n  '), ''),
  CASE WHEN doc_id % 10 = 0 THEN replace(text, '. ', '.\r') WHEN doc_id % 5 = 0 THEN replace(text, '. ', '.\r\n') ELSE text END,
  if(doc_id % 11 = 0, concat('\n## Notes\n\nsee doc ', doc_id), ''),
  CASE WHEN doc_id % 7 <> 0 THEN '' WHEN doc_id div 7 % 3 = 0 THEN char(0)
       WHEN doc_id div 7 % 3 = 1 THEN repeat(char(1), cast(length(text) div 5 + 1 AS int)) ELSE char(2) END
), 'UTF-8')"""


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str, by_source: bool) -> DataFrame:
    """Documents with their key and content."""
    corpus = "concat(lang, '/', source)" if by_source else "lang"
    return (
        read_table(spark, folder, "documents")
        .selectExpr("doc_id", "text", "source", f"{corpus} AS corpus_id", f"inline(array(struct({_PATH} AS relative_path)))")
        # a plain column, so that queries on paths alone do not read the texts
        .selectExpr("doc_id", *KEY, f"{_CONTENT} AS content")
    )


def files(spark: SparkSession, folder: str, by_source: bool = False) -> DataFrame:
    """Documents as files; one corpus per language, or per language and source."""
    return _documents(spark, folder, by_source).selectExpr(
        *KEY,
        "concat('/corpora/', corpus_id, '/', relative_path) AS path",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id AS int), 0) AS modified_time",
        "content",
        "cast(octet_length(content) AS bigint) AS size",
        "sha2(content, 256) AS checksum",
    )


def write_stores(spark: SparkSession, folder: str) -> DataFrame:
    """Write the files as trees below the shared staging folder and return the corpora's roots, ``corpus_id, root``."""
    top = staging_path(spark, "trees")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = connect(top)
        corpora = set()
        for batch in batches:
            for corpus, path, content in zip(batch["corpus_id"], batch["relative_path"], batch["content"]):
                there = f"{base}/{corpus}/{path}"
                store.create_dir(there.rpartition("/")[0])
                with store.open_output_stream(there) as file:
                    file.write(content)
            corpora.update(batch["corpus_id"])
        yield pd.DataFrame({"corpus_id": sorted(corpora)}, dtype="object")

    written = files(spark, folder).select(*KEY, "content").mapInPandas(write, "corpus_id string")
    # evaluated once: whoever reads the names again must not write the files again
    return staged(written.distinct().select("corpus_id", F.concat(F.lit(f"{top}/"), "corpus_id").alias("root")), "roots")


def write_trees(spark: SparkSession, folder: str) -> dict[str, str]:
    """Write the files below the shared staging folder, which has to be a mount, and return the corpora's roots."""
    return {row.corpus_id: "/" + row.root.removeprefix("file:").lstrip("/") for row in write_stores(spark, folder).collect()}


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages as the files of one more corpus."""
    return read_table(spark, folder, "pages").selectExpr(
        "'pages' AS corpus_id",
        "concat('/corpora/pages/', url) AS path",
        "concat(regexp_replace(url, '^[a-z]+://', ''), '/page_', page_id, '.html') AS relative_path",
        "cast(octet_length(html) AS bigint) AS size",
        "timestamp_ntz'2024-03-01 00:00:00' AS modified_time",
        "encode(html, 'UTF-8') AS content",
    )


def state(spark: SparkSession, folder: str, by_source: bool = False) -> DataFrame:
    """The digest an earlier run left: absent, outdated, without checksum, or equal.

    Some entries are of files that are gone, some of a corpus that is.
    """
    documents = _documents(spark, folder, by_source)
    date = "timestamp_ntz'2023-06-01 00:00:00' + make_dt_interval(0, cast(doc_id % 5000 AS int), 0, 0) AS summary_date"
    other = "sha2(encode(concat('old ', doc_id), 'UTF-8'), 256)"
    summary = r"concat('Earlier summary of doc ', doc_id, if(doc_id % 11 = 0, '\n## Usage\nrun it', '')) AS content"
    known = documents.where("doc_id div 48 % 4 <> 0").selectExpr(
        *KEY, date,
        f"CASE doc_id div 48 % 4 WHEN 1 THEN {other} WHEN 3 THEN sha2(content, 256) END AS checksum",
        summary,
    )
    stale = documents.where("doc_id % 10 = 0").selectExpr(
        "corpus_id", "concat('gone/doc_', doc_id) AS relative_path", date, f"{other} AS checksum", summary
    )
    retired = documents.where("doc_id % 50 = 0").selectExpr(
        "'retired' AS corpus_id", "concat('old/doc_', doc_id) AS relative_path", date,
        f"{other} AS checksum", summary,
    )
    return known.unionByName(stale).unionByName(retired)


def rule_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of rule files: one per document, many of them alike, blank or comments."""
    line = r"""CASE doc_id % 5
      WHEN 0 THEN concat('  src/', source, '/* ') WHEN 1 THEN '# comment' WHEN 2 THEN ' \t'
      WHEN 3 THEN concat('doc_?', doc_id % 7, '.[jm]*') ELSE '\t*.rs ' END AS line"""
    return read_table(spark, folder, "documents").selectExpr("lang AS corpus_id", line)


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns as responses of a model: one file per conversation, one attempt per turn."""
    return read_table(spark, folder, "conversations").where("role = 'assistant'").selectExpr(
        "*", "(conv_id * 7 + turn * 3) % 11 AS kind", "concat('conv_', conv_id) AS relative_path"
    ).selectExpr(
        "concat('c', conv_id % 4) AS corpus_id",
        "relative_path",
        "cast((turn + 1) div 2 AS int) AS attempt",
        "CASE WHEN kind = 0 THEN 500 WHEN kind = 1 THEN 429 WHEN kind > 5 THEN 200 END AS status_code",
        "CASE kind WHEN 2 THEN 'timeout' WHEN 3 THEN 'connection' WHEN 4 THEN 'request' WHEN 5 THEN 'unexpected' END AS error_kind",
        r"""CASE WHEN kind = 0 THEN 'busy' WHEN kind = 1 THEN 'slow down' WHEN kind < 6 THEN 'no route'
          WHEN kind = 6 THEN '{"choices": []}' WHEN kind = 7 THEN '{"usage": 1}'
          WHEN kind = 8 AND conv_id % 4 = 0 THEN concat('<html>', text) WHEN kind = 8 AND conv_id % 4 = 1 THEN ''
          WHEN kind = 8 AND conv_id % 4 = 2 THEN '{"choices": [{"message": {"role": "assistant", "content": 5}}]}'
          ELSE to_json(named_struct('choices', array(named_struct('message', named_struct('role', 'assistant', 'content',
            concat(if(conv_id % 3 = 0, concat('## File: ', relative_path, '\n\n'), ' \n'), text, ' \n')))))) END AS body""",
    )


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns as result texts, some of them failures."""
    return read_table(spark, folder, "conversations").where("role = 'assistant'").select(
        F.expr("concat('c', conv_id % 4)").alias("corpus_id"),
        F.expr("concat('conv_', conv_id, '/', turn)").alias("relative_path"),
        F.when(F.expr("(conv_id + turn) % 4 = 0"), F.lit(f"Error: {fv.NO_CHOICES}"))
        .otherwise(F.col("text")).alias("summary"),
    )


class UnsteadyClient:
    """Answers with the file's name.  Some files fail at first, some always."""

    def __init__(self):
        self.calls: dict[str, int] = {}

    def __call__(self, request: str) -> tuple[int, str]:
        question = json.loads(request)["messages"][1]["content"]
        path = question.split("Path: ", 1)[1].split("\n", 1)[0]
        number = int(path.rsplit("doc_", 1)[1].split(".")[0])
        self.calls[path] = self.calls.get(path, 0) + 1
        if number % 4 == 1:
            return 503, "busy"
        if number % 4 == 2 and self.calls[path] < 3:
            raise TimeoutError("late")
        if number % 4 == 3 and self.calls[path] < 2:
            return 200, '{"choices": []}'
        return 200, json.dumps({"choices": [{"message": {"content": f" - **Role**: {path} \n"}}]})
