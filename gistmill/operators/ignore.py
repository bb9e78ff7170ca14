"""Ignore rules and the scan class of a file.

``kept``: to be processed.  ``ignored``: the file itself is hit.  ``pruned``: a directory
above it is hit, so a walk would not have come across it; such files count nowhere.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill import fixed_values as fv
from gistmill.functions.globs import compile_rules, glob_regex_column, has_literal_slash
from gistmill.functions.text import strip
from gistmill.operators.skew import join_by_corpus


def usable_rules(rule_lines: DataFrame) -> DataFrame:
    """``corpus_id, pattern`` from ``corpus_id, line``, without blank lines and comments."""
    return (
        rule_lines.select("corpus_id", strip(F.col("line")).alias("pattern"))
        .where((F.col("pattern") != "") & ~F.startswith("pattern", F.lit("#")))
        .distinct()
    )


def rule_table(
    rule_lines: DataFrame, corpora: DataFrame, defaults: Iterable[str] = fv.DEFAULT_IGNORE_RULES
) -> DataFrame:
    """Rules in force per corpus: the defaults and the usable lines of its own rule file.

    ``corpora`` has one row per corpus.
    """
    default = corpora.select(
        "corpus_id", F.explode(F.split(F.lit("\n".join(defaults)), "\n")).alias("pattern")
    )
    return default.union(usable_rules(rule_lines)).distinct()


def is_ignored(
    path: Column, rules: Iterable[str] = fv.DEFAULT_IGNORE_RULES, own_output: str = fv.DIGEST_FILE
) -> Column:
    """Whether the rules hit the path itself."""
    return path.rlike(compile_rules(tuple(rules), own_output).itself)


def is_below_ignored(
    path: Column, rules: Iterable[str] = fv.DEFAULT_IGNORE_RULES, own_output: str = fv.DIGEST_FILE
) -> Column:
    """Whether the rules hit a directory above the path."""
    return path.rlike(compile_rules(tuple(rules), own_output).ancestor)


def scan_class(
    path: Column, rules: Iterable[str] = fv.DEFAULT_IGNORE_RULES, own_output: str = fv.DIGEST_FILE
) -> Column:
    return _classify(is_below_ignored(path, rules, own_output), is_ignored(path, rules, own_output))


def _classify(below: Column, itself: Column) -> Column:
    return F.when(below, F.lit("pruned")).when(itself, F.lit("ignored")).otherwise(F.lit("kept"))


#: What the rules of a corpus come to: texts that paths are held against, and two expressions for the rest.
_LISTS = ["names", "tails", "equals", "trees"]


def _with_shapes(rules: DataFrame) -> DataFrame:
    """Sort rules of a column ``pattern`` by what they need: a rule that is plain text, or such text behind ``*``, needs no regex."""
    pattern = F.col("pattern")
    is_tree = F.endswith(pattern, F.lit("/*"))
    body = F.when(is_tree, F.expr("left(pattern, length(pattern) - 2)")).otherwise(pattern)
    is_plain, tail = ~F.rlike(body, F.lit(r"[*?\[]")), F.regexp_replace("pattern", r"\A\*+", "")
    is_tail = ~is_tree & F.startswith(pattern, F.lit("*")) & (tail != "") & ~F.rlike(tail, F.lit(r"[*?\[]"))
    is_name = ~is_tree & is_plain & ~F.contains(pattern, F.lit("/"))
    is_glob = ~is_plain & ~is_tail
    by_name = is_glob & ~is_tree & ~has_literal_slash(pattern)
    return rules.select(
        "corpus_id",
        F.when(is_name, pattern).alias("names"),
        F.when(is_tail, tail).alias("tails"),
        F.when(is_plain & ~is_name, body).alias("equals"),
        F.when(is_tree, F.concat(F.lit("/"), body, F.lit("/"))).alias("trees"),
        F.when(is_glob, glob_regex_column(body)).alias("whole"),
        F.when(by_name, glob_regex_column(pattern, within_name=True)).alias("name"),
    )


def rules_by_corpus(rules: DataFrame) -> DataFrame:
    """``corpus_id, pattern`` rows folded to one row ``corpus_id, own`` for each corpus.

    A corpus has as many rules as its rule file has lines; files never enter this group.
    """
    def joined(field: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(field)), "|").alias(field)

    folded = _with_shapes(rules).groupBy("corpus_id").agg(
        *[F.array_sort(F.collect_set(name)).alias(name) for name in _LISTS], joined("whole"), joined("name")
    )

    def expression(end: str) -> Column:
        parts = [F.when(F.col("whole") != "", F.concat(F.lit(r"\A(?:"), "whole", F.lit(f"){end}"))),
                 F.when(F.col("name") != "", F.concat(F.lit(r"(?:\A|/)(?:"), "name", F.lit(f"){end}")))]
        return F.when((F.col("whole") != "") | (F.col("name") != ""), F.concat(F.lit("(?s)"), F.concat_ws("|", *parts)))

    return folded.select("corpus_id", F.struct(
        *_LISTS, expression(r"\z").alias("itself_regex"), expression("/").alias("ancestor_regex")
    ).alias("own"))


def with_corpus_rules(files: DataFrame, own_rules: DataFrame) -> DataFrame:
    """Attach what a corpus's own rules come to as ``own`` (NULL where it has none).

    For rows without contents: beyond the size that the planner broadcasts they are shuffled,
    a corpus over many tasks.
    """
    return join_by_corpus(files, rules_by_corpus(own_rules), "left")


def own_rules_hit() -> Column:
    """Whether the rules in ``own`` hit the path itself."""
    path = F.col("relative_path")
    return F.coalesce(
        F.array_contains("own.names", F.substring_index(path, "/", -1))
        | F.exists("own.tails", lambda tail: F.endswith(path, tail))
        | F.array_contains("own.equals", path)
        | _below_tree()
        | F.coalesce(F.rlike(path, F.col("own.itself_regex")), F.lit(False)),
        F.lit(False),
    )


def own_rules_hit_above() -> Column:
    """Whether the rules in ``own`` hit a directory above the path."""
    path, rooted, slash = F.col("relative_path"), F.concat(F.lit("/"), F.col("relative_path")), F.lit("/")
    return F.coalesce(
        F.exists("own.names", lambda name: F.contains(rooted, F.concat(slash, name, slash)))
        | F.exists("own.tails", lambda tail: F.contains(path, F.concat(tail, slash)))
        | F.exists("own.equals", lambda whole: F.startswith(path, F.concat(whole, slash)))
        | _below_tree()
        | F.coalesce(F.rlike(path, F.col("own.ancestor_regex")), F.lit(False)),
        F.lit(False),
    )


def _below_tree() -> Column:
    rooted = F.concat(F.lit("/"), F.col("relative_path"))
    return F.exists("own.trees", lambda tree: F.startswith(rooted, tree))


def with_scan_class(
    files: DataFrame,
    own_rules: DataFrame | None = None,
    rules: Iterable[str] = fv.DEFAULT_IGNORE_RULES,
    own_output: str = fv.DIGEST_FILE,
) -> DataFrame:
    """Add ``scan_class`` under the shared rules and, if given, rules per corpus.

    The shared rules are constants of the plan, compiled once per task.  Rules per corpus are
    columns, nearly all of them plain texts; an expression is compiled again only where the
    corpus changes from one row to the next.  Files that could not be examined, which have no
    ``size``, count as ignored.
    """
    path = F.col("relative_path")
    below, itself = is_below_ignored(path, rules, own_output), is_ignored(path, rules, own_output)
    if "size" in files.columns:
        itself = itself | F.col("size").isNull()
    if own_rules is None:
        return files.withColumn("scan_class", _classify(below, itself))
    return (
        with_corpus_rules(files, own_rules)
        .withColumn("scan_class", _classify(below | own_rules_hit_above(), itself | own_rules_hit()))
        .drop("own")
    )


def kept(files: DataFrame) -> DataFrame:
    return files.where(F.col("scan_class") == "kept").drop("scan_class")
