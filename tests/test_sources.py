"""File trees, object listings, rule files, state versions, digest texts."""

import datetime
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from gistmill.operators import digest as dg
from gistmill.operators import ignore
from gistmill.schemas import STATE
from gistmill.sources import digest_text, objects, tables, tree as trees

NOW = datetime.datetime(2024, 5, 1, 8, 30, 0)


def listed(frame):
    return {r.relative_path for r in frame.collect()}


def test_listing_sees_every_file(spark, tree):
    (tree / "empty.txt").write_text("")
    (tree / "__init__.py").write_text("")
    (tree / ".gitignore").write_text("x")
    (tree / "src" / "_deep" / "er").mkdir(parents=True)
    (tree / "src" / "_deep" / "er" / "q q+1%20.py").write_text("x = 1")
    (tree / "node_modules").mkdir()
    (tree / "node_modules" / "m.js").write_text("no")
    os.symlink("nowhere", tree / "dangling")
    os.symlink(tree / "src", tree / "link")
    for share in (1, 2, 2000):
        rows = trees.list_corpora(spark, {"p": str(tree)}, directories_per_task=share)
        assert listed(rows) == {
            "small.py", "large.py", "binary_file.bin", "README.md", "config.json", "empty.txt",
            "__init__.py", ".gitignore", "src/_deep/er/q q+1%20.py", "dangling",
        }
    classes = {r.relative_path: r.scan_class for r in ignore.with_scan_class(rows).collect()}
    assert classes["dangling"] == "ignored" and classes["small.py"] == "kept"
    files = {r.relative_path: r for r in trees.read_contents(rows).collect()}
    for name in ("small.py", "binary_file.bin", "empty.txt", "src/_deep/er/q q+1%20.py"):
        content = (tree / name).read_bytes()
        assert files[name].content == content and files[name].size == len(content)
        assert files[name].checksum == hashlib.sha256(content).hexdigest()
        modified = datetime.datetime.fromtimestamp(os.stat(tree / name).st_mtime)
        assert abs(files[name].modified_time - modified) < datetime.timedelta(seconds=1)
    assert files["dangling"].content is None and files["dangling"].checksum == "unreadable"


def test_listing_many_files_and_corpora(spark, tmp_path):
    for corpus in ("a", "b"):
        for i in range(30):
            folder = tmp_path / corpus / f"d{i % 7}" / f"e{i % 3}"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"f{i}.py").write_text(f"# {i}")
    for share in (3, 2000):
        rows = trees.list_corpora(spark, {c: str(tmp_path / c) for c in "ab"}, directories_per_task=share)
        counts = {r.corpus_id: r["count"] for r in rows.groupBy("corpus_id").count().collect()}
        assert counts == {"a": 30, "b": 30} and rows.select("path").distinct().count() == 60


def test_file_too_large_for_a_row(spark, tree):
    (tree / "large.bin").write_bytes(b"\0" * 200)
    listing = trees.list_corpora(spark, {"p": str(tree)})
    got = {r.relative_path: r for r in trees.read_contents(listing, row_bytes=100).collect()}
    assert got["large.py"].content == b"" and got["large.bin"].content is None
    assert got["large.py"].checksum == hashlib.sha256((tree / "large.py").read_bytes()).hexdigest()
    assert got["small.py"].content == b'print("hello")'


def test_listing_errors_and_empty_tree(spark, tmp_path, tree):
    with pytest.raises(ValueError):
        trees.list_corpora(spark, {"p": "/path/to/nothing"})
    with pytest.raises(ValueError):
        trees.list_corpora(spark, {"p": str(tree / "small.py")})
    (tmp_path / "void").mkdir()
    assert trees.list_corpora(spark, {"p": str(tmp_path / "void")}).count() == 0


def test_rule_files(spark, tree, tmp_path):
    (tree / ".gistmillignore").write_text("# rules\n\n  *.json \r\nbuild/\ncustom/*\n")
    (tree / "custom").mkdir()
    (tree / "custom" / "x.py").write_text("x")
    bare = tmp_path / "bare"
    bare.mkdir()
    roots = {"p": str(tree), "bare": str(bare)}
    lines = trees.rule_lines(spark, roots)
    own = ignore.usable_rules(lines)
    assert {(r.corpus_id, r.pattern) for r in own.collect()} == {("p", "*.json"), ("p", "build/"), ("p", "custom/*")}
    assert trees.rule_file_lines(str(tree)) == ["*.json", "build/", "custom/*"]
    assert trees.rule_lines(spark, {"bare": str(bare)}).count() == 0
    rows = ignore.with_scan_class(trees.list_corpora(spark, roots), own)
    classes = {r.relative_path: r.scan_class for r in rows.collect()}
    assert classes["config.json"] == "ignored" and "custom/x.py" not in classes
    assert classes[".gistmillignore"] == "kept"


def test_object_listing(spark, tree):
    (tree / "sub dir").mkdir()
    (tree / "sub dir" / "q q+1%20.py").write_text("x = 1")
    (tree / "_hidden.py").write_text("x")
    rows = objects.read_objects(spark, str(tree), "p")
    assert listed(rows) == {"small.py", "large.py", "binary_file.bin", "README.md", "config.json", "sub dir/q q+1%20.py"}
    for row in rows.collect():
        content = (tree / row.relative_path).read_bytes()
        assert row.checksum == hashlib.sha256(content).hexdigest() and row.size == len(content)
    children = objects.read_objects(spark, str(tree.parent))
    assert {r.corpus_id for r in children.collect()} == {"project"}
    assert "sub dir/q q+1%20.py" in listed(children)
    slim = children.where(F.col("size") > 10).select("relative_path", "size")
    plan = slim._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1] and "GreaterThan(length,10)" in plan


def entry(corpus, path, content, checksum="a" * 64, date=NOW):
    return corpus, path, date, checksum, content


def test_state_versions(spark, tmp_path):
    store = tables.StateStore(spark, str(tmp_path / "state"))
    assert store.read().count() == 0 and store.versions() == []
    first = spark.createDataFrame([entry("c", "a", "one")], STATE)
    assert store.write(first) == 1
    # the plan reads version 1 while version 2 is written
    assert store.write(store.read().withColumn("content", F.upper("content"))) == 2
    assert [r.content for r in store.read().collect()] == ["ONE"]
    assert [r.content for r in store.read(1).collect()] == ["one"]
    # a run that was lost halfway is not seen, and its number is not used again
    (tmp_path / "state" / "rows" / "version=3").mkdir()
    assert store.versions() == [1, 2]
    assert store.write(first) == 4


def test_digest_text_round_trip(spark, tmp_path):
    stored = spark.createDataFrame([
        entry("c", "b.py", "beta\n"), entry("c", "a b.py", "alpha", None), entry("d/x", "z.md", "zeta\n\nmore", "unreadable"),
    ], STATE)
    totals = spark.createDataFrame([("c", 5), ("d/x", 1)], "corpus_id string, total bigint")
    lines = dg.digest_lines(stored, totals, NOW)
    digest_text.write_digest_texts(lines, str(tmp_path / "out"))
    folders = sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("corpus_id="))
    texts = []
    for folder in folders:
        parts = sorted(p for p in os.listdir(tmp_path / "out" / folder) if p.endswith(".txt"))
        texts.append("".join((tmp_path / "out" / folder / p).read_text() for p in parts))
    assert texts[0] == (
        "# Project Summary\n\nGenerated by gistmill on 2024-05-01 08:30:00\n\nTotal files processed: 5\n\n---\n\n"
        "## a b.py\n\nSummarized on 2024-05-01 08:30:00\n\nalpha\n\n"
        f"## b.py\n\nSummarized on 2024-05-01 08:30:00 (checksum: {'a' * 64})\n\nbeta\n\n"
    )
    for i, name in enumerate(("c.md", "d.md")):
        (tmp_path / name).write_text(texts[i])
    documents = digest_text.read_digest_texts(spark, {"c": str(tmp_path / "c.md"), "d/x": str(tmp_path / "d.md")})
    got = {(r.corpus_id, r.relative_path): (r.summary_date, r.checksum, r.content) for r in digest_text.import_digest(documents).collect()}
    assert got == {
        ("c", "a b.py"): (NOW, None, "alpha"),
        ("c", "b.py"): (NOW, "a" * 64, "beta"),
        ("d/x", "z.md"): (NOW, "unreadable", "zeta\n\nmore"),
    }


def test_documents_of_small_and_large_corpora(spark):
    stored = spark.createDataFrame([entry("big", f"f{i:03d}", "x" * 100) for i in range(50)] + [entry("small", "a", "y")], STATE)
    totals = stored.groupBy("corpus_id").agg(F.count("*").alias("total"))
    lines = dg.digest_lines(stored, totals, NOW)
    whole = {r.corpus_id: r.document for r in dg.digest_documents(lines).collect()}
    for part_bytes in (1, 500, 2000):
        pieces = dg.digest_documents(lines, part_bytes).orderBy("corpus_id", "part").collect()
        assert 2 < len([p for p in pieces if p.corpus_id == "big"]) <= 51
        for corpus in ("big", "small"):
            assert "".join(p.document for p in pieces if p.corpus_id == corpus) == whole[corpus]


def test_import_of_pieces_is_that_of_the_whole(spark):
    contents = ["plain", "a\n## Heading\nb", "x\n## One\n\n## Two\nc", "", "z\n## Summarized on nothing"]
    stored = spark.createDataFrame([entry("c", f"f{i:02d}", contents[i * 7 % 5]) for i in range(30)], STATE)
    lines = dg.digest_lines(stored, stored.groupBy("corpus_id").agg(F.count("*").alias("total")), NOW)

    def imported(part_bytes):
        return sorted(map(repr, digest_text.import_digest(dg.digest_documents(lines, part_bytes)).collect()))

    whole = imported(dg.PART_BYTES)
    assert any("##" in row for row in whole)
    for part_bytes in (1, 300, 1000):
        assert imported(part_bytes) == whole


def test_absent_digests_give_no_rows(spark, tmp_path):
    (tmp_path / "c.md").write_text(f"## a\n\nSummarized on 2024-05-01 08:30:00\n\ntext\n")
    paths = {"c": str(tmp_path / "c.md"), "d": str(tmp_path / "none.md")}
    assert [r.corpus_id for r in digest_text.import_digest(digest_text.read_digest_texts(spark, paths)).collect()] == ["c"]
    assert digest_text.import_digest(digest_text.read_digest_texts(spark, {"d": str(tmp_path / "none.md")})).count() == 0


def test_import_keeps_the_known_cut_at_headings(spark):
    mark = "\n\nSummarized on {} (checksum: " + "b" * 64 + ")\n\n"
    text = (
        "# Project Summary\n\n---\n\n"
        "## one.md" + mark.format("2024-01-01 10:00:00") + "intro\n\n## Heading\n\nrest\n\n"
        "## two.py" + mark.format("2024-01-01 11:00:00") + "  two  \n\n"
        "## bad.py" + mark.format("2024-02-30 11:00:00") + "never\n\n"
        "## two.py" + mark.format("2024-01-01 12:00:00") + "again\n\n"
        "## short.py\n\nSummarized on 2024-01-01 10:00:00 (checksum: abc123)\n\nlost\n"
    )
    rows = digest_text.import_digest(spark.createDataFrame([("c", text)], "corpus_id string, document string")).collect()
    got = {r.relative_path: r.content for r in rows}
    assert got == {"one.md": "intro", "Heading\n\nrest\n\n## two.py": "two", "two.py": "again"}


def test_import_agrees_with_python_regex(spark):
    import random
    import re

    pattern = re.compile(
        r"## (.+?)\n\nSummarized on (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(?: \(checksum: ([a-f0-9]{64}|unreadable)\))?\n\n(.*?)(?=\n## |\Z)",
        re.DOTALL,
    )
    rng = random.Random(4)
    bits = ["## ", "\n## ", "a.py", "\n\n", "\n", "Summarized on 2024-01-01 10:00:00", " (checksum: unreadable)",
            "Summarized on 2024-13-01 10:00:00", "Summarized on 0000-01-01 10:00:00", "text", "# "]
    texts = []
    for _ in range(300):
        parts = [rng.choice(bits) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(parts))
            parts[at:at] = ["## ", rng.choice(["p", "q q"]), "\n\n", rng.choice(bits[5:9]), "\n\n"]
        texts.append("".join(parts))
    expected = set()
    for i, text in enumerate(texts):
        found = {}
        for path, date, checksum, content in pattern.findall(text):
            try:
                found[path] = (datetime.datetime.strptime(date, "%Y-%m-%d %H:%M:%S"), checksum or None, content.strip())
            except ValueError:
                continue
        expected |= {(str(i), path, *rest) for path, rest in found.items()}
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "corpus_id string, document string")
    got = {(r.corpus_id, r.relative_path, r.summary_date, r.checksum, r.content) for r in digest_text.import_digest(frame).collect()}
    assert len(expected) > 50 and got == expected
