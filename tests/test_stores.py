"""Listing and reading through pyarrow's file systems against the walk of a mount."""

import datetime
import hashlib
import os
import random

import pytest
from pyarrow import fs

from gistmill.operators import ignore
from gistmill.sources import stores, tree as trees


def rows_of(frame):
    return sorted(tuple(row) for row in frame.select("corpus_id", "relative_path", "size", "modified_time").collect())


def roots_of(spark, roots):
    return spark.createDataFrame(list(roots.items()), "corpus_id string, root string")


@pytest.fixture
def odd_tree(tree):
    (tree / "empty.txt").write_text("")
    (tree / ".hidden").write_text("x")
    (tree / "_deep" / ".er" / "q q+1%20 é#?.d").mkdir(parents=True)
    (tree / "_deep" / ".er" / "q q+1%20 é#?.d" / "_SUCCESS").write_text("x = 1")
    (tree / "node_modules").mkdir()
    (tree / "node_modules" / "m.js").write_text("no")
    (tree / "custom").mkdir()
    (tree / "custom" / "m.py").write_text("no")
    (tree / ".gistmillignore").write_text("custom/*\n*.json\n")
    os.symlink("nowhere", tree / "dangling")
    os.symlink(tree / "_deep", tree / "link")
    return tree


def test_times_as_the_mount_gives_them(tmp_path):
    file, draw = tmp_path / "f", random.Random(8)
    file.write_text("x")
    for _ in range(5000):
        os.utime(file, ns=(0, draw.randrange(1_700_000_000 * 10**9, 1_800_000_000 * 10**9)))
        found = stores._modified(fs.LocalFileSystem().get_file_info(str(file)))
        assert found == datetime.datetime.fromtimestamp(os.stat(file).st_mtime, datetime.timezone.utc).replace(tzinfo=None)


@pytest.mark.parametrize("share", [1, 2, 2000])
def test_same_rows_as_the_mount(spark, odd_tree, tmp_path, share):
    roots = {"p": str(odd_tree), "q": str(odd_tree / "_deep"), "void": str(tmp_path / "void")}
    (tmp_path / "void").mkdir()
    # pyarrow passes over links that lead nowhere
    expected = [row for row in rows_of(trees.list_corpora(spark, roots, directories_per_task=share)) if row[2] is not None]
    given = roots_of(spark, {**roots, "p": f"file://{odd_tree}/"})
    found = stores.list_stores(given, directories_per_task=share)
    assert rows_of(found) == expected and {row[0] for row in expected} == {"p", "q"}
    names = {row[1] for row in expected}
    assert {"empty.txt", ".hidden", "_deep/.er/q q+1%20 é#?.d/_SUCCESS"} <= names
    assert not names & {"node_modules/m.js", "custom/m.py", "link/.er/q q+1%20 é#?.d/_SUCCESS"}


def test_contents_are_those_of_the_mount(spark, odd_tree):
    os.unlink(odd_tree / "dangling")
    (odd_tree / "large.bin").write_bytes(b"\0" * 5000)
    (odd_tree / "latin.txt").write_bytes(b"\xe9" * 5000)
    roots = {"p": str(odd_tree)}
    columns = ["path", "relative_path", "size", "checksum", "content"]
    for limit in (100, 1 << 20):
        mounted = trees.read_contents(trees.list_corpora(spark, roots), row_bytes=limit).select(columns).collect()
        read = stores.read_stores(stores.list_stores(roots_of(spark, roots)), row_bytes=limit).select(columns).collect()
        assert sorted(map(tuple, read), key=str) == sorted(map(tuple, mounted), key=str)
        by_name = {row.relative_path: row for row in read}
        assert by_name["large.bin"].checksum == hashlib.sha256(b"\0" * 5000).hexdigest()
    listing = stores.list_stores(roots_of(spark, roots))
    os.unlink(odd_tree / "large.bin")
    gone = {row.relative_path: row for row in stores.read_stores(listing).collect()}["large.bin"]
    assert gone.content is None and gone.checksum == "unreadable"


def test_rules_of_the_roots(spark, odd_tree, tmp_path):
    given = roots_of(spark, {"p": str(odd_tree), "none": str(tmp_path / "nothing")})
    own = ignore.usable_rules(stores.rule_lines(given))
    assert {(r.corpus_id, r.pattern) for r in own.collect()} == {("p", "custom/*"), ("p", "*.json")}


def test_odd_roots(spark, tree, tmp_path):
    schema = "root string, corpus_id string, kind int"
    rows = [(str(tree), "p", 1), (str(tree), "p", 2), (str(tree) + "/", "p", 3), (None, "p", 4), (str(tree), None, 5)]
    once = stores.list_stores(spark.createDataFrame(rows, schema))
    assert once.count() == 5 and once.columns == ["corpus_id", "path", "relative_path", "size", "modified_time"]
    assert stores.list_stores(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError, match="does not exist"):
        stores.list_stores(roots_of(spark, {"p": str(tmp_path / "nothing")}))
    with pytest.raises(ValueError, match="not a directory"):
        stores.list_stores(roots_of(spark, {"p": str(tree / "small.py")}))


def test_given_connection(spark, tree):
    """A store that no URI names: everything below another root."""
    base = str(tree.parent)

    def connect(root):
        return fs.SubTreeFileSystem(base, fs.LocalFileSystem()), root.removeprefix("mine://")

    listing = stores.list_stores(roots_of(spark, {"p": "mine://project"}), connect=connect)
    files = {r.path: r for r in stores.read_stores(listing, connect=connect).collect()}
    assert files["mine://project/small.py"].content == b'print("hello")' and len(files) == 5
