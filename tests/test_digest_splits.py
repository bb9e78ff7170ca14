"""Digest files cut at any byte range are imported like the whole text."""

import random

import pytest

from gistmill.sources import digest_text
from gistmill.sources.digest_text import import_digest, read_digest_texts

DATE = "Summarized on 2024-05-01 08:30:{:02d}"


def digest_of(draw, n, newline):
    """Entries with headings, half marks, dates that are none, multi-byte letters and lost marks."""
    text = draw.choice(["# Project Summary\n\n---\n\n", "", "### Odd ## start\n", "## "])
    for i in range(n):
        check = draw.choice(["", f" (checksum: {draw.choice('abc') * 64})", " (checksum: unreadable)"])
        content = draw.choice(["plain é日😀", "", "a\n## Notes\n\nb", "\n\n## x\n", "x\r y", "## Heading", "### deep\n#", "日" * 40])
        mark = draw.choice([f"\n\n{DATE.format(i % 60)}{check}\n\n"] * 6 + [f"\n\n{DATE.format(i % 60)}\n", "\n", "\n\nSummarized on 2024-13-45 00:00:00\n\n"])
        text += f"## f{draw.randrange(n)}.py{mark}{content}{draw.choice(['', chr(10), chr(10) * 2, chr(10) * 2])}"
    return text.replace("\n", newline)


def imported(frame):
    return sorted(import_digest(frame).collect())


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_any_split_size(spark, tmp_path, newline):
    draw = random.Random(len(newline))
    texts = {f"c{i}": digest_of(draw, 25, newline) for i in range(6)}
    paths = {}
    for corpus, text in texts.items():
        paths[corpus] = str(tmp_path / f"{corpus} digest.md")
        with open(paths[corpus], "wb") as file:
            file.write(text.encode())
    plain = [(c, t.replace("\r\n", "\n").replace("\r", "\n")) for c, t in texts.items()]
    whole = imported(spark.createDataFrame(plain, "corpus_id string, document string"))
    assert len(whole) > 60
    conf, before = spark.conf, spark.conf.get("spark.sql.files.maxPartitionBytes")
    conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for size in (7, 50, 133, 1000, 10**8):
            conf.set("spark.sql.files.maxPartitionBytes", str(size))
            read = read_digest_texts(spark, paths)
            texts_again = {}
            for r in read.orderBy("corpus_id", "part").collect():
                texts_again[r.corpus_id] = texts_again.get(r.corpus_id, "") + r.document
            assert texts_again == dict(plain)
            assert imported(read) == whole
    finally:
        conf.set("spark.sql.files.maxPartitionBytes", before)
        conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_parts_of_few_sections(spark, tmp_path, monkeypatch, newline):
    """A byte range with many sections is no single row, and its parts are imported like the whole text."""
    monkeypatch.setattr(digest_text, "PIECE_BITS", 1, raising=False)
    draw = random.Random(9)
    texts = {f"c{i}": digest_of(draw, 30, newline) for i in range(3)}
    for corpus, text in texts.items():
        (tmp_path / f"{corpus}.md").write_bytes(text.encode())
    plain = [(c, t.replace("\r\n", "\n").replace("\r", "\n")) for c, t in texts.items()]
    conf, before = spark.conf, spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (300, 10**8):
            conf.set("spark.sql.files.maxPartitionBytes", str(size))
            read = read_digest_texts(spark, {c: str(tmp_path / f"{c}.md") for c in texts})
            rows = read.orderBy("corpus_id", "part").collect()
            assert max(r.document.count("\n## ") for r in rows) <= 2
            assert len({(r.corpus_id, r.part) for r in rows}) == len(rows)
            assert [(c, "".join(r.document for r in rows if r.corpus_id == c)) for c in texts] == plain
            assert imported(read) == imported(spark.createDataFrame(plain, "corpus_id string, document string"))
    finally:
        conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_file(spark, tmp_path):
    (tmp_path / "empty.md").write_text("")
    assert imported(read_digest_texts(spark, {"c": str(tmp_path / "empty.md")})) == []
    assert imported(digest_text.read_digest_texts(spark, {})) == []
