"""Byte-level cases of the text functions, and random texts against Python."""

import random

from pyspark.sql import functions as F

from gistmill import fixed_values as fv
from gistmill.functions import entries
from gistmill.functions import text as tx


def evaluate(spark, values, schema, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r[1] for r in sorted(rows.select("i", column(F.col("v"))).collect())]


def test_decoding(spark):
    cases = {
        b"\xff\xfe a": "\xff\xfe a",
        b"\xed\xa0\x80": "\xed\xa0\x80",
        b"\xc0\xaf": "\xc0\xaf",
        b"\xef\xbb\xbfx\r\ny\rz": "﻿x\ny\nz",
        b"": "",
        "é ü".encode(): "é ü",
        b"a\r\r\nb": "a\n\nb",
    }
    assert evaluate(spark, [bytearray(k) for k in cases], "binary", tx.read_text) == list(cases.values())


def test_random_bytes_decode_as_in_python(spark):
    rng = random.Random(3)
    samples = [bytes(rng.choice(b"a\xc3\xa9\xe2\x82\xac\xff\r\n\xed\xa0\x80") for _ in range(rng.randint(0, 8))) for _ in range(2000)]

    def python(content):
        try:
            text = content.decode("utf-8")
        except UnicodeDecodeError:
            text = content.decode("latin-1")
        return text.replace("\r\n", "\n").replace("\r", "\n")

    assert evaluate(spark, [bytearray(s) for s in samples], "binary", tx.read_text) == [python(s) for s in samples]


def test_random_texts_count_as_in_python(spark):
    rng = random.Random(5)
    alphabet = fv.WHITESPACE + "ab​﻿ᚁ⁰é\U0001F600\x00\x07"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", " ", "a"]
    assert evaluate(spark, texts, "string", tx.token_estimate) == [len(t.split()) + len(t) // 4 for t in texts]
    assert evaluate(spark, texts, "string", tx.strip) == [t.strip() for t in texts]
    assert evaluate(spark, texts, "string", tx.strip_left) == [t.lstrip() for t in texts]
    assert evaluate(spark, texts, "string", tx.is_binary) == [
        "\x00" in t or len([c for c in t if ord(c) < 32 and c not in "\n\r\t"]) > len(t) * 0.1 for t in texts
    ]


def test_binary_bounds(spark):
    texts = ["\x01" + "a" * 9, "\x01" + "a" * 8, "a" * 5000 + "\x00", "", "\t\n\r" * 5]
    assert evaluate(spark, texts, "string", tx.is_binary) == [False, True, True, False, False]


def test_size_labels_and_messages(spark):
    sizes = [0, 500, 1023, 1024, 1048575, 1048576, 5 * 2**30]
    assert evaluate(spark, sizes, "bigint", tx.size_label) == ["0B", "500B", "1023B", "1K", "1023K", "1M", "5120M"]
    rng = random.Random(9)
    sizes = [int(10.25 * 2**20), int(10.75 * 2**20)] + [rng.randint(0, 2**40) for _ in range(2000)]
    sizes += [rng.randint(0, 4000) * 2**18 for _ in range(500)]
    expected = [f"File size ({s / (1024 * 1024):.1f}MB) exceeds limit (10.0MB)" for s in sizes]
    assert evaluate(spark, sizes, "bigint", lambda s: tx.oversize_message(s, 10.0)) == expected


def test_threshold_is_exact(spark):
    from gistmill.operators.route import below_threshold

    rng = random.Random(21)
    texts = ["".join(rng.choice("ab  ") for _ in range(rng.choice([100, 400, 500, 780, 799, 800, 801, 900]))) for _ in range(400)]
    expected = [len(t.split()) + len(t) // 4 < 200 for t in texts]
    assert True in expected and False in expected
    assert evaluate(spark, texts, "string", lambda t: below_threshold(t, 200)) == expected


def test_header_and_entry_path(spark):
    rows = spark.createDataFrame([
        ("a.py", "## File: a.py\n\n  body\n"), ("a.py", "## File: a.py"), ("a.py", "## File: a.python\nx"),
        ("a.py", "x\n## File: a.py\ny"), ("a.py", "## File: b.py\nx"),
    ], "p string, c string")
    stripped = [r[0] for r in rows.select(entries.strip_header(F.col("c"), F.col("p"))).collect()]
    assert stripped == ["body\n", "## File: a.py", "x", "x\n## File: a.py\ny", "## File: b.py\nx"]
    named = evaluate(spark, ["## a b.py \nx", "## x", "no", "### y"], "string", entries.entry_path)
    assert named == ["a b.py", "x", None, None]
