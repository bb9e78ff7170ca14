"""Rows that every operator has to take: nulls, empty and long texts, ties, clashing names."""

import random

CLASHING = "size string, n_tokens string, start string, score string, label string, fingerprint string, offset string, _id string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"
WORDS = "the of and to in cat river stone bridge flood morning village water idiot Straße été niño don't 42 foo-bar".split()


def text_of(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def rows() -> list[tuple]:
    texts = [
        (1, "one two three"), (2, ""), (3, None), (4, " \n\t "), (5, text_of(1, 4000)), (6, "one two three"), (7, "x" * 3000),
        (7, "x" * 3000), (8, text_of(2, 30)), (None, "nobody's words"), (9, "日本語 テキスト 😀 word"), (10, "a<|endoftext|>b <|startoftext|>"),
        (11, text_of(3, 700)), (12, "The MIT License, the mit license"),
    ]
    return [(i, t, None if k % 5 == 0 else "en", [None, "a", "b"][k % 3], 7, *["x"] * 8) for k, (i, t) in enumerate(texts)]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def components(ids: list, linked) -> dict:
    """Smallest reachable id of each, by plain search."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
