"""Toxicity by compression distance.

A text is cut into windows, one for each word.  Each window is compressed twice by zstandard,
once with a dictionary of ordinary text and once with that and a dictionary of toxic text
behind it; the bytes that the second saves are the window's gain.  A window stands
between the same two runs of ordinary text in both frames: fixed costs are met by these, and
the compressor, which looks for no match in the last few bytes, sees the whole word.  Gains
are whole bytes and depend a little on these runs, so they are summed over a few pairs.
Windows like anything ordinary gain nothing, whatever their language.

Training takes a bounded sample of labelled texts (``MOST_TEXTS``, ``MOST_LENGTH``).  Near copies are taken
once, so that a text that was copied often does not pass for a habit of speech.  The
ordinary dictionary is trained on windows of ordinary texts.  The toxic one holds the stems
that toxic texts have far more often than ordinary ones do, all of them, as many bytes as
they take; a dictionary trained on toxic windows spends itself on ordinary words and finds a
third as much.  The gain at which a window counts, and the weights that turn counts into a
score, are calibrated on the same sample.  One task fits the model, so the driver holds no texts.

Defined results: null and blank texts have no window, and the score of a text without any
sign; repeated rows are scored alike; an empty table gives no rows; without labelled texts
of both kinds there is nothing to learn and every score is 0; other columns are kept by
``toxicity_column`` and not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import small_batches

#: Labelled texts that are fitted at most, and the longest of them in code points.
MOST_TEXTS, MOST_LENGTH = 5_000, 50_000

#: Words of a training window, of how many such windows of an ordinary text one is trained on,
#: size of the ordinary dictionary, bytes of ordinary text before and behind a window, and how
#: many pairs of these.
TRAINING_WORDS, EVERY, ORDINARY_BYTES, LEAD, FRAMES = 8, 2, 8192, 32, 3

#: How a trained dictionary begins (fixed value of the format).
DICTIONARY_MAGIC = bytes.fromhex("37a430ec")

#: Windows whose gain a worker remembers.
REMEMBERED = 500_000

#: Bytes above the least gain from which a window gains much.
MUCH = 6

#: A stem is distinctive if it is in so many times as many toxic texts as the ordinary share
#: would give, and that is so many deviations above chance, where the variance has this much
#: added: ten texts or so must have a stem, however many toxic texts there are.
TIMES, SURPRISE, EXTRA = 4.0, 6.0, 3.0

#: Shortest and longest stem, the first characters of a word.  The compressor finds matches of four
#: bytes and more; a longer word is known by its beginning.
STEM = (4, 8)

THRESHOLD = 0.7

# Lower-case A-Z; what is neither a letter, a digit nor beyond ASCII separates words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def training_windows(found: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(found[i: i + TRAINING_WORDS]) + b" " for i in range(0, len(found), TRAINING_WORDS)]


@dataclass
class Model:
    """What a task needs: dictionaries, the gain that counts, and the weights."""

    toxic: bytes
    ordinary: bytes
    least_gain: int
    weights: tuple[float, ...]

    def __post_init__(self):
        self._pair, self._known = None, {}

    def __getstate__(self):
        return {**self.__dict__, "_pair": None, "_known": {}}

    def pair(self):
        if self._pair is None:
            settings = zstandard.ZstdCompressionParameters(
                window_log=15, chain_log=13, hash_log=13, search_log=5, min_match=4, target_length=64,
                strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0,
            )
            self._pair, self._known = [], {}
            cuts = [self.ordinary[len(self.ordinary) - k * LEAD:][:LEAD] for k in range(2, 2 + 2 * FRAMES)]
            self._frames = [(lead + b" ", b" " + tail) for lead, tail in zip(cuts[::2], cuts[1::2])]
            # the compressor does not look into a dictionary's last few bytes either
            for content in (self.ordinary, self.ordinary + self.toxic + b" " * 16):
                trained = content[:4] == DICTIONARY_MAGIC
                kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
                held = zstandard.ZstdCompressionDict(content, dict_type=kind)
                held.precompute_compress(compression_params=settings)
                self._pair.append(zstandard.ZstdCompressor(dict_data=held, compression_params=settings))
        return self._pair

    def gains(self, found: list[bytes]) -> np.ndarray:
        """Gain of every window of a text's words."""
        (plain, toxic), known = self.pair(), self._known
        if len(known) > REMEMBERED:
            known.clear()
        for word in found:
            if word not in known:
                gain = 0
                for lead, tail in self._frames:
                    window = lead + word + tail
                    gain += len(plain.compress(window)) - len(toxic.compress(window))
                known[word] = gain
        return np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found))

    def score(self, text: str | None) -> float:
        if not self.toxic:
            return 0.0
        found = words(text)
        return float(1 / (1 + np.exp(-np.dot(signs(found, self.gains(found), self.least_gain), self.weights))))


def signs(found: list[bytes], gains: np.ndarray, least: int) -> np.ndarray:
    """Constant; whether one, two, three different windows count; how many do, how many gain much, their share."""
    hits = {word: gain for word, gain in zip(found, gains.tolist()) if gain >= least}
    n, much = len(hits), sum(gain >= least + MUCH for gain in hits.values())
    share = n / max(len(found), 1)
    return np.array([1.0, n > 0, n > 1, n > 2, np.log1p(n), np.log1p(much), np.sqrt(share), min(share * 25, 1.0)], dtype=float)


def stems(found: list[bytes]) -> set[str]:
    """First characters of words, of all lengths that are looked at."""
    kept = set()
    for word in set(found):
        letters = word.decode(errors="replace")
        kept.update(letters[:n] for n in range(STEM[0], min(STEM[1], len(letters)) + 1))
    return kept


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str) -> DataFrame:
    """``toxic, text`` of labelled rows that may be learnt from, in a fixed order; the bound keeps the smallest hashes."""
    known = labels.where(F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(F.max(label_column).alias("_toxic"))
    known = known.where(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id").limit(MOST_TEXTS)
    texts = documents.where(F.length(text_column) <= MOST_LENGTH).select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    rows = texts.join(known, "_id").orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text")).limit(MOST_TEXTS)
    return rows.select(F.col("_toxic").cast("int").alias("toxic"), F.col("_text").alias("text"))


def without_copies(rows: list[tuple]) -> list[tuple[int, list[bytes]]]:
    """Words of the texts, leaving out those most of whose five-word runs were seen before."""
    seen, kept = set(), []
    for toxic, text in rows:
        found = words(text)
        runs = {hash(tuple(found[i: i + 5])) for i in range(max(len(found) - 4, 1))}
        if len(runs & seen) * 2 < len(runs):
            kept.append((toxic, found))
        seen |= runs
    return kept


def fit(rows: list[tuple]) -> Model:
    """Model of ``(toxic, text)`` rows; the same rows in the same order give the same model."""
    kept = without_copies(rows)
    counts = {0: Counter(), 1: Counter()}
    texts = Counter(toxic for toxic, _ in kept)
    if not texts[0] or not texts[1]:
        return Model(b"", b"", 0, ())
    for toxic, found in kept:
        counts[toxic].update(stems(found))
    floor = 0.5 / texts[0]
    distinctive = set()
    for stem, n in counts[1].items():
        chance = texts[1] * max(counts[0][stem] / texts[0], floor)
        if n >= TIMES * chance and n - chance >= SURPRISE * np.sqrt(chance + EXTRA):
            distinctive.add(stem)

    def telling(word: bytes) -> str | None:
        return max(stems([word]) & distinctive, key=lambda stem: (counts[1][stem], stem), default=None)

    told = Counter(stem for toxic, found in kept if toxic for stem in {telling(w) for w in set(found)} if stem)
    if not told:
        return Model(b"", b"", 0, ())
    plain = [w for toxic, found in kept if not toxic for w in training_windows(found)[::EVERY]]
    # what is near the end of a dictionary costs least, so the most frequent stem is last
    ranked = sorted(told, key=lambda stem: (told[stem], stem))
    model = Model(b"".join(b" " + stem.encode() for stem in ranked) + b" ", _dictionary(plain, ORDINARY_BYTES), 1, ())
    gains = [(toxic, found, model.gains(found)) for toxic, found in kept]
    best = None
    for least in range(3, 16, 2):
        x = np.stack([signs(found, g, least) for _, found, g in gains])
        y = np.array([toxic for toxic, _, _ in gains], dtype=float)
        weights = _logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-x @ weights)), 1e-9, 1 - 1e-9)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        if best is None or loss < best[0] - 1e-9:
            best = (loss, least, tuple(weights.tolist()))
    model.least_gain, model.weights = best[1:]
    return model


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Trained dictionary; if all that differs fits into it, that itself, most frequent last."""
    counts = Counter(samples)
    ranked = sorted(counts, key=lambda sample: (counts[sample], sample))
    if sum(map(len, ranked)) <= size:
        return b"".join(ranked) + b" "
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b"".join(ranked)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps; the constant is not shrunk."""
    shrink = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + shrink @ weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + shrink + 1e-6 * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def train(
    documents: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
) -> Model:
    """Model of the labelled sample, fitted by one task; only the model comes to the driver."""

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [row for batch in batches for row in zip(batch["toxic"].tolist(), batch["text"].tolist())]
        model = fit(rows)
        yield pd.DataFrame({
            "toxic": [model.toxic], "ordinary": [model.ordinary], "least_gain": [model.least_gain], "weights": [list(model.weights)],
        })

    small_batches(documents.sparkSession)
    sample = labelled_sample(documents, labels, id_column, text_column, label_column)
    found = sample.mapInPandas(fitted, "toxic binary, ordinary binary, least_gain int, weights array<double>").collect()  # one row
    return Model(bytes(found[0].toxic), bytes(found[0].ordinary), found[0].least_gain, tuple(found[0].weights)) if found else fit([])


def toxicity_column(model: Model, text: Column) -> Column:
    """Score of whole texts, 0 to 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(text) for text in texts], dtype="float64")

    return score(text)


def toxicity_scores(documents: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` of every row."""
    small_batches(documents.sparkSession)
    scored = documents.select(
        F.col(id_column), held_out(F.col(id_column)).alias("held_out"), toxicity_column(model, F.col(text_column)).alias("score")
    )
    return scored.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def remainder(doc_id) -> int:
    """The held-out rule outside Spark."""
    return zlib.crc32(str(doc_id).encode()) % 3
