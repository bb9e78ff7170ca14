"""An FM-index over a sequence of numbers: suffix order, wavelet matrix, sampled positions.

The sequence is made of documents, each closed by a separator of its own that no pattern holds.
``FmIndex.build`` sorts the suffixes by doubling (only suffixes that still tie are sorted again),
takes the symbol before each suffix, and stores these as a wavelet matrix: one row of bits for
each bit of a symbol, with running counts of ones.  Searches and walks handle many patterns or
suffixes at once.
"""

from __future__ import annotations

import numpy as np

#: Every position divisible by this is stored; a walk to a stored one takes fewer steps.
SAMPLE = 32


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order; a suffix that ends sorts before its extensions."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    bits = max(int(symbols.max() + 1).bit_length(), 1)
    depth = max(min(62 // bits, 8), 1)
    key = np.zeros(n, dtype=np.int64)
    for k in range(depth):
        key <<= bits
        key[: max(n - k, 0)] |= symbols[k:] + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    places = np.flatnonzero(~(first & np.r_[first[1:], True]))
    while len(places):
        tied = order[places]
        group = rank[tied]
        key = group * (n + 1) + rank[np.minimum(tied + depth, n)] + 1
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        order[places] = tied
        first = np.r_[True, key[1:] != key[:-1]]
        rank[tied] = places[np.flatnonzero(first)[np.cumsum(first) - 1]]
        places = places[~(first & np.r_[first[1:], True])]
        depth *= 2
    return order


class Bits:
    """Rows of bits with a rank for any number of places at once."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.ones = np.zeros((words.shape[0], words.shape[1] + 1), dtype=np.int32)
        np.cumsum(np.bitwise_count(words), axis=1, out=self.ones[:, 1:])

    @staticmethod
    def packed(bits: np.ndarray) -> np.ndarray:
        """Bits as 64-bit words, with one word more so that a rank at the end needs no test."""
        octets = np.packbits(bits, bitorder="little")
        out = np.zeros((len(bits) // 64 + 1) * 8, dtype=np.uint8)
        out[: len(octets)] = octets
        return out.view("<u8")

    def rank(self, row: int, at: np.ndarray) -> np.ndarray:
        """Ones before the places ``at``."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[row, word] + np.bitwise_count(self.words[row, word] & below)

    def get(self, row: int, at: np.ndarray) -> np.ndarray:
        return ((self.words[row, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FmIndex:
    """``symbols`` 1 to ``n_symbols`` - 1, and 0 for what stands before a document's first one."""

    def __init__(self, n: int, n_symbols: int, counts: np.ndarray, levels: np.ndarray, marks: np.ndarray, positions: np.ndarray):
        self.n, self.n_symbols, self.counts, self.positions = n, n_symbols, counts, positions
        self.levels, self.marks = Bits(levels), Bits(marks)
        self.zeros = [n - int(ones[-1]) for ones in self.levels.ones]

    @classmethod
    def build(cls, symbols: np.ndarray, n_symbols: int, sample: int = SAMPLE) -> "FmIndex":
        """``symbols``: int64, 0 closes a document (and the last one)."""
        n, ends = len(symbols), symbols == 0
        # separators differ, so that equal documents tie no further than their ends
        plain = np.where(ends, np.cumsum(ends) - 1, symbols + int(ends.sum()) - 1)
        order = suffix_order(plain)
        before = symbols[order - 1]
        stored = (order % sample == 0) | (before == 0) | (order == 0)
        levels, left = [], before
        for level in range(max(int(n_symbols - 1).bit_length(), 1) - 1, -1, -1):
            bit = (left >> level) & 1 == 1
            levels.append(Bits.packed(bit))
            left = np.concatenate([left[~bit], left[bit]])
        counts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        return cls(n, n_symbols, counts, np.array(levels), Bits.packed(stored)[None, :], order[stored].astype(np.int64))

    def to_bytes(self) -> dict[str, bytes]:
        return {"counts": self.counts.astype("<i8").tobytes(), "levels": self.levels.words.tobytes(),
                "marks": self.marks.words.tobytes(), "positions": self.positions.astype("<i4").tobytes()}

    @classmethod
    def from_bytes(cls, n: int, n_symbols: int, parts: dict[str, bytes]) -> "FmIndex":
        wide = n // 64 + 1
        return cls(n, n_symbols, np.frombuffer(parts["counts"], "<i8"), np.frombuffer(parts["levels"], "<u8").reshape(-1, wide),
                   np.frombuffer(parts["marks"], "<u8").reshape(1, wide), np.frombuffer(parts["positions"], "<i4").astype(np.int64))

    def _shift(self) -> list[tuple[int, int]]:
        return [(row, len(self.zeros) - 1 - row) for row in range(len(self.zeros))]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before the places ``at``."""
        start = np.zeros_like(at)
        for row, level in self._shift():
            one = (symbol >> level) & 1 == 1
            a, b = self.levels.rank(row, at), self.levels.rank(row, start)
            at = np.where(one, self.zeros[row] + a, at - a)
            start = np.where(one, self.zeros[row] + b, start - b)
        return at - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with each row of ``patterns``, read from its end.

        Patterns stand to the right; 0 to the left means that one is shorter, -1 a symbol
        that the index does not have.
        """
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        low[(patterns == -1).any(axis=1)] = self.n
        alive = np.flatnonzero(low < high)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, column]
            now, symbol = alive[symbol > 0], symbol[symbol > 0]
            if not len(now):
                break
            both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low[now], high[now]]))
            low[now] = self.counts[symbol] + both[: len(now)]
            high[now] = self.counts[symbol] + both[len(now):]
            alive = alive[low[alive] < high[alive]]
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at places ``at`` of the order: walk back to a stored one."""
        out, steps, owner = np.empty(len(at), dtype=np.int64), 0, np.arange(len(at))
        while len(at):
            stored = self.marks.get(0, at)
            out[owner[stored]] = self.positions[self.marks.rank(0, at[stored])] + steps
            owner, at, steps = owner[~stored], at[~stored], steps + 1
            at = self._back(at)
        return out

    def _back(self, at: np.ndarray) -> np.ndarray:
        """The place of the suffix that is longer by one symbol."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for row, level in self._shift():
            one = self.levels.get(row, at)
            symbol |= one.astype(np.int64) << level
            a, b = self.levels.rank(row, at), self.levels.rank(row, start)
            at = np.where(one, self.zeros[row] + a, at - a)
            start = np.where(one, self.zeros[row] + b, start - b)
        return self.counts[symbol] + at - start
