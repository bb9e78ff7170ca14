"""A Bloom filter of keys as a predicate, so that rows leave where they are scanned.

The bits are made by tasks and put together as one array of words, whose size has a bound;
the predicate reads them through a scalar subquery and is an ordinary expression of the scan.
Some rows without a key pass, none with one is lost, so an exact join follows.
"""

from __future__ import annotations

import dataclasses
import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.schemas import KEY

#: Bits for each key, and bits at the most: 32 MiB, which every task holds.
BITS_PER_KEY, MOST_BITS = 10, 1 << 28
_WORD = 64


@dataclasses.dataclass(frozen=True)
class FilterSize:
    """Bits, a power of two, and how many of them stand for a key."""

    bits: int
    probes: int

    @classmethod
    def of(cls, keys: int, most_bits: int = MOST_BITS) -> FilterSize:
        """Beyond ``most_bits`` a filter lets more rows pass; up to there about one in a hundred."""
        bits = min(most_bits, max(_WORD, 1 << math.ceil(math.log2(max(1, keys) * BITS_PER_KEY))))
        return cls(bits, min(7, max(1, round(bits / max(1, keys) * math.log(2)))))

    def places(self) -> list[Column]:
        """Bits of a row's key; NULL for a key that has a NULL."""
        is_key = F.col(KEY[0]).isNotNull() & F.col(KEY[1]).isNotNull()
        start = F.when(is_key, F.pmod(F.xxhash64(*KEY), F.lit(self.bits)))
        step = F.pmod(F.xxhash64(*reversed(KEY)), F.lit(self.bits)).bitwiseOR(F.lit(1))
        return [F.pmod(start + step * i, F.lit(self.bits)) for i in range(self.probes)]


def filter_words(keys: DataFrame, size: FilterSize) -> DataFrame:
    """``words``: one row with all bits of the keys; repeated keys count once, NULL ones not at all."""
    place = keys.select(F.explode(F.array(*size.places())).alias("place")).where("place IS NOT NULL")
    one = F.expr(f"shiftleft(1L, cast(place % {_WORD} AS int))")
    words = place.groupBy(F.expr(f"place div {_WORD}").alias("id")).agg(F.bit_or(one).alias("bits"))
    dense = keys.sparkSession.range(size.bits // _WORD).join(words, "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits"))))
    return dense.agg(F.transform(ordered, lambda word: word.bits).alias("words"))


def may_be_key(words: DataFrame, size: FilterSize) -> Column:
    """Whether a row's key may be among those of ``filter_words``."""
    found = words.select("words").scalar()
    bits = [F.getbit(F.get(found, F.shiftright(p, 6).cast("int")), (p % _WORD).cast("int")) == 1 for p in size.places()]
    return functools.reduce(lambda a, b: a & b, bits)
