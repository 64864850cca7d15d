"""Bloom filters made of plain SQL expressions: bits are gathered by an aggregate, tests are column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A filter is held in the plan as one literal; no filter larger than this is made. Callers have another way for more keys.
MAX_FILTER_BYTES = 8 << 20


class TooLarge(ValueError):
    """A filter would not fit the plan."""


@dataclass(frozen=True)
class Bloom:
    """``words`` are the bits, 64 to a word; ``seed`` tells filters over the same keys apart."""

    words: tuple[int, ...]
    n_hashes: int
    seed: int

    def literal(self) -> Column:
        return F.expr(f"cast(split('{','.join(map(str, self.words))}', ',') as array<bigint>)")

    def test(self, key: Column) -> Column:
        """True if the key may be in the set; never false for a key that is."""
        bits, words = 64 * len(self.words), self.literal()
        found = None
        for j in range(self.n_hashes):
            at = F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(j)), F.lit(bits))
            word = F.get(words, F.floor(at / 64).cast("int"))
            hit = F.call_function("getbit", word, F.pmod(at, F.lit(64)).cast("int")) == 1
            found = hit if found is None else found & hit
        return found


def filter_bytes(n_keys: int, rate: float) -> int:
    """Bytes of a filter for so many keys at a rate of false positives."""
    return 8 * max(1, math.ceil(-n_keys * math.log(rate) / math.log(2) ** 2 / 64))


def build(keys: DataFrame, column: str, n_keys: int, rate: float, seed: int = 0) -> Bloom:
    """The filter over a column of distinct keys.

    The driver receives at most ``filter_bytes(n_keys, rate)`` bytes; if these exceed MAX_FILTER_BYTES, TooLarge is raised before anything is read.
    An empty table gives a filter that holds nothing.
    """
    size = filter_bytes(n_keys, rate)
    if size > MAX_FILTER_BYTES:
        raise TooLarge(f"a filter over {n_keys} keys takes {size} bytes; at most {MAX_FILTER_BYTES} are held in a plan")
    n_hashes = max(1, round(-math.log2(rate)))
    bits = 8 * size
    at = F.explode(F.array(*[F.pmod(F.xxhash64(F.col(column), F.lit(seed), F.lit(j)), F.lit(bits)) for j in range(n_hashes)]))
    rows = (
        keys.select(at.alias("_at"))
        .groupBy(F.floor(F.col("_at") / 64).alias("_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(pmod(_at, 64) as int)))").alias("_bits"))
        .collect()
    )
    words = [0] * (size // 8)
    for r in rows:
        words[r["_word"]] = r["_bits"]
    return Bloom(tuple(words), n_hashes, seed)
