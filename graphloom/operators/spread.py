"""Joins and numbering that hold up when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialise

#: Rows of a key from which it counts as hot; its rows are dealt into parts of about so many, MOST_PARTS at most.
HOT_ROWS, MOST_PARTS = 100_000, 4096
#: The most rows of a table that is sent to every executor on account of its count.
FEW_ROWS = 100_000


def hot_keys(counts: DataFrame, on: Sequence[str], n: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Kept table (on, _parts) of the keys with more than ``hot_rows`` rows, from a table of counts ``n``. There are few, as the count of all rows bounds them."""
    parts = F.least(F.lit(MOST_PARTS), F.ceil(F.col(n) / hot_rows)).cast("int")
    return materialise(counts.filter(F.col(n) > hot_rows).select(*on, parts.alias("_parts")), "hot")


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", hot_rows: int = HOT_ROWS, hot: DataFrame | None = None) -> DataFrame:
    """``left`` joined to ``right`` on equal columns; ``how`` is inner or left. ``right`` should have few rows of a key.

    The rows of a hot key (see ``hot_keys``; counted here where ``hot`` is not given) are dealt into parts by a hash of the row, and its rows on the right are repeated for
    each part. Rows with a null in the key are dealt out too: they match nothing. No column may be named _part or _parts.
    """
    on = list(on)
    some_null = F.lit(False)
    for c in on:
        some_null = some_null | F.col(c).isNull()
    if hot is None:
        hot = hot_keys(left.filter(~some_null).groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), on, "_n", hot_rows)
    n_hot = hot.count()
    if n_hot > FEW_ROWS:  # over FEW_ROWS * hot_rows rows: then no key has a large share
        return left.join(right, on, how)
    dealt = F.xxhash64(*[F.col(c) for c in left.columns])
    lone = F.when(some_null, F.pmod(dealt, F.lit(64)).cast("int"))
    if not n_hot:
        if how == "inner":
            return left.join(right, on)
        l, r = left.withColumn("_part", lone.otherwise(0)), right.withColumn("_part", F.lit(0))
    else:
        l = left.join(F.broadcast(hot), on, "left").withColumn("_part", lone.when(F.col("_parts").isNotNull(), F.pmod(dealt, F.col("_parts")).cast("int")).otherwise(0)).drop("_parts")
        every = F.when(F.col("_parts").isNotNull(), F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(F.lit(0)))
        r = right.join(F.broadcast(hot), on, "left").withColumn("_part", F.explode(every)).drop("_parts")
    return l.join(r, [*on, "_part"], how).drop("_part")


def numbered(df: DataFrame, within: str, by: str, name: str = "dense") -> DataFrame:
    """``df`` with a number from 0, without gaps, in the order of ``by`` among the rows of equal ``within``.

    A distributed sort; the only table that is put together has a row for each part of it.
    """
    placed = materialise(df.orderBy(within, by).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, row = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).count().withColumnRenamed("count", "n").collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    start = F.array(*map(F.lit, before or [0])).cast("array<bigint>")
    ranked = placed.withColumn("_at", F.get(start, part) + row)
    first = materialise(ranked.groupBy(within).agg(F.min("_at").alias("_first")), "first")
    out = ranked.join(F.broadcast(first) if first.count() <= FEW_ROWS else first, within)
    return out.withColumn(name, F.col("_at") - F.col("_first")).select(*df.columns, name)
