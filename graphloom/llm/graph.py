"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.spread import hot_keys, spread_join
from graphloom.session import materialise, release


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id of ``links`` (a, b): component is the smallest id that can be reached.

    In each round every id takes the smallest label among itself and its neighbours, then the label of that label, so
    long chains shrink by more than half a round. Labels are written out each round; nothing is gathered on the driver.
    Links may repeat, have either direction, or join an id to itself. No links give no rows. The rows of an id with many links, and of a component with many members, are dealt into parts.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).filter(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    centres = hot_keys(both.groupBy("b").agg(F.count(F.lit(1)).alias("n")), ["b"], "n")
    while True:
        theirs = labels.select(F.col("id").alias("b"), F.col("component").alias("c"))
        least = spread_join(both, theirs, ["b"], hot=centres).groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        low = labels.join(least, "id").select("id", F.col("component").alias("was"), F.least("component", "c").alias("c"))
        up = labels.select(F.col("id").alias("c"), F.col("component").alias("root"))
        # Roots that many ids had so far; which they are now need not be known exactly.
        roots = hot_keys(labels.groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("n")), ["c"], "n")
        now = materialise(spread_join(low, up, ["c"], "left", hot=roots).select("id", "was", F.least(F.col("c"), F.coalesce("root", "c")).alias("component")), "labels")
        changed = now.filter(F.col("was") != F.col("component")).limit(1).count()
        release(labels)
        release(roots)
        labels = now
        if not changed:
            release(both)
            release(centres)
            return labels.select("id", "component")
