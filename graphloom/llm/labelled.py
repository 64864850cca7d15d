"""Statistics of documents as a table, and bounded samples for fitting."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import statistics
from graphloom.llm.arrays import give_back, pieces
from graphloom.session import materialise


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            counts, features = statistics.measure(part.column(1))
            width = features.shape[1]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(c) for c in counts.T], pa.ListArray.from_arrays(pa.array(range(0, len(features) * width + 1, width), pa.int32()), pa.array(features.ravel()))],
                names=["doc_id", *statistics.COUNTS, "features"],
            )
    give_back()


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, counts of statistics.COUNTS, features) for each row of ``docs``; kept in the shared folder, as it is read twice."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in statistics.COUNTS) + ", features array<double>"
    return materialise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measured, schema), "measured")


def bucket(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; -1 for a null key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus)), F.lit(-1)).cast("int")


def bounded(df: DataFrame, key: str, most: int) -> DataFrame:
    """All rows if there are ``most`` or fewer, else about that many, and never more, chosen by a hash of the key."""
    n = df.count()
    if n <= most:
        return df
    share = F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(1 << 30))
    return df.filter(share < int((1 << 30) * 1.1 * most / n)).orderBy(F.xxhash64(F.col(key), F.lit(5)), key).limit(most)


def with_label(stats: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """Measured rows of labelled documents, with ``label`` 0 or 1; null labels and ids are left out, repeated ones count once."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    return stats.join(known.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id")
