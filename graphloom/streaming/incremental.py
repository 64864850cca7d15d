"""Incremental building: each micro-batch of documents is merged into the graph kept under a folder.

A batch writes a new version named after its id; a version that exists is not written again, so a batch that is repeated after
a failure changes nothing. One query may write to a folder at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from graphloom.plans.pipeline import Config, build_graph


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of complete versions, ascending; a version is complete once its relations are."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(_fs(spark, f"{folder}/{n}/relations/_SUCCESS")[1]))


def current(spark: SparkSession, folder: str, before: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(entities, relations) of the latest version, or of the latest before a number."""
    known = [v for v in versions(spark, folder) if before is None or v < before]
    if not known:
        return None
    return tuple(spark.read.parquet(f"{folder}/v={known[-1]}/{name}") for name in ("entities", "relations"))


def merge_batch(docs: DataFrame, batch_id: int, folder: str, config: Config | None = None) -> None:
    """Merge one batch of (doc_id, text) into the graph under ``folder``."""
    spark = docs.sparkSession
    if batch_id in versions(spark, folder):
        return
    entities, relations = build_graph(docs, config, current(spark, folder, before=batch_id))
    entities.write.mode("overwrite").parquet(f"{folder}/v={batch_id}/entities")
    relations.write.mode("overwrite").parquet(f"{folder}/v={batch_id}/relations")


def graph_stream(docs: DataFrame, folder: str, checkpoint: str, config: Config | None = None) -> DataStreamWriter:
    """A writer that merges a stream of documents; start it with a trigger of your choice. Its checkpoint remembers which files are done."""
    return docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: merge_batch(df, n, folder, config))
