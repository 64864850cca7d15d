"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

cos(w.x + b) with normal w and uniform b approximates a Gaussian kernel on standardised statistics. Each partition sums its part of the
normal equations; the sums are added up by Spark and the driver solves one system of DIMENSION unknowns, whatever the input. Labelled
rows fall into two halves by a hash; each half is scored by the other half's solution, and Spark counts labels
over GRID steps of that score, from which pool-adjacent-violators makes the rising calibration. Scores then come from the solution over both halves.

Only rows whose fold (crc32 of doc_id, modulo 4) is not HELD_OUT are learned from. Defined results: null or empty text is
scored by its statistics, all zero. Without labels of both classes every score is 0.5 (predicted 0). Repeated rows
get equal results, empty tables give empty ones; only doc_id and text, doc_id and quality are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import labelled
from graphloom.llm.statistics import FEATURES
from graphloom.session import materialise, release

DIMENSION, GAMMA, RIDGE, GRID = 160, 0.02, 1.0, 512
FOLDS, HELD_OUT = 4, 2
ACCEPT = 0.7
#: Parts into which the partitions' sums are added before these are added.
ADDED_AT_ONCE = 256


@dataclass(frozen=True)
class Projection:
    """Standardisation and random directions."""

    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(11)
        w = rng.normal(0, np.sqrt(2 * GAMMA), (x.shape[1], DIMENSION))
        b = rng.uniform(0, 2 * np.pi, DIMENSION)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.sqrt(2 / DIMENSION) * np.cos(z @ w + b), np.ones(len(x))])


@dataclass(frozen=True)
class Model:
    projection: Projection
    weights: np.ndarray
    places: np.ndarray
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.projection(x) @ self.weights, self.places, self.levels)


def _features(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))


def _sums(projection: Projection):
    """Per partition and half: the rows of the normal equations, row i as (half, i, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = DIMENSION + 1
        total = np.zeros((2, n, n + 1))
        for batch in batches:
            z = projection(_features(batch, 0))
            y, half = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in (0, 1):
                zk = z[half == k]
                total[k] += zk.T @ np.column_stack([zk, y[half == k]])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], n), pa.int32()), pa.array(np.tile(np.arange(n), 2), pa.int32()), pa.array(list(total.reshape(2 * n, n + 1)), pa.list_(pa.float64()))], names=["half", "i", "values"])

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"half": pdf["half"][:1], "i": pdf["i"][:1], "values": [np.sum(np.stack(pdf["values"].to_list()), axis=0)]})


def _crossed(projection: Projection, weights: list[np.ndarray], low: float, high: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, half = projection(_features(batch, 0)), batch.column(2).to_numpy()
            raw = np.where(half == 0, z @ weights[1], z @ weights[0])
            step = np.clip(((raw - low) / (high - low) * GRID).astype(np.int64), 0, GRID - 1)
            yield pa.RecordBatch.from_arrays([pa.array(step, pa.int32()), batch.column(1)], names=["step", "label"])

    return run


def rising(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``value`` (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, w1, n1 = blocks.pop()
            v0, w0, n0 = blocks.pop()
            blocks.append([(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame) -> Model | None:
    """The model from all labelled rows outside the held-out fold; None without labels of both classes."""
    fold = labelled.bucket(F.col("doc_id"), FOLDS)
    rows = labelled.with_label(stats, labels).filter((fold != HELD_OUT) & (fold >= 0))
    rows = materialise(rows.select("features", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")), "labelled")
    sums = [f(F.col("features")[i]) for i in range(len(FEATURES)) for f in (F.avg, F.stddev_pop)]
    got = rows.agg(F.count(F.lit(1)), F.coalesce(F.avg("label"), F.lit(0.0)), *sums).first()
    if not got[0] or not 0 < got[1] < 1:
        return None
    scale = np.array(got[3::2], dtype=float)
    projection = Projection(np.array(got[2::2], dtype=float), np.where(scale > 1e-9, scale, 1.0))
    # Added up in two steps, so that a task never gets a row from every partition.
    schema = "half int, i int, values array<double>"
    parts = rows.mapInArrow(_sums(projection), schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(ADDED_AT_ONCE)))
    parts = parts.groupBy("half", "i", "part").applyInPandas(_add, schema).groupBy("half", "i").applyInPandas(_add, schema)
    n = DIMENSION + 1
    total = np.zeros((2, n, n + 1))
    for r in parts.collect():
        total[r["half"], r["i"]] = r["values"]
    solve = lambda s: np.linalg.solve(s[:, :n] + RIDGE * np.diag([1.0] * (n - 1) + [1e-6]), s[:, n])
    weights = [solve(total[0]), solve(total[1])]
    low, high = -0.5, 1.5
    counts = rows.mapInArrow(_crossed(projection, weights, low, high), "step int, label double").groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("s")).orderBy("step").collect()
    release(rows)
    weight, ones, step = (np.array([r[c] for r in counts], dtype=float) for c in ("n", "s", "step"))
    places = low + (step + 0.5) * (high - low) / GRID
    return Model(projection, solve(total[0] + total[1]), places, rising(ones / weight, weight))


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_features(batch, 1)) if model is not None else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text); ``labels`` has doc_id and quality."""
    stats = labelled.measured(docs)
    model = fit(stats, labels)
    scored = stats.select("doc_id", "features").mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", (labelled.bucket(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted 1, with all their columns; one whose id is null is kept, as it cannot be looked up."""
    gone = classify(docs, labels).filter("predicted = 0").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
