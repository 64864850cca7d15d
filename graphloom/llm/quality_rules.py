"""Quality rules: exact counts, base rules, and gradient-boosted trees over document statistics.

The trees are grown in numpy on at most SAMPLE labelled documents, by histograms of binned features, with the logistic loss. For the features
in MONOTONE a split that would turn against the wanted direction is not taken, and the values below a split stay on their side of
its middle, so the score falls (never rises) as such a feature grows. The fitted trees are flattened into arrays of nodes; a batch
walks all trees at once, one level at a time.

Defined results: null text has no words and fails the base rules. With no usable labels, or labels of one class only, the
verdict of the base rules stands. Each repeated row gets the same result; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import labelled
from graphloom.llm.statistics import COUNTS, FEATURES

#: The most labelled documents that the trees are grown on.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 60, 3, 0.2, 64, 10, 1.0
#: Sign of the effect on quality that a feature may have.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "caps_words": -1, "exclaim_share": -1, "pipe_share": -1, "top_share": -1}
ACCEPT = 0.5


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees in arrays (trees x nodes); a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality 1 for each row."""
        n, trees = len(x), np.arange(self.feature.shape[0])
        at = np.zeros((n, len(trees)), dtype=np.int64)
        rows = np.arange(n)[:, None]
        for _ in range(DEPTH):
            f = self.feature[trees, at]
            at = np.where(x[rows, f] <= self.threshold[trees, at], self.left[trees, at], self.right[trees, at])
        return 1 / (1 + np.exp(-(self.base + self.value[trees, at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[str, int] = MONOTONE, names: tuple[str, ...] = FEATURES) -> Trees:
    """Trees for features x and labels y (0 or 1, both present)."""
    n, d = x.shape
    sign = np.array([monotone.get(f, 0) for f in names])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    width = BINS + 1
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(n, base)
    nodes = 2 ** (DEPTH + 1) - 1
    shape = (TREES, nodes)
    feature, threshold = np.zeros(shape, dtype=np.int64), np.full(shape, np.inf)
    left, right, value = np.tile(np.arange(nodes), (TREES, 1)), np.tile(np.arange(nodes), (TREES, 1)), np.zeros(shape)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        bounds = {0: (-np.inf, np.inf)}
        value[t, 0] = RATE * g.sum() / (h.sum() + RIDGE)
        for level in range(DEPTH):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node) if node in bounds else np.zeros(0, dtype=np.int64)
                if len(rows) < 2 * LEAST:
                    continue
                lo, hi = bounds[node]
                flat = (binned[rows] + np.arange(d) * width).ravel()
                sums = [np.bincount(flat, np.repeat(v, d) if v is not None else None, d * width).reshape(d, width).cumsum(axis=1)[:, :-1] for v in (g[rows], h[rows], None)]
                gl, hl, nl = sums
                gt, ht, nt = g[rows].sum(), h[rows].sum(), len(rows)
                vl, vr = np.clip(gl / (hl + RIDGE), lo, hi), np.clip((gt - gl) / (ht - hl + RIDGE), lo, hi)
                # The loss that a clipped value leaves, not the best one.
                gain = 2 * gl * vl - (hl + RIDGE) * vl**2 + 2 * (gt - gl) * vr - (ht - hl + RIDGE) * vr**2
                v0 = np.clip(gt / (ht + RIDGE), lo, hi)
                gain -= 2 * gt * v0 - (ht + RIDGE) * v0**2
                gain[(nl < LEAST) | (nt - nl < LEAST) | (sign[:, None] * (vr - vl) < 0)] = -np.inf
                for j, c in enumerate(cuts):
                    gain[j, len(c) :] = -np.inf
                best = int(np.argmax(gain))
                j, b = divmod(best, width - 1)
                if not gain[j, b] > 1e-6:
                    continue
                one, two = 2 * node + 1, 2 * node + 2
                feature[t, node], threshold[t, node], left[t, node], right[t, node] = j, cuts[j][b], one, two
                value[t, one], value[t, two] = RATE * vl[j, b], RATE * vr[j, b]
                middle = (vl[j, b] + vr[j, b]) / 2
                bounds[one], bounds[two] = {0: ((lo, hi), (lo, hi)), -1: ((middle, hi), (lo, middle)), 1: ((lo, middle), (middle, hi))}[int(sign[j])]
                goes = x[rows, j] <= cuts[j][b]
                at[rows] = np.where(goes, one, two)
        raw = raw + value[t, at]
    return Trees(feature, threshold, left, right, value, base)


def trained(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees from at most ``sample`` labelled documents; None if there are not labels of both classes."""
    chosen = labelled.bounded(labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)), "doc_id", sample)
    rows = labelled.with_label(stats, chosen).dropDuplicates(["doc_id"]).orderBy("doc_id").select("features", "label").collect()
    x, y = np.array([r["features"] for r in rows], dtype=float), np.array([r["label"] for r in rows], dtype=float)
    return fit(x, y) if len(y) and 0 < y.mean() < 1 else None


def _judge(trees: Trees | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(COUNTS))]
            x = batch.column(1 + len(COUNTS)).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            score = trees.score(x) if trees is not None else np.ones(batch.num_rows)
            n_words, repeat = counts[0], counts[4]
            failed = (n_words < 50) | (100 * repeat > 50 * n_words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts], pa.array(failed), pa.array(~failed & (score >= ACCEPT)), pa.array(score)], names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    return run


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, counts, base_failed, kept, score) for each row of ``docs`` (doc_id, text); ``labels`` has doc_id and quality."""
    stats = labelled.measured(docs)
    trees = trained(stats, labels, sample)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return stats.mapInArrow(_judge(trees), schema)
