"""Sinks: a graph into an external store, and reports of an evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import preview
from graphloom.operators.evaluate import metrics
from graphloom.operators.graph import edges, nodes

#: Rows that go to a store in one call.
BATCH = 500


class GraphStore(Protocol):
    """What takes nodes and edges. It is sent to the executors; ``open()`` is called once in each task, so a connection is made there."""

    def open(self) -> None: ...

    def nodes(self, rows: list[dict]) -> None: ...

    def edges(self, rows: list[dict]) -> None: ...

    def close(self) -> None: ...


def quoted(label: str) -> str:
    """A label between backticks, with those inside doubled (SNK3)."""
    return "`" + label.replace("`", "``") + "`"


class CypherStore:
    """Upserts by MERGE, a call for each label in a batch (SNK1, SNK2). ``connect`` gives an object with ``run(query, params)`` and ``close()``."""

    def __init__(self, connect: Callable[[], object], graph_id: str | None = None):
        self.connect, self.graph_id = connect, graph_id

    def open(self) -> None:
        self.session = self.connect()

    def close(self) -> None:
        self.session.close()

    def _by(self, rows: list[dict], *keys: str) -> Iterator[tuple[tuple[str, ...], list[dict]]]:
        groups: dict[tuple[str, ...], list[dict]] = {}
        for r in rows:
            groups.setdefault(tuple(r[k] for k in keys), []).append(r)
        yield from groups.items()

    def nodes(self, rows: list[dict]) -> None:
        own = f", {self.graph_id}: row.{self.graph_id}" if self.graph_id else ""
        for (label,), some in self._by(rows, "label"):
            self.session.run(f"UNWIND $rows AS row MERGE (n:{quoted(label)} {{name: row.name{own}}}) SET n += row.properties", {"rows": [self._row(r, ("name",)) for r in some]})

    def edges(self, rows: list[dict]) -> None:
        own = f", {self.graph_id}: row.{self.graph_id}" if self.graph_id else ""
        for (start, end, label), some in self._by(rows, "start_label", "end_label", "label"):
            match = f"MATCH (a:{quoted(start)} {{name: row.start_name{own}}}), (b:{quoted(end)} {{name: row.end_name{own}}})"
            self.session.run(f"UNWIND $rows AS row {match} MERGE (a)-[r:{quoted(label)}]->(b) SET r += row.properties", {"rows": [self._row(r, ("start_name", "end_name")) for r in some]})

    def _row(self, row: dict, keys: tuple[str, ...]) -> dict:
        given = {k: row[k] for k in (*keys, *([self.graph_id] if self.graph_id else []))}
        kept = {k: row[k] for k in ("name", "embedding", "description", *([self.graph_id] if self.graph_id else [])) if row.get(k) is not None}
        return given | {"properties": kept}


def _sent(df: DataFrame, store: GraphStore, kind: str, batch: int) -> int:
    """Rows that were sent; each task opens the store once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store.open()
        n = 0
        try:
            for pdf in frames:
                for a in range(0, len(pdf), batch):
                    rows = [{k: (v.tolist() if hasattr(v, "tolist") else v) for k, v in r.items()} for r in pdf.iloc[a : a + batch].to_dict("records")]
                    getattr(store, kind)(rows)
                    n += len(rows)
        finally:
            store.close()
        yield pd.DataFrame({"n": [n]})

    return df.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_graph(entities: DataFrame, relations: DataFrame, store: GraphStore, order: str = "ord", graph_id: str | None = None, batch: int = BATCH) -> tuple[int, int]:
    """Nodes, and when all of them are there the edges between them, into a store; gives how many of each (SNK12).

    Rows with a null name or label are left out: no store has them. Repeating the call after a failure changes nothing, as rows are upserted.
    """
    named = entities.dropna(subset=["name", "label"])
    table = nodes(named, order, graph_id)
    keep = [c for c in ("label", "name", "embedding", "description", graph_id) if c and c in table.columns]
    n = _sent(table.select(*keep), store, "nodes", batch)
    links = edges(relations.dropna(subset=["start_name", "start_label", "end_name", "end_label", "label"]), table, order, graph_id)
    keep = [c for c in ("start_label", "start_name", "end_label", "end_name", "label", "name", "embedding", "description", graph_id) if c and c in links.columns]
    return n, _sent(links.select(*keep), store, "edges", batch)


def report_details(details: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """A row for each document as the report has it: counts, and what was found rightly, wrongly, and not at all; with the text's beginning where ``texts`` (doc_id, text) is given."""
    pairs = F.arrays_zip("predicted", "hits")
    found = lambda good: F.transform(F.filter(pairs, lambda x: (x["hits"] > 0) == F.lit(good)), lambda x: x["predicted"])
    numbered = F.arrays_zip(F.col("truth"), F.sequence(F.lit(1), F.size("truth")).alias("i"))
    lost = F.when(F.size("truth") > 0, F.transform(F.filter(numbered, lambda x: ~F.array_contains(F.col("hits"), x["i"])), lambda x: x["truth"])).otherwise(F.slice("truth", 1, 0))
    out = details.select("doc_id", "n_truth", "n_predicted", "n_correct", "n_wrong", "n_missed", found(True).alias("correct"), found(False).alias("wrong"), lost.alias("missed"))
    return out if texts is None else out.join(texts.select("doc_id", preview(F.col("text"), 100).alias("text")), "doc_id", "left")


#: Lines of a report's head, with the column of the metrics and the digits that each shows.
HEAD = (("Precision", "precision", 4), ("Recall", "recall", 4), ("F1", "f1", 4), ("Accuracy of matches", "accuracy", 4), ("Truth", "n_truth", 0), ("Extracted", "n_predicted", 0), ("Correct", "n_correct", 0))


def report_lines(details: DataFrame, extra: str, spent: DataFrame | None = None) -> DataFrame:
    """(line_no, line) of the head of a readable report: metrics, documents, and what the calls took where ``spent`` (see usage.summary) is given."""
    row = metrics(details, extra).withColumn("n_documents", F.lit(details.count()))
    shown = [(name, F.format_string(f"%.{d}f", c) if d else F.col(c).cast("string")) for name, c, d in HEAD] + [("Accurate", F.col(extra).cast("string")), ("Documents", F.col("n_documents").cast("string"))]
    lines = row.select(F.posexplode(F.array(*[F.concat(F.lit(f"{name}: "), v) for name, v in shown])).alias("line_no", "line"))
    if spent is None:
        return lines
    money = [("Calls", F.col("calls").cast("string")), ("Input tokens", F.col("input_tokens").cast("string")), ("Output tokens", F.col("output_tokens").cast("string")), ("Cost in USD", F.format_string("%.4f", "cost_total"))]
    more = spent.select(F.posexplode(F.array(*[F.concat(F.lit(f"{name}: "), v) for name, v in money])).alias("line_no", "line"))
    return lines.unionByName(more.withColumn("line_no", F.col("line_no") + len(shown)))


def write_report(details: DataFrame, extra: str, path: str, spent: DataFrame | None = None, texts: DataFrame | None = None) -> None:
    """The report of an evaluation under ``path`` (SNK10): ``metrics`` (one JSON object), ``details`` (a JSON line for each document), and ``summary`` (text).

    Details are written by all tasks; the two others are a few lines each.
    """
    row = metrics(details, extra).withColumn("dataset_size", F.lit(details.count()))
    if spent is not None:
        row = row.withColumn("token_usage", F.struct(*[F.lit(v).alias(k) for k, v in spent.first().asDict().items()]))  # one row
    row.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    report_details(details, texts).write.mode("overwrite").json(f"{path}/details")
    report_lines(details, extra, spent).coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(f"{path}/summary")
