"""Every query against its DuckDB counterpart, and the driver's contract."""

import re

import pytest
from compare import SF, oracle_rows, spark_rows
from test_merge import distinct_in_order, model

from graphloom import catalogue
from graphloom.backends import NAME_RULE, HashEmbedder
from graphloom.operators.distill import text_blocks


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_oracle(spark, name):
    assert spark_rows(catalogue.QUERIES[name](spark, SF)) == oracle_rows(catalogue.ORACLES[name])


def test_build_kg_runs(spark):
    df = catalogue.QUERIES["build_kg"](spark, SF)
    rows = df.collect()
    assert rows and len(rows) == len({(r.start_name, r.end_name, r.label, r.name) for r in rows})


def test_build_kg_is_the_graph_of_all_documents(spark, tmp_path):
    """Every document counts, by lists and brute force, and the benchmark table none."""
    docs = [
        (7, "Alexander met Alexandra near Berlin, and they talked for hours.\nThen Berlin and Hamburg were left behind by Alexandra."),
        (2, "The Committee of Hamburg wrote to Robert about this matter.\nno names in this line, which is long enough to stay.\nRoberta and Robert answered the Committees of Berlin at once."),
        (2**40, "Christina told Christine about Roberts and about Hamburg.\n" * 3 + "Berlin, Alexander. " * 30 + "That was the end of a long text."),
        (5, None), (6, ""), (9, "nothing to find here at all, no names."), (11, "Alexander met Alexandra near Berlin, and they talked for hours."),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "Nobody of this benchmark, says Xavier to Yolanda, is a document.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    vector = lambda n: tuple(0.3 * HashEmbedder().embed([n])[0])
    blocks = []
    for b in text_blocks(df).orderBy("doc_id", "block_idx").collect():
        names = re.findall(NAME_RULE, b.text)
        if len(names) > 1:
            blocks.append(([(n, "Term", vector(n)) for n in dict.fromkeys(names)], [(x, "Term", y, "Term", "precedes", "precedes") for x, y in zip(names, names[1:])]))
    assert len(blocks) >= 8
    while len(blocks) > 1:
        blocks = [model(blocks[i], blocks[i + 1], 0.8) if i + 1 < len(blocks) else blocks[i] for i in range(0, len(blocks), 2)]
    want = distinct_in_order(blocks[0][1], lambda r: (r[0], r[2], r[4], r[5]))
    got = catalogue.QUERIES["build_kg"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_driver_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "block_idx", "text"]
    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalogue.QUERIES) <= set(e.queries())


def test_distilling_needs_no_shuffle(spark):
    plan = catalogue.QUERIES["distill_blocks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
