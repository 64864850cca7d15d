"""Merging against a list model of the rules, on hand-made and random blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators.merge import entity_blocks, merge_round, merge_with_existing, tree_merge
from graphloom.operators.similarity import PARTS, ROWS, _dealt, _named, bands_for, cosine_pairs, likely_pairs, outermost_matches, pairs_within
from graphloom.operators.spread import numbered, spread_join

ENT = "graph long, block int, ord long, name string, label string, embedding array<double>, description string"
REL = "graph long, block int, ord long, start_name string, start_label string, end_name string, end_label string, label string, name string, embedding array<double>, description string"


def cos(a, b):
    n = lambda v: max(math.sqrt(sum(x * x for x in v)), 1e-8)
    return sum(x * y for x, y in zip(a, b)) / (n(a) * n(b))


def model(left, right, t):
    """A pair of blocks, each (entities, relations), as lists with repeats."""
    (e1, r1), (e2, r2) = left, right
    hits = [(i, j) for i in range(len(e1)) for j in range(len(e2)) if cos(e1[i][2], e2[j][2]) >= t]
    names = {}
    for i, j in hits:
        names[e1[i][0]] = names[e2[j][0]] = e1[i]
    ents = [e1[i] for i, _ in hits] + [e for j, e in enumerate(e2) if j not in {y for _, y in hits}] + [e for i, e in enumerate(e1) if i not in {x for x, _ in hits}]
    new = lambda n, l: (names[n][0], names[n][1]) if n in names else (n, l)
    return ents, [(*new(a, al), *new(b, bl), lab, nm) for a, al, b, bl, lab, nm in r1 + r2]


def distinct_in_order(rows, key):
    seen, out = set(), []
    for r in rows:
        if key(r) not in seen:
            seen.add(key(r))
            out.append(r)
    return out


def frames(spark, blocks):
    ents = [(0, b, i, n, l, list(v), "") for b, (es, _) in enumerate(blocks) for i, (n, l, v) in enumerate(es)]
    rels = [(0, b, i, *r[:4], r[4], r[5], None, "") for b, (_, rs) in enumerate(blocks) for i, r in enumerate(rs)]
    return spark.createDataFrame(ents, ENT), spark.createDataFrame(rels, REL)


def random_blocks(seed, n):
    rng = random.Random(seed)
    vecs = [(1.0, 0.0), (0.9, 0.1), (0.0, 1.0), (0.1, 0.9), (-1.0, 0.0), (0.0, 0.0), (0.7, 0.7)]
    ent = lambda: (rng.choice("abcdef"), rng.choice("XY"), rng.choice(vecs))
    rel = lambda: (rng.choice("abcdef"), "X", rng.choice("abcdef"), "Y", rng.choice("pq"), rng.choice("rs"))
    return [([ent() for _ in range(rng.randint(1, 5))], [rel() for _ in range(rng.randint(1, 4))]) for _ in range(n)]


@pytest.mark.parametrize("seed,n", [(1, 2), (2, 3), (3, 5), (4, 9)])
def test_tree_merge_equals_the_list_model(spark, seed, n):
    blocks = random_blocks(seed, n)
    want = [b for b in blocks]
    while len(want) > 1:
        want = [model(want[i], want[i + 1], 0.8) if i + 1 < len(want) else want[i] for i in range(0, len(want), 2)]
    ents, rels = tree_merge(*frames(spark, blocks), 0.8)
    got = distinct_in_order([(r.name, r.label, tuple(r.embedding)) for r in ents.orderBy("first").collect()], lambda r: r[:2])
    assert got == distinct_in_order(want[0][0], lambda r: r[:2])
    assert [(r.start_name, r.start_label, r.end_name, r.end_label, r.label, r.name) for r in rels.orderBy("ord").collect()] == want[0][1]


def test_one_person_on_both_sides(spark):
    p = ("李明", "Person", (1.0, 0.0, 0.0))
    one = ([p, ("清华大学", "Organization", (0.0, 1.0, 0.0))], [("李明", "Person", "清华大学", "Organization", "works", "at")])
    two = ([p, ("Tsinghua University", "Organization", (0.0, 0.9, 0.1)), ("PhD", "Degree", (0.0, 0.0, 1.0))], [("李明", "Person", "Tsinghua University", "Organization", "works", "at"), ("李明", "Person", "PhD", "Degree", "has", "degree")])
    ents, rels = frames(spark, [one, two])
    e, r, pairs = merge_round(entity_blocks(ents), rels, 0.65)
    assert [x.name for x in e.orderBy("first").collect()] == ["李明", "清华大学", "PhD"]
    assert [(x.start_name, x.end_name) for x in r.orderBy("ord").collect() if x.label == "works"] == [("李明", "清华大学")] * 2
    assert sorted((x.l_name, x.r_name) for x in pairs.collect()) == [("李明", "李明"), ("清华大学", "Tsinghua University")]


def test_existing_graph_is_the_left_side(spark):
    known, new = random_blocks(7, 1), random_blocks(8, 1)
    want, want_rels = model(known[0], new[0], 0.8)
    ke, kr = frames(spark, known)
    ne, nr = frames(spark, new)
    e, r = merge_with_existing(*tree_merge(ne, nr, 0.8), entity_blocks(ke), kr, 0.8)
    key = lambda x: x
    assert distinct_in_order([(x.name, x.label, tuple(x.embedding)) for x in e.orderBy("first").collect()], key) == distinct_in_order(want, key)
    assert [(x.start_name, x.start_label, x.end_name, x.end_label, x.label, x.name) for x in r.orderBy("ord").collect()] == want_rels


def test_cosine_pairs_in_small_parts(spark):
    rng = random.Random(3)
    rows = [(i % 2, i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(0, None, [1.0] * 4), (0, 99, None), (1, 100, [0.0] * 4)]
    df = spark.createDataFrame(rows, "g int, id long, embedding array<double>")
    want = {(g, a, b) for g, a, x in rows for h, b, y in rows if g == h and None not in (a, b) and x and y and cos(x, y) >= 0.5}
    assert {(r.g, r.a, r.b) for r in cosine_pairs(df, df, 0.5, ["g"], rows=7).collect()} == want
    both = {(a, b) for _, a, x in rows for _, b, y in rows if None not in (a, b) and x and y and cos(x, y) >= 0.5}
    assert {(r.a, r.b) for r in cosine_pairs(df, df, 0.5, rows=7).collect()} == both
    assert cosine_pairs(df.limit(0), df, 0.5).count() == 0


def test_pairs_within_a_table(spark):
    rng = random.Random(4)
    rows = [(i % 45, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(None, [1.0] * 4), (99, None), (100, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    want = sorted((a, b) for a, x in rows for b, y in rows if None not in (a, b) and a < b and x and y and cos(x, y) >= 0.5)
    for size in (7, ROWS):
        assert sorted((r.a, r.b) for r in pairs_within(df, 0.5, rows=size).collect()) == want
    assert pairs_within(df.limit(0), 0.5).count() == 0


def test_a_group_is_dealt_to_many_tasks_in_few_copies(spark):
    """The blocks of one group stay apart behind a join by the group, and vectors are not sent to more and more parts, nor as doubles."""
    rows = [(0, i, [float(i), 1.0]) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, id long, embedding array<float>")
    own = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert cosine_pairs(df, df, -1.0, ["g"], rows=250).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
    named = _named(df, ["g"], "id", "embedding")
    assert named.schema["_vector"].dataType.simpleString() == "array<float>"
    assert _dealt(named, named, ["g"], 10).count() == 2 * PARTS * 1000


@pytest.mark.parametrize("recall", [None, 0.9999])
def test_matches_are_reduced_where_they_are_found(spark, recall):
    rng = random.Random(5)
    rows = [(i % 2, i, rng.choice([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [-1.0, 0.1]]), rng.randrange(1000), 1000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "s int, id long, embedding array<double>, first long, last long")
    left, right = ([r for r in rows if r[0] == k] for k in (0, 1))
    hits = [(a, b) for a in left for b in right if cos(a[2], b[2]) >= 0.9]
    want = {(0, a[1], min(y[3] for x, y in hits if x is a), max(y[4] for x, y in hits if x is a), None) for a, _ in hits}
    want |= {(1, b[1], None, *max((x[4], x[1]) for x, y in hits if y is b)) for _, b in hits}
    assert len(hits) > 10 * len(rows)
    for size in (20, ROWS):
        found = outermost_matches(df.filter("s = 0"), df.filter("s = 1"), 0.9, rows=size, recall=recall).collect()
        assert len(found) == len(want) and {(r.side, r.id, r.first, r.last, r.by) for r in found} == want


def test_likely_pairs_are_exact_and_nearly_all(spark):
    rng = random.Random(6)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i % 2, i, [x + rng.gauss(0, 0.35) for x in rng.choice(base)]) for i in range(600)] + [(0, None, [1.0] * 16), (0, 1000, None), (1, 1001, [0.0] * 16)]
    df = spark.createDataFrame(rows, "g int, id long, embedding array<double>")
    pairs = lambda found: {(r.g, r.a, r.b) for r in found.collect()}
    want, got = pairs(cosine_pairs(df, df, 0.8, ["g"])), pairs(likely_pairs(df, df, 0.8, ["g"], rows=50))
    assert got <= want and len(got) > 0.99 * len(want) > 600
    assert bands_for(0.8, 0.99) == 27 and bands_for(1.0, 0.99) == 1
    assert likely_pairs(df.limit(0), df, 0.8).count() == 0


def test_joins_with_hot_keys(spark):
    rows = [(i, "hot" if i % 2 else str(i % 50) if i % 4 else None, i % 3) for i in range(4000)]
    left = spark.createDataFrame(rows, "id long, k string, n int")
    right = spark.createDataFrame([("hot", 1), ("2", 2), ("2", 3), (None, 4), ("none", 5)], "k string, v int")
    for how in ("inner", "left"):
        key = lambda df: sorted((r.id, r.k or "", r.n, r.v or 0) for r in df.select("id", "k", "n", "v").collect())
        want = key(left.join(right, ["k"], how))
        assert key(spread_join(left, right, ["k"], how, hot_rows=100)) == want
        assert key(spread_join(left, right, ["k"], how)) == want
    assert spread_join(left.limit(0), right, ["k"]).count() == 0


def test_numbers_without_gaps(spark):
    rng = random.Random(7)
    rows = [(g, b) for g in (0, 1, 5) for b in rng.sample(range(10**6), 500 if g else 3000)]
    got = numbered(spark.createDataFrame(rng.sample(rows, len(rows)), "graph long, block long").repartition(7), "graph", "block").collect()
    assert sorted((r.graph, r.block, r.dense) for r in got) == [(g, b, i) for g in (0, 1, 5) for i, b in enumerate(sorted(b for h, b in rows if h == g))]
    assert numbered(spark.createDataFrame([], "graph long, block long"), "graph", "block").count() == 0
