"""Near-duplicates by circulant MinHash, with exact Jaccard verification and connected components.

One permutation scatters a text's shingles over a ring of RING places; a second one, read at a place and the COORDINATES
places that follow, gives all signature coordinates: coordinate k is the least value that the second permutation,
shifted by k, takes over the set. Bands of coordinates make the buckets (see bands_of); a pair at the threshold shares no
bucket with a chance of 3e-7, and a pair that shares one is compared on its whole sets of 64-bit shingle names.

Texts with equal sets are one representative from the start, so exact copies never meet in a bucket. A bucket of
representatives is not expanded into pairs:

1. Its smallest member is compared with all others, and components are made of the links (linear in the bucket).
2. Where members of different components are left, each of those outside the bucket's largest component is compared with the
   member that its signature is nearest to, which joins most of them.
3. Only where different components are left even then, those outside the largest one are compared with the rest. Blocks of outsiders meet blocks of members, so that a task holds one block of each, and a pair goes on to exact
   comparison only if its signatures agree in a share of the coordinates that is SLACK below the threshold, or more. A linked pair
   falls short of that with a chance under 1e-7, as rare as missing every bucket.

Defined results: null or blank text has the empty set and is alone. A text with fewer words than WIDTH has its whole
sequence as its one shingle. Repeated rows (equal doc_id) are judged once and each row gets the result. A row whose
doc_id is null is alone: no component, and it is kept. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrays import U, Words, give_back, mix, pieces
from graphloom.llm.graph import components
from graphloom.operators.spread import hot_keys, spread_join
from graphloom.session import materialise, release

RING = 1 << 20
#: Coordinates of every text, and of those that share a bucket (the first ones are the same).
COORDINATES, LONG = 192, 1024
#: Chance that a pair at the threshold shares no bucket.
MISSED = 3e-7
#: Long signatures of linked pairs agree in this much less than the threshold, or more; see slack_of.
SLACK = 0.067
#: Outsiders and members of a bucket that one task compares at a time.
OUTSIDERS, MEMBERS = 64, 1024
#: Copies of each group of equal sets among which its rows are dealt when they look up their representative.
SALTS = 32


def bands_of(percent: int) -> tuple[int, int]:
    """(bands, rows of each): the most rows with which bands of COORDINATES miss a pair at the threshold with a chance of MISSED or less."""
    best = None
    for rows in range(1, 17):
        share = (percent / 100) ** rows
        bands = 1 if share >= 1 else math.ceil(round(math.log(MISSED) / math.log1p(-share), 3))
        if bands * rows <= COORDINATES:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"{COORDINATES} coordinates do not find pairs at {percent} percent")
    return best


def slack_of(percent: int) -> float:
    """How far below the threshold the share of equal coordinates of a linked pair may fall: over 5 standard deviations."""
    s = percent / 100
    return max(SLACK, 5.3 * math.sqrt(max(0.0, s * (1 - s)) / LONG))


_A, _B, _C = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)


def _second_permutation() -> np.ndarray:
    values = np.random.default_rng(19).permutation(RING).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[:LONG]]), LONG)


_shifted: list[np.ndarray] = []


def signature(names: np.ndarray, count: int = COORDINATES) -> np.ndarray:
    """``count`` least values over the set; the first permutation is the top bits of the mixed names."""
    if not _shifted:
        _shifted.append(_second_permutation())
    least = np.full(count, 0xFFFFFFFF, dtype=np.uint32)
    places = (mix(names ^ _C) >> U(44)).astype(np.int64)
    for i in range(0, len(places), 1024):
        np.minimum(least, _shifted[0][places[i : i + 1024], :count].min(axis=0), out=least)
    return least


def shingle_sets(column: pa.Array, width: int, lower: bool = True) -> list[np.ndarray]:
    """The sorted distinct shingle names of each text."""
    w = Words(column, lower=lower)
    name, first = w.name, w.first
    n = len(name)
    whole = np.zeros(0, dtype=np.uint64)
    if n >= width:
        whole = name[: n - width + 1].copy()
        for j in range(1, width):
            whole = whole * _A + name[j : n - width + 1 + j]
        whole = mix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            short = U(b - a) * _B
            for x in name[a:b]:
                short = short * _A + x
            out.append(mix(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def band_keys(sig: np.ndarray, bands_n: int, rows_n: int) -> np.ndarray:
    """The buckets of a signature: a 64-bit name of each band's place and coordinates."""
    rows = sig[: bands_n * rows_n].reshape(bands_n, rows_n).astype(np.uint64)
    key = np.arange(1, bands_n + 1, dtype=np.uint64) * _C
    for j in range(rows_n):
        key = mix(key * _A + rows[:, j])
    return key


def _signatures(width: int, percent: int):
    bands_n, rows_n = bands_of(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in pieces(batch):
                    ids, size, one, two, bands = part.column(0), [], [], [], []
                    for s in shingle_sets(part.column(1), width):
                        size.append(len(s))
                        one.append(int(_signed(np.add.reduce(mix(s), keepdims=True))[0]) if len(s) else 0)
                        two.append(int(_signed(np.bitwise_xor.reduce(mix(s * _B), keepdims=True))[0]) if len(s) else 0)
                        sig = signature(s) if len(s) else None
                        if sig is None:
                            bands.append(None)
                            continue
                        bands.append(_signed(band_keys(sig, bands_n, rows_n)))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                        names=["doc_id", "n_shingles", "f1", "f2", "bands"],
                    )
        give_back()

    return run


def _sets(width: int, percent: int):
    shape = bands_of(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in pieces(batch):
                    sets = shingle_sets(part.column(1), width)
                    long = [signature(s, LONG) for s in sets]
                    # A byte of each coordinate is enough: different values look equal one time in 256, which lets a pair through, never stops it.
                    marks = [(x & 0xFF).astype(np.uint8).tobytes() for x in long]
                    bands = [band_keys(x, *shape).astype(np.uint32).tobytes() for x in long]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(marks, pa.binary()), pa.array(bands, pa.binary())], names=["doc_id", "names", "marks", "places"])
        give_back()

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                if 100 * len(p) < percent * len(q):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])
        give_back()

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. One document may be the first of very many pairs."""
    pairs = materialise(pairs, "pairs")
    hot = hot_keys(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), ["a"], "n")
    left = sets.select(F.col("doc_id").alias("a"), F.col("names").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("names").alias("y"))
    return spread_join(pairs, left, ["a"], hot=hot).join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long")


def _fixed(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes, as a matrix."""
    n = len(column)
    if not n:
        return np.zeros((0, width // np.dtype(kind).itemsize), dtype=kind)
    start = np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], dtype=kind, count=n * width // np.dtype(kind).itemsize, offset=int(start)).reshape(n, -1)


def _flat(rows: pa.Table) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows.column(i).chunk(0) for i in range(rows.num_columns)], names=rows.column_names)


def _best(part: pa.RecordBatch, bands_n: int, agree: float, nearest: bool) -> list[tuple[np.ndarray, ...]]:
    """(o, a, b, same) for each outsider o of one block of outsiders and one of members: the pairs of different components whose signatures agree enough, or the best one.

    A pair that shares an earlier bucket too is left to that one, so each goes on once.
    """
    outside = part.column("outside").to_numpy(zero_copy_only=False)
    if outside.all() or not outside.any():
        return []
    ids, labels = part.column("id").to_numpy(), part.column("component").to_numpy()
    marks, places = _fixed(part.column("marks"), LONG, np.uint8), _fixed(part.column("places"), 4 * bands_n, np.uint32)
    here = part.column("bucket")[0].as_py() & 0xFFFFFFFF
    mem, found = np.flatnonzero(~outside), []
    m, m_ids, m_labels, m_places = marks[mem], ids[mem], labels[mem], places[mem]
    for k in np.flatnonzero(outside).tolist():
        same = np.where(m_labels != labels[k], (m == marks[k]).sum(axis=1), -1)
        hit = np.flatnonzero(same >= agree * LONG)
        if len(hit) and nearest:
            hit = hit[[np.lexsort((m_ids[hit], -same[hit]))[0]]]
        elif len(hit):
            hit = hit[places[k][(m_places[hit] == places[k]).argmax(axis=1)] == here]
        if len(hit):
            found.append((np.full(len(hit), ids[k]), np.minimum(m_ids[hit], ids[k]), np.maximum(m_ids[hit], ids[k]), same[hit]))
    return found


def _compared(bands_n: int, agree: float, nearest: bool):
    """:func:`_best` of each run of rows with equal (bucket, i, j); rows come sorted by these, and of a run only as much is held as it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kept = ["o", "a", "b", "same"], None

        def out(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], names=names)

        for batch in batches:
            rows = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            rows = rows.combine_chunks()
            keys = [rows.column(c).chunk(0).to_numpy() for c in ("bucket", "i", "j")] if rows.num_rows else []
            edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if rows.num_rows > 1 else np.zeros(0, dtype=np.int64)
            found, at = [], 0
            for to in edge.tolist():
                if to - at > 1:
                    found += _best(_flat(rows.slice(at, to - at)), bands_n, agree, nearest)
                at = to
            kept = rows.slice(at)
            if found:
                yield out(found)
        if kept is not None and kept.num_rows > 1 and (found := _best(_flat(kept), bands_n, agree, nearest)):
            yield out(found)
        give_back()

    return run


def _remaining(buckets: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of one bucket but different components, one of them outside the bucket's largest component."""
    named = buckets.join(labels, F.col("rep") == F.col("id"), "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    counts = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("bucket").agg(F.max_by("component", F.struct("n", F.negative("component"))).alias("largest"), F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("outsiders"))
    # Counted by bucket first, so this has a row a bucket; most have one component and go.
    top = materialise(top.filter(F.col("outsiders") > 0), "mixed")
    mixed = spread_join(named, top, ["bucket"], hot=hot_keys(top, ["bucket"], "members")).join(sets.select(F.col("doc_id").alias("rep"), "marks", "places"), "rep")
    n_out, n_mem = F.ceil(F.col("outsiders") / OUTSIDERS).cast("int"), F.ceil(F.col("members") / MEMBERS).cast("int")
    outside = F.col("component") != F.col("largest")
    part = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n).cast("int")
    base = ["bucket", F.col("rep").alias("id"), "component", "marks", "places"]
    outs = mixed.filter(outside).select(*base, part(n_out, 1).alias("i"), F.explode(F.sequence(F.lit(0), n_mem - 1)).alias("j"), F.lit(True).alias("outside"))
    mems = mixed.select(*base, F.explode(F.sequence(F.lit(0), n_out - 1)).alias("i"), part(n_mem, 2).alias("j"), F.lit(False).alias("outside"))
    met = outs.unionByName(mems).select("bucket", "i", "j", "id", "component", "marks", "places", "outside")
    # Blocks are small and many: they are read from a sorted partition in batches, not handed over one by one.
    met = met.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    pairs = met.mapInArrow(_compared(bands_of(percent)[0], percent / 100 - slack_of(percent), nearest), "o long, a long, b long, same long")
    if nearest:  # the best of those found in each block and bucket
        pairs = pairs.groupBy("o").agg(F.max_by(F.struct("a", "b"), F.struct("same", F.negative("a"), F.negative("b"))).alias("p")).select("p.a", "p.b")
    return pairs.select("a", "b").distinct()


def representatives(sigs: DataFrame) -> DataFrame:
    """(f1, f2, n_shingles, rep, copies) for each distinct non-empty set; rep is the smallest doc_id."""
    return sigs.filter(F.col("n_shingles") > 0).groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    ``width`` words make a shingle; documents are linked where 100 * intersection >= ``percent`` * union. component_id is
    the smallest doc_id that links reach, and that document is kept.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sigs = materialise(docs.filter(F.col("doc_id").isNotNull()).mapInArrow(_signatures(width, percent), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"), "sigs")
    groups = materialise(representatives(sigs), "groups")
    reps = materialise(sigs.join(groups.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "bands"), "reps")
    members = reps.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("rep"))
    leaders = materialise(members.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "leaders")
    buckets = materialise(spread_join(members, leaders.select("bucket", "leader"), ["bucket"], hot=hot_keys(leaders, ["bucket"], "n")), "buckets")
    sets = materialise(docs.join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets(width, percent), "doc_id long, names binary, marks binary, places binary"), "sets")
    stars = buckets.filter("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialise(_linked(stars, sets, percent), "links")
    labels = components(links)
    for nearest in (True, False):
        more = _remaining(buckets.select("bucket", "rep"), sets, labels, percent, nearest)
        found = materialise(_linked(more, sets, percent).union(links), "links")
        release(links)
        links = found
        labels = components(links)
    for t in (leaders, buckets, sets, reps, links):
        release(t)
    named = groups.join(labels, F.col("rep") == F.col("id"), "left").select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component_id"), "copies", "rep")
    # A set held by one document finds its row by that document; rows of a set with copies look it up among SALTS copies of it.
    salted = named.filter("copies > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    single = named.filter("copies = 1").withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    rows = sigs.select("doc_id", "n_shingles", "f1", "f2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    out = rows.join(single.unionByName(salted).drop("copies", "rep"), ["f1", "f2", "n_shingles", "salt"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    lost = docs.filter(F.col("doc_id").isNull()).mapInArrow(_signatures(width, percent), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")
    out = out.unionByName(lost.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns; equal rows of that document stay as they are."""
    gone = near_duplicates(docs, width, percent).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def oracle() -> str:
    """DuckDB SQL for shingles of three words and 85 percent: links by counted intersections, components by a recursive walk."""
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
rare AS (SELECT x, count(*) AS c FROM e GROUP BY x),
ranked AS (SELECT doc_id, e.x, row_number() OVER (PARTITION BY doc_id ORDER BY c, e.x) AS r FROM e JOIN rare USING (x)),
prefix AS (SELECT doc_id, x FROM ranked JOIN n USING (doc_id) WHERE r <= n_shingles - ceil(0.85 * n_shingles) + 1),
pairs AS (SELECT DISTINCT p.doc_id AS a, q.doc_id AS b FROM prefix p JOIN prefix q ON p.x = q.x AND p.doc_id < q.doc_id),
links AS (SELECT a, b FROM pairs JOIN e p ON p.doc_id = a JOIN e q ON q.doc_id = b AND p.x = q.x JOIN n m ON m.doc_id = a JOIN n k ON k.doc_id = b
          GROUP BY a, b, m.n_shingles, k.n_shingles HAVING 100 * count(*) >= 85 * (m.n_shingles + k.n_shingles - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
walk AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT w.a, l.b FROM walk w JOIN both_ways l ON l.a = w.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM walk GROUP BY a)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""
