"""Repeated passages by recompression: token runs and pairs are renamed round by round, the same everywhere.

A round renames maximal runs of one symbol, and pairs of neighbouring symbols whose fingerprint is larger than that of the
pairs overlapping them; a name is a 64-bit function of what it stands for. Whether symbols join depends on
their neighbours alone. So after LEVELS rounds equal passages consist of equal symbols except near their ends, and for each symbol
the span of words that determines it is known. Spark then names the symbols globally: it counts for every symbol
the first and the last document that holds it.

A window of WINDOW words that fully holds the determining span of a symbol which no earlier document has cannot start in an
earlier document, and is cleared; likewise one with a symbol that no later document has cannot be the source of a later one. The windows that remain (those in
shared passages, and the few that hold no determining span) are compared by 128-bit names of their
whole word sequence, so nothing depends on how well the rounds cut a text, and of 10**12 windows two different ones have one name with a chance of 10**-14. Documents whose whole word sequence an earlier one has are
the longest symbols of all: they are settled at the start and take no part in the rounds.

Defined results: null or blank text has no word and nothing is removed. Texts of fewer than WINDOW words lose nothing. Repeated rows of one
doc_id are no earlier document to each other; each gets the same result. A row whose doc_id is null is left as it is and is no source for others. Empty
tables give empty results. Words are compared byte for byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrays import U, Words, give_back, inverse, mix, pieces, powers, rolling
from graphloom.operators.spread import hot_keys, spread_join
from graphloom.session import materialise, release

WINDOW = 50
LEVELS = 4
#: Words of the longest symbol that pairing makes.
LONGEST = 16
#: The most ids of exact copies that are sent to every executor (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Parts among which the rows of one group of copies are dealt.
SALTS = 32
_FAR = 1 << 40
_A, _B = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)


def recompress(name: np.ndarray, text: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, text, low, high): the symbols after so many rounds, and the span of words low:high that determines each.

    ``name`` are word names of texts one after the other, ``text`` the texts they belong to. Spans that reach over a text's
    end are beyond all places.
    """
    n = len(name)
    sym, own = name.copy(), text
    size = np.ones(n, dtype=np.int64)
    low, high = np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64)
    for level in range(levels):
        n = len(sym)
        if n < 2:
            break
        same = own[1:] == own[:-1]
        equal = same & (sym[1:] == sym[:-1])
        pair = mix(sym[:-1] * _A + sym[1:] * _B + U(level)) | U(1)
        pair[equal | ~same | (size[1:] + size[:-1] > LONGEST)] = 0
        # pair[i] is about the gap between i and i + 1; outside the array there is none.
        before, after = np.concatenate([[U(0)], pair[:-1]]), np.concatenate([pair[1:], [U(0)]])
        by_left, by_right = before >= pair, after >= pair
        run_left, run_right = np.concatenate([[False], equal[:-1]]), np.concatenate([equal[1:], [False]])
        joined = equal | ((pair > 0) & ~by_left & ~by_right & ~run_left & ~run_right)
        head = np.flatnonzero(np.concatenate([[True], ~joined]))
        tail = np.concatenate([head[1:], [n]]) - 1
        # What a gap that stays open needs to be known: the next symbol, or the one after it too.
        shut = pair == 0
        near_right = shut | by_left | run_left
        near_left = shut | by_right | run_right
        reach = np.ones(n, dtype=np.int64)
        reach[:-1][~near_right] = 2
        to = tail + reach[tail]
        back = np.ones(n, dtype=np.int64)
        back[1:][~near_left] = 2
        frm = head - back[head]
        owner = own[head]
        ok_to = (to < n) & (own[np.minimum(to, n - 1)] == owner)
        ok_frm = (frm >= 0) & (own[np.maximum(frm, 0)] == owner)
        new_high = np.where(ok_to, high[np.minimum(to, n - 1)], _FAR)
        new_low = np.where(ok_frm, low[np.maximum(frm, 0)], -_FAR)
        low, high = np.minimum(new_low, low[head]), np.maximum(new_high, high[tail])
        count = tail - head + 1
        run = (count > 1) & (sym[head] == sym[tail])
        sym = np.where(count == 1, sym[head], np.where(run, mix(sym[head] * _B + count.astype(np.uint64)), mix(sym[head] * _A + sym[tail] * _B + U(0x51))))
        total = np.concatenate([[0], np.cumsum(size)])
        size = total[tail + 1] - total[head]
        own = owner
    return sym, own, low, high


def _parse(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols whose determining span fits a window, with their text."""
    sym, text, low, high = recompress(w.name, w.text_of())
    fits = high - low <= WINDOW
    return sym[fits], text[fits], low[fits], high[fits]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its number of words, a 128-bit name of its word sequence, and the digest of all its words."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in pieces(batch):
                w = Words(part.column(1))
                names, sha = [], []
                sums = [np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(w.name * m) * powers(base, len(w.name)))]) for m, base in ((_A, 0xE7037ED1A0B428DB), (_B, 0x8EBC6AF09C88C6E3))]
                for s, base in zip(sums, (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3), strict=True):
                    names.append(mix((s[w.first[1:]] - s[w.first[:-1]]) * powers(inverse(base), len(w.name) + 1)[w.first[:-1]]))
                for t in part.column(1):
                    sha.append(hashlib.sha256(b" ".join(t.as_py().encode().split()) if t.is_valid else b"").hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(w.first).astype(np.int64)), pa.array(_signed(names[0])), pa.array(_signed(names[1])), pa.array(sha, pa.string())], names=["doc_id", "n_words", "f1", "f2", "sha"])


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in pieces(batch):
                w = Words(part.column(1))
                sym, text, _, _ = _parse(w)
                order = np.lexsort((sym, text))
                sym, text = sym[order], text[order]
                new = np.ones(len(sym), dtype=bool)
                new[1:] = (sym[1:] != sym[:-1]) | (text[1:] != text[:-1])
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(sym[new])), pa.array(ids[text[new]])], names=["sym", "doc_id"])


def _holds(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """For each window start 0..n-WINDOW whether the window holds one of the spans."""
    count = n - WINDOW + 1
    delta = np.zeros(count + 1, dtype=np.int64)
    np.add.at(delta, np.clip(high - WINDOW, 0, count), 1)
    np.add.at(delta, np.clip(low + 1, 0, count), -1)
    return np.cumsum(delta)[:count] > 0


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document what is left to compare: names and places of windows that may repeat (q) or be repeated (t)."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in pieces(batch):
                w = Words(part.column(1))
                names, more = rolling(w.name, WINDOW), rolling(mix(w.name ^ _B), WINDOW, 0x8EBC6AF09C88C6E3)
                sym, text, low, high = _parse(w)
                bounds = np.searchsorted(text, np.arange(len(w.first)))
                rows: list[tuple] = []
                for k in range(part.num_rows):
                    a, b = int(w.first[k]), int(w.first[k + 1])
                    q = t = np.zeros(0, dtype=np.int64)
                    if b - a >= WINDOW:
                        s = slice(int(bounds[k]), int(bounds[k + 1]))
                        mine, lo, hi = _signed(sym[s]), low[s] - a, high[s] - a
                        shared = np.zeros(len(mine), dtype=np.int8)
                        if part.column(2)[k].is_valid:
                            found = part.column(2)[k].values
                            known, kinds = found.field(0).to_numpy(), found.field(1).to_numpy()
                            order = np.argsort(known)
                            known, kinds = known[order], kinds[order]
                            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                            shared = np.where(known[at] == mine, kinds[at], 0)
                        # kinds: 1 an earlier document has the symbol, 2 a later one has it, 3 both.
                        none_before, none_after = (shared & 1) == 0, (shared & 2) == 0
                        q = np.flatnonzero(~_holds(lo[none_before], hi[none_before], b - a))
                        t = np.flatnonzero(~_holds(lo[none_after], hi[none_after], b - a))
                    if len(q) or len(t):
                        text_k = part.column(1)[k].as_py() if len(q) else None
                        t = np.setdiff1d(t, q, assume_unique=True)
                        rows.append((part.column(0)[k].as_py(), text_k, _signed(names[a + q]), _signed(more[a + q]), q.astype(np.int32), _signed(names[a + t]), _signed(more[a + t])))
                if rows:
                    ids, txt, qh, q2, qp, th, t2 = zip(*rows, strict=True)
                    longs = lambda x: pa.array(x, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(txt, pa.string()), longs(qh), longs(q2), pa.array(qp, pa.list_(pa.int32())), longs(th), longs(t2)], names=["doc_id", "text", "q", "q2", "at", "t", "t2"]
                    )
        give_back()


def _removed(n: int, at: np.ndarray) -> np.ndarray:
    """Which of n words a window starting at one of the places covers."""
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, np.minimum(at + WINDOW, n), -1)
    return np.cumsum(delta)[:n] > 0


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, sha, kept = [], [], []
        for text, at in zip(batch.column(1), batch.column(2), strict=True):
            words = text.as_py().encode().split()
            gone = _removed(len(words), at.values.to_numpy())
            joined = b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g])
            removed.append(int(gone.sum()))
            sha.append(hashlib.sha256(joined).hexdigest())
            kept.append(joined.decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_removed", "kept_sha256", "kept_text"])


def copies(whole: DataFrame) -> DataFrame:
    """Distinct doc_id of the documents whose word sequence a document of smaller id has.

    Groups are counted first; their first members are then dealt SALTS times, so that the rows of one group meet them in many tasks.
    """
    groups = whole.filter("n_words > 0").groupBy("f1", "f2", "n_words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    salted = materialise(groups, "groups").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = whole.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, ["f1", "f2", "n_words", "salt"]).filter(F.col("first") < F.col("doc_id")).select("doc_id").distinct()


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for each row of ``docs`` (doc_id, text).

    A word goes if a window of WINDOW words that covers it also starts in a document of smaller id. kept_text is null where
    nothing goes, and else the words that are left, joined by spaces.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    whole = materialise(docs.mapInArrow(_whole, "doc_id long, n_words long, f1 long, f2 long, sha string"), "whole")
    again = materialise(copies(whole.filter(F.col("doc_id").isNotNull())), "copies")
    known = docs.filter(F.col("doc_id").isNotNull())
    own = known.join(F.broadcast(again) if again.count() <= BROADCAST_IDS else again, "doc_id", "left_anti").select("doc_id", "text")
    held = own.mapInArrow(_symbols, "sym long, doc_id long")
    shared = materialise(held.groupBy("sym").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("first < last"), "shared")
    kinds = (F.when(F.col("first") < F.col("doc_id"), 1).otherwise(0) + F.when(F.col("last") > F.col("doc_id"), 2).otherwise(0)).cast("byte")
    hot = hot_keys(shared, ["sym"], "n")
    mine = spread_join(held, shared.drop("n"), ["sym"], hot=hot).groupBy("doc_id").agg(F.collect_set(F.struct("sym", kinds.alias("kind"))).alias("shared"))
    suspects = materialise(own.join(mine, "doc_id", "left").select("doc_id", "text", "shared").mapInArrow(_suspects, "doc_id long, text string, q array<long>, q2 array<long>, at array<int>, t array<long>, t2 array<long>"), "suspects")
    release(shared)
    q = suspects.select("doc_id", F.explode(F.arrays_zip("q", "q2", "at")).alias("x")).select("doc_id", F.col("x.q").alias("w"), F.col("x.q2").alias("w2"), F.col("x.at").alias("at"))
    t = suspects.select("doc_id", F.explode(F.arrays_zip("t", "t2")).alias("x")).select("doc_id", F.col("x.t").alias("w"), F.col("x.t2").alias("w2"))
    first = materialise(q.select("doc_id", "w", "w2").union(t).groupBy("w", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("first < last").select("w", "w2", "first", "n"), "first")
    gone = spread_join(q, first.drop("n"), ["w", "w2"], hot=hot_keys(first, ["w", "w2"], "n")).filter(F.col("first") < F.col("doc_id")).groupBy("doc_id").agg(F.collect_set("at").alias("gone"))
    changed = suspects.filter(F.col("text").isNotNull()).select("doc_id", "text").dropDuplicates(["doc_id"]).join(gone, "doc_id").select("doc_id", "text", "gone")
    cut = changed.mapInArrow(_finish, "doc_id long, n_removed long, kept_sha256 string, kept_text string")
    empty = again.select("doc_id", F.lit(True).alias("copy"))
    all_gone = F.coalesce(F.col("copy"), F.lit(False)) & (F.col("n_words") >= WINDOW)
    return (
        whole.select("doc_id", "n_words", "sha")
        .join(cut.unionByName(empty, allowMissingColumns=True), "doc_id", "left")
        .select(
            "doc_id",
            "n_words",
            F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
            F.when(all_gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        )
    )


def oracle() -> str:
    """DuckDB SQL: every window's text by list slices, the smallest document of each, and the words they cover."""
    return rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW}),
h AS (SELECT p.doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM p JOIN w USING (doc_id)),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT DISTINCT doc_id, i + unnest(range({WINDOW})) AS j FROM h JOIN f USING (h) WHERE first < doc_id),
x AS (SELECT doc_id, list(j) AS js FROM g GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda v, k: NOT list_contains(js, k)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN x USING (doc_id)
"""
