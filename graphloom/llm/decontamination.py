"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

A text's words are cut at white space and freed of punctuation at both ends. A word with a digit is ``#n``, a word
that starts with a capital is ``#p``, a word of UNITS is ``#u``, any other is itself in lower case. WIDTH such tokens in
a row are a template window; a window with fewer than two plain words says too little and is keyed by its original
words instead, in lower case. Windows of the documents are hash-joined with those of the benchmark. A few windows of each item,
which no document that shows enough of the item can lack, pick the documents to look at; of these all windows are joined.

Matches of one document and item are grouped by their offset (place in document less place in item): that is one
copy of the item. In it every filler of a slot must stand for one filler only; ``3 pens ... 3 pens`` may become
``5 pens ... 5 pens`` but not ``5 pens ... 7 pens``. Windows of consistent copies are united over offsets, so that inserted or deleted words
do not hide an item, and an item that shows SHARE of its windows is reported. In a short item one word is in so many windows that
a change does hide it, and so does quoting a part or changing capitals; decontaminate() therefore also takes documents that
quote a run of an item's words (see quoted()).

Defined results: null or short texts (fewer than WIDTH words) on either side have no window and are never reported.
Repeated rows give the same pairs once per (doc_id, item_id). Empty tables give an empty result. Only the named
columns of either table are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm import bloom
from graphloom.session import materialise

WIDTH = 5
SHARE = 0.8
#: Words in a row, capitals aside, that make a quotation; half of the item's words where that is less, WIDTH at least.
RUN = 8
#: Words that are units of measure wherever they stand.
UNITS = ("kg", "km", "cm", "mm", "ml", "mg", "lb", "lbs", "ft", "mph", "kmh", "usd", "eur", "gb", "mb", "hz", "khz", "mhz", "kwh", "hours", "minutes", "seconds", "meters", "metres", "kilometers", "miles", "dollars", "euros", "percent")
PUNCTUATION = ".,;:!?\"'()[]{}<>*_#$%&|"
#: The most benchmark windows that are sent to every executor; more are joined by a shuffle.
BROADCAST_WINDOWS = 100_000
#: The most ids of candidate documents that are sent to every executor (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: The most anchor words that stand in the plan as a set; more are held in a filter, and beyond its limit all words are looked at.
SET_ANCHORS = 20_000
RATE = 1e-3


def words_of(text: Column) -> Column:
    """Words at white space, without punctuation at their ends; words of punctuation alone are dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: F.call_function("btrim", w, F.lit(PUNCTUATION))), lambda w: w != "")


def template(words: Column) -> Column:
    """The words with numbers, names and units replaced by placeholders."""
    units = F.array(*map(F.lit, UNITS))

    def one(w: Column) -> Column:
        plain = F.lower(w)
        return F.when(F.rlike(w, F.lit("[0-9]")), "#n").when(F.rlike(w, F.lit(r"^\p{Lu}")), "#p").when(F.array_contains(units, plain), "#u").otherwise(plain)

    return F.transform(words, one)


def _windows_of(words: DataFrame, key: str) -> DataFrame:
    """A row (key, at, window, words, tokens) for each template window of a column ``_w`` of words.

    A window's text is its tokens, or its words in lower case behind ``=`` where fewer than two tokens are plain.
    """
    # Generators stand between the steps: a projection would be merged into the lambdas and evaluated for each element.
    t = words.filter(F.size("_w") >= WIDTH).select(key, "_w", F.explode(F.array(template(F.col("_w")))).alias("_t"))
    steps = range(WIDTH)
    shifted = [F.slice(F.col(c), F.lit(j + 1), F.size("_t") - (WIDTH - 1)).alias(f"{c}{j}") for c in ("_t", "_w") for j in steps]

    def window(x: Column) -> Column:
        slots = sum((F.startswith(x[f"_t{j}"], F.lit("#")).cast("int") for j in steps), F.lit(0))
        text = F.when(slots <= WIDTH - 2, F.concat_ws(" ", *[x[f"_t{j}"] for j in steps])).otherwise(F.concat(F.lit("="), F.lower(F.concat_ws(" ", *[x[f"_w{j}"] for j in steps]))))
        return F.struct(text.alias("window"), F.array(*[x[f"_w{j}"] for j in steps]).alias("words"), F.array(*[x[f"_t{j}"] for j in steps]).alias("tokens"))

    found = t.select(key, F.posexplode(F.transform(F.arrays_zip(*shifted), window)).alias("at", "_x"))
    return found.select(key, "at", "_x.window", "_x.words", "_x.tokens")


def windows(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row (key, at, window, words, tokens) for each template window of a text."""
    return _windows_of(df.select(F.col(key), F.explode(F.array(words_of(F.col(text)))).alias("_w")), key)


def anchors(items: DataFrame, share: float = SHARE) -> DataFrame:
    """A row (item_id, window, anchor) for a few windows of each item, with the longest plain word of each.

    An item has n windows; a document that shows ``share`` of them lacks at most n - share * n. So of any
    n - share * n + 1 windows it shows one at least. Those with the longest anchors are taken: long words are rare.
    """
    plain = F.when(F.startswith("window", F.lit("=")), F.split(F.substring("window", 2, 1 << 30), " ")).otherwise(F.filter(F.split("window", " "), lambda x: ~F.startswith(x, F.lit("#"))))
    longest = F.array_max(F.transform(plain, lambda x: F.struct(F.length(x).alias("n"), x.alias("word"))))
    per_item = W.partitionBy("item_id")
    return (
        items.withColumn("_a", longest)
        .withColumn("_rank", F.row_number().over(per_item.orderBy(F.desc("_a.n"), F.desc("_a.word"), "item_at")))
        .withColumn("_n", F.count(F.lit(1)).over(per_item))
        .filter(F.col("_rank") <= F.col("_n") - F.ceil(share * F.col("_n")) + 1)
        .select("item_id", "window", F.col("_a.word").alias("anchor"))
    )


def _plain_windows_of(words: DataFrame, key: str) -> DataFrame:
    """A row (key, at, window) for each WIDTH words in a row of a column ``_w``, in lower case."""
    t = words.filter(F.size("_w") >= WIDTH).select(key, F.explode(F.array(F.transform("_w", F.lower))).alias("_t"))
    shifted = [F.slice("_t", F.lit(j + 1), F.size("_t") - (WIDTH - 1)).alias(f"_t{j}") for j in range(WIDTH)]
    text = F.transform(F.arrays_zip(*shifted), lambda x: F.concat_ws(" ", *[x[f"_t{j}"] for j in range(WIDTH)]))
    return t.select(key, F.posexplode(text).alias("at", "window"))


def _run_of(size: Column) -> Column:
    return F.greatest(F.lit(WIDTH), F.least(F.lit(RUN), F.floor(size / 2))).cast("int")


def quoted(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row (doc_id, item_id, n_words) for each document that quotes a run of an item's words, with the length of the longest run.

    A run is RUN words (see there) that stand in a row on both sides, capitals aside. Each run of an item holds an anchor, its longest word; documents without an
    anchor are not looked at.
    """
    docs = docs.select("doc_id", "text")
    words = benchmark.select("item_id", "text").dropDuplicates(["item_id", "text"]).select("item_id", F.explode(F.array(words_of(F.col("text")))).alias("_w")).filter(F.size("_w") >= WIDTH)
    # Texts of one item_id stay apart, so that windows of two of them make no run.
    words = materialise(words.select(F.struct("item_id", F.xxhash64("_w").alias("h")).alias("item"), "_w", _run_of(F.size("_w")).alias("run")), "item-words")
    items = materialise(_plain_windows_of(words, "item").join(words.select("item", "run"), "item").withColumnRenamed("at", "item_at"), "item-windows")
    few = items.count() <= BROADCAST_WINDOWS
    longest = lambda w: F.array_max(F.transform(w, lambda x: F.struct(F.length(x).alias("n"), F.lower(x).alias("word"))))["word"]
    chosen = words.select("item", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("run") + 1), lambda i: longest(F.slice("_w", i, F.col("run")))))).alias("anchor"))
    chosen = chosen.join(items.select("item", "window"), "item").filter(F.array_contains(F.split("window", " "), F.col("anchor"))).select("window", "anchor")
    ids = materialise(candidates(docs, materialise(chosen, "item-anchors"), _plain_windows_of), "quoting")
    near = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi").select("doc_id", F.explode(F.array(words_of(F.col("text")))).alias("_w"))
    # Rows of one doc_id stay apart as well.
    near = near.select(F.struct("doc_id", F.xxhash64("_w").alias("h")).alias("doc"), "_w")
    pairs = _plain_windows_of(near, "doc").join(F.broadcast(items) if few else items, "window")
    places = pairs.select("doc", "item", "run", (F.col("at") - F.col("item_at")).alias("offset"), "item_at").distinct()
    rank = F.row_number().over(W.partitionBy("doc", "item", "offset").orderBy("item_at"))
    rows = places.withColumn("_island", F.col("item_at") - rank).groupBy("doc", "item", "run", "offset", "_island").agg((F.count(F.lit(1)) + (WIDTH - 1)).alias("n_words"))
    return rows.filter("n_words >= run").groupBy("doc.doc_id", "item.item_id").agg(F.max("n_words").alias("n_words"))


def candidates(docs: DataFrame, chosen: DataFrame, windows_of=_windows_of) -> DataFrame:
    """Distinct doc_id of the documents that show a window of ``chosen`` (see :func:`anchors`), as ``windows_of`` makes them.

    The words of a document are tested once against the anchors; only around a hit are windows made.
    """
    words = materialise(chosen.select("anchor").distinct(), "anchors")
    count = words.count()
    t = docs.select("doc_id", F.explode(F.array(words_of(F.col("text")))).alias("_w")).filter(F.size("_w") >= WIDTH)
    hits = F.transform("_w", lambda w, i: F.struct(F.lower(w).alias("w"), i.alias("i")))
    if count <= SET_ANCHORS:
        held = sorted(r["anchor"] for r in words.collect())
        hits = F.filter(hits, lambda x: x["w"].isin(held))
    elif bloom.filter_bytes(count, RATE) <= bloom.MAX_FILTER_BYTES:
        seen = bloom.build(words, "anchor", count, RATE)
        hits = F.filter(hits, lambda x: seen.test(x["w"]))
    t = t.select("doc_id", "_w", F.explode(F.array(F.transform(hits, lambda x: x["i"]))).alias("_h")).filter(F.size("_h") > 0)
    first = lambda h: F.greatest(F.lit(0), h - (WIDTH - 1))
    around = F.transform("_h", lambda h: F.slice("_w", first(h) + 1, h + WIDTH - first(h)))
    near = t.select("doc_id", F.explode(around).alias("_w"))
    found = windows_of(near, "doc_id").select("doc_id", "window")
    held = materialise(chosen.select("window").distinct(), "chosen")
    return found.join(F.broadcast(held) if held.count() <= BROADCAST_WINDOWS else held, "window", "left_semi").select("doc_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """A row (doc_id, item_id, n_item_windows, n_matched) for each document that shows ``share`` of an item's windows.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text.
    """
    docs = docs.select("doc_id", "text")
    items = windows(benchmark.select("item_id", "text").dropDuplicates(["item_id", "text"]), "item_id", "text")
    items = materialise(items.select("item_id", F.col("at").alias("item_at"), "window", F.col("words").alias("item_words")), "items")
    few = items.count() <= BROADCAST_WINDOWS
    ids = materialise(candidates(docs, anchors(items, share)), "candidates")
    chosen = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    pairs = windows(chosen, "doc_id", "text").join(F.broadcast(items) if few else items, "window")
    # Fillers of the slots: (item's word, document's word), case aside.
    fillers = F.filter(
        F.transform(F.arrays_zip(F.col("tokens"), F.col("item_words"), F.col("words")), lambda x: F.when(F.startswith(x["tokens"], F.lit("#")), F.struct(F.lower(x["item_words"]).alias("i"), F.lower(x["words"]).alias("d")))),
        lambda x: x.isNotNull(),
    )
    copies = (
        pairs.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("offset"), "item_at", fillers.alias("fillers"))
        .groupBy("doc_id", "item_id", "offset")
        .agg(F.collect_set("item_at").alias("ats"), F.array_distinct(F.flatten(F.collect_set("fillers"))).alias("fillers"))
        .filter(F.size("fillers") == F.size(F.array_distinct(F.transform("fillers", lambda x: x["i"]))))
    )
    sizes = items.groupBy("item_id").agg(F.countDistinct("item_at").cast("long").alias("n_item_windows"))
    shown = copies.groupBy("doc_id", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("long").alias("n_matched"))
    return shown.join(sizes, "item_id").filter(F.col("n_matched") >= share * F.col("n_item_windows")).select("doc_id", "item_id", "n_item_windows", "n_matched")


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents without those that :func:`contaminated` or :func:`quoted` reports; all columns stay, and so do rows whose id is null."""
    bad = contaminated(docs, benchmark, share).select("doc_id").union(quoted(docs, benchmark).select("doc_id")).distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL for :func:`contaminated`."""
    punctuation = PUNCTUATION.replace("'", "''")
    units = ", ".join(f"'{u}'" for u in UNITS)

    def side(name: str, key: str, source: str) -> str:
        return f"""
{name}_w AS (SELECT {key}, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: trim(w, '{punctuation}')), lambda w: w <> '') AS w FROM {source}),
{name}_t AS (SELECT {key}, w, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '#n' WHEN regexp_matches(x, '^\\p{{Lu}}') THEN '#p'
             WHEN lower(x) IN ({units}) THEN '#u' ELSE lower(x) END) AS t FROM {name}_w),
{name}_p AS (SELECT {key}, w, t, unnest(range(len(t) - {WIDTH - 1})) AS p FROM {name}_t WHERE len(t) >= {WIDTH}),
{name} AS (SELECT {key}, p, w[p + 1:p + {WIDTH}] AS ws, t[p + 1:p + {WIDTH}] AS ts,
           CASE WHEN len(list_filter(t[p + 1:p + {WIDTH}], lambda x: starts_with(x, '#'))) <= {WIDTH - 2} THEN array_to_string(t[p + 1:p + {WIDTH}], ' ')
           ELSE '=' || lower(array_to_string(w[p + 1:p + {WIDTH}], ' ')) END AS k FROM {name}_p)"""

    return f"""
WITH {side("d", "doc_id", docs)}, {side("b", "item_id", "benchmark")},
m AS (SELECT doc_id, item_id, d.p - b.p AS o, b.p AS i, unnest(range(1, {WIDTH + 1})) AS j, d.ts, d.ws AS dw, b.ws AS iw FROM d JOIN b USING (k)),
s AS (SELECT doc_id, item_id, o, i, CASE WHEN starts_with(ts[j], '#') THEN lower(iw[j]) END AS x, CASE WHEN starts_with(ts[j], '#') THEN lower(dw[j]) END AS y FROM m),
bad AS (SELECT DISTINCT doc_id, item_id, o FROM (SELECT doc_id, item_id, o FROM s WHERE x IS NOT NULL GROUP BY doc_id, item_id, o, x HAVING count(DISTINCT y) > 1)),
n AS (SELECT item_id, count(*) AS n_item_windows FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_item_windows, count(DISTINCT i) AS n_matched
FROM s ANTI JOIN bad USING (doc_id, item_id, o) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item_windows
HAVING count(DISTINCT i) >= {SHARE} * n_item_windows
"""
