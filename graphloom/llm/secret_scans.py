"""Secret scans: three patterns, and strings of high entropy in any sliding window.

Spans are code points, end exclusive. A pattern's matches are the leftmost ones that do not overlap, found by one
``regexp_extract_all``; their places follow from the pieces that ``split`` leaves between them.

The entropy method looks at maximal runs of token characters that hold a digit and a letter. A window of
WINDOW characters slides over each; the counts of its characters are kept, those of the entering and the leaving one change, and with them the sum of
c log2 c; and the largest Shannon entropy of any window is held against the threshold of the run's character class
(hexadecimal, alphanumeric, or base64). Runs that the allow-list knows (UUIDs, dates, words such as EXAMPLE) and runs
that touch a pattern's span are passed over. Masking is stricter: there a run counts unless the patterns' spans cover all of it,
and a run that the allow-list knows counts if it is still suspicious without its known pieces (KNOWN).

Defined results: null text counts as empty and has no span. Ties in start are ordered by kind (assign, access, hex,
entropy). Repeated rows are scanned alike; an empty table gives an empty result. A scan replaces columns that bear the name of a result; masking keeps
every column of any name. Texts with many matches take time in proportion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
_KEY = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Runs that may be secrets by entropy.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits in some window of WINDOW characters, by class of the whole run.
THRESHOLDS = {"hex": 3.05, "alnum": 3.65, "base64": 3.75}
#: Runs that are never secrets: UUIDs, dates, placeholders, runs of words joined by signs.
ALLOW = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    "|^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    "|[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Dd][Uu][Mm][Mm][Yy]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]"
    "|0123456789|ABCDEFGHIJ|abcdefghij"
    "|^[0-9]*[-/_=+]?[A-Z]?[a-z]+([-/_=+][A-Z]?[a-z]+)*[-/_=+]?[0-9]*$"
)
#: Pieces of a run that are left out before the rest is looked at in masking: UUIDs, dates with a time, and what stands between signs and holds a placeholder.
KNOWN = (
    "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    "|(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])(T[0-9]{2}[0-9_-]*Z?(?![0-9A-Za-z]))?"
    "|[0-9A-Za-z]*([Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Dd][Uu][Mm][Mm][Yy]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|0123456789|ABCDEFGHIJ|abcdefghij)[0-9A-Za-z]*"
)
_SPAN = "struct<start:int,rank:int,end:int>"
#: Items that a fold works on before what it has put out is set aside: appending copies, so it is done to short arrays only.
CHUNK = 256


def running(items: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """struct(acc, out): a fold over an array that puts out ``emit(acc, item)``, of type ``kind``, before each ``step``; ``start`` must be a struct.

    The array is folded in chunks whose outputs are joined at the end, so time grows with its length and not with the square of it.
    """
    none = F.array().cast(f"array<{kind}>")

    def inner(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["acc"], x).alias("acc"), F.concat(acc["out"], F.array(emit(acc["acc"], x))).alias("out"))

    def outer(acc: Column, chunk: Column) -> Column:
        found = F.aggregate(chunk, F.struct(acc["acc"].alias("acc"), none.alias("out")), inner)
        # Evaluated once: a lambda's variable stands for it.
        return F.transform(F.array(found), lambda x: F.struct(x["acc"].alias("acc"), F.concat(acc["out"], F.array(x["out"])).alias("out")))[0]

    def folded(whole: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / CHUNK).cast("int")), lambda c: F.slice(whole, c * CHUNK + 1, F.lit(CHUNK)))
        return F.aggregate(chunks, F.struct(start.alias("acc"), F.array().cast(f"array<array<{kind}>>").alias("out")), outer, lambda acc: F.struct(acc["acc"].alias("acc"), F.flatten(acc["out"]).alias("out")))

    return F.when(F.size(items) > 0, F.transform(F.array(items), folded)[0]).otherwise(F.struct(start.alias("acc"), none.alias("out")))


def _placed(text: Column, found: Column, pattern: str) -> Column:
    """Array of struct(start, end, match) for the matches ``found`` of the pattern."""
    kind = "struct<start:int,end:int,match:string>"
    parts = F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"))
    lengths = F.transform(parts, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("n"), x["m"].alias("match")))
    place = running(
        lengths,
        F.struct(F.lit(0).alias("at")),
        lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at")),
        lambda acc, x: F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end"), x["match"].alias("match")),
        kind,
    )
    return F.when(F.size(found) > 0, place["out"]).otherwise(F.array().cast(f"array<{kind}>"))


def _spans(placed: Column, rank: int) -> Column:
    return F.transform(placed, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))


#: Counts of a window are kept five bits each, twelve to a number; characters of a run are numbered from FIRST on.
_BITS, _EACH, _FIRST = 5, 12, 43
_NUMBERS = (122 - _FIRST) // _EACH + 1


def window_entropy(run: Column, width: int = WINDOW) -> Column:
    """Largest Shannon entropy in bits of any ``width`` (31 at most) characters in a row; 0 for shorter runs. Characters must be of CANDIDATE.

    The state holds how often each character stands in the window, the sum of c log2 c over these counts, and the best so far. A step
    raises the count of the entering character and lowers that of the leaving one, and adds what this does to the sum.
    """

    def clog(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def place(ch: Column) -> Column:
        k = F.ascii(ch) - _FIRST
        return F.struct(F.floor(k / _EACH).cast("int").alias("word"), (_BITS * F.pmod(k, F.lit(_EACH))).cast("int").alias("shift"))

    def count(counts: Column, p: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, p["word"]), p["shift"]).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long"))

    def changed(counts: Column, p: Column, by: int) -> Column:
        return F.transform(counts, lambda x, i: F.when(i == p["word"], x + F.lit(by) * F.call_function("shiftleft", F.lit(1).cast("long"), p["shift"])).otherwise(x))

    def step(acc: Column, x: Column) -> Column:
        full = x["i"] >= width
        had = count(acc["counts"], x["gone"])
        left = acc["s"] - F.when(full, clog(had) - clog(had - 1)).otherwise(F.lit(0.0))
        kept = F.when(full, changed(acc["counts"], x["gone"], -1)).otherwise(acc["counts"])
        return F.transform(F.array(kept), lambda k: enter(k, left, acc["b"], x))[0]

    def enter(counts: Column, left: Column, best: Column, x: Column) -> Column:
        now = count(counts, x["come"])
        total = left + clog(now + 1) - clog(now)
        bits = F.log2(F.lit(float(width))) - total / width
        return F.struct(changed(counts, x["come"], 1).alias("counts"), total.alias("s"), F.when(x["i"] >= width - 1, F.greatest(best, bits)).otherwise(best).alias("b"))

    def best(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.struct(i.alias("i"), p.alias("come"), F.get(places, F.greatest(F.lit(0), i - width)).alias("gone")))
        zeros = F.array(*[F.lit(0).cast("long")] * _NUMBERS)
        start = F.struct(zeros.alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("b"))
        return F.aggregate(steps, start, step, lambda acc: acc["b"])

    return F.transform(F.array(F.transform(F.split(run, ""), place)), best)[0]


def _suspicious(run: Column) -> Column:
    limit = (
        F.when(F.rlike(run, F.lit("^[0-9a-fA-F]+$")), F.lit(THRESHOLDS["hex"]))
        .when(F.rlike(run, F.lit("^[0-9A-Za-z]+$")), F.lit(THRESHOLDS["alnum"]))
        .otherwise(F.lit(THRESHOLDS["base64"]))
    )
    mixed = F.rlike(run, F.lit("[0-9]")) & F.rlike(run, F.lit("[A-Za-z]"))
    # The conditions are nested so that the costly one is reached by few runs.
    return F.when(mixed, F.when(~F.rlike(run, F.lit(ALLOW)), window_entropy(run) >= limit).otherwise(False)).otherwise(False)


def _suspicious_without_known(run: Column) -> Column:
    """:func:`_suspicious`, or the same of what KNOWN leaves of the run."""
    rest = F.call_function("btrim", F.regexp_replace(run, KNOWN, ""), F.lit("-/_=+"))
    return F.when(_suspicious(run), True).when(F.rlike(run, F.lit(ALLOW)), F.when(F.length(rest) >= WINDOW, _suspicious(rest)).otherwise(False)).otherwise(False)


def _joined(spans: Column) -> Column:
    """Spans in order of start, with those that overlap or touch made one."""
    two = lambda a, b: F.struct(a.cast("int").alias("start"), F.lit(0).alias("rank"), b.cast("int").alias("end"))
    found = running(
        spans,
        two(F.lit(-2), F.lit(-2)),
        lambda acc, x: F.when(x["start"] <= acc["end"], two(acc["start"], F.greatest(acc["end"], x["end"]))).otherwise(two(x["start"], x["end"])),
        lambda acc, x: F.when(x["start"] > acc["end"], acc),
        _SPAN,
    )
    return F.transform(F.array(found), lambda f: F.filter(F.concat(f["out"], F.array(f["acc"])), lambda x: x["start"] >= 0))[0]


def _free(runs: Column, base: Column, whole: bool) -> Column:
    """The runs that no base span touches; with ``whole`` those that base spans do not cover all of. Both are in order of start.

    Base spans are made disjoint and put in one order with the runs, so a run has to do with the one before and the one behind it alone.
    """
    kind = "struct<start:int,rank:int,end:int,before:int>"
    order = F.array_sort(F.concat(_joined(base), runs))
    ahead = running(
        order,
        F.struct(F.lit(-1).alias("end")),
        lambda acc, x: F.when(x["rank"] == 0, F.struct(x["end"].alias("end"))).otherwise(acc),
        lambda acc, x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), acc["end"].alias("before")),
        kind,
    )["out"]
    if whole:
        return F.transform(F.filter(ahead, lambda x: (x["rank"] > 0) & (x["before"] < x["end"])), lambda x: x.dropFields("before"))
    behind = running(
        F.reverse(ahead),
        F.struct(F.lit((1 << 31) - 1).alias("start")),
        lambda acc, x: F.when(x["rank"] == 0, F.struct(x["start"].alias("start"))).otherwise(acc),
        lambda acc, x: F.when((x["rank"] > 0) & (x["before"] <= x["start"]) & (acc["start"] >= x["end"]), x.dropFields("before")),
        _SPAN,
    )["out"]
    return F.reverse(F.filter(behind, lambda x: x.isNotNull()))


def _scanned(texts: DataFrame, whole: bool) -> DataFrame:
    """``texts`` (_row, _t: no null) with _base_spans, _spans and the counts _n_assign, _n_access, _n_hex."""
    suspicious = _suspicious_without_known if whole else _suspicious
    t, none = F.col("_t"), F.array().cast(f"array<{_SPAN}>")
    found = texts.select("_row", "_t", *[F.regexp_extract_all(t, F.lit(p), F.lit(0)).alias(c) for c, p in (("_assign", ASSIGN), ("_access", ACCESS), ("_hex", HEX), ("_run", CANDIDATE))])
    assign = F.filter(_placed(t, F.col("_assign"), ASSIGN), lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 6)
    # Only texts with a run that looks like a secret are split for its place.
    runs = F.when(F.exists("_run", suspicious), _spans(F.filter(_placed(t, F.col("_run"), CANDIDATE), lambda x: suspicious(x["match"])), 3)).otherwise(none)
    placed = found.select("_row", "_t", _spans(assign, 0).alias("_a"), _spans(_placed(t, F.col("_access"), ACCESS), 1).alias("_k"), _spans(_placed(t, F.col("_hex"), HEX), 2).alias("_h"), runs.alias("_runs"))
    counts = [F.size(c).cast("long").alias(n) for c, n in (("_a", "_n_assign"), ("_k", "_n_access"), ("_h", "_n_hex"))]
    base = placed.select("_row", "_t", "_runs", *counts, F.array_sort(F.concat("_a", "_k", "_h")).alias("_base_spans"))
    free = F.when(F.size("_runs") == 0, none).when(F.size("_base_spans") == 0, F.col("_runs")).otherwise(_free(F.col("_runs"), F.col("_base_spans"), whole))
    return base.select("_row", "_t", "_base_spans", "_n_assign", "_n_access", "_n_hex", free.alias("_free")).withColumn("_spans", F.array_sort(F.concat("_base_spans", "_free")))


def _texts(df: DataFrame, text: str) -> DataFrame:
    """The whole row as one column and the text as another, so no column of the input clashes with those made here."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_t"))


def scan(df: DataFrame, text: str = "text", whole: bool = False) -> DataFrame:
    """Adds base_spans and spans (arrays of struct(start, rank, end), in order), n_assign, n_access, n_hex and n_entropy; columns of these names are replaced.

    With ``whole``, runs that base spans cover in part only, and runs with a known piece in them, count as well.
    """
    made = {"base_spans": "_base_spans", "spans": "_spans", "n_assign": "_n_assign", "n_access": "_n_access", "n_hex": "_n_hex"}
    out = [F.col(c).alias(n) for n, c in made.items()] + [F.size("_free").cast("long").alias("n_entropy")]
    return _scanned(_texts(df, text), whole).select(*[F.col("_row")[c].alias(c) for c in df.columns if c.lower() not in {*made, "n_entropy"}], *out)


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(df: DataFrame) -> DataFrame:
    """The registered query's columns, from ``documents``."""
    s = scan(df.select("doc_id", "text"))
    return s.select("doc_id", "n_assign", "n_access", "n_hex", "n_entropy", F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(df: DataFrame, text: str = "text", mark: str = "[REDACTED]", length: str | None = None) -> DataFrame:
    """Every span of the text replaced by ``mark`` (spans that overlap by one); texts without one stay as they are, and so do all other columns, whatever their names.

    ``length`` names a column that holds the text's length: it is counted anew where the text has changed.
    """
    s, kind = _scanned(_texts(df, text), whole=True), "struct<start:int,end:int>"

    def masked(raw: Column) -> Column:
        # Four bytes a character, so that a piece is found without counting from the start.
        piece = lambda a, b: F.decode(F.substring(raw, 4 * a + 1, 4 * (b - a)), "UTF-32")
        gaps = running(
            F.col("_spans"),
            F.struct(F.lit(0).alias("at")),
            lambda acc, x: F.struct(F.greatest(acc["at"], x["end"]).alias("at")),
            lambda acc, x: F.when(x["start"] >= acc["at"], F.struct(acc["at"].alias("start"), x["start"].alias("end"))),
            kind,
        )
        kept = lambda g: F.transform(F.filter(g["out"], lambda x: x.isNotNull()), lambda x: piece(x["start"], x["end"]))
        rest = lambda g: piece(g["acc"]["at"], F.octet_length(raw) / 4)
        return F.transform(F.array(gaps), lambda g: F.array_join(F.concat(kept(g), F.array(rest(g))), mark))[0]

    hit = F.size("_spans") > 0
    s = s.select("_row", F.when(hit, F.transform(F.array(F.encode("_t", "UTF-32")), masked)[0]).alias("_masked"))
    new = {text.lower(): F.coalesce("_masked", F.col("_row")[text])}
    if length:
        new[length.lower()] = F.coalesce(F.length("_masked").cast(df.schema[length].dataType), F.col("_row")[length])
    return s.select(*[new.get(c.lower(), F.col("_row")[c]).alias(c) for c in df.columns])


def _sql_quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_kind(kind: str, pattern: str, rank: int, keep: str) -> str:
    """Places from the lengths of pieces and matches, summed by a window over the unnested list."""
    p = _sql_quote(pattern)
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s AS start, s + length(m) AS stop, m AS found FROM (
    SELECT doc_id, m, v, (sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m))::BIGINT AS s FROM (
      SELECT doc_id, unnest(ms) AS m, unnest(vs) AS v, unnest(gaps) AS gap, unnest(range(len(ms))) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, {p}) AS ms, {"regexp_extract_all(t, " + p + ", 2)" if kind == "assign" else "regexp_extract_all(t, " + p + ")"} AS vs,
               string_split_regex(t, {p})[1:len(regexp_extract_all(t, {p}))] AS gaps FROM d)))
  WHERE {keep}"""


def oracle() -> str:
    """DuckDB SQL for :func:`digest`: entropy is computed afresh for every window."""
    t = THRESHOLDS
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_sql_kind("assign", ASSIGN, 0, "length(v) >= 6")} UNION ALL {_sql_kind("access", "AKIA[A-Z0-9]+", 1, "length(m) >= 20")} UNION ALL {_sql_kind("hex", "[0-9a-f]+", 2, "length(m) >= 24")}),
runs AS (SELECT * FROM ({_sql_kind("entropy", CANDIDATE, 3, "true")}) WHERE regexp_matches(found, '[0-9]') AND regexp_matches(found, '[A-Za-z]')
         AND NOT regexp_matches(found, {_sql_quote(ALLOW)})),
scored AS (SELECT *, list_max(list_transform(range(1, length(found) - {WINDOW} + 2), lambda i: list_entropy(string_split(substr(found, i, {WINDOW}), '')))) AS bits FROM runs),
high AS (SELECT doc_id, rank, kind, start, stop, found FROM scored s WHERE bits >= CASE WHEN regexp_matches(found, '^[0-9a-fA-F]+$') THEN {t["hex"]}
         WHEN regexp_matches(found, '^[0-9A-Za-z]+$') THEN {t["alnum"]} ELSE {t["base64"]} END
         AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.start < s.stop AND s.start < b.stop)),
b AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS w FROM base GROUP BY doc_id),
a AS (SELECT doc_id, count(*) FILTER (rank = 3) AS n_entropy, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS w
      FROM (SELECT * FROM base UNION ALL SELECT * FROM high) GROUP BY doc_id)
SELECT d.doc_id, coalesce(b.n_assign, 0) AS n_assign, coalesce(b.n_access, 0) AS n_access, coalesce(b.n_hex, 0) AS n_hex, coalesce(a.n_entropy, 0) AS n_entropy,
       sha256(coalesce(b.w, '')) AS base_sha256, coalesce(a.w, '') AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""
