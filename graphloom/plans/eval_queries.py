"""Queries on labelled data: lenient JSON lines, truth sets, matching and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import evaluate as E
from graphloom.session import table
from graphloom.sources.files import labelled_rows, lenient
from graphloom.sources.files import truth_entities as entities_of
from graphloom.sources.sinks import report_details, report_lines


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """A JSON line for each event: most with an entry or two, in both shapes; some blank, some broken."""
    v, k = F.col("event_type"), F.col("event_id")
    user = F.concat(F.lit("u "), F.col("user_id").cast("string"))
    plain = F.concat(F.lit('{"subject": "'), user, F.lit('", "subject_type": "User", "object": "'), v, F.lit('", "object_type": "Event", "predicate": "did"}'))
    nested = F.concat(F.lit('{"subject": "'), user, F.lit('", "subject_type": {"@value": "Person"}, "object": {"@value": "'), v, F.lit('"}, "object_type": {"@value": "Act"}, "predicate": "did"}'))
    whole = lambda *items: F.concat(F.lit('{"text": "t", "spo_list": ['), *items, F.lit("]}"))
    line = F.when(k % 10 == 0, F.lit("{broken")).when(k % 10 == 1, F.lit("")).when(k % 2 == 0, whole(plain)).otherwise(whole(nested, F.lit(", "), plain))
    return table(spark, d, "events").select(k.alias("line_no"), line.alias("line"))


_LINES = """
j AS (SELECT event_id AS doc_id, event_id % 2 = 1 AS two, 'u ' || user_id AS s, event_type AS o FROM events WHERE event_id % 10 > 1),
spo AS (SELECT doc_id, 0 AS ord, s, CASE WHEN two THEN 'Person' ELSE 'User' END AS st, o, CASE WHEN two THEN 'Act' ELSE 'Event' END AS ot FROM j UNION ALL SELECT doc_id, 1, s, 'User', o, 'Event' FROM j WHERE two)"""


def jsonl_lenient(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred lines that are JSON."""
    return lenient(_lines(spark, d), 100).select("line_no", F.try_variant_get("v", "$.text", "string").alias("text"))


def truth_entities(spark: SparkSession, d: str) -> DataFrame:
    lists = E.entity_lists(entities_of(labelled_rows(lenient(_lines(spark, d)))), "truth")
    return lists.select("doc_id", F.explode("truth").alias("t")).select("doc_id", "t.name", "t.label")


def truth_relations(spark: SparkSession, d: str) -> DataFrame:
    lists = E.relation_lists(labelled_rows(lenient(_lines(spark, d))), "truth")
    return lists.select("doc_id", F.explode("truth").alias("t")).select("doc_id", "t.subject", "t.object", "t.predicate")


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ten parts make a document; predicted names are parts of true ones, true ones with spaces, or others."""
    p = table(spark, d, "part").withColumn("doc_id", F.expr("p_partkey div 10"))
    k = F.col("p_partkey")
    truth = p.select("doc_id", k.alias("ord"), F.col("p_type").alias("name"), F.col("p_brand").alias("label"))
    name = F.when(k % 3 == 0, F.split("p_type", " ")[0]).when(k % 3 == 1, F.concat(F.lit(" "), "p_type", F.lit("\t"))).otherwise(F.concat(F.lit("none "), "p_name"))
    pred = p.select("doc_id", (-k).alias("ord"), name.alias("name"), F.when(k % 2 == 0, F.left("p_brand", F.lit(6))).otherwise(F.col("p_brand")).alias("label"))
    return p.select("doc_id").distinct(), pred, truth


def _triples(pred: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    as_triple = lambda df: df.select("doc_id", "ord", F.col("name").alias("subject"), F.col("label").alias("object"), F.lit("made by").alias("predicate"))
    return as_triple(pred), as_triple(truth)


_COUNTS = ["doc_id", "n_truth", "n_predicted", "n_correct", "n_wrong", "n_missed"]


def eval_entity_details(spark: SparkSession, d: str) -> DataFrame:
    return E.entity_details(*_parts(spark, d)).select(*_COUNTS, "n_type_correct")


def eval_relation_details(spark: SparkSession, d: str) -> DataFrame:
    docs, pred, truth = _parts(spark, d)
    return E.relation_details(docs, *_triples(pred, truth)).select(*_COUNTS, "n_direction_correct")


def eval_entities(spark: SparkSession, d: str) -> DataFrame:
    m = E.metrics(E.entity_details(*_parts(spark, d)), "n_type_correct")
    return m.select("n_truth", "n_predicted", "n_correct", "n_type_correct", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


def eval_relations(spark: SparkSession, d: str) -> DataFrame:
    docs, pred, truth = _parts(spark, d)
    m = E.metrics(E.relation_details(docs, *_triples(pred, truth)), "n_direction_correct")
    return m.select("n_truth", "n_predicted", "n_correct", "n_direction_correct", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


def eval_missed(spark: SparkSession, d: str) -> DataFrame:
    return E.missed(E.entity_details(*_parts(spark, d))).select("doc_id", "truth.name", "truth.label")


def eval_report(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the readable report."""
    return report_lines(E.entity_details(*_parts(spark, d)), "n_type_correct").select("line_no", "line")


def eval_report_details(spark: SparkSession, d: str) -> DataFrame:
    """Names found rightly, wrongly and not at all, of each document."""
    rows = report_details(E.entity_details(*_parts(spark, d)))
    names = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x["name"])), "|")
    return rows.select("doc_id", *(names(c).alias(c) for c in ("correct", "wrong", "missed")))


QUERIES = {f.__name__: f for f in (jsonl_lenient, truth_entities, truth_relations, eval_entity_details, eval_relation_details, eval_entities, eval_relations, eval_missed, eval_report, eval_report_details)}

_N = lambda x: f"replace(replace(replace(trim({x}, ' ' || chr(9) || chr(10)), ' ', ''), chr(9), ''), chr(10), '')"
_LIKE = lambda a, b: f"(contains({a}, {b}) OR contains({b}, {a}))"


def _greedy_sql(kind: str) -> str:
    """Tables that end in w(doc_id, i, taken, good): a walk over the predictions of a document that carries the truths taken so far."""
    entity = kind == "entity"
    key = "doc_id, name" if entity else "doc_id, name, label"
    match = _LIKE("p.norm", "t.norm") if entity else f"{_LIKE('p.norm', 't.norm')} AND {_LIKE('p.lnorm', 't.lnorm')}"
    good = _LIKE("p.label", "t.label") if entity else "p.norm = t.norm AND p.lnorm = t.lnorm"
    listed = lambda source: f"(SELECT doc_id, name, label, {_N('name')} AS norm, {_N('label')} AS lnorm, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ord) AS rn FROM {source}) WHERE rn = 1)"
    return f"""
src AS (SELECT p_partkey // 10 AS doc_id, * FROM part),
t0 AS (SELECT doc_id, p_partkey AS ord, p_type AS name, p_brand AS label FROM src),
p0 AS (SELECT doc_id, -p_partkey AS ord, CASE p_partkey % 3 WHEN 0 THEN string_split(p_type, ' ')[1] WHEN 1 THEN ' ' || p_type || chr(9) ELSE 'none ' || p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN left(p_brand, 6) ELSE p_brand END AS label FROM src),
t AS {listed('t0')}, p AS {listed('p0')},
c AS (SELECT p.doc_id, p.i AS pi, t.i AS ti, {good} AS good FROM p JOIN t ON p.doc_id = t.doc_id AND {match}),
cl AS (SELECT doc_id, pi, list(ti ORDER BY ti) AS ts FROM c GROUP BY doc_id, pi),
w AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, []::BIGINT[] AS taken FROM src
  UNION ALL SELECT w.doc_id, w.i + 1, w.taken || coalesce(list_filter(cl.ts, lambda x: NOT list_contains(w.taken, x))[1:1], []) FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1 LEFT JOIN cl ON cl.doc_id = w.doc_id AND cl.pi = w.i + 1),
fin AS (SELECT doc_id, arg_max(taken, i) AS taken, max(i) AS n_predicted FROM w GROUP BY doc_id),
each AS (SELECT a.doc_id, b.taken[len(b.taken)] AS ti, b.i AS pi FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND len(b.taken) > len(a.taken)),
ok AS (SELECT each.doc_id, count(*) FILTER (good) AS n_good FROM each JOIN c USING (doc_id, pi, ti) GROUP BY each.doc_id),
det AS (SELECT fin.doc_id, (SELECT count(*) FROM t WHERE t.doc_id = fin.doc_id) AS n_truth, n_predicted::BIGINT AS n_predicted, len(taken)::BIGINT AS n_correct, coalesce(n_good, 0)::BIGINT AS n_good, taken FROM fin LEFT JOIN ok USING (doc_id))"""


def _details_sql(kind: str, extra: str) -> str:
    return f"WITH RECURSIVE {_greedy_sql(kind)} SELECT doc_id, n_truth, n_predicted, n_correct, n_predicted - n_correct AS n_wrong, n_truth - n_correct AS n_missed, n_good AS {extra} FROM det"


def _metrics_sql(kind: str, extra: str) -> str:
    return f"""WITH RECURSIVE {_greedy_sql(kind)}, s AS (SELECT sum(n_truth)::BIGINT AS n_truth, sum(n_predicted)::BIGINT AS n_predicted, sum(n_correct)::BIGINT AS n_correct, sum(n_good)::BIGINT AS {extra} FROM det),
q AS (SELECT *, n_correct / n_predicted AS p, n_correct / n_truth AS r FROM s)
SELECT n_truth, n_predicted, n_correct, {extra}, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1, round({extra} / n_correct, 9) AS accuracy FROM q"""


_REPORT = f"""WITH RECURSIVE {_greedy_sql('entity')}, s AS (SELECT sum(n_truth)::BIGINT AS t, sum(n_predicted)::BIGINT AS e, sum(n_correct)::BIGINT AS c, sum(n_good)::BIGINT AS g, count(*) AS n FROM det),
q AS (SELECT *, c / e AS p, c / t AS r FROM s),
l AS (SELECT [printf('Precision: %.4f', p), printf('Recall: %.4f', r), printf('F1: %.4f', 2 * p * r / (p + r)), printf('Accuracy of matches: %.4f', g / c), 'Truth: ' || t, 'Extracted: ' || e, 'Correct: ' || c, 'Accurate: ' || g, 'Documents: ' || n] AS l FROM q)
SELECT (i - 1)::INT AS line_no, l[i] AS line FROM l, range(1, 10) AS x(i)"""

ORACLES = {
    "eval_report": _REPORT,
    "eval_report_details": f"""WITH RECURSIVE {_greedy_sql('entity')} SELECT doc_id,
  coalesce((SELECT string_agg(name, '|' ORDER BY name) FROM p JOIN each e USING (doc_id) WHERE p.doc_id = det.doc_id AND e.pi = p.i), '') AS correct,
  coalesce((SELECT string_agg(name, '|' ORDER BY name) FROM p WHERE p.doc_id = det.doc_id AND NOT EXISTS (SELECT 1 FROM each e WHERE e.doc_id = p.doc_id AND e.pi = p.i)), '') AS wrong,
  coalesce((SELECT string_agg(name, '|' ORDER BY name) FROM t WHERE t.doc_id = det.doc_id AND NOT list_contains(det.taken, t.i)), '') AS missed FROM det""",
    "jsonl_lenient": "SELECT event_id AS line_no, 't' AS text FROM events WHERE event_id % 10 > 1 ORDER BY event_id LIMIT 100",
    "truth_entities": f"WITH {_LINES}, en AS (SELECT doc_id, 2 * ord AS o, s AS name, st AS label FROM spo UNION ALL SELECT doc_id, 2 * ord + 1, o, ot FROM spo) SELECT doc_id, name, arg_min(label, o) AS label FROM en GROUP BY doc_id, name",
    "truth_relations": f"WITH {_LINES} SELECT DISTINCT doc_id, s AS subject, o AS object, 'did' AS predicate FROM spo",
    "eval_entity_details": _details_sql("entity", "n_type_correct"),
    "eval_relation_details": _details_sql("relation", "n_direction_correct"),
    "eval_entities": _metrics_sql("entity", "n_type_correct"),
    "eval_relations": _metrics_sql("relation", "n_direction_correct"),
    "eval_missed": f"WITH RECURSIVE {_greedy_sql('entity')} SELECT t.doc_id, t.name, t.label FROM t JOIN det USING (doc_id) WHERE NOT list_contains(det.taken, t.i)",
}
