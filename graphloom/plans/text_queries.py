"""Queries on text: distilling, language, tokens, names; each with DuckDB SQL written another way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.prompts import FORMATS, PROMPTS, rendered
from graphloom.operators.distill import rejected_blocks, text_blocks
from graphloom.operators.usage import PRICES, price, reported_tokens, summary, with_cost, with_previews
from graphloom.session import table
from graphloom.sources.files import new_files, table_lines

CHINESE = "这是一个中文句子" * 20
MODELS = ["gpt-4o", "GPT-4o-mini", "gpt-4-turbo", "gpt-3.5-turbo", "qwen-turbo", "qwen-plus-latest", "ollama/llama", "other"]

_W = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NW = "[^" + _W[1:]


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _blocks_sql(source: str = "documents", tokens: str = r"len(regexp_extract_all(t, '(?s)[A-Za-z0-9]+(?:\.\d+)?%?|.'))") -> str:
    """Common tables that end in b(doc_id, p, t): blocks by a walk from line to line."""
    return f"""
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source}),
s AS (SELECT doc_id, i, {_strip('t')} AS t FROM raw),
n AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM s WHERE t <> ''),
step AS (SELECT doc_id, p, t, lead(t) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM n),
walk AS (SELECT doc_id, 1::BIGINT AS p FROM n WHERE p = 1
         UNION ALL SELECT w.doc_id, w.p + CASE WHEN length(s.t) < 10 AND s.nxt IS NOT NULL THEN 2 ELSE 1 END FROM walk w JOIN step s ON s.doc_id = w.doc_id AND s.p = w.p WHERE s.nxt IS NOT NULL),
b AS (SELECT doc_id, p, CASE WHEN length(t) < 10 AND nxt IS NOT NULL THEN t || ' ' || nxt ELSE t END AS t FROM walk JOIN step USING (doc_id, p)),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS pos, t, CASE
  WHEN NOT regexp_matches(t, '[A-Za-z一-龥]') THEN 'no_letter'
  WHEN len(regexp_extract_all(t, '{_NW}+')) <= 2 AND {tokens} <= 2 THEN 'few_words'
  WHEN regexp_matches(t, '\\[{_W}*\\p{{Nd}}+{_W}*\\]{_W}*[A-Z][a-z]+') OR regexp_matches(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')
    OR (regexp_matches(t, '(?i)Proceedings|Journal|Conference|pages|vol|ACM|IEEE|arXiv|Springer') AND regexp_matches(t, '[A-Z]\\.?,{_W}*[A-Z]')) THEN 'reference'
  WHEN NOT regexp_matches(t, '[.?!。]') THEN 'no_sentence' END AS reason FROM b)"""


def distill_blocks(spark: SparkSession, d: str) -> DataFrame:
    return text_blocks(table(spark, d, "documents"))


def distill_rejects(spark: SparkSession, d: str) -> DataFrame:
    return rejected_blocks(table(spark, d, "documents")).select("doc_id", "pos", "reject_reason")


def document_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """Documents, every seventh with Chinese text in front."""
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(CHINESE), "text")).otherwise(F.col("text")).alias("text"))


_MIXED = f"(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '{CHINESE}' || text ELSE text END AS text FROM documents)"
_ZH = "length(regexp_replace(left(text, 500), '[^一-龥]', '', 'g'))"
_EN = "length(regexp_replace(left(text, 500), '[^a-zA-Z]', '', 'g'))"
_LANG = f"CASE WHEN {_ZH} + {_EN} = 0 THEN NULL WHEN {_ZH} / ({_ZH} + {_EN}) > 0.2 THEN 'zh' WHEN {_ZH} + {_EN} > 0 THEN 'en' END"
_NAMED = "CASE WHEN regexp_matches(f, '[一-龥]') OR regexp_matches(lower(f), '中文|文档|报告|论文|章节|附录|chinese|zhongwen|zh') THEN 'zh' ELSE 'en' END"


def lang_detect_text(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).select("doc_id", T.language_of_text(F.col("text")).alias("lang_detected"))


def lang_detect_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.language_of_filename(F.col("url")).alias("lang_detected"))


def lang_detect_doc(spark: SparkSession, d: str) -> DataFrame:
    docs = _mixed(spark, d).withColumns({"text": F.when(F.col("doc_id") % 5 == 0, "123").otherwise(F.col("text")), "path": F.concat(F.lit("/zh/"), F.when(F.col("doc_id") % 3 == 0, "报告").otherwise("doc"), F.col("doc_id").cast("string"), F.lit(".pdf"))})
    return docs.select("doc_id", T.document_language(F.col("text"), F.col("path")).alias("lang_detected"))


def _classify(text: str) -> str:
    """Stands in for a classifier: sure of two languages, at a loss elsewhere."""
    return "zh-cn" if "中文" in text else {"e": "en", "d": "de"}[text[0].lower()]


def lang_classified(spark: SparkSession, d: str) -> DataFrame:
    """Languages where a classifier goes before the rules."""
    docs = _mixed(spark, d)
    return docs.select("doc_id", T.document_language(F.col("text"), F.lit("x.pdf"), T.classified(_classify)(F.col("text"))).alias("lang_detected"))


def table_csv(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as rows of tables, a table for each conversation."""
    rows = table(spark, d, "conversations").select(F.concat(F.lit("c"), (F.col("conv_id") % 7).cast("string")).alias("path"), F.col("conv_id").cast("int").alias("table_idx"), F.col("turn").cast("int").alias("row_idx"), F.array("role", F.concat(F.lit('say "'), F.left("text", F.lit(20)), F.lit('"')), F.lit(""), F.lit("a,b")).alias("cells"), F.lit(None).cast("string").alias("error"))
    return table_lines(rows)


def segmented_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Valid blocks where a segmenter counts: here one that takes every two characters as a token."""
    return text_blocks(_mixed(spark, d), T.segmented(lambda t: range((len(t) + 1) // 2)))


def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).select("doc_id", rendered(F.col("text"), T.language_of_text(F.col("text"))).alias("prompt"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.coarse_token_estimate(F.col("text")).alias("coarse_tokens"))


def _usage(spark: SparkSession, d: str) -> DataFrame:
    """A call for each user turn: its text is the prompt, the next turn of the conversation the response."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").withColumn("response", F.lead("text").over(w)).filter("role = 'user'")
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("conv_id") % len(MODELS) + 1).cast("int"))
    return turns.select("conv_id", "turn", model.alias("model"), F.col("text").alias("prompt"), "response", T.token_estimate(F.col("text")).alias("input_tokens"), T.token_estimate(F.col("response")).alias("output_tokens"))


_TOK = lambda x: f"(CASE WHEN {x} IS NULL THEN 0 ELSE length(regexp_replace({x}, '[^一-龥]', '', 'g')) + (length(regexp_replace({x}, '[一-龥]', '', 'g')) // 4) END)::BIGINT"
_USAGE = f"""
u AS (SELECT conv_id, turn, {MODELS}[(conv_id % {len(MODELS)} + 1)::INT] AS model, text AS prompt, response FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS response FROM conversations) WHERE role = 'user'),
prices(ord, key, p_in, p_out) AS (VALUES {', '.join(str((i, *p)) for i, p in enumerate(PRICES))}),
hit AS (SELECT conv_id, turn, min(ord) AS ord FROM u JOIN prices ON contains(lower(model), key) GROUP BY conv_id, turn),
c AS (SELECT u.*, {_TOK('prompt')} AS input_tokens, {_TOK('response')} AS output_tokens, coalesce(p_in, 0)::DOUBLE AS p_in, coalesce(p_out, 0)::DOUBLE AS p_out FROM u LEFT JOIN hit USING (conv_id, turn) LEFT JOIN prices ON prices.ord = hit.ord)"""


def token_cost(spark: SparkSession, d: str) -> DataFrame:
    out = with_cost(_usage(spark, d))
    return out.select("conv_id", "turn", "model", "input_tokens", "output_tokens", "total_tokens", *(F.round(c, 9).alias(c) for c in ("cost_input", "cost_output", "cost_total")))


def price_lookup(spark: SparkSession, d: str) -> DataFrame:
    first, longest = price(F.col("model")), price(F.col("model"), longest=True)
    return _usage(spark, d).select("conv_id", "turn", first[0].alias("price_in"), first[1].alias("price_out"), longest[0].alias("longest_in"), longest[1].alias("longest_out"))


def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary(with_cost(_usage(spark, d)), "model").select("model", "calls", "input_tokens", "output_tokens", "total_tokens", F.round("cost_total", 9).alias("cost_total"), F.round("avg_tokens", 6).alias("avg_tokens"))


def usage_log(spark: SparkSession, d: str) -> DataFrame:
    return with_previews(_usage(spark, d).select("conv_id", "turn", "prompt", "response"))


def usage_reported(spark: SparkSession, d: str) -> DataFrame:
    """Tokens from the first source that reports any: by turn one of two sources, or the estimate."""
    t = F.col("turn") % 4
    sources = [(F.when(t == 0, 11), F.when(t == 0, 0)), (F.when(t == 1, 0), F.lit(None).cast("long")), (F.when(t == 2, 5), F.when(t == 2, 7))]
    conv = table(spark, d, "conversations")
    i, o = reported_tokens(sources, F.col("text"), F.when(t == 3, F.col("text")))
    return conv.select("conv_id", "turn", i.alias("input_tokens"), o.alias("output_tokens"))


def preview_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text"), 100).alias("preview"))


def normalise_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.normalise_name(F.concat(F.lit(" 　\t"), "c_name", F.lit(" \n x\ty "), "c_mktsegment", F.lit("\r\n"))).alias("name"))


def escape_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.escape_label(F.concat(F.lit("`"), "p_name", F.lit("``x"))).alias("label"))


def bold_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each document with its own capitalised words set bold."""
    return table(spark, d, "documents").select("doc_id", T.bold_names(F.col("text"), F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{2,})")))).alias("bold"))


def incremental_files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"))
    return new_files(docs, docs.filter("doc_id % 3 = 0"))


QUERIES = {f.__name__: f for f in (distill_blocks, distill_rejects, document_text, lang_detect_text, lang_detect_filename, lang_detect_doc, lang_classified, table_csv, segmented_blocks, prompt_render, token_estimate, token_cost, price_lookup, usage_summary, usage_log, usage_reported, preview_text, normalise_name, escape_label, bold_entities, incremental_files)}


def _cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN {x}[1:{n}] || '...' ELSE {x} END"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLES = {
    "distill_blocks": f"WITH RECURSIVE {_blocks_sql()} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS block_idx, t AS text FROM r WHERE reason IS NULL",
    "distill_rejects": f"WITH RECURSIVE {_blocks_sql()} SELECT doc_id, pos::INT AS pos, reason AS reject_reason FROM r WHERE reason IS NOT NULL",
    "document_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "lang_detect_text": f"SELECT doc_id, {_LANG} AS lang_detected FROM {_MIXED}",
    "lang_detect_filename": f"SELECT page_id, {_NAMED} AS lang_detected FROM (SELECT page_id, url AS f FROM pages)",
    "lang_detect_doc": f"SELECT doc_id, coalesce({_LANG}, {_NAMED}) AS lang_detected FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '123' ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN '报告' ELSE 'doc' END || doc_id || '.pdf' AS f FROM {_MIXED})",
    "lang_classified": f"SELECT doc_id, CASE WHEN contains(left(text, 1000), '中文') THEN 'zh' WHEN lower(left(text, 1)) = 'e' THEN 'en' ELSE coalesce({_LANG}, 'en') END AS lang_detected FROM {_MIXED}",
    "table_csv": """WITH t AS (SELECT 'c' || (conv_id % 7) AS path, conv_id::INT AS table_idx, turn::INT AS row_idx, role, 'say "' || left(text, 20) || '"' AS said FROM conversations)
SELECT path, table_idx, row_idx, role || ',"' || replace(said, '"', '""') || '",,"a,b"' AS line FROM t
UNION ALL SELECT DISTINCT path, table_idx, -1, 'Table ' || table_idx || ':' FROM t UNION ALL SELECT path, table_idx, (max(row_idx) + 1)::INT, '' FROM t GROUP BY path, table_idx""",
    "segmented_blocks": f"WITH RECURSIVE {_blocks_sql(_MIXED, '(length(t) + 1) // 2')} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS block_idx, t AS text FROM r WHERE reason IS NULL",
    "prompt_render": f"SELECT doc_id, 'Text: ' || text || chr(10) || 'Question: ' || CASE WHEN coalesce({_LANG}, 'en') = 'zh' THEN {_q(PROMPTS['zh']['extract'])} ELSE {_q(PROMPTS['en']['extract'])} END || chr(10) || 'Format_instructions: ' || {_q(FORMATS['extract'])} || chr(10) || 'Answer:' AS prompt FROM {_MIXED}",
    "token_estimate": f"SELECT doc_id, {_TOK('text')} AS tokens, coalesce(length(text) // 2, 100)::BIGINT AS coarse_tokens FROM {_MIXED}",
    "token_cost": f"WITH {_USAGE} SELECT conv_id, turn, model, input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens, round(input_tokens * p_in / 1000, 9) AS cost_input, round(output_tokens * p_out / 1000, 9) AS cost_output, round((input_tokens * p_in + output_tokens * p_out) / 1000, 9) AS cost_total FROM c",
    "price_lookup": f"WITH {_USAGE}, far AS (SELECT conv_id, turn, arg_max(p_in, length(key)) AS a, arg_max(p_out, length(key)) AS b FROM u JOIN prices ON contains(lower(model), key) GROUP BY conv_id, turn) SELECT conv_id, turn, p_in AS price_in, p_out AS price_out, coalesce(a, 0)::DOUBLE AS longest_in, coalesce(b, 0)::DOUBLE AS longest_out FROM c LEFT JOIN far USING (conv_id, turn)",
    "usage_summary": f"WITH {_USAGE} SELECT model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(input_tokens + output_tokens)::BIGINT AS total_tokens, round(sum((input_tokens * p_in + output_tokens * p_out) / 1000), 9) AS cost_total, round(avg(input_tokens + output_tokens), 6) AS avg_tokens FROM c GROUP BY model",
    "usage_log": f"WITH {_USAGE} SELECT conv_id, turn, {_cut('prompt', 200)} AS prompt_preview, {_cut('response', 200)} AS response_preview FROM u",
    "usage_reported": "SELECT conv_id, turn, (CASE turn % 4 WHEN 0 THEN 11 WHEN 2 THEN 5 ELSE coalesce(length(text) // 2, 100) END)::BIGINT AS input_tokens, (CASE turn % 4 WHEN 0 THEN 0 WHEN 2 THEN 7 WHEN 3 THEN coalesce(length(text) // 2, 100) ELSE 100 END)::BIGINT AS output_tokens FROM conversations",
    "preview_text": f"SELECT doc_id, {_cut('text', 100)} AS preview FROM documents",
    "normalise_name": "SELECT c_custkey, replace(c_name, ' ', '') || 'xy' || replace(c_mktsegment, ' ', '') AS name FROM customer",
    "escape_label": "SELECT p_partkey, '``' || replace(p_name, '`', '``') || '````x' AS label FROM part",
    # Without look-around: a sign on either side is matched and put back, twice, so that names which share one are both found.
    "bold_entities": """WITH RECURSIVE n AS (SELECT doc_id, text AS t, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Z][a-z]{2,}'), lambda x: lpad((99999 - length(x))::VARCHAR, 5, '0') || x))) AS names FROM documents),
w AS (SELECT doc_id, 1 AS i, t, names FROM n UNION ALL SELECT doc_id, i + 1, regexp_replace(regexp_replace(t, '(^|[^*])(' || names[i][6:] || ')([^*]|$)', '\\1**\\2**\\3', 'g'), '(^|[^*])(' || names[i][6:] || ')([^*]|$)', '\\1**\\2**\\3', 'g'), names FROM w WHERE i <= len(names))
SELECT doc_id, t AS bold FROM w WHERE i = coalesce(len(names), 0) + 1""",
    "incremental_files": "SELECT d.doc_id, 'f' || d.doc_id AS path FROM documents d ANTI JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) p USING (doc_id)",
}
