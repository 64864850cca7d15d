"""Text functions and distilling on hand-made cases and against plain Python."""

import re
import time
from itertools import product

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.distill import rejected_blocks, text_blocks
from graphloom.operators.extract import records


def blocks_of(spark, text):
    return [r.text for r in text_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("block_idx").collect()]


def test_reject_reasons(spark):
    cases = {
        "": "empty", "12345 678.": "no_letter", "word": "few_words", "two words.": None, "one": "few_words", "Two words here": "no_sentence", "这是一个句子。": None, "这是什么？": "no_sentence",
        "[10] Huasheng Liu, et al.": "reference", "As shown in [3] Smith argues so.": "reference", "Write to a.b@example.com now.": "reference", "They involve A., B and more.": "reference", "They involve nothing. So": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.reject_reason(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == cases


def test_short_blocks_join_the_next(spark):
    text = "Short\n\n  A long block that ends here. \nab\ncd\nAnother long block ends here.\nx\ny\nz\nThe last long block is here.\nEnd"
    assert blocks_of(spark, text) == ["Short A long block that ends here.", "Another long block ends here.", "z The last long block is here."]
    assert blocks_of(spark, "A long line, nine.\n　\t Ideographic space around it. 　") == ["A long line, nine.", "Ideographic space around it."]
    assert blocks_of(spark, None) == [] and blocks_of(spark, "") == []


def greedy(lines):
    out, i = [], 0
    while i < len(lines):
        if len(lines[i]) < 10 and i + 1 < len(lines):
            out.append(f"{lines[i]} {lines[i + 1]}")
            i += 2
        else:
            out.append(lines[i])
            i += 1
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("ab \r ", min_size=0, max_size=14), max_size=12), min_size=1, max_size=20))
def test_joining_equals_the_greedy_rule(spark, docs):
    df = spark.createDataFrame([(i, "\n".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    found = {}
    for r in rejected_blocks(df).collect() + [x for x in text_blocks(df).collect()]:
        found.setdefault(r.doc_id, []).append(r.text)
    want = {i: w for i, d in enumerate(docs) if (w := greedy([x.strip() for x in d if x.strip()]))}
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def python_bold(text, names):
    for n in sorted({x for x in names if x}, key=lambda x: (-len(x), x)):
        text = re.sub(rf"(?<!\*)({re.escape(n)})(?!\*)", r"**\1**", text)
    return text


def test_bold_names(spark):
    cases = [("GSub and GSub-X meet A.B (c)", ["GSub", "GSub-X", "A.B", "(c)", "", None]), ("$1 \\ plain", ["$1", "\\"]), ("nothing", []), (None, ["a"])]
    df = spark.createDataFrame(cases, "text string, names array<string>").select(T.bold_names(F.col("text"), F.col("names")).alias("b"))
    assert [r.b for r in df.collect()] == [None if t is None else python_bold(t, n) for t, n in cases]


def test_bold_names_in_order_of_length(spark):
    texts = ["TheThe", "TheThenThe ThenThe", "SheThe TheShe", "Then* The*n *Then Theme", "**Then** The", "TheThemeThenAndThe.", "aXaXa aa aaa", "é𝒳Then𝒳The", ""]
    cases = [(t, names) for t in texts for names in (re.findall("[A-Z][a-z]{2,}", t), ["The", "Then", "Them", "hen", "e", "eThe", "aXa", "aa", "𝒳"], ["The", "*", "**Then", "n*", "e**"], [])] + [("Then", None)]
    df = spark.createDataFrame(cases, "text string, names array<string>").select(T.bold_names(F.col("text"), F.col("names")).alias("b"))
    assert [r.b for r in df.collect()] == [None if n is None else python_bold(t, n) for t, n in cases]


def test_bold_names_reads_a_text_once(spark):
    names = ["A" + "".join(x) for x in product("abcdefghij", repeat=4)]
    df = spark.createDataFrame([(" ".join(names), names), (None, names)], "text string, names array<string>").select(T.bold_names(F.col("text"), F.col("names")).alias("b"))
    began = time.time()
    assert [r.b for r in df.collect()] == [" ".join(f"**{n}**" for n in names), None]
    assert time.time() - began < 20


def test_languages_and_tokens(spark):
    df = spark.createDataFrame([("中文" * 10 + "a" * 60,), ("中" * 10 + "a" * 50,), ("123",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.language_of_text(F.col("t"))).collect()] == ["zh", "en", None, None, None]
    assert [r[0] for r in df.select(T.token_estimate(F.col("t"))).collect()] == [35, 22, 0, 0, 0]
    names = spark.createDataFrame([("/a/zhang.pdf",), ("/中文/report.pdf",), ("/a/报告.pdf",), (None,)], "p string")
    assert [r[0] for r in names.select(T.document_language(F.lit("1"), F.col("p"))).collect()] == ["zh", "en", "zh", "en"]


def test_records(spark):
    df = spark.createDataFrame([("entity<|>A<|>T<|>d\nrelation<|>A<|>B<|>k<|>d\nentity<|>bad\n<END>\nentity<|>C<|>T<|>d",)], "t string")
    assert df.select(records(F.col("t"))).first()[0] == [["entity", "A", "T", "d"], ["relation", "A", "B", "k", "d"]]


def test_distilling_is_planned_once(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for df in (text_blocks(docs), rejected_blocks(docs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(T.SENTENCE) == 1 and plan.count("Filter (size(valid") <= 1 and plan.count("regexp_replace") == 1
