"""The corpus pipeline against its stages' own operators, on the small tables."""

import math
import re
from collections import Counter

import duckdb
from compare import SF
from test_operators import brute_components, odd_docs

from graphloom.llm import decontamination, quality_classifier, secret_scans
from graphloom.session import table

import corpus_pipeline


def test_stages_take_effect_one_after_the_other(spark):
    docs = table(spark, SF, "documents")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    one, two, three, four, five = (f for _, f in corpus_pipeline.STAGES)
    a = one(spark, docs, SF).cache()
    verdict = quality_classifier.classify(docs, table(spark, SF, "labels"))
    assert ids(a) == ids(verdict.filter("predicted = 1")) < ids(docs)
    b = two(spark, a, SF).cache()
    comp = brute_components([(r.doc_id, r.text) for r in a.select("doc_id", "text").collect()], 5, 80)
    assert ids(b) == {i for i, (_, c) in comp.items() if i == c}
    c = three(spark, b, SF).cache()
    assert ids(c) == ids(b) - ids(decontamination.contaminated(b, table(spark, SF, "benchmark")))
    d = four(spark, c, SF).cache()
    assert ids(d) == ids(c) and all(x.columns == docs.columns for x in (a, b, c, d))
    assert secret_scans.scan(d).count() == d.count() and {r.n_assign for r in secret_scans.digest(d).select("n_assign").distinct().collect()} <= {0, 1}
    e = five(spark, d, SF)
    assert ids(e) == ids(d) and e.count() == d.count() and e.filter("not round_trip").count() == 0
    assert ids(corpus_pipeline.run(spark, SF)) == ids(e)


def test_stages_on_odd_documents(spark, tmp_path):
    odd = odd_docs(spark)
    for t in ("labels", "benchmark"):
        table(spark, SF, t).write.parquet(str(tmp_path / f"{t}.parquet"))
    names = [f for _, f in corpus_pipeline.STAGES]
    for docs in (odd, odd.limit(0)):
        for stage in names[1:4]:  # what the classifier thinks of such texts is no matter here
            docs = stage(spark, docs, str(tmp_path)).cache()
            assert docs.columns == odd.columns and docs.dtypes == odd.dtypes
        out = names[4](spark, docs, str(tmp_path)).collect()
        assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in docs.collect())
    accepted = names[0](spark, odd, str(tmp_path))
    assert accepted.columns == odd.columns and {r.doc_id for r in accepted.collect()} <= {r.doc_id for r in odd.collect()}
    kept = [r.doc_id for r in names[1](spark, odd, str(tmp_path)).collect()]
    assert kept.count(1) == 2 and 2 not in kept and 7 not in kept and kept.count(None) == 2 and {3, 4, 5, 6, 8, 9} <= set(kept)


def brute_masked(text):
    """The spans of the three patterns and of suspicious runs, found anew, replaced by one mark where they overlap."""
    S = secret_scans
    spans = [m.span() for m in re.finditer(S.ASSIGN, text) if len(m[2]) >= 6] + [m.span() for p in (S.ACCESS, S.HEX) for m in re.finditer(p, text)]

    def suspicious(run):
        if not re.search("[0-9]", run) or not re.search("[A-Za-z]", run) or re.search(S.ALLOW, run):
            return False
        kind = "hex" if re.fullmatch("[0-9a-fA-F]+", run) else "alnum" if re.fullmatch("[0-9A-Za-z]+", run) else "base64"
        windows = [run[i : i + S.WINDOW] for i in range(len(run) - S.WINDOW + 1)]
        return any(-sum(n / S.WINDOW * math.log2(n / S.WINDOW) for n in Counter(w).values()) >= S.THRESHOLDS[kind] for w in windows)

    base = {i for a, b in spans for i in range(a, b)}
    for m in re.finditer(S.CANDIDATE, text):
        run = m[0]
        rest = re.sub(S.KNOWN, "", run).strip("-/_=+") if re.search(S.ALLOW, run) else run
        if not set(range(*m.span())) <= base and suspicious(rest):
            spans.append(m.span())
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[REDACTED]"
        at = max(at, b)
    return out + text[at:]


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    import sentencepiece as spm

    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    item = table(spark, SF, "benchmark").orderBy("item_id").first().text
    good = [r.text for r in quality_classifier.accepted(docs, table(spark, SF, "labels")).orderBy("doc_id").limit(3).collect()]
    part = "0a1b2c3d4e5f60718293a4b5"
    more = [f"{good[0]}\nk sk-Zx9Qw8Er7-{part}-Ty6Ui5Op end " + "of words that stand here " * 9, f"{good[1]}\n{item.lower()}", good[2]]
    extra = spark.createDataFrame([(10**6 + i, t, "en", "x", len(t)) for i, t in enumerate(more)], docs.schema)
    docs.unionByName(extra).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        table(spark, SF, t).coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = {r.doc_id: r.text for r in docs.unionByName(extra).collect()}
    verdict = quality_classifier.classify(table(spark, str(tmp_path), "documents"), table(spark, str(tmp_path), "labels")).collect()
    kept = {r.doc_id for r in verdict if r.score >= 0.7}
    assert 0 < len(kept) < len(rows)
    kept = {i for i, (_, c) in brute_components([(i, rows[i]) for i in kept], 5, 80).items() if i == c}
    words = lambda t: [x for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if (x := w.strip(decontamination.PUNCTUATION))]
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    items = [(w, max(5, min(8, len(w) // 2))) for r in table(spark, SF, "benchmark").collect() if len(w := words(r.text)) >= 5]
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    bad = {r[0] for r in con.execute(decontamination.oracle()).fetchall()}
    bad |= {i for i in kept if any(grams(words(rows[i]), n) & grams(w, n) for w, n in items)}
    assert kept & bad
    sp = spm.SentencePieceProcessor(model_file=corpus_pipeline.VOCABULARY)
    want = {i: sp.encode(brute_masked(rows[i] or "")) for i in kept - bad}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.doc_id: list(r.ids) for r in got} == want
