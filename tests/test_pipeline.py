"""Extraction, files, evaluation, usage, the whole pipeline and streaming."""

import io
import json
import pickle
import time
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.backends import HashEmbedder, Limiter, ReplayExtractor, Reply, Switchable, model_name, register, switch, with_retries
from graphloom.functions import text as T
from graphloom.operators import evaluate as E
from graphloom.operators import graph as G
from graphloom.operators.distill import listed_blocks, text_blocks
from graphloom.operators.extract import block_entities, embedded, logged_replies, parsed_entities, parsed_relations, replies, replies_once, rule_relations, valid_relations
from graphloom.operators.usage import summary, with_cost
from graphloom.plans.pipeline import Config, build_graph, token_usage
from graphloom.sources import files
from graphloom.sources.sinks import CypherStore, write_graph, write_report
from graphloom.streaming.incremental import current, graph_stream, merge_batch, versions


def entity(n, label="T", d=""):
    return {"label": label, "name": n, "description": d}


def blocks(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, block_idx int, text string")


def test_replies_and_malformed_blocks(spark):
    rel = lambda a, b, name="r", label="L": {"start_entity": a, "end_entity": b, "label": label, "name": name, "description": "d"}
    known = {
        "good": json.dumps({"relations": [rel(entity("A"), entity("B")), rel(entity("A"), entity("A", "U")), rel(entity("B"), entity(" "), "", "L")]}),
        "names": json.dumps({"relations": [rel("A", "B")]}),
        "null end": json.dumps({"relations": [rel(entity("A"), None)]}),
        "none": '{"relations": []}', "other": '{"x": 1}', "broken": "{",
    }
    got = replies(blocks(spark, *known, "unknown"), ReplayExtractor(known))
    assert {r.text: r.error is None for r in got.collect()} == {**dict.fromkeys(known, True), "unknown": False}
    rels = parsed_relations(got)
    assert [(r.block_idx, r.ord, r.start.name, r.end.name, r.end.label) for r in rels.orderBy("block_idx", "ord").collect()] == [(0, 0, "A", "B", "T"), (0, 1, "A", "A", "U"), (0, 2, "B", " ", "T"), (1, 0, "A", "B", None)]
    assert valid_relations(rels).count() == 3
    assert [(r.ord, r.name, r.label) for r in block_entities(rels).orderBy("block_idx", "ord").collect()] == [(0, "A", "T"), (1, "B", "T"), (3, "A", "U")]
    ents, rel_rows = embedded(rels, HashEmbedder(8))
    assert ents.count() == 3 and rel_rows.count() == 3  # ends that are no entities stay in their relations


def test_entity_replies(spark):
    reply = json.dumps({"entities": [entity("A"), entity(" "), {"name": "C"}]})
    got = replies(blocks(spark, "x"), ReplayExtractor({"x": reply}), "entities")
    assert [r.name for r in parsed_entities(got).collect()] == ["A"]
    assert [r.name for r in parsed_entities(got, strict=False).collect()] == ["A", " "]


def test_rule_backend_equals_its_expressions(spark):
    b = blocks(spark, "Alice met Bob near Carol.", "nothing here", "One Two")
    by_backend = parsed_relations(replies(b, switch("extractor", "rule")))
    key = lambda df: sorted((r.block_idx, r.ord, r.start.name, r.end.name) for r in df.collect())
    assert key(by_backend) == key(rule_relations(b)) != []


def test_limiter_and_retries():
    now, slept = [0.0], []
    lim = Limiter(2.0, clock=lambda: now[0], sleep=slept.append)
    assert [lim.wait() for _ in range(3)] == [0.0, 0.5, 1.0] and slept == [0.5, 1.0]
    calls = []
    with pytest.raises(ValueError):
        with_retries(lambda: calls.append(1) or int("x"), 3)
    assert len(calls) == 3
    with pytest.raises(KeyError):
        switch("extractor", "missing")


def docx(path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    inner = f"<w:tbl><w:tr><w:tc>{p('in')}</w:tc></w:tr></w:tbl>"
    xml = f"<w:document {w}><w:body>{p('A first paragraph ends here.')}{p('ab')}<w:tbl><w:tr><w:tc>{p(' x ')}</w:tc><w:tc>{inner}</w:tc></w:tr></w:tbl></w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
        z.writestr("word/media/b.PNG", b"2")
        z.writestr("word/media/a.jpg", b"1")
        z.writestr("word/media/c.txt", b"3")
    path.write_bytes(out.getvalue())


def test_word_files(spark, tmp_path):
    docx(tmp_path / "d.docx")
    (tmp_path / "t.txt").write_text("Plain text.")
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    (tmp_path / "x.unknown").write_bytes(b"x")
    found = files.binary_files(spark, str(tmp_path))
    texts = {r.path.rsplit("/", 1)[1]: r for r in files.documents(found).collect()}
    assert texts["d.docx"].text.split("\n")[:2] == ["A first paragraph ends here.", "ab"] and texts["t.txt"].text == "Plain text."
    assert texts["broken.docx"].error and texts["x.unknown"].error == "unknown extension"
    rows = [r.cells for r in files.tables(found).filter("cells is not null").orderBy("table_idx", "row_idx").collect()]
    # rows of a nested table count in the outer one too, and ordered by table the outer comes first
    assert rows == [["x", "in", "in"], ["in"], ["in"]]
    ocr = lambda b: ["l1", "l2"] if b == b"1" else 1 / 0
    assert [(r.image_idx, bytes(r.image), r.ocr_text) for r in files.images(found, ocr).filter("image is not null").orderBy("image_idx").collect()] == [(0, b"1", "l1\nl2"), (1, b"2", "OCR Error")]
    assert files.table_csv([["a", "b,c"]], 1) == 'Table 1:\na,"b,c"\n\n'


STUBS = {
    "fitz": '''
import json
class Page:
    def __init__(self, number, page): self.number, self.page = number, page
    def get_text(self, kind): return [(0, 0, 1, 1, b, i, 0) for i, b in enumerate(self.page["blocks"])] if kind == "blocks" else None
    def get_images(self, full): return [(x,) for x in self.page["images"]]
class Document:
    def __init__(self, data): self.pages = [Page(i, p) for i, p in enumerate(data["pages"])]
    def __enter__(self): return self
    def __exit__(self, *a): pass
    def __iter__(self): return iter(self.pages)
    def extract_image(self, xref):
        if xref < 0: raise ValueError("broken")
        return {"image": b"image %d" % xref}
def open(stream, filetype): return Document(json.loads(stream))
''',
    "pdfplumber": '''
import json
class Page:
    def __init__(self, page): self.page = page
    def extract_tables(self, settings): return self.page["tables"] if not settings else self.page[settings["vertical_strategy"]]
class Document:
    def __init__(self, data): self.pages = [Page(p) for p in data["pages"]]
    def __enter__(self): return self
    def __exit__(self, *a): pass
def open(stream): return Document(json.loads(stream.read()))
''',
}


def test_portable_documents_with_stand_in_libraries(spark, tmp_path):
    """The libraries are not installed here: stand-ins with the calls that are used read a page description instead."""
    for name, code in STUBS.items():
        (tmp_path / f"{name}.py").write_text(code)
        spark.sparkContext.addPyFile(str(tmp_path / f"{name}.py"))
    page = lambda blocks, images, tables, ruled: {"blocks": blocks, "images": images, "tables": tables, "lines": ruled, "text": [[["only", "rows"]]]}
    doc = {"pages": [page(["First block, over\ntwo lines. ", "short", "Next block is here. "], [7, -1, 8], [[["a", None], ["b,c", 'q"']]], [[]]), page([" \n", "Block of the second page."], [9], [], [[["x"]]])]}
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.pdf").write_text(json.dumps(doc))
    (src / "broken.pdf").write_text("{")
    docx(src / "b.docx")
    found = files.binary_files(spark, str(src))
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.documents(found).collect()}
    assert rows["a.pdf"].blocks[0] == "First block, over\ntwo lines. " and rows["broken.pdf"].error
    listed = listed_blocks(files.documents(found).filter("path like '%a.pdf'").select(F.lit(1).cast("long").alias("doc_id"), "blocks"))
    assert [r.text for r in listed.orderBy("block_idx").collect()] == ["First block, over\ntwo lines.", "short Next block is here.", "Block of the second page."]
    images = files.images(found, ocr=lambda b: ["text of", str(len(b))] if b != b"image 9" else 1 / 0, readable=lambda b: 1 / 0 if b == b"1" else None).filter("image is not null")
    got = [(r.path.rsplit("/", 1)[1], r.page, r.image_idx, r.ocr_text) for r in images.orderBy("path", "page", "image_idx").collect()]
    assert got == [("a.pdf", 1, 0, "text of\n7"), ("a.pdf", 1, 2, "text of\n7"), ("a.pdf", 2, 0, "OCR Error"), ("b.docx", 0, 1, "text of\n1")]
    tables = files.tables(found)
    cells = lambda ext: [r.cells for r in tables.filter(f"path like '%{ext}' and cells is not null").orderBy("table_idx", "row_idx").collect()]
    assert cells("a.pdf") == [["a", ""], ["b,c", 'q"']]
    assert files.Pdf("lines").ruling == "lines"
    files.register_distiller(".pdf", files.Pdf("lines"))
    assert [r.cells for r in files.tables(found).filter("path like '%a.pdf' and cells is not null").collect()] == [["x"]]
    files.register_distiller(".pdf", files.Pdf())
    out = str(tmp_path / "csv")
    files.write_tables(tables, out)
    parts = {p.parent.parent.name.rsplit("%2F", 1)[1] + "/" + p.parent.name: p.read_text() for p in (tmp_path / "csv").glob("*/*/part-*")}
    assert parts["a.pdf/table_idx=0"] == files.table_csv([["a", ""], ["b,c", 'q"']], 0) and set(parts) == {"a.pdf/table_idx=0", "b.docx/table_idx=0", "b.docx/table_idx=1"}


def test_lines_of_several_files_are_in_order(spark, tmp_path):
    for n in (2, 0, 1):
        (tmp_path / f"{n}.jsonl").write_text("".join(json.dumps({"text": f"{n}-{i}"}) + "\n" for i in range(5 - n)) + "\n")
    rows = files.json_lines(spark, str(tmp_path), 7).select("line_no", F.try_variant_get("v", "$.text", "string").alias("t")).collect()
    assert [(r.line_no, r.t) for r in sorted(rows)] == [(0, "0-0"), (1, "0-1"), (2, "0-2"), (3, "0-3"), (4, "0-4"), (6, "1-0"), (7, "1-1")]


def test_segmenter_and_classifier(spark):
    docs = spark.createDataFrame([(1, "第一个，句。\n好，的。\nOne two three.")], "doc_id long, text string")
    joined = [r.text for r in text_blocks(docs).collect()]
    some = text_blocks(docs, T.segmented(lambda t: [t] if "One" not in t else t.split()))
    assert [(r.block_idx, r.text) for r in some.collect()] == [(0, "One two three.")] and len(joined) == 2
    def fails(text):
        if "boom" in text:
            raise ValueError
        return text[:5]

    langs = spark.createDataFrame([("zh-TW x",), ("english",), ("de",), ("boom",), ("",), (None,)], "t string").coalesce(1).select(T.classified(fails)(F.col("t")).alias("l")).collect()
    assert [r.l for r in langs] == ["zh", "en", None, None, None, None]
    assert T.chinese_segmenter() is None and T.installed_classifier() is None


def test_usage_and_log_of_replies(spark, tmp_path):
    class Counting(ReplayExtractor):
        """Answers with tokens, and writes a line for each call."""

        def __init__(self, replies, folder):
            super().__init__(replies)
            self.folder, self.model_name = folder, "gpt-4o-mini"

        def reply(self, prompt, text):
            open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
            return Reply(super().reply(prompt, text), 100, 10) if text != "plain" else super().reply(prompt, text)

    calls = tmp_path / "calls"
    calls.mkdir()
    backend = Counting({"good": "{}", "plain": "é" * 9, "late": "{}"}, str(calls))
    b = blocks(spark, "good", "plain", "fails")
    log = str(tmp_path / "log")
    first = replies_once(b, backend, log, attempts=2)
    assert len(list(calls.iterdir())) == 4 and first.filter("error is not null").count() == 1
    u = {r.block_idx: r for r in token_usage(first).collect()}
    prompt_length = len(first.filter("text = 'plain'").first().prompt)
    assert (u[0].model, u[0].input_tokens, u[0].output_tokens) == ("gpt-4o-mini", 100, 10) and (u[1].input_tokens, u[1].output_tokens) == (prompt_length // 2, 4) and 2 not in u
    assert summary(token_usage(first)).first().calls == 2
    again = replies_once(blocks(spark, "good", "plain", "fails", "late"), backend, log, attempts=1)
    assert len(list(calls.iterdir())) == 6  # one that failed, and a new one
    assert {r.text: r.reply for r in again.collect()} == {"good": "{}", "plain": "é" * 9, "fails": None, "late": "{}"}
    assert "é" in "".join(p.read_text() for p in (tmp_path / "log").glob("*.json"))
    ents, _ = build_graph(spark.createDataFrame(DOCS, "doc_id long, text string"), Config(threshold=0.99, log=str(tmp_path / "log2")))
    assert ents.count() == 7 and logged_replies(spark, str(tmp_path / "log2")).count() == 4


def test_batches_of_prompts_rate_and_names(spark):
    class Many(ReplayExtractor):
        _llm_type = "many"

        def reply_many(self, prompts, texts):
            return [KeyError(t) if t not in self.replies else Reply(f"{len(texts)}", None, None) for t in texts]

    got = {r.text: (r.reply, r.error, r.model) for r in replies(blocks(spark, "a", "b", "c", "x").coalesce(1), Many({"a": "", "b": "", "c": ""}), batch=3).collect()}
    assert got["a"] == ("3", None, "many") and got["x"][0] is None and "KeyError" in got["x"][1]
    began = time.time()
    replies(blocks(spark, *"abcd").coalesce(1), ReplayExtractor(dict.fromkeys("abcd", "{}")), rate=8.0).collect()
    assert time.time() - began > 3 * spark.sparkContext.defaultParallelism / 8  # one of four tasks has a quarter of the rate
    slept = []
    with pytest.raises(ValueError):
        with_retries(lambda: int("x"), 4, 0.5, slept.append)
    assert slept == [0.5, 1.0, 2.0]
    s = Switchable("extractor", "rule")
    register("extractor", "replay", lambda: ReplayExtractor({"t": "r"}))
    assert s.label == "Term" and model_name(s) == "rule" and model_name(object()) == "unknown" and len(s.batch(["", ""], ["Ab", "Abc"])) == 2
    s.switch("replay")
    assert s.reply("", "t") == "r" and list(s.stream("", "t")) == ["r"] and pickle.loads(pickle.dumps(s)).reply("", "t") == "r"


def test_graph_into_a_store(spark, tmp_path):
    class Folder:
        """A session that writes down what it is asked to run."""

        def __init__(self, folder):
            self.folder = folder

        def run(self, query, params):
            with open(f"{self.folder}/{time.time_ns()}-{uuid.uuid4().hex}", "w") as f:
                json.dump([query, params], f)

        def close(self):
            pass

    ents = spark.createDataFrame([(0, "A", "T", [1.0], "old"), (1, "A", "T", [1.0], "new"), (2, "B", "Q`x", [0.5], "b"), (3, None, "T", None, "")], "ord long, name string, label string, embedding array<double>, description string")
    rels = spark.createDataFrame([(0, "A", "T", "B", "Q`x", "knows", "n", "d"), (1, "A", "T", "C", "T", "knows", "n", "d")], "ord long, start_name string, start_label string, end_name string, end_label string, label string, name string, description string")
    folder = str(tmp_path)
    assert write_graph(ents, rels, CypherStore(lambda: Folder(folder)), batch=2) == (2, 1)
    said = [json.loads(p.read_text()) for p in sorted(tmp_path.iterdir())]
    assert all("MERGE (n:" in q for q, _ in said[:-1]) and "MATCH (a:`T` {name: row.start_name}), (b:`Q``x` {name: row.end_name}) MERGE (a)-[r:`knows`]->(b)" in said[-1][0]
    rows = {r["name"]: r["properties"] for q, p in said[:-1] for r in p["rows"]}
    assert rows["A"] == {"name": "A", "embedding": [1.0], "description": "new"} and set(rows) == {"A", "B"}
    assert said[-1][1]["rows"] == [{"start_name": "A", "end_name": "B", "properties": {"name": "n", "description": "d"}}]
    assert write_graph(ents.limit(0), rels, CypherStore(lambda: Folder(folder))) == (0, 0)


def test_report(spark, tmp_path):
    row = lambda *x: spark.createDataFrame(x, "doc_id long, ord int, name string, label string")
    docs = spark.createDataFrame([(1, "text " * 50), (2, "none")], "doc_id long, text string")
    d = E.entity_details(docs, row((1, 0, "ab", "X"), (1, 1, "q", "X")), row((1, 0, "abc", "X"), (1, 1, "z", "Y")))
    spent = summary(with_cost(spark.createDataFrame([("gpt-4o", 1000, 1000)], "model string, input_tokens long, output_tokens long")))
    write_report(d, "n_type_correct", str(tmp_path / "r"), spent, docs)
    read = lambda part, glob: [json.loads(x) for p in (tmp_path / "r" / part).glob(glob) for x in p.read_text().splitlines()]
    (m,) = read("metrics", "part-*")
    assert (m["precision"], m["recall"], m["dataset_size"], m["token_usage"]["calls"]) == (0.5, 0.5, 2, 1)
    one, two = sorted(read("details", "part-*"), key=lambda r: r["doc_id"])
    assert [x["name"] for k in ("correct", "wrong", "missed") for x in one[k]] == ["ab", "q", "z"] and one["text"].endswith("...") and two["n_truth"] == 0
    text = "".join(p.read_text() for p in (tmp_path / "r" / "summary").glob("part-*"))
    assert text.splitlines()[0] == "Precision: 0.5000" and text.splitlines()[-1] == "Cost in USD: 0.0200"


def test_settings(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('[openai]\nmodel = "m"\n')
    assert files.provider(files.settings(str(f))) == ("openai", {"model": "m"})
    with pytest.raises(FileNotFoundError):
        files.settings(str(tmp_path / "none.toml"))


def test_lenient_lines(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"text": "a"}\n\n{broken\n{"text": "b", "spo_list": [{"subject": "s", "subject_type": "t", "object": {"@value": "o"}, "object_type": {"@value": "u"}, "predicate": "p"}]}\n{"text": "c"}\n')
    rows = files.json_lines(spark, str(f), 2)
    assert rows.count() == 2
    r = files.labelled_rows(rows).first()
    assert (r.subject, r.subject_type, r.object, r.object_type, r.predicate) == ("s", "t", "o", "u", "p")


def test_greedy_matching(spark):
    pred = spark.createDataFrame([(1, 0, "ab", "X"), (1, 1, "a", "X"), (1, 2, "ab", "Z"), (1, 3, "q", "X"), (2, 0, "z", "X"), (1, 4, None, "X")], "doc_id long, ord int, name string, label string")
    true = spark.createDataFrame([(1, 0, "a b c", "XY"), (1, 1, "ab", "Q"), (3, 0, "m", "X")], "doc_id long, ord int, name string, label string")
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "doc_id long")
    d = E.entity_details(docs, pred, true)
    got = {r.doc_id: (r.n_truth, r.n_predicted, r.n_correct, r.n_type_correct) for r in d.collect()}
    assert got == {1: (2, 3, 2, 1), 2: (0, 1, 0, 0), 3: (1, 0, 0, 0), 4: (0, 0, 0, 0)}
    assert [(r.doc_id, r.truth.name) for r in E.missed(d).collect()] == [(3, "m")]
    m = E.metrics(d, "n_type_correct").first()
    assert (m.precision, m.recall, m.accuracy) == (0.5, 2 / 3, 0.5)
    zero = E.metrics(d.limit(0), "n_type_correct").first()
    assert (zero.precision, zero.recall, zero.f1, zero.accuracy) == (0, 0, 0, 0)


def test_usage_without_calls(spark):
    none = spark.createDataFrame([], "model string, input_tokens long, output_tokens long")
    assert summary(with_cost(none)).first().asDict() == {"calls": 0, "input_tokens": 0, "output_tokens": 0, "total_tokens": 0, "cost_total": 0.0, "avg_tokens": 0.0}


DOCS = [(1, "Alice met Bob near Carol, and it was so.\nThen Bob saw Carol and Dave there."), (2, "Alice wrote to Erin, and that is all.\nErin met Dave in Paris."), (3, None), (4, "")]


def test_whole_pipeline(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    ents, rels = build_graph(docs, Config(threshold=0.99))
    names = [r.name for r in ents.orderBy("ord").collect()]
    assert len(names) == len(set(names)) and set(names) == {"Alice", "Bob", "Carol", "Then", "Dave", "Erin", "Paris"}
    pairs = {(r.start_name, r.end_name) for r in rels.collect()}
    assert ("Alice", "Bob") in pairs and ("Dave", "Paris") in pairs
    by_doc, _ = build_graph(docs, Config(threshold=0.99, by_document=True, mode="serial"))
    assert {r.graph for r in by_doc.select("graph").distinct().collect()} == {1, 2}
    nodes = G.nodes(ents)
    assert G.edges(rels, nodes).count() == rels.count()
    empty = build_graph(docs.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_batches_and_stream(spark, tmp_path):
    folder, src = str(tmp_path / "kg"), tmp_path / "in"
    src.mkdir()
    config = Config(threshold=0.99)
    lines = lambda docs: "".join(json.dumps({"doc_id": i, "text": t}) + "\n" for i, t in docs)
    (src / "1.json").write_text(lines(DOCS[:1]))
    start = lambda: graph_stream(spark.readStream.schema("doc_id long, text string").json(str(src)), folder, str(tmp_path / "cp"), config).trigger(availableNow=True).start().awaitTermination()
    start()
    first = {r.name for r in current(spark, folder)[0].collect()}
    (src / "2.json").write_text(lines(DOCS[1:]))
    start()
    ents, rels = current(spark, folder)
    assert versions(spark, folder) == [0, 1] and first < {r.name for r in ents.collect()}
    assert [r.name for r in ents.orderBy("ord").collect()][: len(first)] == [r.name for r in current(spark, folder, before=1)[0].orderBy("ord").collect()]
    assert rels.groupBy(*G.RELATION_KEY).count().filter("count > 1").count() == 0
    before = ents.count()
    merge_batch(spark.createDataFrame(DOCS, "doc_id long, text string"), 1, folder, config)  # a batch that is done is not done again
    assert current(spark, folder)[0].count() == before


def test_relations_are_parsed_once(spark, monkeypatch):
    """Later steps read kept tables; none parses the replies again."""
    from graphloom.plans import pipeline

    parsed, plain = spark.sparkContext.accumulator(0), pipeline.parsed_relations

    def counted(replied):
        df = plain(replied)

        def run(batches):
            for b in batches:
                parsed.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    monkeypatch.setattr(pipeline, "parsed_relations", counted)
    docs = spark.createDataFrame([(1, "Alice met Robert in Paris, and they talked.")], "doc_id long, text string")
    _, rels = pipeline.build_graph(docs)
    assert parsed.value == 2 and rels.count() == 2
