import io
import datetime
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quern import engine, providers
from quern.config import Config
from quern.sources import files, labelled, notion
from quern.streaming import watch

W, A, S = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("# Contract\n\nThe total amount is 3000 euro and it is due in May.\n", encoding="utf-8")
    (root / "sub" / "b.txt").write_text("Hiking needs shoes, a tent and a stove.", encoding="utf-8")
    (root / "c.csv").write_bytes("名称,金额\n,\n服务,12\n".encode("gbk"))
    (root / "d.csv").write_bytes(b"\xef\xbb\xbfname,n\nx,1\n")
    (root / "e.docx").write_bytes(packed({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>Para</w:t><w:tab/><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>'}))
    slide = f'<p:sld xmlns:p="p" xmlns:a="{A}"><a:p><a:r><a:t> Sli</a:t></a:r><a:r><a:t>de</a:t></a:r></a:p><a:tbl><a:tr><a:tc><a:p><a:r><a:t>x</a:t></a:r></a:p></a:tc><a:tc><a:p/></a:tc><a:tc><a:p><a:r><a:t>y</a:t></a:r></a:p></a:tc></a:tr></a:tbl></p:sld>'
    (root / "f.pptx").write_bytes(packed({"ppt/slides/slide2.xml": slide, "ppt/slides/slide1.xml": f'<p:sld xmlns:p="p" xmlns:a="{A}"/>', "ppt/slides/slide10.xml": slide}))
    sheet = f'<worksheet xmlns="{S}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="A2"/></row><row><c r="A3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    (root / "g.xlsx").write_bytes(packed({"xl/workbook.xml": f'<workbook xmlns="{S}"><sheets><sheet name="S1"/></sheets></workbook>', "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>head</t></si></sst>'}))
    (root / "bad.docx").write_bytes(b"no zip")
    (root / "h.pdf").write_bytes(b"%PDF")
    (root / "skip.py").write_text("x")
    return root


def test_parsers(spark, folder):
    rows = {(r.path, r.slide): r for r in files.parse(files.scan(spark, f"file://{folder}")).collect()}
    text = {k: r.content for k, r in rows.items()}
    assert text["sub/b.txt", None].startswith("Hiking") and text["c.csv", None] == "名称 | 金额\n服务 | 12" and text["d.csv", None] == "name | n\nx | 1"
    assert text["e.docx", None] == "Para\tone\n\ntwo" and text["f.pptx", 2] == "Slide\nx | y" and ("f.pptx", 1) not in text and ("f.pptx", 10) in text
    assert text["g.xlsx", None] == "head |  | 7\nin" and rows["g.xlsx", None].sheet == "S1"
    assert rows["bad.docx", None].content is None and "BadZipFile" in rows["bad.docx", None].error and rows["h.pdf", None].error
    assert not any(p == "skip.py" for p, _ in rows)
    assert {r.path: r.content for r in files.text_documents(files.scan(spark, f"file://{folder}")).collect()}["a.md"].startswith("# Contract")


def test_parser_fallback():
    calls = []
    assert files.parse_one("x.pdf", b"", {"pdf": [lambda raw: calls.append(1) or [], lambda raw: [{"content": "second"}]]})[0]["content"] == "second" and calls
    assert files.parse_one("x.unknown", b"", files.PARSERS) == []


def test_page_helpers(spark):
    words = spark.createDataFrame([(1, 600.0, 800.0, 50.0 if i % 2 else 400.0, 200.0) for i in range(40)] + [(2, 600.0, 800.0, 50.0, 200.0)] * 40, "page int, page_width double, page_height double, x0 double, top double")
    assert {r.page: r.two_column for r in files.two_column_pages(words).collect()} == {1: True, 2: False}
    assert {(r.x0, r.band) for r in files.reading_order(words.where("page = 1")).select("x0", "band").distinct().collect()} == {(50.0, 1), (400.0, 2)}
    meta = spark.createDataFrame([("T", "(anonymous)", "(unspecified)", "k")], "t string, a string, s string, k string")
    assert meta.select(files.pdf_metadata_text(F.col("t"), F.col("a"), F.col("s"), F.col("k")).alias("x")).first().x == "Title: T\nKeywords: k"
    table = spark.createDataFrame([([["a", "b"], ["1", None]],)], "r array<array<string>>")
    assert table.select(files.markdown_table(F.col("r")).alias("x")).first().x == "| a | b |\n| --- | --- |\n| 1 |  |"
    images = spark.createDataFrame([("s", 1, i, 200, 200) for i in range(25)] + [("s", 2, 0, 50, 200)], "source string, page int, ordinal int, width int, height int")
    assert files.image_captions(images, F.when(F.col("ordinal") > 0, F.lit("pic"))).count() == 20


def test_notion(spark, tmp_path):
    text = lambda t: {"rich_text": [{"plain_text": t}]}
    blocks = [{"type": "heading_2", "heading_2": text("H")}, {"type": "paragraph", "paragraph": text("")}, {"type": "to_do", "to_do": text("t") | {"checked": True}}, {"type": "code", "code": text("x=1") | {"language": "py"}}, {"type": "divider"}, {"type": "video"}]
    pages = [{"id": "1", "properties": {"Name": {"type": "title", "title": [{"plain_text": "My/Page"}]}}, "_blocks": blocks}, {"id": "2", "properties": {}, "_blocks": []}]
    (tmp_path / "dump.json").write_text("\n".join(map(json.dumps, pages)))
    found = {r.path: r.content for r in notion.markdown_files(notion.read_dump(spark, str(tmp_path / "dump.json"))).collect()}
    assert found == {"My_Page.md": "# My/Page\n\n## H\n\n- [x] t\n\n```py\nx=1\n```\n\n---\n", "Untitled.md": "# Untitled\n\n\n"}


def test_reindex_and_answer(spark, folder, tmp_path):
    config = Config(embedding_dim=32, use_answerability_check=False)
    store = engine.Store(spark, f"file://{tmp_path}/store")
    first = engine.reindex(store, f"file://{folder}", config=config).first()
    assert (first.total_files, first.new_or_changed, first.deleted) == (9, 9, 0) and first.chunks_added >= 7
    n = store.chunks().count()
    again = engine.reindex(store, f"file://{folder}", config=config).first()
    assert again.chunks_added == 0 and store.chunks().count() == n  # files that failed are tried again, and add nothing
    (folder / "a.md").write_bytes(b"\xff\xfe broken")
    (folder / "sub" / "b.txt").unlink()
    engine.reindex(store, f"file://{folder}", config=config)
    sources = {r.source for r in store.chunks().select("source").distinct().collect()}
    assert "a.md" in sources and "sub/b.txt" not in sources
    asked = spark.createDataFrame([(1, "total amount due in May"), (2, "zzz")], "query_id int, question string")
    found = {r.query_id: r for r in engine.answer(store, asked, config=config).collect()}
    assert found[1].delivered and found[1].sources[0].source == "a.md" and "3000" in found[1].answer
    assert not found[2].delivered and found[2].confidence < 0.3 and found[2].answer.startswith("资料中未找到") and len(found[2].sources) <= 2
    rewritten = engine.retrieve(store, asked, config=Config(embedding_dim=32, use_query_rewrite=True)).where("query_id = 1 and rank = 1").first()
    assert rewritten.source == "a.md"


def test_parent_child_and_evaluation(spark, folder, tmp_path):
    config = Config(embedding_dim=32, use_parent_child=True, use_critic=True)
    store = engine.Store(spark, f"file://{tmp_path}/store")
    engine.reindex(store, f"file://{folder}", config=config)
    assert store.parents().count() > 0 and store.chunks().where("parent_id is null").count() == 0
    tests = tmp_path / "set.json"
    tests.write_text(json.dumps([{"id": "a", "question": "Which shoes and tent for hiking?", "ground_truth_keywords": ["tent"], "must_cite": "b.txt"}, {"id": "b", "question": "zzz", "must_cite": ["__none__"], "expect_reject": True, "negative_type": "off_topic"}]))
    questions = labelled.read_questions(spark, str(tests))
    assert {r.query_id: (r.must_cite, r.expect_answerability) for r in questions.collect()} == {"a": (["b.txt"], "ANSWERABLE"), "b": (["__none__"], "UNANSWERABLE")}
    rows, summary = engine.evaluate(store, questions, config)
    values = {r.metric: r.value for r in summary.collect()}
    assert values["hit_at_1"] == 1.0 and values["context_recall"] == 1.0 and values["reject_accuracy_off_topic"] == 1.0
    labelled.save_run(rows, summary, f"{tmp_path}/runs", "r1")
    labelled.save_run(rows, summary, f"{tmp_path}/runs", "r2")
    assert {r.run for r in labelled.latest_runs(spark, f"{tmp_path}/runs", 1).select("run").distinct().collect()} == {"r2"}
    assert labelled.overlapping_sources(questions, questions.limit(0)).count() == 0


def test_empty_store(spark, tmp_path):
    store = engine.Store(spark, f"file://{tmp_path}/none")
    asked = spark.createDataFrame([(1, "anything")], "query_id int, question string")
    row = engine.answer(store, asked, config=Config(embedding_dim=8)).first()
    assert row.answer.startswith("知识库为空") and row.confidence == 0.0 and not row.delivered and row.sources is None


def test_a_model_plugged_in(spark, folder, tmp_path):
    providers.MODELS["echo"] = lambda prompt: F.when(prompt.isNotNull(), F.lit('{"verdict": "ANSWERABLE", "evidence": "3000 euro"}'))
    config = Config(embedding_dim=32, llm="echo")
    store = engine.Store(spark, f"file://{tmp_path}/store")
    engine.reindex(store, f"file://{folder}", config=config)
    asked = spark.createDataFrame([(1, "total amount due in May")], "query_id int, question string")
    assert engine.answer(store, asked, config=config).first().status == "ANSWERABLE"


def test_bursts(spark):
    rows = spark.createDataFrame([("a.md", "modified", t) for t in (0.0, 1.9, 3.9, 6.0)], "path string, op string, t double").withColumn("ts", F.timestamp_millis((F.col("t") * 1000).cast("long")))
    assert sorted(r.n for r in watch.bursts(rows).collect()) == [1, 3]


def test_watch_stream(spark, tmp_path):
    events = tmp_path / "events"
    events.mkdir()
    (events / "1.json").write_text("\n".join(json.dumps({"path": p, "op": "modified", "ts": t}) for p, t in (("a.md", "2024-01-01T00:00:00Z"), ("a.md", "2024-01-01T00:00:01Z"), ("x.py", "2024-01-01T00:10:00Z"), ("b.xlsx", "2024-01-01T01:00:00Z"))))
    runs = []

    def reindex():
        runs.append(1)
        if len(runs) == 1:
            raise RuntimeError("first pass fails")

    errors = []
    query = watch.start(watch.read_events(spark, str(events)), reindex, checkpoint=f"{tmp_path}/ck", once=True, on_error=errors.append)
    query.awaitTermination()
    assert len(runs) >= 2 and len(errors) == 1


def wait_for(condition, seconds=60.0):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.05)
    return condition()


def test_a_lone_burst_causes_one_pass(spark, tmp_path):
    """One event alone, and two in quick succession, cause one pass each; no later event is needed."""
    events = tmp_path / "events"
    events.mkdir()
    runs = []
    query = watch.start(watch.read_events(spark, str(events)), lambda: runs.append(time.time()), gap_seconds=1.0, checkpoint=f"{tmp_path}/ck")

    def drop(name, path="a.md"):
        (tmp_path / name).write_text(json.dumps({"path": path, "op": "modified", "ts": "2024-01-01T00:00:00Z"}))
        (tmp_path / name).rename(events / name)

    try:
        assert len(runs) == 1
        drop("other.json", "a.py")
        drop("1.json")
        dropped = time.time()
        assert wait_for(lambda: len(runs) > 1) and runs[1] - dropped >= 1.0
        drop("2.json")
        time.sleep(0.1)
        drop("3.json")
        assert wait_for(lambda: len(runs) > 2)
        time.sleep(4.0)
        assert len(runs) == 3 and query.isActive
    finally:
        query.stop()


def test_snapshot_events(spark):
    schema = "path string, length long, modified timestamp"
    t = [datetime.datetime(2024, 1, 1, 0, 0, k) for k in range(3)]
    old = spark.createDataFrame([("a", 1, t[0]), ("b", 1, t[0]), ("d", 1, t[0]), ("e", 1, t[0])], schema)
    new = spark.createDataFrame([("a", 2, t[0]), ("c", 1, t[0]), ("d", 1, t[0]), ("e", 1, t[1])], schema)
    assert {r.path: r.op for r in watch.snapshot_events(old, new).collect()} == {"a": "modified", "b": "deleted", "c": "created", "e": "modified"}


def test_models_rewrite_judge_describe_and_check(spark, folder, tmp_path):
    """Every step that asks a model, with one that answers by the rules of its prompt; failed calls are errors."""
    from quern.functions import fixed

    def scripted(prompt):
        starts = lambda rules: prompt.startswith(rules)
        return (
            F.when(starts(fixed.REWRITE_RULES), "1. total amount due in May\n- total price")
            .when(starts(fixed.CRITIC_RULES), F.when(F.contains(prompt, F.lit("3000")), "YES\nNO\nNO\nNO\nNO").otherwise("NO"))
            .when(starts(fixed.CONTEXT_RULES), "--- 第1段 ---\nAbout a contract.")
            .when(starts(fixed.CLAIM_RULES), '```json\n{"claims": [{"text": "a", "supported": true}, {"text": "b", "supported": false}]}\n```')
            .when(starts(fixed.ANSWERABILITY_RULES), F.when(F.contains(prompt, F.lit("broken")), F.lit(None)).otherwise('{"verdict": "ANSWERABLE", "evidence": "3000 euro"}'))
            .when(starts(fixed.ANSWER_RULES), "3000 euro [1]")
        )

    providers.MODELS["scripted"] = scripted
    config = Config(embedding_dim=32, llm="scripted", use_contextual=True, use_critic=True, use_query_rewrite=True, evaluate_answerability=True, confidence_threshold=0.0)
    store = engine.Store(spark, f"file://{tmp_path}/store")
    engine.reindex(store, f"file://{folder}", config=config)
    contents = {r.source: r.content for r in store.chunks().collect()}
    assert contents["a.md"].startswith(f"{fixed.CONTEXT_OPEN}About a contract.{fixed.CONTEXT_CLOSE}# Contract") and "description" not in store.chunks().columns
    assert {r.token for r in store.index().terms.where("df = 1").collect()} >= {"3000", "may"}
    asked = spark.createDataFrame([(1, "how much is it"), (2, "broken total amount")], "query_id int, question string")
    found = {r.query_id: r for r in engine.answer(store, asked, config=config).collect()}
    assert found[1].status == "ANSWERABLE" and found[1].answer == "3000 euro [1]" and [s.source for s in found[1].sources] == ["a.md"]
    assert found[2].status == "ERROR" and not found[2].delivered
    questions = asked.select("query_id", "question", F.array(F.lit("3000")).alias("keywords"), F.array(F.lit("a.md")).alias("must_cite"), F.lit(False).alias("expect_reject"), F.lit(None).cast("string").alias("negative_type"), F.lit("ANSWERABLE").alias("expect_answerability"))
    values = {r.metric: r.value for r in engine.evaluate(store, questions, config)[1].collect()}
    assert values["answerability_evaluated"] == 2 and values["answerability_coverage"] == 0.5 and values["answerability_accuracy"] == 1.0
    checks = {r.check: r.passed for r in engine.diagnose(store, questions, config).collect()}
    assert set(checks) == {"collection", "lexical", "dense", "confidence", "rerank_spread", "mini_eval"} and checks["mini_eval"] and not checks["collection"]
    results = spark.createDataFrame([("q", "a and b", ["x"], None)], "question string, answer string, contexts array<string>, sources array<struct<snippet:string,context:string>>")
    judged = engine.faithfulness(results, config).first()
    assert judged.score == 0.5 and judged.unsupported == ["b"]


def test_preferred_parser():
    def plain(raw):
        return [{"content": "plain"}]

    def layout(raw):
        return [{"content": "layout"}]

    files.register_parser("pdfx", plain)
    files.register_parser("pdfx", layout)
    try:
        for wanted in ("plain", "layout"):
            order = sorted(files.PARSERS["pdfx"], key=lambda p: p.__name__ != wanted)
            assert files.parse_one("a.pdfx", b"", {"pdfx": order})[0]["content"] == wanted
    finally:
        del files.PARSERS["pdfx"]


def test_images_of_office_files(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (300).to_bytes(4, "big") + (120).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08" + (50).to_bytes(2, "big") + (60).to_bytes(2, "big") + b"\0" * 8
    rows = [("a.docx", packed({"word/media/b.png": png, "word/media/c.jpeg": jpeg, "word/media/d.emf": b"x", "word/document.xml": "<a/>"})), ("b.pptx", b"broken"), ("c.txt", b"x")]
    found = files.images(spark.createDataFrame(rows, "path string, content binary")).orderBy("ordinal").collect()
    assert [(r.source, r.ordinal, r.width, r.height) for r in found] == [("a.docx", 0, 300, 120), ("a.docx", 1, 60, 50)]


def test_paged_notes(spark, tmp_path):
    """Pages and blocks are listed to the end, however many pages of results there are."""
    import http.server
    import threading

    class Service(http.server.BaseHTTPRequestHandler):
        def reply(self, cursor, rows):
            at = int(cursor or 0)
            body = json.dumps({"results": rows[at : at + 2], "has_more": at + 2 < len(rows), "next_cursor": str(at + 2)}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.reply(asked.get("start_cursor"), [{"id": f"p{i}", "properties": {"n": {"type": "title", "title": [{"plain_text": f"Page {i}"}]}}} for i in range(5)])

        def do_GET(self):
            page, _, query = self.path.partition("?")
            cursor = dict(p.split("=") for p in query.split("&")).get("start_cursor")
            self.reply(cursor, [{"type": "paragraph", "paragraph": {"rich_text": [{"plain_text": f"{page.split('/')[-2]} line {i}"}]}} for i in range(3)])

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        notion.fetch_dump(spark, "db", "token", f"file://{tmp_path}/dump", f"http://127.0.0.1:{server.server_port}", 2)
    finally:
        server.shutdown()
    found = {r.path: r.content for r in notion.markdown_files(notion.read_dump(spark, f"file://{tmp_path}/dump")).collect()}
    assert len(found) == 5 and found["Page 3.md"] == "# Page 3\n\np3 line 0\n\np3 line 1\n\np3 line 2\n"


def test_polled_folder(spark, folder, tmp_path):
    events = tmp_path / "events"
    events.mkdir()
    known = watch.poll(spark, f"file://{folder}", str(events))
    assert watch.poll(spark, f"file://{folder}", str(events), known).count() == known.count() and not list(events.glob("*.json"))
    (folder / "a.md").write_text("changed")
    (folder / "d.csv").unlink()
    watch.poll(spark, f"file://{folder}", str(events), known)
    assert {(r.path, r.op) for r in spark.read.schema(watch.EVENT_SCHEMA).json(str(events)).collect()} == {("a.md", "modified"), ("d.csv", "deleted")}


def test_storage_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from quern import storage

    class Elsewhere:
        conf = spark.conf

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "elsewhere"

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError):
            storage.shared_root(Elsewhere)


def test_notes_are_synced_by_time_of_edit(spark, tmp_path):
    """A second sync fetches the blocks of edited and new pages only, and an idle one those of none."""
    import http.server
    import threading

    pages, blocks_of = {f"p{i}": f"2024-01-0{i + 1}T00:00:00.000Z" for i in range(5)}, []

    class Service(http.server.BaseHTTPRequestHandler):
        def reply(self, rows):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"results": rows, "has_more": False}).encode())

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            since = asked.get("filter", {}).get("last_edited_time", {}).get("on_or_after", "")
            self.reply([{"id": k, "last_edited_time": t, "properties": {"n": {"type": "title", "title": [{"plain_text": f"Page {k}"}]}}} for k, t in pages.items() if t >= since])

        def do_GET(self):
            page = self.path.split("/")[-2]
            blocks_of.append(page)
            self.reply([{"type": "paragraph", "paragraph": {"rich_text": [{"plain_text": f"{page} as of {pages[page][:10]}"}]}}])

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    sync = lambda: notion.sync_dump(spark, "db", "token", f"file://{tmp_path}/dump", f"http://127.0.0.1:{server.server_port}", 2)
    try:
        assert sync() == 5 and sorted(blocks_of) == sorted(pages)
        blocks_of.clear()
        assert sync() == 0 and not blocks_of
        pages |= {"p1": "2024-02-01T00:00:00.000Z", "p7": "2024-01-05T00:00:00.000Z"}
        assert sync() == 2 and sorted(blocks_of) == ["p1", "p7"]
    finally:
        server.shutdown()
    found = {r.path: r.content for r in notion.markdown_files(notion.read_dump(spark, f"file://{tmp_path}/dump")).collect()}
    assert len(found) == 6 and "p1 as of 2024-02-01" in found["Page p1.md"] and "p0 as of 2024-01-01" in found["Page p0.md"]
