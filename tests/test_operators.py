import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern import providers
from quern.config import Config
from quern.operators import chunking, context, dense, diagnostics, evaluation, fusion, gates, indexing, lexical, memory, probe, ranking


def test_bm25_fills_up_and_breaks_ties_by_id(spark):
    docs = spark.createDataFrame([(i, "apple pear" if i in (3, 4) else f"other{i} words") for i in range(9)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "apple"), (2, "!!"), (3, "apple apple")], "query_id long, question string")
    index = lexical.build_index(docs)
    rows = lexical.search(index, asked, 5).orderBy("query_id", "rank").collect()
    assert [r.doc_id for r in rows if r.query_id == 1] == [3, 4, 0, 1, 2] and not [r for r in rows if r.query_id == 2]
    one, two = ([r.score for r in rows if r.query_id == q][0] for q in (1, 3))
    assert one > 0 and two == pytest.approx(2 * one, abs=2e-6)
    assert lexical.search(index, asked, 5, matched_only=True).where("query_id = 1").count() == 2


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "apple")], "query_id long, question string")
    assert lexical.search(lexical.build_index(docs), asked).count() == 0


def test_dense_excludes_nothing_but_itself(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    assert [r.vec_id for r in dense.search(vectors, asked, 4).orderBy("rank").collect()] == [1, 3, 2, 4]
    assert [r.vec_id for r in dense.search(vectors, asked, 2, exclude_self=True).orderBy("rank").collect()] == [3, 2]


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1, 5.0), (1, 11, 2, 4.0)], "query_id long, doc_id long, rank int, score double")
    b = spark.createDataFrame([(1, 12, 1, 0.9), (1, 10, 2, 0.8)], a.schema)
    rows = fusion.reciprocal_rank_fusion([a, b]).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [10, 12, 11] and rows[0].rrf_score == pytest.approx(1 / 61 + 1 / 62, abs=1e-9)
    assert rows[0].score_0 == 5.0 and rows[0].score_1 == 0.8 and rows[1].score_0 is None


def test_fusion_by_parent(spark):
    hits = spark.createDataFrame([(1, 0, 1, "a", "p1", 0.9), (1, 0, 2, "b", "p2", 0.8), (1, 1, 1, "c", "p1", 0.7), (1, 1, 2, "d", "", 0.6), (1, 1, 3, "e", None, 0.6)], "query_id int, list_no int, rank int, id string, parent_id string, rerank_score double")
    rows = fusion.fuse_by_parent(hits).orderBy("rank").collect()
    assert [(r.fusion_key, r.id) for r in rows] == [("p1", "a"), ("p2", "b"), ("d", "d"), ("e", "e")]
    assert rows[0].rrf_score == pytest.approx(2 / 61, abs=1e-9) and "rerank_score" not in rows[0].asDict()


def confidences(spark, rows, schema="query_id int, rank int, rerank_score double, rrf_score double"):
    return [r.confidence for r in ranking.with_confidence(spark.createDataFrame(rows, schema)).orderBy("rank").collect()]


def test_confidence(spark):
    assert confidences(spark, [(1, 1, 0.5, 0.01), (1, 2, 0.5, 0.005)]) == pytest.approx([0.6, 0.5])
    assert confidences(spark, [(1, 1, float("nan"), 0.01)]) == pytest.approx([0.2])
    assert confidences(spark, [(1, 1, 0.08), (1, 2, -1.0), (1, 3, float("inf"))], "query_id int, rank int, rrf_score double") == pytest.approx([0.8, 0.0, 0.0])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(), st.floats()), min_size=1, max_size=12))
def test_confidence_is_a_share(spark, pairs):
    assert all(0.0 <= c <= 1.0 for c in confidences(spark, [(1, i + 1, a, b) for i, (a, b) in enumerate(pairs)]))


HITS = "query_id int, rank int, id string, content string, source string, parent_id string, parent_text string, confidence double"


def test_contexts_show_a_parent_once(spark):
    hits = spark.createDataFrame([(1, 1, "a", "child a", "s1", "p1", "whole parent", 0.9), (1, 2, "b", "child b", "s1", "p1", "whole parent", 0.8), (1, 3, "c", " alone ", None, None, None, 0.256), (1, 4, "p1", "", "s2", None, None, 0.1)], HITS)
    text = context.model_context(hits).first().context
    assert text == "[1] s1 (parent chunk, 置信度: 0.90)\nwhole parent\n\n[2] unknown (置信度: 0.26)\nalone\n\n[3] s2 (置信度: 0.10)\n"
    assert context.bounded_context(hits).first().context == "[1] s1\nwhole parent\n\n[2] unknown\nalone"


def test_bounded_context_cuts_and_stops(spark):
    hits = spark.createDataFrame([(1, i, str(i), chr(96 + i) * 5000, "s", None, None, 0.5) for i in range(1, 7)], HITS)
    blocks = context.bounded_context(hits).first().context.split("\n\n")
    assert [len(b) for b in blocks] == [3506, 3506, 3506, 12000 - 3 * 3506]
    tight = Config(context_chars=3600)
    assert [len(b) for b in context.bounded_context(hits, tight).first().context.split("\n\n")] == [3506]


def test_sources(spark):
    hits = spark.createDataFrame([(1, 1, "a", "x" * 400, "d/a.md", None, None, 0.9, 3), (1, 2, "b", "text", "d/b.txt", None, None, 0.8, None)], HITS + ", start_line int")
    files = spark.createDataFrame([("d/a.md", "# One\nl2\nl3\nl4\nl5\nl6")], "path string, content string")
    a, b = context.sources_of(hits, files).orderBy("index").collect()
    assert (a.heading, a.context, len(a.snippet), a.line) == ("One", "# One\nl2\nl3\nl4\nl5", 300, 3) and (b.heading, b.context, b.line) == (None, "", 0)


def test_history(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(12)], "conv_id int, turn int, role string, text string")
    lines = context.history(turns).first().history.split("\n")
    assert len(lines) == 8 and lines[0] == "用户: m4" and lines[-1] == "助手: m11"


def test_critic(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, "NO"), (1, 2, 0.5, "MAYBE"), (1, 3, 0.4, "YES"), (2, 1, 0.3, "NO"), (2, 2, 0.6, "NO")], "query_id int, rank int, confidence double, verdict string")
    got = [(r.query_id, r["rank"], round(r.confidence, 3), r.critic_verdict) for r in gates.apply_critic(rows, maybe_penalty=0.5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 0.4, "YES"), (1, 2, 0.25, "MAYBE"), (2, 1, 0.18, "ALL_NO_PENALTY")]


def test_verdict_lines(spark):
    rows = spark.createDataFrame([("no\n\nMaybe so\nhm",), (None,)], "r string").select(gates.parsed_verdicts(F.col("r"), F.lit(4)).alias("v")).collect()
    assert rows[0].v == ["NO", "MAYBE", "YES", "YES"] and rows[1].v == ["YES"] * 4


def test_answerability(spark):
    ask = [("{\"verdict\": \"answerable\", \"evidence\": \"due on May 3\"}", "It is due on May 3.", True, "ANSWERABLE"), ("```json\n{\"verdict\": \"ANSWERABLE\", \"evidence\": \"in May\"}\n```", "It is due on May 3.", True, "SKIPPED"), ("{\"verdict\": \"UNANSWERABLE\"}", "x", True, "UNANSWERABLE"), ("no JSON", "x", True, "SKIPPED"), (None, "x", True, "SKIPPED"), ("{}", "", True, "UNANSWERABLE"), ("{}", "x", False, "UNANSWERABLE"), ("{\"verdict\": \"ANSWERABLE\", \"evidence\": \"abc\"}", "abc", True, "SKIPPED")]
    rows = spark.createDataFrame(ask, "r string, c string, h boolean, want string")
    for r in rows.select("want", gates.answerability(F.col("r"), F.col("c"), F.col("h")).status.alias("got")).collect():
        assert r.got == r.want


def test_gate_is_strict(spark):
    rows = spark.createDataFrame([(1, 0.3), (2, 0.2999), (3, None)], "query_id int, confidence double")
    assert {r.query_id: r.rejected for r in gates.confidence_gate(rows).collect()} == {1: False, 2: True, 3: True}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 。！\n.", max_size=300), st.integers(5, 40))
def test_splitter_keeps_order_and_size(text, size):
    chunks = chunking.split_text(text, size, size // 4)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    at = 0
    for c in chunks:
        found = text.find(c, max(0, at - size))
        assert found >= 0
        at = found + 1
    if not any(len(p) > size for p in text.split()):
        assert set("".join(chunks)) | set(" \n") >= set(text)


def test_splitter_levels():
    assert chunking.split_text("a" * 12, 5, 0) == ["aaaaa", "aaaaa", "aa"]
    assert chunking.split_text("一二三。四五六。七", 5, 0) == ["一二三", "。四五六", "。七"]
    assert chunking.split_text("aa bb cc dd", 8, 3) == ["aa bb cc", "cc dd"]
    assert chunking.split_text("exact", 5, 0) == ["exact"] and chunking.split_text("", 5, 0) == [] and chunking.split_text(None, 5, 0) == []


def test_parents_and_children(spark):
    docs = spark.createDataFrame([("s", "word " * 600, None), ("m", "Title: x", "pdf_metadata")], "source string, content string, chunk_role string")
    parents = chunking.parents(docs).collect()
    assert {len(p.parent_id) for p in parents} == {12} and len({p.parent_id for p in parents}) == len(parents) > 2
    children = chunking.with_parents(chunking.children(chunking.parents(docs)), chunking.parents(docs)).collect()
    assert all(c.content in c.parent_text for c in children) and [c.chunk_role for c in children if c.source == "m"] == ["pdf_metadata"]


def test_manifest_pass(spark):
    old = spark.createDataFrame([("same", "1"), ("changed", "1"), ("gone", "1"), ("broken", "1")], "path string, sha256 string")
    new = spark.createDataFrame([("same", "1"), ("changed", "2"), ("new", "1"), ("broken", "2")], "path string, sha256 string")
    assert {r.path: r.status for r in indexing.diff(new, old).collect()} == {"same": "unchanged", "changed": "changed", "gone": "deleted", "new": "new", "broken": "changed"}
    changed, deleted = indexing.changed_files(new, old), indexing.deleted_files(new, old)
    parsed = changed.where("path <> 'broken'").select("path")
    after = indexing.next_manifest(old, new, parsed, deleted)
    assert {tuple(r) for r in after.collect()} == {("same", "1"), ("changed", "2"), ("new", "1"), ("broken", "1")}
    assert {r.path for r in indexing.diff(new, after).where("status <> 'unchanged'").collect()} == {"broken"}
    chunks = spark.createDataFrame([("same", "a"), ("changed", "b"), ("gone", "c"), ("broken", "d")], "source string, content string")
    fresh = spark.createDataFrame([("changed", "B"), ("new", "N")], "source string, content string")
    assert {tuple(r) for r in indexing.apply_changes(chunks, fresh, deleted).collect()} == {("same", "a"), ("changed", "B"), ("new", "N"), ("broken", "d")}


def test_evaluation(spark):
    questions = spark.createDataFrame([(1, ["Key", "other"], ["a.md"], False, None), (2, [], ["x"], True, "off_topic"), (3, [], ["x"], True, None), (4, None, ["b"], False, None)], "query_id int, keywords array<string>, must_cite array<string>, expect_reject boolean, negative_type string")
    hits = spark.createDataFrame([(1, 1, "d/b.md", "the KEY", 0.5), (1, 2, "d/a.md", "nothing", 0.4), (2, 1, "q", "t", 0.31), (3, 1, "q", "t", 0.29)], "query_id int, rank int, source string, text string, confidence double")
    rows = {r.query_id: r for r in evaluation.question_rows(questions, hits).collect()}
    assert (rows[1].context_precision, rows[1].context_recall, rows[1].hit_at_1, rows[1].hit_at_3, rows[1].answer_hit_at_3, rows[1].reject_correct) == (0.5, 0.5, 0, 1, 1, None)
    assert (rows[2].reject_correct, rows[3].reject_correct, rows[4].context_precision, rows[4].context_recall) == (0, 1, 0.0, 1.0)
    summary = {r.metric: r.value for r in evaluation.summary(evaluation.question_rows(questions, hits)).collect()}
    assert summary["reject_accuracy"] == 0.5 and summary["reject_accuracy_off_topic"] == 0.0 and summary["reject_accuracy_untyped"] == 1.0 and summary["num_negative_untyped"] == 1.0 and summary["hit_at_3"] == 0.5


def test_run_comparison(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.5), ("z", 1.0)], "metric string, value double")
    b = spark.createDataFrame([("x", 0.7), ("y", 0.4), ("w", 1.0)], "metric string, value double")
    rows = {r.metric: (r["diff"], r.improved) for r in evaluation.compare_runs(a, b).collect()}
    assert rows == {"x": (0.2, True), "y": (-0.1, False), "z": (None, None), "w": (None, None)}
    assert "↑" in evaluation.report_lines(evaluation.compare_runs(a, b)).where("metric = 'x'").first().line


def test_probe(spark):
    runs = spark.createDataFrame([("q1", "positive", 0, "the key", 0.9, False, ["key"]), ("q1", "positive", 1, "nothing here at all", 0.9, False, ["key"]), ("q2", "off_topic", 0, "x", 0.1, True, [])], "question string, type string, run int, answer string, confidence double, expect_reject boolean, keywords array<string>")
    states = probe.classify(runs)
    rows = {r.question: r for r in probe.question_summary(states).collect()}
    assert rows["q1"].state == "MIXED" and rows["q1"].state_counts["DELIVERED"] == 1 and rows["q1"].state_counts["REFUSED"] == 0 and rows["q2"].state == "SYSTEM_REFUSE"
    total = probe.aggregate(states).first()
    assert (total.n_records, total.refused, total.refused_by_template, total.delivery_rate, total.non_delivery_rate, total.gate_share) == (3, 0, 0, 0.5, 1.0, 1.0)


def test_faithfulness(spark):
    replies = ['```json\n{"claims": [{"text": "a", "supported": true}, {"text": "b", "supported": false}]}\n```', '{"claims": [], "score": 0.25}', "broken", '{"claims": []}']
    rows = spark.createDataFrame([(r,) for r in replies], "r string").select(probe.judged_claims(F.col("r")).alias("j")).select("j.*")
    assert [(r.score, r.unsupported) for r in rows.collect()] == [(0.5, ["b"]), (0.25, []), (None, []), (None, [])]
    assert tuple(probe.faithfulness_summary(rows).first()) == (4, 0.375, 2)


def test_contexts_of_results(spark):
    rows = spark.createDataFrame([(["c"], [("s", "x")]), ([], [("s", ""), ("", ""), ("t", "y")]), (None, None)], "c array<string>, s array<struct<snippet:string,context:string>>")
    assert [r.x for r in rows.select(probe.contexts_of(F.col("c"), F.col("s")).alias("x")).collect()] == [["c"], ["s", "y"], []]


def test_memory(spark, tmp_path):
    path = f"{tmp_path}/memory"
    memory.append(memory.new_items(spark, [("u", "likes green tea", ["drink"]), ("u", "lives in Rome", []), ("v", "green tea", [])]), path)
    items = memory.load(spark, path)
    asked = spark.createDataFrame([(1, "u", "green tea drink"), (2, "u", "zzz"), (3, "u", "")], "query_id int, user_id string, question string")
    found = memory.search(items, asked).join(items, "id").collect()
    assert [(r.query_id, r.content, r.score) for r in found] == [(1, "likes green tea", pytest.approx(3 / 3**0.5, abs=1e-6))]
    gone = items.where("user_id = 'v'").select("id")
    assert memory.without(items, gone).count() == 2 and memory.without(items, spark.createDataFrame([("none",)], "id string")).count() == 3


def test_diagnostics(spark):
    lists = spark.createDataFrame([(0.5, 0.2), (0.4, 0.1)], "confidence double, rerank_score double")
    assert all(r.passed for r in diagnostics.retrieval_checks(lists, lists, lists).collect())
    assert {r.check: r.passed for r in diagnostics.retrieval_checks(lists.limit(0), lists, lists.limit(0)).collect()} == {"lexical": False, "dense": True, "confidence": False, "rerank_spread": False}
    assert diagnostics.collection_size(spark.range(95)).first().verdict == "duplicated"


def test_config(spark, monkeypatch):
    monkeypatch.setenv("QUERN_TOP_K", "7")
    assert Config.load().top_k == 7 and len(Config.__dataclass_fields__) >= 24
    with pytest.raises(ValueError, match="overlap"):
        Config(chunk_size=10, chunk_overlap=10)


def test_notify(monkeypatch):
    sent = []

    class Reply:
        status = 204

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    monkeypatch.setattr(providers.urllib.request, "urlopen", lambda request, timeout: sent.append(json.loads(request.data)) or Reply())
    assert providers.notify("http://x", "done", {"n": 1}) and sent == [{"event": "done", "data": {"n": 1}, "source": "quern"}]

    def fail(*_, **__):
        raise OSError("down")

    monkeypatch.setattr(providers.urllib.request, "urlopen", fail)
    assert not providers.notify("http://x", "done", {}) and not providers.notify(None, "done", {})


def test_unknown_plugin():
    with pytest.raises(KeyError):
        providers.chosen(providers.EMBEDDERS, "missing")


def test_as_of_over_stretches(spark):
    """The last heading above each hit, also where a stretch of lines has none of its own, whatever the stretch's width."""
    rng = random.Random(2)
    heads = [(p, rng.randint(0, 400), f"h{i:03d}") for i in range(60) for p in ("a", "b")] + [("a", 7, "h900"), ("only", 3, "h1")]
    hits = [(p, rng.randint(0, 500), i) for i in range(150) for p in ("a", "b", "c")] + [("only", 2, 1), ("only", 3, 2), ("only", 4000, 3)]
    want = {}
    for p, line, i in hits:
        above = [(at, h) for q, at, h in heads if q == p and at <= line]
        want[p, line, i] = max(above)[1] if above else None
    left, right = spark.createDataFrame(hits, "path string, line int, hit int"), spark.createDataFrame(heads, "path string, line int, heading string")
    for width in (1, 10, 1000):
        found = context.as_of(left, right, ["path"], "line", "heading", width).collect()
        assert len(found) == len(hits) and {(r.path, r.line, r.hit): r.heading for r in found} == want


def test_memories_are_compared_in_cells(spark, monkeypatch):
    """Cells give the best memories of each query, ties by id, and no row for what a frequent word has in common."""
    import random

    from quern.operators import memory

    for name, size in (("QUERIES", 20), ("ITEMS", 50), ("TOGETHER", 8), ("TOKENS", 40), ("BLOCK", 16)):
        monkeypatch.setattr(memory, name, size)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    said = lambda n: "the " + " ".join(rng.choices(words, k=n))
    items = [(str(i), "a" if i % 10 else "b", said(rng.randint(0, 12)), None) for i in range(400)]
    asked = [(i, "a" if i % 4 else "b", said(rng.randint(0, 9)) if i % 9 else "") for i in range(60)] + [(60, "nobody", "the w1")]
    held = spark.createDataFrame(items, "id string, user_id string, content string, tags array<string>")
    found = memory.search(held, spark.createDataFrame(asked, "query_id int, user_id string, question string"), 3)
    want = []
    for q, user, question in asked:
        tokens = set(question.split())
        scores = sorted((-len(tokens & set(text.split())), i) for i, owner, text, _ in items if owner == user and tokens & set(text.split()))
        want += [(q, i, rank, round(-n / len(tokens) ** 0.5, 6)) for rank, (n, i) in enumerate(scores[:3], 1)]
    assert sorted((r.query_id, r.id, r["rank"], r.score) for r in found.collect()) == sorted(want)
    assert "Generate explode(tokens" not in found._jdf.queryExecution().executedPlan().toString() and "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_index_has_the_tokens_of_the_expression(spark):
    """Words are counted over bytes in tasks; odd texts give the tokens of search_tokens, and a range is one block a token."""
    texts = ["", None, "One one ONE_1 two", "合同Abc金额 über 100 元", "İstanbul K K naïve", "a" * 3000 + " b", "末", "鿿一 x鿿ꀀy", "é _ 9", "ab", "ab", "  \n", "😀合😀同 z"] + [f"w{i % 7} w{i % 5} 合{chr(0x4E00 + i % 9)}" for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    index = lexical.build_index(docs)
    found = index.blocks.select("token", "part", "n", "total", "top_tf", "low_tokens", F.explode("postings").alias("p")).collect()
    wanted = lexical._counted(lexical._tokens(docs, "doc_id", "text")).select("doc_id", "token", "tf", "n_tokens").collect()
    assert sorted((r.p.doc_id, r.token, r.p.tf, r.p.n_tokens) for r in found) == sorted(tuple(r) for r in wanted)
    groups = {}
    for r in found:
        groups.setdefault((r.token, r.part, r.n, r.total, r.top_tf, r.low_tokens), []).append(r.p)
    assert len(groups) == index.blocks.count() == index.blocks.select("token", "part").distinct().count()
    for (_, _, n, total, top, low), held in groups.items():
        assert (n, total, top, low) == (len(held), sum(p.tf for p in held), max(p.tf for p in held), min(p.n_tokens for p in held))
    assert set(lexical._counts(docs, "doc_id", "text").columns) == {"doc_id", "n_tokens", "words", "tfs"}
