"""The store's parts, versions and compaction, and the index of segments, against plain counts."""

import json
import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern import engine
from quern import store as stores
from quern.config import Config
from quern.operators import lexical
from quern.sources import files

CONFIG = Config(embedding_dim=8, use_answerability_check=False)
WORDS = "amount contract hiking shoes tent invoice paid total service maker river stone cloud index page".split()


def text(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(n))


def written(root):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names}


def bm25(docs, query, top):
    """Scores worked out document by document."""
    tokens = {k: re.findall(r"[a-z0-9_]+", t.lower()) for k, t in docs.items()}
    df = Counter(w for t in tokens.values() for w in set(t))
    average, n = sum(map(len, tokens.values())) / len(tokens), len(tokens)
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    scores = {}
    for k, t in tokens.items():
        counts = Counter(t)
        s = sum(idf[w] * counts[w] * 2.5 / (counts[w] + 1.5 * (0.25 + 0.75 * len(t) / average)) for w in re.findall(r"[a-z0-9_]+", query.lower()) if w in counts)
        scores[k] = round(s, 6)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:top]


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    for i in range(6):
        (root / f"f{i}.md").write_text(text(i))
    return root


def test_passes_write_what_changed(spark, folder, tmp_path):
    store, where = engine.Store(spark, f"file://{tmp_path}/store"), f"{tmp_path}/store"
    passed = lambda: engine.reindex(store, f"file://{folder}", config=CONFIG).first()
    first = passed()
    assert (first.total_files, first.new_or_changed, first.deleted) == (6, 6, 0) and first.chunks_added == store.chunks().count() >= 6
    before = written(where)
    again = passed()
    assert (again.new_or_changed, again.deleted, again.chunks_added) == (0, 0, 0) and written(where) == before and store.version() == 1
    os.utime(folder / "f1.md", (1, 1))  # touched only: its digest is read and noted, and it is not parsed again
    touched = passed()
    assert (touched.new_or_changed, touched.chunks_added, store.version()) == (0, 0, 2)
    (folder / "f2.md").write_text("   \n")  # nothing is left in it
    (folder / "f3.md").unlink()
    (folder / "f4.md").write_text("quite another text")
    (folder / "a [b].md").write_text("a name with signs of a pattern")
    third = passed()
    assert (third.total_files, third.new_or_changed, third.deleted, third.chunks_added) == (6, 3, 1, 2)
    held = {}
    for r in store.chunks().collect():
        held.setdefault(r.source, []).append(r.content)
    assert set(held) == {"f0.md", "f1.md", "f4.md", "f5.md", "a [b].md"} and held["f4.md"] == ["quite another text"]
    assert {r.path for r in store.manifest().collect()} == {"f0.md", "f1.md", "f2.md", "f4.md", "f5.md", "a [b].md"}
    assert passed().new_or_changed == 0 and store.version() == 3 and store.versions() == [2, 3]  # the two newest are kept
    forced = engine.reindex(store, f"file://{folder}", force=True, config=CONFIG).first()
    assert forced.new_or_changed == 6 and len(store.state()) == 1 and store.chunks().count() == sum(map(len, held.values()))


def test_a_failing_file_keeps_its_chunks(spark, folder, tmp_path):
    store = engine.Store(spark, f"file://{tmp_path}/store")
    engine.reindex(store, f"file://{folder}", config=CONFIG)
    (folder / "f0.md").write_bytes(b"\xff\xfe broken")
    for _ in range(2):
        assert engine.reindex(store, f"file://{folder}", config=CONFIG).first().new_or_changed == 1
        assert "f0.md" in {r.source for r in store.chunks().collect()} and store.version() == 1


def test_two_passes_at_once_are_a_conflict(spark, folder, tmp_path):
    one, other = (engine.Store(spark, f"file://{tmp_path}/store") for _ in range(2))
    engine.reindex(one, f"file://{folder}", config=CONFIG)
    one._based_on = other._based_on = 1
    other._commit(other.state(1))
    with pytest.raises(stores.Conflict):
        one._commit([])
    assert other.version() == 2 and one.chunks().count() > 0


def rows_of(spark, given):
    chunks = spark.createDataFrame([(f"{s}#{c}", s, None, 0, c, None, [0.0]) for s, c in given], stores.CHUNK_SCHEMA)
    return chunks, spark.createDataFrame([], stores.PARENT_SCHEMA)


def test_compaction_keeps_the_collection(spark, tmp_path, monkeypatch):
    """After every pass, also those that merge parts, chunks, manifest and BM25 are those of the files that are left."""
    monkeypatch.setattr(stores, "MOST_PARTS", 3)
    store, rng, left = engine.Store(spark, f"file://{tmp_path}/store"), random.Random(4), {}
    merged = 0
    for step in range(7):
        changed = {f"s{i}": text(100 * step + i, 12) for i in rng.sample(range(12), 12 if step == 0 else 2)}
        gone = set(rng.sample(sorted(left), 1)) - set(changed) if step else set()
        left = {k: v for k, v in left.items() if k not in gone} | changed
        if step == 5:  # a chunk that was there before comes back
            changed["s0"] = left["s0"] = "the very same words again"
        if step == 6:
            changed["s0"] = left["s0"] = "the very same words again"
        parts = len(store.state())
        manifest = spark.createDataFrame([(k, v, 1, None) for k, v in changed.items()] + [(k, None, None, None) for k in gone], stores.MANIFEST_SCHEMA)
        store.write(*rows_of(spark, changed.items()), manifest, spark.createDataFrame([(k,) for k in {*changed, *gone}], "source string"))
        merged += len(store.state()) <= parts
        assert {(r.source, r.content) for r in store.chunks().collect()} == set(left.items()) and store.chunks().count() == len(left)
        assert {(r.path, r.sha256) for r in store.manifest().collect()} == set(left.items())
        index = store.index()
        assert index.n_docs == len(left) and {r.doc_id for r in index.documents.collect()} == {f"{s}#{c}" for s, c in left.items()}
    assert merged and len(store.state()) <= 3
    question = "the same total1 amount2 contract3 shoes1 tent2 river5 again"
    found = lexical.search(index, spark.createDataFrame([(1, question)], "query_id int, question string"), 5).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in found] == bm25({f"{s}#{c}": c for s, c in left.items()}, question, 5)
    names = set(os.listdir(tmp_path / "store" / "parts"))
    assert names >= {p["name"] for p in store.state()} and json.loads((tmp_path / "store" / "versions" / f"v{store.version():09d}.json").read_text()) == store.state()


def test_large_parts_are_not_rewritten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST_PARTS", 2)
    store = engine.Store(spark, f"file://{tmp_path}/store")
    for step in range(4):
        given = [(f"s{step}-{i}", text(step * 50 + i, 5)) for i in range(40 if step == 0 else 1)]
        store.write(*rows_of(spark, given), spark.createDataFrame([(s, "x", 1, None) for s, _ in given], stores.MANIFEST_SCHEMA), spark.createDataFrame([(s,) for s, _ in given], "source string"))
    assert [p["chunks"] for p in store.state()] == [40, 3] and store.state()[0]["seq"] == 1


@pytest.fixture(scope="module")
def zipfian(spark):
    """Documents of a few frequent words and many rare ones."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    docs = {i: " ".join(rng.choices(vocabulary, weights, k=rng.randint(5, 80))) for i in range(1500)}
    return docs, lexical.build_index(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))


def test_ranges_that_cannot_enter_are_skipped(spark, zipfian, monkeypatch):
    docs, _ = zipfian
    monkeypatch.setattr(lexical, "RANGE", 16)
    index = lexical.build_index(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    asked = [(0, docs[17]), (1, "w0 w1 w2 w3"), (2, "w2500 w0"), (3, docs[99] + " w0 w0"), (4, "nothing here"), (5, "w7 w2999 w1"), (6, ""), (7, "w100 w0"), (8, "w0")]
    queries = spark.createDataFrame(asked, "query_id int, question string")
    for top in (3, 10):
        found = {}
        for r in lexical.search(index, queries, top).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append((r.doc_id, r.score))
        for q, question in asked:
            assert found.get(q, []) == (bm25(docs, question, top) if question else [])
    tokens = queries.select("query_id", F.explode(F.split("question", " ")).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    chosen = lexical.choose_blocks(lexical.LexicalIndex(**vars(index)), tokens, 3)
    counts = {r.query_id: (r["read"], r.skipped) for r in chosen.groupBy("query_id").agg(F.count_if("needed").alias("read"), F.count_if(~F.col("needed")).alias("skipped")).collect()}
    assert all(counts[q][1] > counts[q][0] > 0 for q in (7, 8)) and all(counts[q][1] > 0 for q in (0, 1, 3))


def test_segments_are_one_index(spark, zipfian, tmp_path):
    """Three segments, of which later ones take documents away, give what one index of the rest gives."""
    docs, _ = zipfian
    paths, gone = {}, spark.createDataFrame([], "doc_id long, before int")
    lost: set[int] = set()
    for seq in range(3):
        part = {k: v for k, v in docs.items() if k % 3 == seq}
        dead = {k: v for k, v in docs.items() if k % 3 < seq and k % 10 == seq and k not in lost}
        lost |= set(dead)
        paths[seq] = f"file://{tmp_path}/{seq}"
        frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
        lexical.write_segment(frame(part), paths[seq], gone=frame(dead) if dead else None)
        gone = gone.unionByName(spark.createDataFrame([(k, seq) for k in dead], "doc_id long, before int"))
    whole = {k: v for k, v in docs.items() if k not in lost}
    index = lexical.read_segments(spark, paths, gone)
    assert lost and index.n_docs == len(whole)
    queries = spark.createDataFrame([(0, docs[17]), (1, "w0 w5 w2500"), (2, docs[min(lost)])], "query_id int, question string")
    got = {}
    for r in lexical.search(index, queries, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert all(got[q] == bm25(whole, question, 10) for q, question in [(0, docs[17]), (1, "w0 w5 w2500"), (2, docs[min(lost)])])


def test_many_queries_are_scored_in_cells_of_ranges(spark, zipfian, tmp_path, monkeypatch):
    """What many tokens ask for is scored range by range: the result is that of few, over segments with lost documents too."""
    docs, index = zipfian
    monkeypatch.setattr(lexical, "FEW_ASKED", 0)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 7)
    monkeypatch.setattr(lexical, "POSTINGS", 500)
    asked = [(k, docs[k * 37]) for k in range(20)] + [(20, "w0 w0 w1"), (21, "nothing here"), (22, "")]
    queries = spark.createDataFrame(asked, "query_id int, question string")
    seen = lexical._in_cells(index, index.terms.join(queries.selectExpr("query_id", "explode(split(question, ' ')) as token", "1L as times"), "token"), 10)
    assert seen.where("query_id = 20").count() < 1000  # matches by far more, of which each cell gives what can be among the best

    def check(index, docs, top):
        found = {}
        for r in lexical.search(index, queries, top).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append((r.doc_id, r.score))
        for q, question in asked:
            assert found.get(q, []) == (bm25(docs, question, top) if question else [])

    check(index, docs, 10)
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    lost = {k: v for k, v in docs.items() if k % 6 == 0}
    lexical.write_segment(frame({k: v for k, v in docs.items() if k % 2 == 0}), f"file://{tmp_path}/0")
    lexical.write_segment(frame({k: v for k, v in docs.items() if k % 2}), f"file://{tmp_path}/1", gone=frame(lost))
    gone = spark.createDataFrame([(k, 1) for k in lost], "doc_id long, before int")
    check(lexical.read_segments(spark, {0: f"file://{tmp_path}/0", 1: f"file://{tmp_path}/1"}, gone), {k: v for k, v in docs.items() if k not in lost}, 5)


def test_a_cell_gives_what_is_best_in_all_of_it(spark, zipfian, monkeypatch):
    """What the first ranges of a cell found goes once later ones are better; terms of one segment don't move."""
    docs, index = zipfian
    assert "Exchange" not in index.terms._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lexical, "FEW_ASKED", 0)
    monkeypatch.setattr(lexical, "POSTINGS", 200)
    monkeypatch.setattr(lexical, "DOCUMENTS", 16)
    asked = [(k, docs[k * 37]) for k in range(20)]
    queries = spark.createDataFrame(asked, "query_id int, question string")
    words = queries.selectExpr("query_id", "explode(split(question, ' ')) as token").groupBy("query_id", "token").agg(F.count("*").alias("times"))
    terms = index.terms.join(words, "token")
    assert lexical._in_cells(index, terms, 10).count() <= 20 * 4 * 12  # 4 cells; 10 of each, and ties
    monkeypatch.setattr(lexical, "FOUND", 8)
    found = {}
    for r in lexical.search(index, queries, 10).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert found == {q: bm25(docs, question, 10) for q, question in asked}


@pytest.mark.parametrize("few", [0, 256])
def test_scores_below_zero_are_kept(spark, monkeypatch, few):
    """A word of all documents of a corpus of copies has a weight below zero; documents that also fill lists keep that score."""
    monkeypatch.setattr(lexical, "FEW_ASKED", few)
    index = lexical.build_index(spark.createDataFrame([(i, "apple") for i in range(30)], "doc_id long, text string"))
    rows = lexical.search(index, spark.createDataFrame([(1, "apple")], "query_id int, question string"), 5).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in rows] == [(i, round(0.25 * (math.log(0.5) - math.log(30.5)), 6)) for i in range(5)]


def test_postings_are_made_where_their_range_is(spark):
    """Tokens are counted within a row: no shuffle and no aggregation over occurrences."""
    docs = spark.createDataFrame([(1, "b a b c b a"), (2, ""), (3, None), (4, "x")], "doc_id long, text string")
    counted = lexical._counted(lexical._tokens(docs, "doc_id", "text"))
    assert sorted((r.doc_id, r.n_tokens, r.token, r.tf) for r in counted.collect()) == [(1, 6, "a", 2), (1, 6, "b", 3), (1, 6, "c", 1), (4, 1, "x", 1)]
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_scan_by_paths(spark, folder):
    assert {r.path for r in files.scan(spark, f"file://{folder}", only=["f1.md", "f3.md"]).collect()} == {"f1.md", "f3.md"}
    assert files.scan(spark, f"file://{folder}", only=[]).count() == 0 and files.listing(spark, f"file://{folder}").count() == 6
