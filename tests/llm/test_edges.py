"""Empty tables, repeated rows, shared and missing ids, and columns whose names operators use themselves."""

import random

import corpus_pipeline
import public_tokenizers
import pytest
from conftest import SCHEMA, prose
from pyspark.sql import functions as F

from quern.llm import decontaminate, kernels, language_id, license_scan, lm_scoring, packing, quality, simhash, substring_dedup, token_output

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
OPERATORS = {
    "language_id": lambda d, b: language_id.identify(d, language_id.fit_dictionaries(d)),
    "substring_dedup": lambda d, b: substring_dedup.remove_duplicates(d),
    "token_output": lambda d, b: token_output.token_digest(d, BYTE),
    "license_scan": lambda d, b: license_scan.scan_licenses(d),
    "simhash": lambda d, b: simhash.near_duplicates(d),
    "lm_scoring": lambda d, b: lm_scoring.score_texts(d, kernels.remainder() != 1),
    "decontaminate": lambda d, b: decontaminate.contamination_digest(d, b),
    "packing": lambda d, b: packing.pack_documents(d, WORD).where("start = 0"),
    "quality": lambda d, b: quality.score_quality(d, d.select("doc_id", F.lit(1).alias("quality")), kernels.remainder() == 0),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, no_docs, benchmark):
    assert OPERATORS[name](no_docs, benchmark).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, odd_docs, benchmark):
    found = OPERATORS[name](odd_docs, benchmark).collect()
    per_id = {}
    for r in found:
        per_id[r.doc_id] = per_id.get(r.doc_id, 0) + 1
    assert per_id == {1: 2, 2: 2, None: 2, 7: 1}


def test_repeated_rows_of_one_id_are_one_place(odd_docs):
    """The two equal rows of id 1 come first and keep their words; the later copies lose theirs."""
    found = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_duplicates(odd_docs).collect()]
    assert sorted(found, key=str) == sorted([(1, 22, 0), (1, 22, 0), (2, 22, 22), (2, 6, 0), (None, 22, 22), (None, 0, 0), (7, 0, 0)], key=str)


def test_components_without_ids(odd_docs):
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd_docs).collect()}
    assert (1, 1) in found and (2, 1) in found and (None, 1) in found and (7, 7) in found and (None, 7) in found


@pytest.fixture(scope="module")
def long_rows():
    """A text longer than a slice, a copy of it, and short ones before and behind."""
    text = prose(random.Random(17), "en", 220_000)
    return [(0, "short text first"), (1, text), (2, text), (3, "the mit license and more words"), (4, None)]


@pytest.mark.parametrize("name", OPERATORS)
def test_text_beyond_a_slice(name, spark, long_rows, benchmark):
    import brute

    assert len(long_rows[1][1]) > kernels.SLICE_BYTES
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in long_rows], SCHEMA).coalesce(1)
    found = {r.doc_id: r for r in OPERATORS[name](docs, benchmark).collect()}
    assert set(found) == {0, 1, 2, 3, 4}
    if name == "substring_dedup":
        assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in found.items()} == brute.substring_dedup(long_rows)
    elif name == "license_scan":
        assert {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in found.items()} == brute.license_base(long_rows)
    elif name == "lm_scoring":
        base, model = brute.language_model_base(long_rows), brute.language_model(long_rows, lm_scoring.MU)
        assert all(r.n_tokens == base[i][0] and r.base_score == pytest.approx(base[i][3], rel=1e-9) for i, r in found.items())
        assert all(abs(r.score - model[i]) / r.n_tokens < lm_scoring.CODE_STEP for i, r in found.items())
    elif name == "simhash":
        assert found[1].component_id == found[2].component_id == 1 and found[1].fp == found[2].fp
    elif name == "language_id":
        assert found[1].lang_pred == "en" == found[2].lang_pred


def test_no_items(docs, benchmark, rows):
    found = decontaminate.contamination_digest(docs, benchmark.limit(0)).collect()
    assert len(found) == len(rows) and not any(r.contaminated for r in found)


@pytest.fixture()
def folder(spark, docs, benchmark, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_stages(spark, docs, folder, rows, items):
    """Each stage against the contract of its operator, on what the one before it kept."""
    import brute

    now, kept = docs, {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns
        now = corpus_pipeline.stage_table(now, "test")
        got = {r.doc_id: r.text for r in now.collect()}
        if name == "language_id":
            assert not any(not t or not any(c.isalpha() for c in t) for t in got.values())
            assert len(got) >= len(kept) - 6
        elif name == "near_dedup":
            shingles = {d: brute.shingles(t) for d, t in kept.items()}
            share = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])  # noqa: B023, E731
            assert not [(a, b) for a in got for b in got if a < b and share(a, b) >= 0.87]
            assert all(any(share(d, e) >= 0.65 for e in kept if e != d) for d in set(kept) - set(got))
            assert len(got) < len(kept)
        elif name == "substring_dedup":
            want = brute.substring_dedup(list(kept.items()))
            assert set(got) == {d for d, (n, gone, _) in want.items() if gone == 0 or gone < n}
            assert all(len(brute.SPACED.findall(got[d])) == want[d][0] - want[d][1] and (want[d][1] or got[d] == kept[d]) for d in got)
        else:
            assert set(got) == {d for d, v in brute.contamination(list(kept.items()), items).items() if not v[4]}
        kept = got
    packed = corpus_pipeline.STAGES[-1][1](spark, now, folder)
    assert {r.doc_id for r in packed.collect()} == set(kept)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()} == set(kept)


def test_near_dedup_judges_rows_not_ids(spark, odd_docs, docs):
    """A unique text stays though another row of its id is a copy; rows without an id stay; the choice is the same each time."""
    kept = [[r.asDict() for r in corpus_pipeline.drop_near_duplicates(spark, odd_docs.repartition(n), "").collect()] for n in (1, 4)]
    assert sorted(map(str, kept[0])) == sorted(map(str, kept[1]))
    texts = sorted(((r["doc_id"], (r["text"] or "")[:7]) for r in kept[0]), key=str)
    assert texts == sorted([(1, "one two"), (2, "another"), (None, "one two"), (None, ""), (7, "")], key=str)
    twice = docs.where("doc_id < 9")
    assert corpus_pipeline.drop_near_duplicates(spark, twice.unionByName(twice), "").count() == corpus_pipeline.drop_near_duplicates(spark, twice, "").count()


def test_pipeline_with_odd_rows(spark, odd_docs, no_docs, folder):
    for given in (odd_docs, no_docs):
        now = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, folder)
            assert now.columns == given.columns
            now = corpus_pipeline.stage_table(now, "test")
        corpus_pipeline.STAGES[-1][1](spark, now, folder).collect()
