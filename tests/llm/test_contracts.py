"""Operators against the contracts worked out row by row, on rows with every awkward case."""

import math
import random

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import HEADS, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import decontaminate, kernels, language_id, license_scan, lm_scoring, packing, quality, simhash, substring_dedup, token_output, topk_search

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_substring_dedup(docs, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_duplicates(docs).collect()}
    want = brute.substring_dedup(pairs(rows))
    assert got == want
    assert sum(v[1] for v in want.values()) > 500


def test_substring_dedup_texts_and_factors(docs, rows):
    by_id = dict(pairs(rows))
    seen = 0
    for r in substring_dedup.remove_duplicates(docs).where("n_removed > 0").collect():
        kept = brute.SPACED.findall(r.kept_text)
        assert len(kept) == r.n_words - r.n_removed
        for f in r.factors:
            seen += 1
            words, source = brute.SPACED.findall(by_id[r.doc_id]), brute.SPACED.findall(by_id[f.source_id])
            assert f.length >= 20 and (f.source_id, f.source_start) < (r.doc_id, f.start)
            assert words[f.start : f.start + f.length] == source[f.source_start : f.source_start + f.length]
    assert seen


@pytest.mark.parametrize("seed", range(4))
def test_substring_dedup_small_alphabet(spark, seed, monkeypatch):
    """Texts of two words repeat everywhere, with overlaps and ties; hot anchors change nothing."""
    if seed > 1:
        for name, value in (("HOT_SAMPLE", 1), ("HOT_LEAST", 3)):
            monkeypatch.setattr(substring_dedup, name, value)
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) if i % 3 else " ".join(["a"] * rng.randint(15, 60))) for i in range(25)]
    found = substring_dedup.remove_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=6)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()} == brute.substring_dedup(rows, 6)


def test_factors_are_maximal(spark):
    """A factor can't go on in its source; one over the borders of many runs is found whole."""
    rng = random.Random(31)
    word = lambda: f"w{rng.randrange(30)}"
    texts = [[word() for _ in range(rng.randint(30, 120))] for _ in range(6)]
    for _ in range(30):  # pieces of earlier texts, one behind the other, some with new words between
        new = []
        for _ in range(rng.randint(1, 6)):
            source = rng.choice(texts)
            a = rng.randrange(len(source))
            new += source[a : a + rng.randint(5, 60)] + [word() for _ in range(rng.choice([0, 0, 1, 4]))]
        texts.append(new)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = substring_dedup.remove_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), window=6).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute.substring_dedup(rows, 6)

    def match(doc, start, source, at):
        n = 0
        while start + n < len(texts[doc]) and at + n < len(texts[source]) and texts[doc][start + n] == texts[source][at + n]:
            n += 1
        return n

    longer = 0
    for r in found:
        factors = [(f.start, f.length, f.source_id, f.source_start) for f in r.factors]
        assert factors == sorted(factors) and len({f[0] for f in factors}) == len(factors)
        for start, n, source, at in factors:
            assert (source, at) < (r.doc_id, start) and match(r.doc_id, start, source, at) == n >= 6
            longer += n > 40
    assert longer > 5


def test_parse_of_a_long_repetition_is_quick():
    """A hundred thousand windows with one name are a few factors, not a search of all with all."""
    n = 100_000
    runs = [(i, 1, 3, 0) for i in range(n)]
    assert substring_dedup.parse(7, runs, {3: [(i, 1, 3, 0) for i in range(1, 1000)]})[:2] == [(0, 1000, 3, 0), (1000, 1000, 3, 0)]
    assert substring_dedup.parse(3, runs[1:], {}) == [(1, n - 1, 3, 0)]
    assert substring_dedup.parse(7, [(0, 5, 3, 0), (5, 5, 3, 0)], {3: [(0, 9, 1, 4)]}) == [(0, 5, 3, 0), (5, 5, 3, 0)]


def test_parse_follows_the_longest_source():
    """Windows 0 to 9 first occur in document 1 and 10 to 29 in document 2, which repeats the first ten before them."""
    runs = [(0, 10, 1, 100), (10, 20, 2, 60)]
    assert substring_dedup.parse(7, runs, {2: [(50, 10, 1, 100)]}) == [(0, 30, 2, 50)]
    assert substring_dedup.parse(7, runs, {2: [(50, 10, 1, 101)]}) == [(0, 10, 1, 100), (10, 20, 2, 60)]
    assert substring_dedup.parse(7, runs, {1: [(110, 5, 2, 60)]}) == [(0, 15, 1, 100), (15, 15, 2, 65)]
    assert substring_dedup.touching_sources(7, runs) == [1, 2] and substring_dedup.touching_sources(7, [(0, 9, 1, 5), (10, 3, 2, 0)]) == []


def test_token_digest(docs, rows):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output.token_digest(docs, BYTE).collect()}
    assert got == brute.token_digest(pairs(rows), plain(BYTE))


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = rng.choice([0, 3, 255, 256, 50000, 65535, 65536, 2**24, 2**32 - 1], n).astype(np.uint32)
        codes = token_output.Codes(token_output.pack(ids))
        assert codes.all().tolist() == ids.tolist() and [codes[i] for i in range(n)] == ids.tolist()
    with pytest.raises(IndexError):
        token_output.Codes(token_output.pack(np.zeros(3, np.uint32)))[3]


def test_token_at(spark, docs, rows, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_output.write_token_files(docs, path, BYTE)
    tokenizer = plain(BYTE)
    whole = [i for _, t in sorted(pairs(rows)) for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]]
    for k in (0, 1, 777, len(whole) // 2, len(whole) - 1):
        assert token_output.token_at(spark, path, k) == whole[k]
    with pytest.raises(IndexError):
        token_output.token_at(spark, path, len(whole))


def test_license_base(docs, rows):
    found = license_scan.scan_licenses(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found} == brute.license_base(pairs(rows))
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in found if r.base_labels)
    assert all(0 <= r.score <= 1 for r in found) and {r.score for r in found if r.n_base} == {1.0}


def test_license_diagonals_survive_changed_words(spark):
    notice = license_scan.TEMPLATES[0][1]
    words = notice.split()
    edited = " ".join([*words[:12], "really", *words[12:30], *words[31:]])
    rows = [(0, "before it " + notice), (1, "x " * 50 + edited), (2, " ".join(sorted(words))), (3, None)]
    found = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == ("mit", 1.0) and found[1][0] == "mit" and 0.6 < found[1][1] < 1.0
    assert found[2] == ("", 0.0) and found[3] == ("", 0.0)


def test_simhash(docs, rows):
    found = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_text().alias("fp"), "component_id").collect()
    want = brute.simhash(pairs(rows))
    assert {r.doc_id: (r.fp, r.component_id) for r in found} == want
    assert len({c for _, c in want.values()}) < len(want)


@pytest.mark.parametrize("limit", [3, 4096])
def test_links_of_chains_and_crowded_shards(spark, limit):
    """Chains of fingerprints three bits apart, in one shard that has to be cut, give one component each."""
    values, x = [], 0
    for k in range(20):
        values.append(x)
        x ^= 7 << (3 * k)
    other = [(1 << 63) | v for v in range(0, 64, 9)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values + other]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in simhash.star_components(simhash.linked_pairs(nodes, limit=limit)).collect()}
    parent = {v: v for v in signed}
    for _ in signed:
        for a in signed:
            for b in signed:
                if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3:
                    parent[a] = parent[b] = min(parent[a], parent[b])
    assert {v: roots.get(v, v) for v in signed} == parent


def test_similar_documents(spark):
    """Near copies by their share of five-word shingles: groups of them are found, texts that share half are left apart."""
    rng, rows, kin = random.Random(11), [], {}
    for g in range(30):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(80, 300))]
        for c in range(4):
            changed = list(words)
            for _ in range(c * len(words) // 150):
                changed[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
            if c == 3:
                changed = words[: len(words) // 2] + [f"y{rng.randrange(9999)}" for _ in range(len(words) // 2)]
            kin[len(rows)] = (g, c)
            rows.append((len(rows), " ".join(changed)))
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    near = [d for d, (g, c) in kin.items() if c in (1, 2)]
    assert sum(found[d] == 4 * kin[d][0] for d in near) >= 0.97 * len(near)
    assert all(found[d] == d for d, (g, c) in kin.items() if c in (0, 3))


def test_similar_documents_against_brute_force(spark):
    """Pairs just above and below 0.8, short texts, and texts that share nothing but a repeated shingle."""
    rng, rows = random.Random(21), []
    word = lambda: f"w{rng.randrange(10**6)}"
    for k in range(120):
        n = rng.choice([8, 9, 40, 100, 200])
        words = [word() for _ in range(n)]
        last = max(1, round((n - 4) * rng.uniform(0.05, 0.18)))  # so many shingles are others
        rows += [" ".join(words), " ".join(words[:-last] + [word() for _ in range(last)]) if k % 2 else " ".join(words[: n - last])]
    rows += [" ".join(["spam spam spam spam spam"] * 40 + [word() for _ in range(20)]) for _ in range(6)]
    sets = [brute.shingles(t) for t in rows]
    parent = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((parent[a], parent[b]))
                parent = [low if p == high else p for p in parent]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)).collect()}
    assert found == dict(enumerate(parent))
    assert 30 < sum(p != i for i, p in enumerate(parent)) < 110


@pytest.mark.parametrize("limit", [2, 1024])
def test_exact_links_in_chunks(spark, limit):
    """A chain of texts, each similar to the next alone, holds together over chunks."""
    words = [f"w{i}" for i in range(140)]
    docs = spark.createDataFrame([(k, " ".join(words[4 * k : 4 * k + 60])) for k in range(20)], "doc_id long, text string")
    prints = docs.select("text").mapInArrow(lambda parts: (pa.RecordBatch.from_arrays([pa.array(kernels.signed(n)), pa.array([x.tobytes() for x in p])], names=["node", "bits"]) for p, _, n in map(simhash.wide_fingerprint_batch, parts)), "node long, bits binary")
    links = simhash.similar_pairs(docs, prints.withColumn("root", F.lit(0).cast("long")), 5, limit)
    assert len({r.root for r in simhash.star_components(links).collect()}) == 1 and simhash.star_components(links).count() == 19


def test_key_scheme_never_misses():
    for n in (1, 10**6, 10**9, 10**13):
        blocks, equal = simhash.key_scheme(n)
        assert blocks - equal == 3 and len(set(simhash._masks(blocks, equal))) >= blocks


def test_bk_tree():
    rng = random.Random(3)
    values = list({rng.getrandbits(64) & 0xFFF for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.values[i] for i in tree.near(q, 3)) == sorted(v for v in values if (v ^ q).bit_count() <= 3)


def crowd(rng, n):
    """Fingerprints around a few centres, chains among them, that all agree in sixteen bits."""
    values = set()
    while len(values) < n:
        x = rng.choice([0, 0xFFFF0000, 0x0F0F0F0F0F0F])
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(48)
            values.add(x)
    return np.array(sorted(values)[:n], np.uint64)


@pytest.mark.parametrize("n", [20, 700])
def test_links_come_from_the_tree(n, monkeypatch):
    """A shard's links are those of brute force, and without the tree there is none."""
    values = crowd(random.Random(n), n)
    links = simhash.shard_links(values.view(np.int64), values[:, None], 3)
    close = np.bitwise_count(values[:, None] ^ values) <= 3
    label = np.arange(n)
    while not (label == (low := np.where(close, label, n).min(axis=1))).all():
        label = low
    assert dict(links) == {int(values[i]): int(values[r]) for i, r in enumerate(label) if i != r} and len(links) > n / 3
    monkeypatch.setattr(simhash.BKTree, "near", lambda *_: [])
    monkeypatch.setattr(simhash.TreeSearch, "near", lambda *_: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert not simhash.shard_links(values.view(np.int64), values[:, None], 3)


def test_tree_searches_skip_only_what_is_one_component():
    values = crowd(random.Random(2), 300)
    tree = simhash.BKTree()
    for v in values.tolist():
        tree.add(v)
    search, label = simhash.TreeSearch(tree, values[:, None]), np.arange(300)
    query, node = search.near(np.arange(300), 3, label)
    close = np.bitwise_count(values[:, None] ^ values) <= 3
    assert {(q, x) for q, x in zip(query.tolist(), node.tolist()) if q != x} == {(q, x) for q, x in zip(*map(np.ndarray.tolist, np.nonzero(close))) if q != x}
    label = np.where(np.arange(300) < 150, 0, 1)
    query, node = search.near(np.arange(300), 3, label)
    across = {(q, x) for q, x in zip(*map(np.ndarray.tolist, np.nonzero(close))) if label[q] != label[x]}
    assert across <= set(zip(query.tolist(), node.tolist()))


@pytest.mark.parametrize("limit", [5, 10**6])
def test_shards_that_are_keyed_again_lose_no_link(spark, limit):
    values = crowd(random.Random(5), 400)
    close = np.bitwise_count(values[:, None] ^ values) <= 3
    label = np.arange(400)
    while not (label == (low := np.where(close, label, 400).min(axis=1))).all():
        label = low
    nodes = spark.createDataFrame([(v,) for v in values.view(np.int64).tolist()], "fp long").repartition(3)
    roots = {r.node: r.root for r in simhash.star_components(simhash.linked_pairs(nodes, limit=limit)).collect()}
    assert roots == {int(values[i]): int(values[r]) for i, r in enumerate(label) if i != r}


def test_top_k(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(120)]
    vectors += [(120, vectors[7][1]), (121, vectors[7][1]), (150, None), (151, [None] * 8), (152, [float("nan")] * 8), (200, [float("inf")] * 8), (153, [0.0] * 8), (250, [-0.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    single = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {}
    for r in topk_search.exact_top_k(df, F.col("vec_id") % 50 == 0, query_chunk=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == brute.top_k(single)
    few = spark.createDataFrame([(0, [1.0]), (3, [0.5])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.exact_top_k(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 3, 256 * 128)]
    assert topk_search.exact_top_k(few.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_odd_rows(spark):
    """Repeated rows, shared and missing ids, ties, clashing columns, ragged and huge vectors, an empty table."""
    long = (1 << 63) - 1
    given = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (0, [2.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [9.0, 9.0]), (4, [1e30, -1e30]), (5, [-1e30]), (6, []), (50, [1e30, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in given], "vec_id long, embedding array<double>, score long, rank int, weights long, cell string").repartition(3)
    weights = [(i, [max(-long - 1, min(long, math.floor(256 * x))) for x in v]) for i, v in given if i is not None]
    want = []
    for q, v in {(i, tuple(w)) for i, w in weights if i % 50 == 0}:
        scores = sorted((-max(-long - 1, min(long, sum(a * b for a, b in zip(v, w)))), i) for i, w in weights if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    for chunk in (1, 100):
        found = topk_search.exact_top_k(df, F.col("vec_id") % 50 == 0, query_chunk=chunk)
        assert found.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert topk_search.exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_sparse_accumulation():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(-9, 9, (k, 30)) * (rng.random((k, 30)) < 0.2) for k in (7, 50))
    assert (topk_search.accumulate(a, b) == a @ b.T).all()


def test_language_model(docs, rows):
    found = lm_scoring.score_texts(docs, kernels.remainder() != 1).collect()
    want = brute.language_model_base(pairs(rows))
    assert len(found) == len(want)
    for r in found:
        tokens, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6) and np.isfinite(r.score)
    seen = [r for r in found if r.training]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


def model_score_error(found, rows):
    """The largest difference of a score from that by exact counts, in steps of the code for each token."""
    want = brute.language_model(rows, lm_scoring.MU)
    return max(abs(r.score - want[r.doc_id]) / r.n_tokens for r in found) / lm_scoring.CODE_STEP


def test_language_model_scores_by_brute_force(docs, rows):
    assert model_score_error(lm_scoring.score_texts(docs, kernels.remainder() != 1).collect(), pairs(rows)) < 1


@pytest.mark.parametrize("hot", [False, True])
def test_language_model_in_slices_and_hot_shards(spark, hot, monkeypatch):
    """Small slices, and words and pairs that are spread over all shards, change nothing; a text longer than a slice is whole."""
    if hot:
        look = lm_scoring.look

        def spread(docs):
            layout = look(docs)
            words = [lm_scoring.tokens_of(pa.record_batch({"text": pa.array([w])}))[0][0] for w in "abc"]
            layout.hot_words = np.union1d(layout.hot_words, np.array(words[:2], np.uint64))
            layout.hot_pairs = np.union1d(layout.hot_pairs, lm_scoring.pair_hashes(np.array([words[0]] * 2), np.array([words[1], words[2]])))
            layout.numbered = np.sort(np.array(words[1:], np.uint64))
            layout.shards = 13
            return layout

        monkeypatch.setattr(lm_scoring, "look", spread)
    monkeypatch.setattr(lm_scoring, "SLICE_BYTES", 200)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("aaabbcdefg") for _ in range(rng.choice([0, 1, 2, 30, 600])))) for i in range(80)] + [(80, None)]
    found = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), kernels.remainder() != 1).collect()
    base = brute.language_model_base(rows)
    assert all((r.n_tokens, r.n_known, r.train_tokens) == base[r.doc_id][:3] and r.base_score == pytest.approx(base[r.doc_id][3], abs=1e-6) for r in found)
    assert len(found) == 81 and model_score_error(found, rows) < 1


def test_model_probabilities_sum_to_one(spark):
    """Over all words and the unknown one, the probabilities behind a context add up to 1."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(12))) for i in range(40)]
    contexts = ["", "a", "c d", "b b", "e a"]
    asked = [(1000 + 10 * c + k, f"{context} {w}") for c, context in enumerate(contexts) for k, w in enumerate([*"abcde", "unknown"])] + [(2000 + c, context) for c, context in enumerate(contexts)]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string")
    score = {r.doc_id: r.score for r in lm_scoring.score_texts(docs, F.col("doc_id") < 1000).collect()}
    exact = lambda text: brute_text(rows, text)
    for c, context in enumerate(contexts):
        before = exact(context)
        total = sum(10 ** (exact(f"{context} {w}")[0] - before[0]) for w in [*"abcde", "unknown"]) + 10 ** (before[1] - before[0])
        assert total == pytest.approx(1.0, abs=1e-9)
        for k, w in enumerate([*"abcde", "unknown"]):
            assert score[1000 + 10 * c + k] == pytest.approx(exact(f"{context} {w}")[1], abs=2e-3)
        assert score[2000 + c] == pytest.approx(before[1], abs=2e-3)


def brute_text(rows, text):
    """log10 of the words of a text, and of the whole text with its end, by exact counts."""
    counts, texts = [brute.Counter() for _ in range(3)], len(rows)
    for _, t in rows:
        line = ["<s>", "<s>", *t.split(), "</s>"]
        for i in range(2, len(line)):
            for n in range(3):
                counts[n][tuple(line[i - n : i + 1])] += 1

    def probability(gram):
        if len(gram) == 1:
            return (counts[0][gram] + 0.5) / (sum(counts[0].values()) + 0.5 * (len(counts[0]) + 1))
        context = texts if set(gram[:-1]) == {"<s>"} else counts[len(gram) - 2][gram[:-1]]
        return (counts[len(gram) - 1][gram] + lm_scoring.MU * probability(gram[1:])) / (context + lm_scoring.MU)

    line = ["<s>", "<s>", *text.split(), "</s>"]
    logs = [math.log10(probability(tuple(line[i - 2 : i + 1]))) for i in range(2, len(line))]
    return sum(logs[:-1]), sum(logs)


def test_trie_finds_successors_within_their_context():
    """Every n-gram of training texts is found below its context, and no other one."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(30)]
    tokens, ends = lm_scoring.tokens_of(pa.record_batch({"text": pa.array(texts)}))
    layout = lm_scoring.Layout(1, np.sort(np.unique(tokens))[:2], np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    g = lm_scoring.cut_grams(tokens, ends, np.arange(30) % 2 == 0, layout, False)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    r = lm_scoring.Request.of(lm_scoring.requests(g, 0, layout).column("request"), layout.listed)
    trie = lm_scoring.Trie(lm_scoring.Trie.build(r, {"words": none, "pairs": none}))
    first, pair, triple = trie.find(r.a, r.b, r.t, r.first_of, r.pair_of)
    assert ((pair >= 0) == (r.b_count > 0)).all() and ((triple >= 0) == (r.t_count > 0)).all()
    for found in (first, pair, triple):
        assert sorted(found[found >= 0].tolist()) == list(range(found.max() + 1))
    ends_ = trie.first_ends.get(np.arange(trie.firsts.n + 1)).astype(int)
    assert all(ends_[first[a]] <= p < ends_[first[a] + 1] for a, p in zip(r.first_of, pair) if p >= 0)


def test_elias_fano():
    rng = np.random.default_rng(5)
    for values in ([], [0], [5], range(100), rng.integers(0, 2**63, 4000, dtype=np.uint64), np.concatenate([np.arange(500), np.arange(500) * 97 + (1 << 40)])):
        values = np.unique(np.array(list(values), np.uint64))
        parts = lm_scoring.map_arrays(lm_scoring.pack_arrays(lm_scoring.EliasFano.build(values).parts("x")))
        held = lm_scoring.EliasFano.of(parts, "x")
        assert held.find(values).tolist() == list(range(len(values)))
        assert held.get(np.arange(len(values))).tolist() == values.tolist()
        assert held.find(values, np.arange(len(values)) + 1, np.full(len(values), len(values))).tolist() == [-1] * len(values)
        ask = np.concatenate([values + np.uint64(1), rng.integers(0, 2**63, 200, dtype=np.uint64), np.zeros(1, np.uint64)])
        where = {int(v): i for i, v in enumerate(values)}
        assert held.find(ask).tolist() == [where.get(int(v), -1) for v in ask]


def test_contamination(docs, benchmark, rows, items):
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination_digest(docs, benchmark).collect()}
    want = brute.contamination(pairs(rows), items)
    assert found == want
    assert any(v[4] for v in want.values()) and not all(v[4] for v in want.values())


def test_contamination_in_rounds(docs, benchmark, rows, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "ROUND_WORDS", 40)
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination_digest(docs, benchmark).collect()}
    assert found == brute.contamination(pairs(rows), items)


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(0, f"x {item} y"), (1, "x alpha beta filler gamma delta epsilon zeta eta theta iota kappa"), (2, "kappa alpha iota")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    exact = {r.doc_id: r.n_hit > 0 for r in decontaminate.find_contamination(docs, bench).collect()}
    near = {r.doc_id: r.n_hit > 0 for r in decontaminate.find_contamination(docs, bench, slop=1).collect()}
    assert exact == {0: True, 1: False, 2: False} and near == {0: True, 1: True, 2: False}


def test_proximity_without_the_rarest_term(spark):
    """A place with nine of ten terms counts whichever term is missing, the rarest one or one that no text has too."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(["x", *item[:i], "edited", *item[i + 1 :], "y"])) for i in range(10)] + [(10, " ".join(["edited", "edited", *item[2:]])), (11, "kappa " * 9)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for kept in (rows, rows[1:]):  # without the first row nothing but row 11 lacks only kappa
        found = {r.doc_id: r.n_hit > 0 for r in decontaminate.find_contamination(docs.where(F.col("doc_id").isin([r[0] for r in kept])), bench, min_terms=0.9).collect()}
        assert found == {r[0]: r[0] < 10 for r in kept}


def test_packing(docs, rows):
    tokenizer, by_id, pieces, sequences = plain(WORD), dict(pairs(rows)), {}, {}
    for r in packing.pack_documents(docs, WORD).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(by_id)
    for doc_id, text in by_id.items():
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == brute.crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)


def test_differencing_balances_and_raises_the_count():
    rng = random.Random(6)
    for _ in range(20):
        sizes = [rng.randint(1, 2047) for _ in range(rng.randint(1, 60))]
        groups = packing.balanced_windows(sizes, 2048)
        assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
        assert max(sum(sizes[i] for i in g) for g in groups) <= 2048
    near = [sum([8, 7, 6, 5, 4][i] for i in g) for g in packing.differencing([8, 7, 6, 5, 4], 2)]
    assert sorted(near) == [14, 16]
    assert len(packing.balanced_windows([1500, 1500, 1000], 2048)) == 3


def test_windows_are_those_of_differencing(monkeypatch):
    """What is written is what the last differencing gave, full windows throughout, each id once."""
    rng, calls, method = random.Random(7), [], packing.differencing
    monkeypatch.setattr(packing, "differencing", lambda sizes, k: calls.append((sizes, method(sizes, k))) or calls[-1][1])
    for _ in range(20):
        pieces = [(d, 0, rng.randint(1, 1500)) for d in range(60)]
        k = sum(p[2] for p in pieces) // 2048
        now, rest = packing.take_ids(pieces, k * 2048)
        assert sum(p[2] for p in now) == k * 2048 and sum(p[2] for p in now + rest) == sum(p[2] for p in pieces)
        windows = packing.filled_windows(now, k, 2048)
        sizes, groups = calls[-1]
        assert [[p[2] for p in w] for w in windows] == [[sizes[i] for i in g] for g in groups if g]
        assert [sum(p[2] for p in w) for w in windows] == [2048] * k
        ids = [(doc, i) for w in windows for doc, first, n in w for i in range(first, first + n)]
        assert sorted(ids) == [(doc, i) for doc, first, n in now for i in range(first, first + n)]


def test_packing_of_whole_and_of_very_long_documents(spark):
    rng = random.Random(9)
    rows = [(0, prose(rng, "en", 300_000)), *((i, prose(rng, "fr", rng.randint(1, 400))) for i in range(1, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for whole in (False, True):
        found, used = packing.pack_documents(docs, WORD, whole=whole).collect(), {}
        assert sum(r.length for r in found) == sum(r.doc_tokens for r in found if r.start == 0)
        for r in found:
            used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
        assert max(used.values()) == 2048
        assert whole or sum(n < 2048 for n in used.values()) <= 11
        assert not whole or all(r.start % 2048 == 0 for r in found)


def test_language_id(docs, rows):
    dictionaries = language_id.fit_dictionaries(docs, kernels.remainder() != 0)
    assert set(dictionaries) <= {"en", "fr", "de"}
    found = {r.doc_id: r for r in language_id.identify(docs, dictionaries).collect()}
    assert len(found) == len(rows)
    right = held = 0
    for doc_id, text, lang, *_ in rows:
        r = found[doc_id]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.accepted) == ("und", False)
            continue
        assert r.lang_pred in dictionaries and 0 <= r.score <= 1
        if lang and len(text) > 80 and brute.remainder(doc_id) == 0:
            held += 1
            right += r.lang_pred == lang
    assert held >= 8 and right / held >= 0.9


def test_long_texts_keep_their_margin(docs, spark):
    """A clean text of megabytes is as sure as a short one of its kind."""
    dictionaries, rng = language_id.fit_dictionaries(docs), random.Random(12)
    rows = [(lang, prose(rng, lang, n)) for lang in sorted(HEADS) for n in (200, 2_000, 20_000, 300_000)]
    assert all(len(t) > 1_000_000 for _, t in rows[3::4])
    found = language_id.identify(spark.createDataFrame(rows, "lang string, text string"), dictionaries, keep=["lang"]).collect()
    assert all(r.lang_pred == r.lang and r.accepted for r in found)
    margins = {lang: [r.margin for r in found if r.lang == lang] for lang in HEADS}
    assert all(max(m) < 2 * min(m) for m in margins.values()), margins


def test_two_languages_in_either_order(docs, spark):
    """The answer does not depend on what comes first."""
    dictionaries, rng = language_id.fit_dictionaries(docs), random.Random(13)
    french, english = prose(rng, "fr", 40_000), prose(rng, "en", 160_000)
    rows = [("a", f"{french} {english}"), ("b", f"{english} {french}")]
    found = language_id.identify(spark.createDataFrame(rows, "name string, text string"), dictionaries, keep=["name"]).collect()
    assert len({r.lang_pred for r in found}) == 1 and abs(found[0].margin - found[1].margin) < 0.002


def test_compressed_sizes_by_brute_force(docs):
    """The sizes of a long text are the sums of its blocks' sizes, each behind the dictionary; equal sizes go to the first name."""
    dictionaries = language_id.fit_dictionaries(docs)
    model, text = language_id.Compressors(dictionaries), prose(random.Random(3), "de", 20_000).encode()
    n = -(-len(text) // language_id.BLOCK_BYTES)
    blocks = [text[len(text) * i // n : len(text) * (i + 1) // n] for i in range(n)]
    assert b"".join(blocks) == text and n > 3
    assert model.sizes(text) == [sum(len(c.compress(b)) for b in blocks) for c in model.fast]
    assert model._decide([5.0, 3.0, 3.0])[0] == model.languages[1] and model._decide([5.0, 3.0, 3.0])[2] == 0.0


def test_language_without_labels(docs):
    found = language_id.identify(docs, language_id.fit_dictionaries(docs.where("lang = 'xx'")))
    assert {(r.lang_pred, r.accepted) for r in found.collect()} == {("und", False)}


def test_quality(spark, docs, rows):
    rng = random.Random(8)
    made = [(i, " ".join(rng.choice(["good", "plain", "words", "here"]) for _ in range(30)) if i % 2 else " ".join(f"{rng.choice(['BUY', 'NOW', 'CHEAP'])}!!" for _ in range(30))) for i in range(200)]
    docs = spark.createDataFrame([*made, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 200)] + [(3, 0, 0), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.score_quality(docs, labels, kernels.remainder() == 0).collect()}
    assert len(found) == 202
    for i, r in found.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (brute.remainder(i) == 0)
    held = [i for i in range(200) if found[i].held_out]
    assert sum(found[i].predicted == i % 2 for i in held) / len(held) > 0.95


def test_quality_without_labels(docs, spark, rows):
    found = quality.score_quality(docs, spark.createDataFrame([], "doc_id long, quality int"), kernels.remainder() == 0).collect()
    assert len(found) == len(rows) and {r.score for r in found} == {0.5}


def test_temperature_corrects_overconfidence():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (rng.random(600) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.fit_network(x, y, np.arange(600) % 3 == 0)
    assert 0.25 <= net.temperature <= 16 and abs(net.probabilities(x).mean() - y.mean()) < 0.1


def own_labels(r):
    """What the method adds to the base labels."""
    return sorted(set(r.labels.split(",")) - set(r.base_labels.split(",")) - {""})


def test_each_license_has_its_own_label(spark):
    """The notices of a license, whole and edited, and every statement give that license and no other."""
    rng, cases = random.Random(21), []
    whole = {}
    for label, text in license_scan.NOTICES:
        whole.setdefault(label, []).append(text)
    for label, texts in whole.items():
        cases.append((label, f"{prose(rng, 'en', 30)}. " + " ".join(texts) + f" {prose(rng, 'en', 30)}"))
    for label, text in license_scan.NOTICES:
        words = text.split()
        told_by = license_scan.MARKS.get(label, "").lower().split()
        for k in range(10, len(words) - 8, 25):
            if words[k].strip(",.;").lower() not in told_by:
                words[k] = "edited"
        cases.append((label, "Notice: " + " ".join(words)))
    cases += [(label, f"x {text} y") for label, text in license_scan.TEMPLATES[len(license_scan.NOTICES) :]]
    cases.append(("bsd-3-clause", " ".join(t for label, t in license_scan.NOTICES if label in ("bsd", "bsd-3-clause"))))
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(cases)], "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    for i, (label, text) in enumerate(cases):
        labels = set(own_labels(found[i])) | (set(found[i].base_labels.split(",")) & {label})
        assert labels == {label}, (label, text[:80], found[i])


def test_words_in_common_are_no_license(spark):
    texts = [
        "We were licensed under the ministry of the arts.", "SPDX-License-Identifier: Foo", "released under the moon", "licensed under CC XY 4.0", "This software is provided by our shop",
        "the GNU General Public Library, version 3", "Permission is hereby granted to enter the garden", "redistribute it and modify it under the terms of your contract",
    ]
    found = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.labels == "" and r.score == 0.0 for r in found)


def test_two_licenses_are_both_found(spark):
    text = "Released under the MIT License. Parts are licensed under CC BY-SA 4.0, others are distributed under the GNU General Public License, version 2. SPDX-License-Identifier: Apache-2.0 " * 3
    (r,) = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.labels == "apache-2.0,cc-by-sa-4.0,gpl,gpl-2.0,mit"
