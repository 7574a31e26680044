"""Suffix-array dedup, token alignment and whitening against brute force, and their edge cases."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest import prose
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quern.llm import suffix_dedup, token_alignment, whitening

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def cut_by_hand(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and not before for g, before in zip(gone, b"\0" + bytes(gone)))
        out.append((len(r), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def repeating_texts(seed=11):
    rng = random.Random(seed)
    passage, second = prose(rng, "de", 120), prose(rng, "fr", 90)
    texts = [prose(rng, "en", rng.randint(20, 200)) for _ in range(20)]
    texts += [f"{prose(rng, 'en', rng.randint(1, 30))} {passage} {prose(rng, 'en', rng.randint(1, 60))}" for _ in range(12)]
    texts += [texts[3], texts[3], texts[5][40:], second + " " + passage[:500] + second, "ab" * 700, "x" * 399, "y" * 400, "z" * 401, "é" * 300, "é" * 200, None, "", passage[:400], passage[100:460] + "!"]
    texts += [(prose(rng, "en", 5) + "\n") * 60, texts[7][:200] + "#" + texts[7][201:]]
    return texts


@pytest.mark.parametrize("limits", [(2048, 1 << 20), (3, 1 << 12)])
def test_repeated_strings_by_brute_force(spark, monkeypatch, limits):
    """Also with so low a limit that hot buckets become cells and cells single windows."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_LIMIT", limits[0])
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", limits[1])
    texts = repeating_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, with_bytes=True).collect()}
    for i, want in enumerate(cut_by_hand(texts)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.length for s in r.spans) == r.n_removed
    assert sum(r.n_removed > 0 for r in got.values()) > 15


def test_hot_edges_become_single_windows(spark, monkeypatch):
    """Forty texts go on differently behind one passage; every level of splitting gives the same as one block."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_LIMIT", 4)
    rng = random.Random(4)
    passage = prose(rng, "en", 110)
    texts = [prose(rng, "fr", rng.randint(0, 40)) + " " + passage[: 420 + i % 3] + " " + prose(rng, "de", 40) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(40)] == cut_by_hand(texts)


@pytest.mark.parametrize("length", [8, 20, 37])
def test_bucket_pointers(length):
    rng = random.Random(length)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 90))) for _ in range(8)]
    offsets = np.cumsum([0, *map(len, texts)])
    pointer = suffix_dedup.refine(np.frombuffer(b"".join(texts), np.uint8), np.repeat(offsets[1:], [len(t) for t in texts]), length)
    groups = defaultdict(set)
    for d, t in enumerate(texts):
        for i in range(len(t)):
            groups[t[i : i + length] if i + length <= len(t) else (d, i)].add(int(pointer[offsets[d] + i]))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_runs_do_not_depend_on_chunks(monkeypatch):
    data = np.frombuffer((prose(random.Random(2), "en", 900) + "a" * 900).encode(), np.uint8)
    offsets = np.array([0, 1500, 1500, len(data)])
    whole = suffix_dedup.runs_of_windows(data, offsets)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    cut = suffix_dedup.runs_of_windows(data, offsets)
    windows = lambda runs: sorted((t, s + k, a - k, g) for t, s, n, a, g, _ in zip(*map(np.ndarray.tolist, runs)) for k in range(n))
    assert windows(whole) == windows(cut) and len(windows(whole)) == 1500 - 399 + len(data) - 1500 - 399


def test_suffix_dedup_odd_rows(odd_docs, no_docs, spark):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    assert Counter(r.doc_id for r in suffix_dedup.remove_repeats(odd_docs).collect()) == {1: 2, 2: 2, None: 2, 7: 1}
    text = prose(random.Random(1), "en", 150)
    rows = [(1, text, 1, {"k": 1}), (1, text, 1, {"k": 1}), (None, text[50:], 2, None), (None, None, 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, `a.b` map<string,int>")
    found = suffix_dedup.remove_repeats(docs, keep=["doc_id", "n_bytes", "a.b"]).collect()
    assert sorted((r.doc_id or 0, r._n_bytes - r.n_removed) for r in found) == [(0, 0), (0, 0), (1, 0), (1, 0)]
    long = spark.createDataFrame([(0, prose(random.Random(5), "en", 240_000)), (1, "short")], "doc_id long, text string")
    doubled = long.unionByName(long.selectExpr("doc_id + 2 AS doc_id", "concat('! ', text) AS text"))
    assert {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.remove_repeats(doubled).collect()} == {0: 0, 1: 5, 2: 2, 3: 7}


ALPHABET = token_alignment.byte_alphabet()


def groups_by_hand(text, byte, piece):
    """Token ids of both sides between places where both end, from the two libraries alone."""
    if not text:
        return None
    a = [(i, bytes(ALPHABET[c] for c in byte.id_to_token(i))) for i in byte.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode()) for i in piece.encode(text)]
    if any(b"".join(t for _, t in side) != (" " + text).encode() for side in (a, b)):
        return None
    ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in (a, b)]
    common = sorted(set(ends[0]) & set(ends[1]))
    place = lambda end: next(k for k, c in enumerate(common) if end <= c)
    groups = [([], []) for _ in common]
    for side in (0, 1):
        for (i, _), end in zip((a, b)[side], ends[side]):
            groups[place(end)][side].append(i)
    return groups


def align_by_hand(texts):
    byte, piece = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    byte.encode_special_tokens = True
    found = [groups_by_hand(t, byte, piece) for t in texts]
    links = [[(x, y) for a, b in g or [] for x in a for y in b] for g in found]
    counts = Counter(p for each in links for p in set(each))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    for g, each in zip(found, links):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        yield (sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), len(each), sum(counts[p] == best[p[0]] for p in each), sum(counts[p] for p in each), hashlib.sha256(shown.encode()).hexdigest() if g else "")


PARTS = [" ", "  ", "a", "the", "\n", "\t", "é", "日本", "ﬁ", "▁", "<s>", "<|endoftext|>", "<0x41>", "'s", "1", "99", ".", "　", "\xa0", "\x00", "\x01", "İ", "😀", "​", "Hello", "\x7f", "\x85", "—", "é", "http://x.y/?q=1", ")", "()"]


def test_alignment_by_brute_force(spark, rows):
    rng = random.Random(8)
    texts = [r[1] for r in rows if r[1] is None or len(r[1]) < 2000] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r for r in token_alignment.align_tokens(docs, BYTE, PIECE).collect()}
    for i, want in enumerate(align_by_hand(texts)):
        r = found[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want, texts[i]
    assert sum(r.groups_sha256 == "" for r in found.values()) > 20


def test_aligner_forgets_and_learns_again():
    small, large = token_alignment.Aligner(BYTE, PIECE, most=40), token_alignment.Aligner(BYTE, PIECE)
    rng = random.Random(6)
    for _ in range(6):
        texts = pa.array([prose(rng, "fr", 30) for _ in range(5)])
        shown = []
        for sizes, digests, pairs, per_text, local, times in (small.texts(texts), large.texts(texts)):
            text = np.repeat(np.arange(len(texts)), per_text)
            shown.append((sizes.tolist(), digests, sorted(zip(text.tolist(), pairs[local].tolist(), times.tolist(), strict=True))))
        assert shown[0] == shown[1]


def test_components_of_chains_and_stars():
    rng = np.random.default_rng(3)
    for n in (1, 7, 400):
        left, right = rng.integers(0, n, n // 2), rng.integers(0, n, n // 2)
        label = list(range(n))
        for _ in range(n):
            for a, b in zip(left.tolist(), right.tolist()):
                label[a] = label[b] = min(label[a], label[b])
        assert token_alignment.components(n, left, right).tolist() == label
    chain = np.arange(999)
    assert not token_alignment.components(1000, chain, chain + 1).any()


def test_alignment_odd_rows(odd_docs, no_docs, spark):
    assert token_alignment.align_tokens(no_docs, BYTE, PIECE).count() == 0
    found = token_alignment.align_tokens(odd_docs, BYTE, PIECE, keep=["doc_id", "score", "tie"]).collect()
    assert Counter(r.doc_id for r in found) == {1: 2, 2: 2, None: 2, 7: 1}
    assert sorted(r.n_a > 0 for r in found) == [False, False, True, True, True, True, True]
    docs = spark.createDataFrame([(0, prose(random.Random(5), "en", 400_000)), (1, "a")], "doc_id long, text string")
    long = {r.doc_id: r for r in token_alignment.align_tokens(docs, BYTE, PIECE).collect()}
    assert long[0].n_groups > 400_000 and long[1].n_groups == 1


def whiten_by_hand(vectors, components=8):
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, width = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(width)]
    deviation = [sum((n * r[i] - sums[i]) ** 2 for i in range(width)) for r in x]
    centred = np.array([[n * r[i] - sums[i] for i in range(width)] for r in x], float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return deviation, (centred @ axes / np.sqrt(values))[:, :components], (values / values.sum())[:components]


def test_whitening_by_brute_force(spark):
    rng = np.random.default_rng(7)
    vectors = (rng.normal(size=(300, 12)) * np.linspace(0.1, 2, 12)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [None] + vectors[0][1:]), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, []), (905, [1.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)).collect()
    assert len(found) == 300 * 8
    deviation, whitened, explained = whiten_by_hand(vectors)
    for r in found:
        k = r.component - 1
        assert r.n == 300 and r.deviation == deviation[r.vec_id] and math.isclose(r.explained, explained[k], rel_tol=1e-9) and 0 <= r.identity_error < 1e-9
        assert math.isclose(abs(r.whitened), abs(whitened[r.vec_id][k]), rel_tol=1e-6, abs_tol=1e-9)
    signs = defaultdict(set)
    for r in found:
        if abs(r.whitened) > 1e-3:
            signs[r.component].add(r.whitened * whitened[r.vec_id][r.component - 1] > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_scatter_is_exact_for_any_size(spark, monkeypatch):
    """Components near the ends of a long, several tiles and blocks of rows: sums are those of whole numbers."""
    monkeypatch.setattr(whitening, "TILE", 3)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(1300, 7)) * 10.0 ** rng.integers(-3, 15, (1300, 7))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>").repartition(3)
    rows = whitening.usable(frame, ["vec_id"], "v")
    width, n, top = whitening.shape_of(rows, "v")
    x = np.column_stack([np.floor(vectors * 1024).astype(np.int64) + 100_000, np.ones(1300, np.int64)]).astype(object)
    assert (whitening.exact_scatter(rows, "v", width, n, top) == x.T @ x).all()
    found = {r.vec_id: r.deviation for r in whitening.whiten(frame).collect()}
    deviation, _, _ = whiten_by_hand(vectors.tolist())
    assert all(found[i] == min(d, (1 << 63) - 1) for i, d in enumerate(deviation)) and max(found.values()) == (1 << 63) - 1


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>, n string, `v.w` int"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25], "x", 1)] * 3, schema), keep=["vec_id", "n", "v.w"]).collect()
    assert len(one) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == ("x", 0, 0.0, 0.0, 0.0) and r._n == 3 for r in one)
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0], None, None) for i in range(4)] + [(None, [9.0, 1.0], None, None), (7, [1e308, -1e308, 1.0], None, None)], schema)).collect()
    by = {(r.vec_id, r.component): r for r in flat}
    assert len(flat) == 10 and by[0, 1].explained == 1.0 and by[0, 2].whitened == 0.0 and by[None, 1].whitened > by[3, 1].whitened
    huge = whitening.whiten(spark.createDataFrame([(0, [1e308], "", 0), (1, [-1e308], "", 0)], schema)).collect()
    assert sorted(round(r.whitened, 6) for r in huge) == [-1.0, 1.0] and all(r.deviation == (1 << 63) - 1 for r in huge)


def test_primes_tell_numbers_apart():
    primes = whitening.primes_for(10**30)
    values = np.array([0, 1, -1, 10**30, -(10**30), 123456789012345678901], object)
    residues = [np.array([int(v) % p for v in values], np.int64) for p in primes]
    assert whitening.from_residues(residues, primes).tolist() == values.tolist() and len(set(primes)) == len(primes)
    assert all(p % d for p in primes for d in range(2, 2049))
