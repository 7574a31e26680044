"""The contracts of the training-data queries, worked out row by row in plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return (text or "").translate(ASCII_LOWER)


def remainder(doc_id, mod=5):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % mod


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def substring_dedup(docs, window=20):
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        words = SPACED.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        kept = [w for w, g in zip(words, gone) if not g]
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def token_digest(docs, tokenizer, end_id=0):
    start, out = 0, {}
    for doc_id, text in sorted(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out[doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    return out


def license_base(docs):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    out = {}
    for doc_id, text in docs:
        words = ALNUM.findall(lower(text))
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        out[doc_id] = (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
    return out


def shingles(text, size=5):
    words = SPACED.findall(lower(text))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def simhash(docs, radius=3):
    import xxhash

    prints = {}
    for doc_id, text in docs:
        words = SPACED.findall(lower(text))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[doc_id] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (f"{prints[d]:016x}", root(d)) for d in ids}


def contamination(docs, items, length=10):
    windows = defaultdict(set)
    for item_id, text in items:
        words = ALNUM.findall(lower(text))
        if words:
            for i in range(max(1, len(words) - length + 1)):
                windows[tuple(words[i : i + length])].add(str(item_id))
    sizes = {len(w) for w in windows}
    out = {}
    for doc_id, text in docs:
        words, hit, named = ALNUM.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if found := windows.get(tuple(words[i : i + n])):
                    hit |= {*range(i, i + n)}
                    named |= found
        out[doc_id] = (len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit))
    return out


def top_k(vectors, k=5):
    rows = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in rows:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return out


def language_model_base(docs):
    count, rows = Counter(), {}
    for doc_id, text in docs:
        rows[doc_id] = [*SPACED.findall(lower(text)), None]
        if remainder(doc_id) != 1:
            count.update(rows[doc_id])
    n, v = sum(count.values()), len(count)
    return {d: (len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for d, t in rows.items()}


def language_model(docs, mu):
    """log10 of the interpolated model of words, pairs and triples, for every text, from exact counts."""
    rows, counts = {}, [Counter(), Counter(), Counter()]
    texts = 0
    for doc_id, text in docs:
        rows[doc_id] = ["<s>", "<s>", *SPACED.findall(lower(text)), "</s>"]
        if remainder(doc_id) != 1:
            texts += 1
            for i in range(2, len(rows[doc_id])):
                for n in range(3):
                    counts[n][tuple(rows[doc_id][i - n : i + 1])] += 1
    tokens, distinct = sum(counts[0].values()), len(counts[0])

    def probability(gram):
        if len(gram) == 1:
            return (counts[0][gram] + 0.5) / (tokens + 0.5 * (distinct + 1))
        context = texts if set(gram[:-1]) == {"<s>"} else counts[len(gram) - 2][gram[:-1]]
        return (counts[len(gram) - 1][gram] + mu * probability(gram[1:])) / (context + mu)

    return {d: sum(math.log10(probability(tuple(t[i - 2 : i + 1]))) for i in range(2, len(t))) for d, t in rows.items()}
