"""Language-model scoring with an Elias-Fano n-gram trie.

The model interpolates words, pairs and triples of all training documents with Dirichlet priors: an n-gram's probability
is ``(count + MU * lower) / (count of its context + MU)``, where ``lower`` is that of the n-gram without its first word.
No n-gram is left out, however rare, so the trie grows with the corpus.  It is therefore cut into shards by the first
word of an n-gram, and texts come to the shards instead of the trie to the texts:

1. Texts are written in slices of two megabytes.
2. A slice asks every shard for its distinct n-grams of that shard, as one row: first words, the successors of each, and
   theirs, with the counts that training texts among them have.  These requests are the counts that a shard adds up.
3. A shard builds its trie from them and answers each request in the order in which it came.
4. A slice with its answers has all that the probabilities of its tokens need.

A level of a shard's trie is a monotone sequence in Elias-Fano code: the low bits of its values packed, the high bits in
unary, with a directory.  The successors of a context are a range of the next level, and monotone pointers, in the same
code, give its ends; an n-gram is found by searching for a word within the range of its context.  Beside a level lie
16-bit codes of the smoothed probabilities' own parts, ``count / (count of the context + MU)``.  A task maps a shard's
levels from a file that has no name any more.

A first word above a share of the corpus is spread over the shards by the second word, a pair above it by the third: only
the count of a context has to be known to all of them, and those of such words and pairs, a bounded number, are counted
while slices are written.  Which ones they are, and which words have short numbers in requests, is found by a look at
every 32nd document; that changes how work is dealt out, and no result.
"""

from __future__ import annotations

import io
import mmap
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import default_partitions, drop_stage, stage_table
from . import kernels as K
from .tokens import HashIndex

MU = 32.0  # of 2, 8, 32, 128 and 512 the best on held-out texts
BEGIN, END, NONE = np.uint64(0), np.uint64(1), np.uint64(2)  # stand for what is no word; the mixed hash of no word is likely to be one of these
CODE_FLOOR = -16.0
CODE_STEP = 16.0 / 65534
SLICE_BYTES = 1 << 21
SHARD_TOKENS = 1 << 19
SAMPLE, NUMBERED, HOT_MOST = 32, 65534, 1 << 14


def quantise(log10: np.ndarray) -> np.ndarray:
    """16-bit codes from 1 on; 0 stands for no entry."""
    return np.clip(np.round((log10 - CODE_FLOOR) / CODE_STEP) + 1, 1, 65535).astype(np.uint16)


def restore(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(float) - 1) * CODE_STEP + CODE_FLOOR


def shares(codes: np.ndarray) -> np.ndarray:
    """What codes stand for, as shares; 0 for no entry."""
    return np.where(codes > 0, 10.0 ** restore(codes), 0.0)


def _place_of(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which bit of each 64-bit word is its one number ``rank`` (from 1)."""
    place, rest = np.zeros(len(words), np.int64), rank.copy()
    for width in (32, 16, 8, 4, 2, 1):
        part = np.bitwise_count((words >> place.astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
        skip = part < rest
        rest -= np.where(skip, part, 0)
        place += np.where(skip, width, 0)
    return place


class EliasFano:
    """A sorted sequence of distinct unsigned values; ``find`` looks up whole arrays of values."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        words = high.view("<u8")
        zeros = 64 - np.bitwise_count(words).astype(np.int64)
        self.zeros = np.concatenate([[0], np.cumsum(zeros)])
        self.ones = np.arange(len(self.zeros)) * 64 - self.zeros
        self.words = words
        self.loads = np.lib.stride_tricks.as_strided(low, (len(low) - 7, 8), (1, 1)) if len(low) >= 8 else None

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        values = np.ascontiguousarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        while n and (top >> bits) > 4 * n + 64:
            bits += 1
        low = np.zeros((n * bits + 7) // 8 + 8, np.uint8)
        if bits:
            lows = values & np.uint64((1 << bits) - 1)
            columns = ((lows[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(columns.ravel(), bitorder="little")
            low[: len(packed)] = packed
        high = (values >> np.uint64(bits)).astype(np.int64)
        size = int(high[-1]) + n + 1 if n else 1
        marks = np.zeros(-(-(size + 1) // 64) * 64, np.uint8)
        marks[high + np.arange(n)] = 1
        return EliasFano(n, bits, low, np.packbits(marks, bitorder="little"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        raw = np.ascontiguousarray(self.loads[bit >> 3]).view("<u8").ravel()
        return (raw >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def _below(self, h: np.ndarray) -> np.ndarray:
        """How many values have high bits below ``h``: ones before the ``h``-th zero."""
        out = np.zeros(len(h), np.int64)
        some = np.flatnonzero(h > 0)
        want = h[some]  # the place of the zero number want (from 1)
        word = np.searchsorted(self.zeros, want, side="left") - 1
        past = word >= len(self.words)
        word = np.minimum(word, len(self.words) - 1)
        place = _place_of(~self.words[word], want - self.zeros[word])
        out[some] = np.where(past, self.n, np.minimum(word * 64 + place - (want - 1), self.n))
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at the places ``i``."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        high = word * 64 + _place_of(self.words[word], i - self.ones[word] + 1) - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def find(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """The index of each value, -1 where it is not in the sequence, or not at a place from ``first`` to before ``last``."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        low = values & np.uint64((1 << self.low_bits) - 1)
        left, right = self._below(high), self._below(high + 1)
        if first is not None:
            left, right = np.maximum(left, first), np.minimum(right, last)
        stop = right.copy()
        while True:  # successor search among the values with the same high bits
            busy = np.flatnonzero(left < right)
            if not len(busy):
                break
            middle = (left[busy] + right[busy]) // 2
            less = self._low(middle) < low[busy]
            left[busy[less]] = middle[less] + 1
            right[busy[~less]] = middle[~less]
        inside = np.minimum(left, self.n - 1)
        return np.where((left < stop) & (self._low(inside) == low), left, -1)

    def parts(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.shape": np.array([self.n, self.low_bits]), f"{name}.low": self.low, f"{name}.high": self.high}

    @staticmethod
    def of(parts: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = parts[f"{name}.shape"].tolist()
        return EliasFano(n, bits, parts[f"{name}.low"], parts[f"{name}.high"])


def pack_arrays(parts: dict[str, np.ndarray]) -> bytes:
    """Arrays one behind the other, 64 bytes apart, with a directory in front."""
    out, directory = io.BytesIO(), []
    for name, array in parts.items():
        out.write(b"\0" * (-out.tell() % 64))
        directory.append((name, array.dtype.str, array.shape, out.tell()))
        out.write(np.ascontiguousarray(array).tobytes())
    head = repr(directory).encode()
    return len(head).to_bytes(8, "little") + head + b"\0" * (-(8 + len(head)) % 64) + out.getvalue()


def map_arrays(raw: bytes) -> dict[str, np.ndarray]:
    """The arrays of :func:`pack_arrays`, mapped from a file without a name."""
    import ast

    with tempfile.TemporaryFile() as file:
        file.write(raw)
        file.flush()
        held = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(held[:8], "little")
    base = 8 + size + -(8 + size) % 64
    view = np.frombuffer(held, np.uint8)
    out = {}
    for name, kind, shape, at in ast.literal_eval(held[8 : 8 + size].decode()):
        n = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = view[base + at : base + at + n].view(kind).reshape(shape)
    return out


@dataclass
class Layout:
    """How n-grams are dealt out.  Words are known by 64-bit hashes."""

    shards: int
    numbered: np.ndarray  # words with short numbers, the most frequent first
    hot_words: np.ndarray  # sorted
    hot_pairs: np.ndarray  # sorted; hashes of pairs that begin with a hot word

    @cached_property
    def listed(self) -> np.ndarray:
        """The words with short numbers in the order of their numbers; the beginning always has one."""
        return np.concatenate([[BEGIN], self.numbered])

    @cached_property
    def by_hash(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbered words in order, and their numbers."""
        order = np.argsort(self.listed)
        return self.listed[order], order.astype(np.uint16)

    def number(self, words: np.ndarray) -> np.ndarray:
        """Short numbers of words, 65535 where there is none."""
        hashes, numbers = self.by_hash
        at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
        return np.where(hashes[at] == words, numbers[at], np.uint16(65535))

    def shard_of(self, a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
        spread = K.mix(a)
        hot = np.flatnonzero(held(self.hot_words, a))
        spread[hot] = pair = pair_hashes(a[hot], b[hot])
        both = np.flatnonzero(held(self.hot_pairs, pair))
        spread[hot[both]] = pair_hashes(pair[both], t[hot[both]])
        return ((spread >> np.uint64(24)) % np.uint64(self.shards)).astype(np.uint16 if self.shards <= 1 << 16 else np.uint32)


def held(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``among`` are in the sorted ``values``."""
    if not len(values):
        return np.zeros(len(among), bool)
    return values[np.minimum(np.searchsorted(values, among), len(values) - 1)] == among


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(a) + b)


@dataclass
class Grams:
    """The distinct n-grams of a slice, by shard and then by word: triples below pairs below first words.

    ``triple_of`` has the triple of every entry; entries are the tokens of a text in order, each with the two before it,
    and one more behind the last token, which stands for the pair that ends the text.
    """

    words: np.ndarray
    shard: np.ndarray
    a: np.ndarray
    b: np.ndarray
    t: np.ndarray
    n: np.ndarray
    pair_at: np.ndarray
    first_at: np.ndarray
    triple_of: np.ndarray | None


def cut_grams(tokens: np.ndarray, ends: np.ndarray, training: np.ndarray, layout: Layout, places: bool) -> Grams:
    """Distinct n-grams of texts (tokens up to ``ends``, each text's end included), counted where ``training``."""
    texts = len(ends) - 1
    sizes = np.diff(ends) + 1
    last = np.cumsum(sizes) - 1  # the entry that stands for the pair at the end
    word = np.full(int(last[-1]) + 1 if texts else 0, NONE, np.uint64)
    real = np.ones(len(word), bool)
    real[last] = False
    word[real] = tokens
    words, rank = np.unique(np.concatenate([word, [BEGIN]]), return_inverse=True)
    t, begin = rank[:-1].astype(np.uint64), np.uint64(rank[-1])
    step = np.arange(len(word)) - np.repeat(last - sizes + 1, sizes)
    b = np.where(step < 1, begin, np.concatenate([[begin], t[:-1]])[: len(t)])
    a = np.where(step < 2, begin, np.concatenate([[begin, begin], t[:-2]])[: len(t)])
    counted = np.repeat(training, sizes).astype(np.uint64)
    if len(words) <= 1 << 21:
        keys = (a << np.uint64(42)) | (b << np.uint64(21)) | t
        parts = lambda k: (k >> np.uint64(42), (k >> np.uint64(21)) & np.uint64((1 << 21) - 1), k & np.uint64((1 << 21) - 1))
    else:  # a single text of very many words
        pairs, pair = np.unique((a << np.uint64(32)) | b, return_inverse=True)
        keys = (pair.astype(np.uint64) << np.uint64(32)) | t
        parts = lambda k: (pairs[(k >> np.uint64(32)).astype(np.int64)] >> np.uint64(32), pairs[(k >> np.uint64(32)).astype(np.int64)] & np.uint64((1 << 32) - 1), k & np.uint64((1 << 32) - 1))
    found = np.sort((keys << np.uint64(1)) | counted)
    counted, found = (found & np.uint64(1)).astype(np.int64), found >> np.uint64(1)
    head = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])[: len(found)])
    n, found = np.add.reduceat(counted, head) if len(head) else counted, found[head]
    ra, rb, rt = (x.astype(np.int64) for x in parts(found))
    shard = layout.shard_of(words[ra], words[rb], words[rt])
    order = np.argsort(shard, kind="stable")
    shard, ra, rb, rt, n = shard[order], ra[order], rb[order], rt[order], n[order]
    apart = np.concatenate([[True], (shard[1:] != shard[:-1]) | (ra[1:] != ra[:-1])])[: len(ra)]
    first_at = np.flatnonzero(apart)
    pair_at = np.flatnonzero(apart | np.concatenate([[True], rb[1:] != rb[:-1]])[: len(ra)])
    triple_of = None
    if places:
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        triple_of = moved[np.searchsorted(found, keys)]
    return Grams(words, shard, ra, rb, rt, n, pair_at, first_at, triple_of)


def _planes(values: np.ndarray) -> list[np.ndarray]:
    """Low and high bytes of 16-bit values, which compress better apart."""
    return [(values & 255).astype(np.uint8), (values >> 8).astype(np.uint8)]


def _short(values: np.ndarray, small: np.ndarray, size: int = 8) -> list[np.ndarray]:
    """``small`` by bytes, and ``size`` bytes of the ``values`` whose small one is the largest there is."""
    full = np.ascontiguousarray(values[small == np.iinfo(small.dtype).max], np.uint64)
    return [*(_planes(small) if small.dtype == np.uint16 else [small]), full.view(np.uint8).reshape(-1, 8)[:, :size].ravel()]


def _short_cuts(small: np.ndarray, cuts: np.ndarray, size: int = 8) -> list[np.ndarray]:
    wide = size * np.concatenate([[0], np.cumsum(small == np.iinfo(small.dtype).max)])[cuts]
    return [cuts, cuts, wide] if small.dtype == np.uint16 else [cuts, wide]


def _full(raw: np.ndarray, size: int = 8) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = raw.reshape(-1, size)
    return out.view(np.uint64).ravel()


def write_rows(columns: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """One compressed value a row, of several arrays of bytes with the cuts between their rows."""
    press = zstandard.ZstdCompressor(level=1, write_checksum=False)
    raw = [np.ascontiguousarray(values).tobytes() for values, _ in columns]
    cuts = np.array([c for _, c in columns], np.int64).T
    sizes = np.diff(cuts, axis=0).astype(np.uint32)
    rows = cuts.tolist()
    return pa.array([press.compress(b"".join([size.tobytes(), *(x[i:j] for x, i, j in zip(raw, a, b, strict=True))])) for size, a, b in zip(sizes, rows, rows[1:], strict=False)], pa.binary())


def read_rows(blobs: pa.Array, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ``n`` arrays of bytes of :func:`write_rows`, each over all rows, and the cuts between rows."""
    expand = zstandard.ZstdDecompressor()
    parts: list[list[bytes]] = [[] for _ in range(n)]
    sizes = np.zeros((len(blobs) + 1, n), np.int64)
    for i, blob in enumerate(blobs.to_pylist()):
        raw = expand.decompress(blob)
        sizes[i + 1] = np.frombuffer(raw, np.uint32, n)
        at = 4 * n
        for part, size in zip(parts, sizes[i + 1].tolist(), strict=True):
            part.append(raw[at : at + size])
            at += size
    return [(np.frombuffer(b"".join(part), np.uint8), np.cumsum(sizes[:, k])) for k, part in enumerate(parts)]


def _join(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint16) | (high.astype(np.uint16) << 8)


def _whole(small: np.ndarray, full: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[small == np.iinfo(small.dtype).max] = full
    return out


REQUEST_PARTS, ANSWER_PARTS = 3 * 3 + 4 * 2, 3 + 2 * 2
#: Bytes of the hash of a word without a number.  A shard counts first words by all of it; second and third words have to
#: differ only from the other successors of their context, whose number a shard's size bounds.
FIRST_BYTES, SUCCESSOR_BYTES = 8, 5
REQUEST = "shard int, slice_id long, request binary"
ANSWER = "slice_id long, shard int, own_words long, answer binary"


def requests(g: Grams, slice_id: int, layout: Layout) -> pa.RecordBatch:
    """A slice's n-grams, one row for each shard that has some."""
    number = layout.number(g.words)
    rows = np.flatnonzero(np.concatenate([[True], g.shard[1:] != g.shard[:-1]])[: len(g.shard)])
    edge = np.append(rows, len(g.shard))
    byte = lambda x: np.minimum(x, 255).astype(np.uint8)
    real = g.words[g.t] != NONE
    before = np.concatenate([[0], np.cumsum(real)])
    pair_edge, first_edge = np.append(g.pair_at, len(g.t)), np.searchsorted(g.pair_at, np.append(g.first_at, len(g.t)))
    by_first, by_pair, by_triple = np.searchsorted(g.first_at, edge), np.searchsorted(g.pair_at, edge), before[edge]
    a, b, t = g.a[g.first_at], g.b[g.pair_at], g.t[real]
    a_n, b_n = np.diff(first_edge), np.diff(before[pair_edge])
    b_count = np.add.reduceat(g.n, g.pair_at) if len(g.pair_at) else g.n
    t_count = g.n[real]
    columns: list[tuple[np.ndarray, np.ndarray]] = []
    for values, small, cuts, size in (
        (g.words[a], number[a], by_first, FIRST_BYTES), (g.words[b], number[b], by_pair, SUCCESSOR_BYTES), (g.words[t], number[t], by_triple, SUCCESSOR_BYTES),
        (a_n, byte(a_n), by_first, 8), (b_n, byte(b_n), by_pair, 8), (b_count, byte(b_count), by_pair, 8), (t_count, byte(t_count), by_triple, 8),
    ):
        columns += zip(_short(values, small, size), _short_cuts(small, cuts, size), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(g.shard[rows].astype(np.int32)), pa.array(np.full(len(rows), slice_id)), write_rows(columns)], names=["shard", "slice_id", "request"])


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (below 2^52), sorted, and the sums of their counts."""
    most = 4095
    if counts.max(initial=0) > most:
        times = -(-counts // most)
        rest = counts - (times - 1) * most
        keys, full = np.repeat(keys, times), np.full(int(times.sum()), most)
        full[np.cumsum(times) - 1] = rest
        counts = full
    packed = np.sort((keys << np.uint64(12)) | counts.astype(np.uint64))
    keys, counts = packed >> np.uint64(12), (packed & np.uint64(most)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


@dataclass
class Request:
    """The n-grams of many requests, one behind the other, words as numbers of the shard."""

    numbered: np.ndarray
    names: list[np.ndarray]  # of first, second and third words those that have a number of this shard
    width: int
    a: np.ndarray
    b: np.ndarray
    t: np.ndarray
    first_of: np.ndarray  # of each pair
    pair_of: np.ndarray  # of each triple
    b_count: np.ndarray
    t_count: np.ndarray
    cuts: list[np.ndarray]  # of first words, pairs and triples, between requests

    @staticmethod
    def of(blobs: pa.Array, numbered: np.ndarray) -> Request:
        read = read_rows(blobs, REQUEST_PARTS)
        words, names = [], []
        for k, size in ((0, FIRST_BYTES), (3, SUCCESSOR_BYTES), (6, SUCCESSOR_BYTES)):
            full = _full(read[k + 2][0], size)
            rare = np.unique(full)
            words.append(_whole(_join(read[k][0], read[k + 1][0]), len(numbered) + np.searchsorted(rare, full)))
            names.append(rare)
        a_n, b_n, b_count, t_count = (_whole(read[k][0], _full(read[k + 1][0])) for k in (9, 11, 13, 15))
        width = len(numbered) + max(map(len, names))
        return Request(numbered, names, width, *words, np.repeat(np.arange(len(a_n)), a_n), np.repeat(np.arange(len(b_n)), b_n), b_count, t_count, [read[k][1] for k in (0, 3, 6)])

    def first_hashes(self, a: np.ndarray) -> np.ndarray:
        """Hashes of first words by their numbers."""
        return np.concatenate([self.numbered, self.names[0]])[a]

    def pair_hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of pairs by the numbers of their words, that of no pair where the second word has no short number; a hot pair's has one."""
        known = b < len(self.numbered)
        out = np.full(len(b), pair_hashes(np.array([NONE]), np.array([NONE]))[0])
        out[known] = pair_hashes(self.first_hashes(a[known]), self.numbered[b[known]])
        return out


class Trie:
    """The n-grams of one shard.  ``totals`` gives the counts of hot words and pairs, which other shards share."""

    def __init__(self, raw: bytes):
        self.parts = map_arrays(raw)
        self.firsts, self.first_ends, self.pairs, self.pair_ends, self.triples = (EliasFano.of(self.parts, n) for n in ("firsts", "first_ends", "pairs", "pair_ends", "triples"))
        self.width = np.uint64(self.parts["width"][0])

    @staticmethod
    def _range(ends: EliasFano, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ends.get(i).astype(np.int64), ends.get(i + 1).astype(np.int64)

    @staticmethod
    def build(r: Request, totals: dict[str, tuple[np.ndarray, np.ndarray]]) -> bytes:
        width = np.uint64(r.width)
        seen = r.b_count > 0
        pair_keys = (r.a[r.first_of].astype(np.uint64) << np.uint64(26)) | r.b.astype(np.uint64)
        keys, counts = _added(pair_keys[seen], r.b_count[seen])
        a, b = (keys >> np.uint64(26)).astype(np.int64), (keys & np.uint64((1 << 26) - 1)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])[: len(a)])
        firsts = a[head]
        of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(a))))
        first_counts = _shared(r.first_hashes(firsts), np.add.reduceat(counts, head) if len(head) else counts, totals["words"])
        counts = _shared(r.pair_hashes(a, b), counts, totals["pairs"])
        pair_log = np.log10(np.maximum(counts, 1)) - np.log10(first_counts[of] + MU)
        pair_row = np.full(len(pair_keys), -1)
        pair_row[seen] = np.searchsorted(keys, pair_keys[seen])
        above = pair_row[r.pair_of]
        known = r.t_count > 0
        triple_keys, triple_counts = _added((above[known].astype(np.uint64) << np.uint64(26)) | r.t[known].astype(np.uint64), r.t_count[known])
        up, t = (triple_keys >> np.uint64(26)).astype(np.int64), triple_keys & np.uint64((1 << 26) - 1)
        triple_log = np.log10(np.maximum(triple_counts, 1)) - np.log10(counts[up] + MU)
        parts = {"width": np.array([width], np.int64), "first_counts": first_counts.astype(np.int64), "pair_codes": quantise(pair_log), "triple_codes": quantise(triple_log)}
        parts |= EliasFano.build(firsts).parts("firsts") | EliasFano.build(np.append(head, len(a))).parts("first_ends")
        parts |= EliasFano.build(of.astype(np.uint64) * width + b.astype(np.uint64)).parts("pairs")
        parts |= EliasFano.build(np.searchsorted(up, np.arange(len(keys) + 1))).parts("pair_ends")
        parts |= EliasFano.build(up.astype(np.uint64) * width + t).parts("triples")
        return pack_arrays(parts)

    def find(self, a: np.ndarray, b: np.ndarray, t: np.ndarray, first_of: np.ndarray, pair_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of first words, of pairs among the successors of theirs, and of triples among those of their pairs; -1 for none."""
        first = self.firsts.find(a)
        return first, (pair := self._successor(self.pairs, self.first_ends, first, first_of, b)), self._successor(self.triples, self.pair_ends, pair, pair_of, t)

    def _successor(self, level: EliasFano, ends: EliasFano, above: np.ndarray, of: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.full(len(word), -1, np.int64)
        some = np.flatnonzero(above >= 0)
        low, high = np.zeros((2, len(above)), np.int64)
        low[some], high[some] = self._range(ends, above[some])
        ask = np.flatnonzero(above[of] >= 0)
        context = of[ask]
        out[ask] = level.find(above[context].astype(np.uint64) * self.width + word[ask].astype(np.uint64), low[context], high[context])
        return out

    def answer(self, r: Request) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of the first words, pairs and triples of requests, 0 where there is none: the codes' shares of their contexts."""
        rows = self.find(r.a, r.b, r.t, r.first_of, r.pair_of)
        first, pair, triple = (np.where(row >= 0, self.parts[name][row] if len(self.parts[name]) else 0, 0) for row, name in zip(rows, ("first_counts", "pair_codes", "triple_codes"), strict=True))
        pairs = np.rint(shares(pair) * (first[r.first_of] + MU)).astype(np.int64)
        return first, pairs, np.rint(shares(triple) * (pairs[r.pair_of] + MU)).astype(np.int64)


def _shared(keys: np.ndarray, counts: np.ndarray, totals: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``counts``, but those of ``totals`` (sorted keys and counts) where it has the key."""
    here = np.flatnonzero(held(totals[0], keys))
    counts = counts.copy()
    counts[here] = totals[1][np.searchsorted(totals[0], keys[here])]
    return counts


@dataclass
class Totals:
    """Of all training texts: tokens (N), distinct tokens (V) and texts."""

    tokens: int
    distinct: int
    texts: int


def token_scores(g: Grams, firsts: np.ndarray, pairs: np.ndarray, triples: np.ndarray, ends: np.ndarray, totals: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token: its count, log10 of the word model, and of the interpolated model."""
    n = len(g.triple_of)
    first_of = np.searchsorted(g.first_at, np.arange(len(g.t)), side="right") - 1
    pair_of = np.searchsorted(g.pair_at, np.arange(len(g.t)), side="right") - 1
    words = np.where(g.words[g.a[g.first_at]] == BEGIN, totals.texts, firsts).astype(float)
    real = g.words[g.t] != NONE
    triple_counts = np.zeros(len(g.t), np.int64)
    triple_counts[real] = triples
    texts = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    at = np.arange(len(texts)) + texts  # a token's entry; the entry of the pair that it ends comes next
    now, following = g.triple_of[at], g.triple_of[at + 1]
    is_end = np.zeros(len(texts), bool)
    is_end[ends[1:] - 1] = True
    count = np.where(is_end, totals.texts, words[first_of[g.triple_of[np.minimum(at + 2, n - 1)]]])
    mass = totals.tokens + 0.5 * (totals.distinct + 1)
    one = (count + 0.5) / mass
    before = words[first_of[following]]
    two = (pairs[pair_of[following]] + MU * one) / (before + MU)
    context = pairs[pair_of[now]].astype(float)
    context[ends[:-1]] = totals.texts
    three = (triple_counts[now] + MU * two) / (context + MU)
    return count, np.log10(one), np.log10(three)


def hashed_tokens(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts, each text's end included, and the offsets of the texts."""
    n = len(words.first) - 1
    ends = words.first + np.arange(n + 1)
    out = np.full(len(words.start) + n, END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[ends[1:] - 1] = False
    out[keep] = words.hashes()
    return out, ends


def tokens_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a slice, each text's end included, and the offsets of the texts."""
    return hashed_tokens(K.batch_words(part, K.SPACED, lower=True))


def look(docs: DataFrame) -> Layout:
    """The layout for ``docs`` (doc_id, text), from every SAMPLE-th document."""
    seen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("look")), F.lit(SAMPLE)) == 0).select("text")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        tokens, ends = tokens_of(part)
        pairs = pair_hashes(tokens[:-1], tokens[1:])[np.diff(np.repeat(np.arange(part.num_rows), np.diff(ends))) == 0]
        counted = [np.unique(x, return_counts=True) for x in (tokens, pairs)]
        # A pair is hot only if its first word is; where it is not, the layout doesn't ask.
        kinds = np.repeat([False, True], [len(c[0]) for c in counted])
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(K.signed(np.concatenate([c[0] for c in counted]))), pa.array(np.concatenate([c[1] for c in counted]))], names=["pair", "gram", "n"])

    counts = K.map_texts(seen, work, "pair boolean, gram long, n long", limit=SLICE_BYTES).groupBy("pair", "gram").agg(F.sum("n").alias("n"))
    counts = stage_table(counts, "lm-look")
    total = counts.where("not pair").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(default_partitions(docs.sparkSession), -(-total * SAMPLE // SHARD_TOKENS))
    least = max(16.0, total / (4.0 * shards))
    take = lambda rows, most: rows.orderBy(F.desc("n")).limit(most).select("gram").toArrow().column("gram").to_numpy().view(np.uint64)
    words, often = counts.where("not pair"), F.col("n") >= least
    hot_words = np.union1d(take(words.where(often), HOT_MOST), [BEGIN])
    hot_pairs = np.union1d(take(counts.where("pair").where(often), HOT_MOST), pair_hashes(np.array([BEGIN]), np.array([BEGIN])))
    layout = Layout(shards, take(words, NUMBERED), hot_words, hot_pairs)
    drop_stage(counts)
    return layout


SLICE = "slice_id long, doc_ids array<long>, training array<boolean>, ends binary, texts binary, n_tokens long, n_texts long, hot binary"


def write_slices(rows: DataFrame, layout: Layout) -> DataFrame:
    """``rows`` (doc_id, training, text) in slices, with counts of their training texts: tokens, texts, hot words and pairs."""
    shared = rows.sparkSession.sparkContext.broadcast(layout)
    hot_size = len(layout.hot_words) + len(layout.hot_pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_id, plan, press = TaskContext.get().partitionId() << 32, shared.value, zstandard.ZstdCompressor(level=3)
        index = HashIndex()
        index.add(np.concatenate([plan.hot_words, plan.hot_pairs]))
        for batch in batches:
            for part in K.text_slices(batch, limit=SLICE_BYTES):
                data, offsets = K.text_bytes(part.column("text"))
                tokens, ends = tokens_of(part)
                training = part.column("training").to_numpy(zero_copy_only=False).astype(bool)
                text = np.repeat(np.arange(part.num_rows), np.diff(ends))
                mine = training[text]
                led = np.flatnonzero(held(plan.hot_words, tokens[:-1]) & mine[:-1] & (text[1:] == text[:-1]))
                places = np.concatenate([index.find(tokens[mine]), index.find(pair_hashes(tokens[led], tokens[led + 1]))])
                hot = np.bincount(places[places >= 0], minlength=hot_size).astype(np.uint32)
                blobs = [(offsets[1:].astype(np.int64)).tobytes(), press.compress(data.tobytes()), hot.tobytes()]
                columns = [pa.array([slice_id]), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([training.tolist()], pa.list_(pa.bool_())), *(pa.array([b], pa.binary()) for b in blobs[:2])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([int(mine.sum())]), pa.array([int(training.sum())]), *(pa.array([b], pa.binary()) for b in blobs[2:])], names=[c.split()[0] for c in SLICE.split(", ")])
                slice_id += 1

    return stage_table(rows.mapInArrow(run, SLICE), "lm-slices")


def gather_totals(slices: DataFrame, layout: Layout) -> tuple[int, int, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Tokens and texts of training, and the counts of hot words and pairs."""
    size = len(layout.hot_words) + len(layout.hot_pairs)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column("hot"):
                hot += np.frombuffer(raw.as_py(), np.uint32)
        here = np.flatnonzero(hot)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(hot[here])], names=["row", "n"])

    found = slices.select("hot").mapInArrow(added, "row long, n long").groupBy("row").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[found.column("row").to_numpy()] = found.column("n").to_numpy()
    tokens, texts = slices.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_texts"), F.lit(0))).first()
    words, pairs = np.split(counts, [len(layout.hot_words)])
    # The beginning stands before every text once, and as a pair too.
    words[layout.hot_words == BEGIN] = texts
    pairs[layout.hot_pairs == pair_hashes(np.array([BEGIN]), np.array([BEGIN]))] = texts
    met = [(keys[n > 0], n[n > 0]) for keys, n in ((layout.hot_words, words), (layout.hot_pairs, pairs))]
    return tokens, texts, {"words": met[0], "pairs": met[1]}


def _slice_grams(batch: pa.RecordBatch, i: int, layout: Layout, places: bool) -> tuple[Grams, np.ndarray]:
    """The n-grams of a stored slice, and the ends of its texts' tokens."""
    text = zstandard.ZstdDecompressor().decompress(batch.column("texts")[i].as_py())
    offsets = np.concatenate([[0], np.frombuffer(batch.column("ends")[i].as_py(), np.int64)])
    tokens, ends = hashed_tokens(K.find_words(K.LOWER[np.frombuffer(text, np.uint8)], offsets, K.SPACED))
    return cut_grams(tokens, ends, np.array(batch.column("training")[i].as_py(), bool), layout, places), ends


def ask(slices: DataFrame, layout: Layout) -> DataFrame:
    """The requests of all slices, by shard."""
    shared = slices.sparkSession.sparkContext.broadcast(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, slice_id in enumerate(batch.column("slice_id").to_pylist()):
                yield requests(_slice_grams(batch, i, shared.value, False)[0], slice_id, shared.value)

    parts = default_partitions(slices.sparkSession)
    rows = slices.select("slice_id", "training", "ends", "texts").mapInArrow(run, REQUEST)
    return rows.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard")


def answer(asked: DataFrame, layout: Layout, totals: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Each shard's trie, asked by every slice.  own_words is the number of words that the shard alone counts, in its first row."""
    shared = asked.sparkSession.sparkContext.broadcast((layout.listed, totals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_: list[pa.RecordBatch] = []

        def answers() -> Iterator[pa.RecordBatch]:
            numbered, sums = shared.value
            batch = pa.Table.from_batches(held_).combine_chunks().to_batches()[0]
            held_.clear()
            r = Request.of(batch.column("request"), numbered)
            trie = Trie(Trie.build(r, sums))
            firsts, pairs, triples = trie.answer(r)
            own = r.first_hashes(trie.firsts.get(np.arange(trie.firsts.n)).astype(np.int64)) if trie.firsts.n else np.zeros(0, np.uint64)
            own_words = np.zeros(batch.num_rows, np.int64)
            own_words[0] = int((~held(sums["words"][0], own)).sum())
            columns = []
            for values, cuts, most, kind in ((firsts, r.cuts[0], 65535, np.uint16), (pairs, r.cuts[1], 255, np.uint8), (triples, r.cuts[2], 255, np.uint8)):
                small = np.minimum(values, most).astype(kind)
                columns += zip(_short(values, small), _short_cuts(small, cuts), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("slice_id"), batch.column("shard"), pa.array(own_words), write_rows(columns)], names=[c.split()[0] for c in ANSWER.split(", ")])

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held_ and held_[-1].column("shard")[0].as_py() != shard[a]:
                    yield from answers()
                held_.append(batch.slice(a, b - a))
        if held_:
            yield from answers()

    return asked.mapInArrow(run, ANSWER)


def score_texts(docs: DataFrame, is_training: Column) -> DataFrame:
    """doc_id, is_training, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    base_score is the add-half word model's log10 probability, score that of the model of words, pairs and triples.  A
    null text is empty, so its end is its one token.  Rows that share a doc_id, or have none, are scored each on their
    own; repeated rows count each time.  Without training rows every word is as likely as an unknown one.  A text of any
    length is scored whole, in a slice of its own if it is long.  No rows: no result.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(is_training, F.lit(False)).alias("training"), F.col("text").cast("string").alias("text"))
    layout = look(rows.where("training"))
    slices = write_slices(rows, layout)
    tokens, words_in, hot = gather_totals(slices, layout)
    answers = stage_table(answer(ask(slices, layout), layout, hot), "lm-answers")
    shared_words = int(np.isin(hot["words"][0], [BEGIN, END], invert=True).sum())
    totals = Totals(tokens, (answers.agg(F.sum("own_words")).first()[0] or 0) + shared_words + (words_in > 0), words_in)
    answers = answers.drop("own_words")
    texts = slices.select("slice_id", F.lit(-1).alias("shard"), "doc_ids", "training", "ends", "texts")
    met = texts.unionByName(answers, allowMissingColumns=True)
    parts = default_partitions(spark)
    shared = spark.sparkContext.broadcast((layout, totals))
    names = ["doc_id", "training", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_: list[pa.RecordBatch] = []

        def scored() -> Iterator[pa.RecordBatch]:
            plan, sums = shared.value
            batch = pa.Table.from_batches(held_).combine_chunks().to_batches()[0]
            held_.clear()
            g, ends = _slice_grams(batch, 0, plan, True)
            low, high, first, pair, pair_full, triple, triple_full = (x for x, _ in read_rows(batch.column("answer").slice(1), ANSWER_PARTS))
            counts = _whole(_join(low, high), _full(first)), _whole(pair, _full(pair_full)), _whole(triple, _full(triple_full))
            count, base, model = token_scores(g, *counts, ends, sums)
            add = lambda x: np.add.reduceat(x, ends[:-1])
            columns = [pa.array(batch.column("doc_ids")[0].as_py(), pa.int64()), pa.array(batch.column("training")[0].as_py(), pa.bool_()), np.diff(ends), add((count > 0).astype(np.int64)), add(base), add(model)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

        for batch in batches:
            slice_id = batch.column("slice_id").to_numpy()
            edges = [0, *(np.flatnonzero(slice_id[1:] != slice_id[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held_ and held_[-1].column("slice_id")[0].as_py() != slice_id[a]:
                    yield from scored()
                held_.append(batch.slice(a, b - a))
        if held_:
            yield from scored()

    dealt = met.repartition(parts, "slice_id").sortWithinPartitions("slice_id", "shard")
    out = dealt.mapInArrow(run, "doc_id long, training boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "training", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")
