"""Alignment of two tokenizers by union-find over overlapping tokens.

The tokens of both tokenizers cover the same bytes.  Tokens of one and of the other that share a byte are linked in a
bipartite graph; its connected components, found by union-find, are exactly the smallest groups at whose ends both
tokenizers cut.  Within a group every token of one side is linked with every one of the other.

Where two neighbouring characters stand in no entry of either vocabulary, no token reaches over the place between them:
so it is before a space behind a character that is no white space, and between most letters and points.  A group never
reaches over such a place and depends on nothing outside it.  A worker therefore aligns each distinct unit (what lies
between two such places) once, and a text is the sequence of its units.

Counting is distributed.  A slice of documents keeps, as one row of a staged table, the pairs of ids that each document
holds, and how many of its documents hold each pair.  These are summed over the corpus by pair, and each slice asks for
the counts of the pairs that it has: a pair reaches the join once for each slice, however many documents hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage_table
from . import kernels as K
from . import tokens

SLICE_BYTES = 2 << 20
SPACE = "▁"
DIGEST = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string"}


def components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Union-find over nodes 0 to n - 1 and edges left[i] - right[i]: the smallest node of each node's component.

    All edges are worked on at once: roots that an edge joins are hooked below the smaller root, then every path is
    compressed; edges within a component fall away, until none is left.
    """
    parent = np.arange(n)
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return parent
        left, right = left[apart], right[apart]
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            grand = parent[parent]
            if np.array_equal(grand, parent):
                break
            parent = grand


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (token of A, token of B) that share a byte, for tokens that cover the same bytes and end where given."""
    begins = np.concatenate([[0], b_ends[:-1]])
    first = np.searchsorted(a_ends, begins, side="right")
    last = np.searchsorted(a_ends, b_ends, side="left")
    sizes = last - first + 1
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0), np.repeat(np.arange(len(b_ends)), sizes)


def _counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(weights, head) if len(head) else np.zeros(0, np.int64)


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _neighbours(entries: list[bytes]) -> np.ndarray:
    """Which pairs of bytes stand side by side in an entry."""
    data, ends = np.frombuffer(b"".join(entries), np.uint8), np.cumsum([len(e) for e in entries])
    within = np.ones(max(len(data) - 1, 0), bool)
    within[ends[:-1] - 1] = False
    table = np.zeros((256, 256), bool)
    table[data[:-1][within], data[1:][within]] = True
    return table


def _spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _shown(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For the groups first[u] up to first[u + 1] of each unit: ids as decimals, "a1,a2|b1,b2;" for each group."""
    group = np.concatenate([a_group, b_group])
    order = np.argsort(group, kind="stable")
    group, ids, side = group[order], np.concatenate([a, b])[order], order >= len(a)
    last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)
    text = np.empty((len(ids), 7), np.uint8)
    for k in range(6):
        text[:, k] = 0x30 + ids // 10 ** (5 - k) % 10
    text[:, 6] = np.where(last, np.where(side, ord(";"), ord("|")), ord(","))
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 6))
    flat = text[np.arange(7) >= (6 - digits)[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(digits + 1)])[np.searchsorted(group, first)].tolist()
    return [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


class Aligner:
    """Groups and links of units, kept up to ``most`` units or ``most_bytes`` bytes of them."""

    def __init__(self, byte_path: str, piece_path: str, most: int = 1 << 18, most_bytes: int = 32 << 20):
        from sentencepiece import SentencePieceProcessor

        self.a = tokens.UnitEncoder(byte_path, 1 << 17)
        self.b = SentencePieceProcessor(model_file=piece_path)
        self.most, self.most_bytes = most, most_bytes
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.b_width = np.array([len(p) for p in self.b_bytes])
        self.b_flat, self.b_first = np.frombuffer(b"".join(self.b_bytes), np.uint8), np.cumsum(self.b_width) - self.b_width
        alphabet = byte_alphabet()
        a_bytes = [bytes(alphabet[c] for c in t) for t in self.a.tokenizer.get_vocab() if all(c in alphabet for c in t)]
        # A cut is made between ASCII characters that are neighbours in no entry; not behind an apostrophe, after which
        # the split pattern of A looks ahead, nor behind white space, whose runs it splits by what follows.
        self.parted = ~_neighbours([x for x in a_bytes + self.b_bytes if x])
        self.parted[:0x21], self.parted[0x7F:], self.parted[0x27], self.parted[:, 0x7F:] = False, False, False, False
        self._reset()

    def _reset(self) -> None:
        self.units, self.pairs = tokens.HashIndex(14), tokens.HashIndex(14)
        self.codes = np.zeros(0, np.int64)  # of pairs: id of A << 32 | id of B
        self.size = np.zeros((0, 4), np.int64)  # of units: tokens of A, of B, groups, links
        self.fits = np.zeros(0, bool)  # both tokenizers give back the bytes
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)  # links of a unit
        self.link, self.times = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.shown: list[bytes] = []
        self.held_bytes = 0

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> K.Words:
        """The units of texts that begin with a space each."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n:
            here = self.parted[data[:-1], data[1:]] | (data[1:] == 0x20) & (data[:-1] >= 0x80)
            high = np.flatnonzero(here & (data[:-1] >= 0x80)) + 1  # the character before may be wide white space
            two, three = data[high - 2], data[high - 3]
            risky = ((high >= 2) & (two == 0xC2)) | ((high >= 3) & (three >= 0xE1) & (three <= 0xE3))
            here[high[risky] - 1] = False
            cut[1:n] = here
        cut[offsets] = True
        start = np.flatnonzero(cut[:n])
        return K.Words(data, start, np.append(start[1:], n)[: len(start)], np.searchsorted(start, offsets))

    def rows_of(self, units: K.Words) -> np.ndarray:
        keys = units.hashes()
        rows = self.units.find(keys)
        fresh = np.flatnonzero(rows < 0)
        if len(fresh):
            new, first = np.unique(keys[fresh], return_index=True)
            if self.units.n and (self.units.n + len(new) > self.most or self.held_bytes > self.most_bytes):
                self._reset()
                new, first = np.unique(keys, return_index=True)
                fresh = np.arange(len(keys))
            self._learn(units, new, fresh[first])
            rows = self.units.find(keys)
        return rows

    def _encode_b(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of B of texts one after another, the offsets of each text's ids, and which texts they give back.

        B puts a space before what it encodes.  Behind that, and a line feed, which merges with nothing, stand the texts,
        with a line feed before each; many are encoded as one as long as that gives back all their bytes.
        """
        ids, counts, fits = [], [], []
        for k in range(0, len(offsets) - 1, 512):
            at = offsets[k : k + 513]
            lengths = np.diff(at)
            want = np.full(len(lengths) + int(at[-1] - at[0]), 0x0A, np.uint8)
            want[np.arange(at[-1] - at[0]) + np.repeat(np.arange(1, len(lengths) + 1), lengths)] = data[at[0] : at[-1]]
            got = np.array(self.b.encode(want.tobytes().decode(), num_threads=1), np.int64)[1:]
            reach = np.cumsum(self.b_width[got])
            ends = np.cumsum(lengths + 1)
            upto = np.searchsorted(reach, ends)
            if reach[-1] == len(want) and np.array_equal(reach[upto], ends) and np.array_equal(self.b_flat[_spans(self.b_first[got], self.b_width[got])], want):
                first = np.concatenate([[0], upto[:-1] + 1])
                ids.append(np.delete(got, first))  # the line feeds
                counts.append(upto - first)
                fits.append(np.ones(len(lengths), bool))
                continue
            for i in range(len(lengths)):
                raw = data[at[i] : at[i + 1]].tobytes()
                one = self.b.encode("\n" + raw.decode(), num_threads=1)[2:]
                ids.append(np.array(one, np.int64))
                counts.append(np.array([len(one)]))
                fits.append(np.array([b"".join(map(self.b_bytes.__getitem__, one)) == raw]))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(fits)

    def _learn(self, units: K.Words, keys: np.ndarray, which: np.ndarray) -> None:
        lengths = units.end[which] - units.start[which]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        data, n_units = units.data[_spans(units.start[which], lengths)], len(which)
        a_ids, a_first = self.a.encode(data, offsets)
        b_ids, b_first, fits = self._encode_b(data, offsets)
        a_ends = np.concatenate([[0], np.cumsum(self.a.width[a_ids])])
        fits &= a_ends[a_first[1:]] - a_ends[a_first[:-1]] == lengths
        # Units that don't fit take no part: theirs is one made-up group, so that positions stay in step.
        a_n, b_n = np.where(fits, np.diff(a_first), 1), np.where(fits, np.diff(b_first), 1)
        a_of, b_of = np.repeat(np.arange(n_units), a_n), np.repeat(np.arange(n_units), b_n)
        a_flat, b_flat = np.zeros(len(a_of), np.int64), np.zeros(len(b_of), np.int64)
        a_flat[fits[a_of]] = a_ids[np.repeat(fits, np.diff(a_first))]
        b_flat[fits[b_of]] = b_ids[np.repeat(fits, np.diff(b_first))]
        a_step = np.where(fits[a_of], self.a.width[a_flat], lengths[a_of])
        b_step = np.where(fits[b_of], self.b_width[b_flat], lengths[b_of])
        a_seen, b_seen = overlaps(np.cumsum(a_step), np.cumsum(b_step))
        label = components(len(a_flat) + len(b_flat), a_seen, b_seen + len(a_flat))
        roots = np.unique(label)  # the first token of A in each group, so groups are in the order of the text
        a_group, b_group = np.searchsorted(roots, label[: len(a_flat)]), np.searchsorted(roots, label[len(a_flat) :])
        n_groups = len(roots)
        unit_of_group = a_of[roots]
        # Links: distinct ids of a group's sides with their numbers, every one with every other.
        a_key, a_times = _counted(a_group << 32 | a_flat, np.ones(len(a_flat), np.int64))
        b_key, b_times = _counted(b_group << 32 | b_flat, np.ones(len(b_flat), np.int64))
        b_first = np.searchsorted(b_key >> 32, np.arange(n_groups + 1))
        mine = a_key >> 32
        sizes = np.diff(b_first)[mine]
        left, right = np.repeat(np.arange(len(a_key)), sizes), _spans(b_first[mine], sizes)
        code = (a_key[left] & 0xFFFFFFFF) << 32 | (b_key[right] & 0xFFFFFFFF)
        found, of_code = np.unique(code, return_inverse=True)
        pair_rows = self.pairs.find(K.mix(found.view(np.uint64)))
        new = pair_rows < 0
        if new.any():
            pair_rows[new] = self.pairs.add(K.mix(found[new].view(np.uint64)))
            self.codes = np.concatenate([self.codes, found[new]])
        unit_link, times = _counted(unit_of_group[mine][left] << 32 | pair_rows[of_code].astype(np.int64), a_times[left] * b_times[right])
        link_unit = unit_link >> 32
        first = np.searchsorted(link_unit, np.arange(n_units + 1))
        links = np.zeros(n_units, np.int64)
        np.add.at(links, link_unit, times)
        rows = self.units.add(keys)
        assert rows[0] == len(self.fits)
        self.fits = np.concatenate([self.fits, fits])
        self.size = np.concatenate([self.size, np.column_stack([a_n, b_n, np.bincount(unit_of_group, minlength=n_units), links])])
        self.at, self.n = np.concatenate([self.at, len(self.link) + first[:-1]]), np.concatenate([self.n, np.diff(first)])
        self.link, self.times = np.concatenate([self.link, (unit_link & 0xFFFFFFFF).astype(np.int32)]), np.concatenate([self.times, times])
        self.shown += _shown(a_flat, b_flat, a_group, b_group, np.searchsorted(unit_of_group, np.arange(n_units + 1)))
        self.held_bytes += int(lengths.sum())

    def texts(self, column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts: their four sizes and digests; distinct pairs of all, and for each text its pairs and how often."""
        plain, offsets = K.text_bytes(column)
        lengths = np.diff(offsets)
        n = len(lengths)
        data = np.full(len(plain) + n, 0x20, np.uint8)
        data[np.arange(len(plain)) + np.repeat(np.arange(1, n + 1), lengths)] = plain
        units = self.cut(data, offsets + np.arange(n + 1))
        rows = self.rows_of(units) if len(units.start) else np.zeros(0, np.int32)
        text_of = units.text_of
        bad = np.bincount(text_of[~self.fits[rows]], minlength=n)
        whole = (lengths > 0) & (bad == 0)
        sizes = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.size[rows], axis=0)])[units.first], axis=0) * whole[:, None]
        digests, listed, first = [], rows.tolist(), units.first.tolist()
        for d, good in enumerate(whole.tolist()):
            digests.append(hashlib.sha256(b"".join(map(self.shown.__getitem__, listed[first[d] : first[d + 1]]))[:-1]).hexdigest() if good else "")
        good = whole[text_of]
        key, times = _counted(text_of[good] << 32 | rows[good].astype(np.int64), np.ones(int(good.sum()), np.int64))
        row = key & 0xFFFFFFFF
        which = np.repeat(np.arange(len(key)), self.n[row])
        link = _spans(self.at[row], self.n[row])
        key, times = _counted((key >> 32)[which] << 32 | self.link[link].astype(np.int64), times[which] * self.times[link])
        pairs, local = np.unique(self.codes[key & 0xFFFFFFFF], return_inverse=True)
        return sizes, digests, pairs, np.bincount(key >> 32, minlength=n), local, times


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """This worker's aligner of two vocabularies; it serves all tasks of the worker."""
    key = byte_path, piece_path
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _slices(rows: DataFrame, text: str, keep: list[str], byte_path: str, piece_path: str) -> DataFrame:
    """One row for each slice: its documents, the pairs they hold and in how many documents, and who holds which."""
    fields = [f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.select(*K.columns(keep)).schema]
    inner = ", ".join([f"key{i}: {f.split('`: ', 1)[1]}" for i, f in enumerate(fields)] + [f"{c}: {t}" for c, t in DIGEST.items()] + ["n_pairs: int"])
    schema = f"slice_id long, docs array<struct<{inner}>>, pairs array<bigint>, held array<int>, local binary, times binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, press = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in K.text_slices(batch, text, SLICE_BYTES):
                sizes, digests, pairs, per_text, local, times = aligner(byte_path, piece_path).texts(part.column(text))
                columns = [part.column(k) for k in keep] + [pa.array(sizes[:, i]) for i in range(4)] + [pa.array(digests, pa.string()), pa.array(per_text.astype(np.int32))]
                names = [f"key{i}" for i in range(len(keep))] + [*DIGEST, "n_pairs"]
                docs = pa.StructArray.from_arrays(columns, names=names)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                held = pa.array(np.bincount(local, minlength=len(pairs)).astype(np.int32))
                blobs = [pa.array([press.compress(x.tobytes())], pa.binary()) for x in (local.astype(np.int32), times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(docs), one(pa.array(pairs)), one(held), *blobs], names=["slice_id", "docs", "pairs", "held", "local", "times"])
                number += 1

    return K.map_batches(K.small_batches(rows), run, schema)


def pair_counts(slices: DataFrame) -> DataFrame:
    """pair (id of A << 32 | id of B), the number of documents that hold it, and whether that is the highest of its A id.

    One A id has at most as many pairs as B has ids.
    """
    seen = slices.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = seen.groupBy("pair").agg(F.sum("held").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def align_tokens(docs: DataFrame, byte_path: str, piece_path: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default doc_id) of every row, and n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Both vocabularies encode a space and the text.  n_links counts pairs of tokens in one group; the count of a pair of
    ids is the number of rows that hold it linked; count_sum adds it up over links, n_best counts the links whose count is
    the highest of their A id.  A null or empty text, and one that a tokenizer does not give back byte for byte, has no
    tokens: zeros and an empty digest.  Repeated rows and rows that share an id or have none are documents each; equal
    counts are all highest.  A text of any length is aligned whole, in a slice of its own.  No rows: no result.  Other
    columns, whatever their names, take no part.
    """
    keep = keep or ["doc_id"]
    text = K.free_name("_text", docs.columns)
    rows = docs.select(*K.columns(keep), F.col("text").cast("string").alias(text))
    slices = stage_table(_slices(rows, text, keep, byte_path, piece_path), "aligned")
    asked = slices.select("slice_id", F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(pair_counts(slices), "pair").groupBy("slice_id").agg(F.collect_list(F.struct("place", "n", "best")).alias("told"))
    joined = slices.select("slice_id", "docs", "local", "times").join(told, "slice_id", "left").drop("slice_id")
    names = [K.free_name(n, keep) for n in (*DIGEST, "n_best", "count_sum")]
    stored = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*K.columns(keep)).schema]
    fields = [*stored, *(f"`{n}` {t}" for n, t in zip(names, [*DIGEST.values(), "long", "long"], strict=True))]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                held = batch.column("docs").slice(i, 1).flatten()
                columns = held.flatten()
                answer = batch.column("told").slice(i, 1).flatten()
                place, n, best = (np.asarray(c) for c in (answer.field(0), answer.field(1), answer.field(2).cast(pa.int64()))) if len(answer) else (np.zeros(0, np.int64),) * 3
                n_of, best_of = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                n_of[place], best_of[place] = n, best
                local = np.frombuffer(expand.decompress(batch.column("local")[i].as_py()), np.int32)
                times = np.frombuffer(expand.decompress(batch.column("times")[i].as_py()), np.int64)
                cut = np.concatenate([[0], np.cumsum(np.asarray(columns[-1]))]).astype(np.int64)
                sums = [np.diff(np.concatenate([[0], np.cumsum(times * x[local])])[cut]) for x in (best_of, n_of)]
                yield pa.RecordBatch.from_arrays([*columns[:-1], *map(pa.array, sums)], names=[*keep, *names])

    return K.map_batches(joined, add_up, ", ".join(fields))
