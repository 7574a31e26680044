"""Substring dedup by relative Lempel-Ziv parsing.

All text is the reference, and a document is parsed against what comes earlier: documents of smaller id, and its own
earlier words.  The index of the reference is spread over blocks, which are the partitions of a shuffle.  Its entries
are anchors: in every window of ``window`` words the ``ANCHOR_WORDS``-gram with the smallest hash, so equal windows have
equal anchors and meet in one block.  An entry holds the windows of its anchor, about eight of them, as 48-bit
fingerprints beside the 64 bits of the anchor.  Within its slice a task settles entries that are equal throughout, so a
passage that a third of all rows share reaches a block once per slice.  Anchors at which very many documents go on in
different ways, like the edges of such a passage, are found by a look at a few documents; there every window is an
entry of its own, under its own key.

A block answers with runs of windows of a document whose first occurrences stand in a row.  The text that holds first
occurrences is the reference, and the first occurrence of a window is its name: two windows are equal if their names
are.  A document is then parsed from left to right against the documents that its runs point to, whose own runs name
their windows: at a place, the source is followed as far as the names agree.  At the border where that ends, the source of
the run behind it is checked: if it holds the text from the place on too, it is followed instead, over the border, and so
on.  The longest match becomes a factor, and the parse goes on behind it.  The windows that begin there have been looked
up like all others, so borders hide nothing.  (Copies within a slice are named by the first of the slice, which may have
an earlier name of its own; a factor may then end before it has to, and the next one begins there.)  Factors are at least ``window`` words long, and what they cover is duplicate.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import default_partitions, stage_table
from . import kernels as K

WINDOW_WORDS = 20
ANCHOR_WORDS = 6
PRINT_BYTES = 6
HOT_SAMPLE, HOT_SHARE, HOT_LEAST, HOT_MOST = 32, 1 / 500, 24, 1 << 16
LAST_ID = (1 << 63) - 1  # rows without an id come last
PLAIN_HEAD = np.dtype([("doc_id", "<i8"), ("start", "<i4"), ("n", "<i2")])  # n windows, below 0 in a settled entry
TIED_HEAD = np.dtype([*PLAIN_HEAD.descr, ("tie", "<i8")])  # where ids repeat
SOURCE = np.dtype([("doc_id", "<i8"), ("start", "<i4")])
FACTOR_SCHEMA = "doc_id long, tie long, start int, n int, source_id long, source_start int"


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its first smallest."""
    n = len(values) - width + 1
    best = np.arange(n)
    low = values[:n].copy()
    for j in range(1, width):
        following = values[j : j + n]
        less = following < low
        low[less] = following[less]
        best[less] = np.flatnonzero(less) + j
    return best


def _ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each size, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _held(values: np.ndarray | None, among: np.ndarray) -> np.ndarray:
    if values is None or not len(values):
        return np.zeros(len(among), bool)
    return values[np.minimum(np.searchsorted(values, among), len(values) - 1)] == among


def hot_anchors(docs: DataFrame, window: int = WINDOW_WORDS) -> np.ndarray:
    """Anchors of at least HOT_SHARE of the documents, sorted, by a look at every HOT_SAMPLE-th document.

    A passage of a third of all rows gives such anchors at its edges, where every row goes on in its own way; as one
    group their entries would meet in one task.  Which anchors are named changes only how work is dealt out.
    """
    seen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("hot")), F.lit(HOT_SAMPLE)) == 0).select("text")

    def anchors(part: pa.RecordBatch) -> pa.RecordBatch:
        words = K.batch_words(part, K.SPACED, lower=False)
        hashes, k = words.hashes(), min(ANCHOR_WORDS, window)
        at, _ = words.ngram_hashes(window, hashes)
        found = np.zeros((0, 2), np.uint64)
        if len(at):
            grams = K.rolling(hashes, k)
            pairs = np.column_stack([words.text_of[at].astype(np.uint64), grams[_sliding_argmin(grams, window - k + 1)[at]]])
            found = np.unique(pairs, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(K.signed(found[:, 1]))], names=["anchor"])

    least = max(HOT_LEAST, seen.count() * HOT_SHARE)
    counts = K.map_texts(seen, anchors, "anchor long").groupBy("anchor").count().where(F.col("count") >= least)
    return np.sort(counts.orderBy(F.desc("count")).limit(HOT_MOST).select("anchor").toArrow().column("anchor").to_numpy().view(np.uint64))


def index_entries(part: pa.RecordBatch, window: int = WINDOW_WORDS, head_type: np.dtype = TIED_HEAD, hot: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes]]:
    """Keys and payloads of the entries of a slice: open ones with the windows of an anchor, settled ones with a source.

    Windows of the anchors in ``hot`` (sorted) are entries of their own, with the window's hash for a key.
    """
    words = K.batch_words(part, K.SPACED, lower=False)
    k = min(ANCHOR_WORDS, window)
    hashes = words.hashes()
    at, prints = words.ngram_hashes(window, hashes)
    if not len(at):
        return np.zeros(0, np.int64), []
    grams = K.rolling(hashes, k)
    anchor = _sliding_argmin(grams, window - k + 1)[at]
    text_of = words.text_of[at]
    alone = _held(hot, grams[anchor])
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (text_of[1:] != text_of[:-1])]) | alone)
    sizes = np.diff(np.append(head, len(at)))
    keys, own = np.where(alone[head], K.mix(prints[head]), grams[anchor[head]]), text_of[head]
    start = (at[head] - words.first[own]).astype(np.int32)
    ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    ties = part.column("tie").to_numpy(zero_copy_only=False).astype(np.int64)
    content = K.mix(np.add.reduceat(K.mix(prints + (at - np.repeat(at[head], sizes)).astype(K.U64)), head) + K.mix(grams[anchor[head]]))
    order = np.lexsort((start, ties[own], ids[own], content))
    same = np.concatenate([[False], content[order][1:] == content[order][:-1]])
    leader = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    source = np.empty(len(head), np.int64)
    source[order] = leader
    here = lambda rows: (ids[own[rows]], ties[own[rows]], start[rows])
    moved = np.zeros(len(head), bool)
    for a, b in zip(here(np.arange(len(head))), here(source), strict=True):
        moved |= a != b
    repeat = (source != np.arange(len(head))) & ~moved  # the same place again, from a repeated row
    heads = np.zeros(len(head), head_type)
    heads["doc_id"], heads["start"], heads["n"] = ids[own], start, np.where(moved, -sizes, sizes)
    if "tie" in head_type.names:
        heads["tie"] = ties[own]
    tails = np.zeros(len(head), SOURCE)
    tails["doc_id"], tails["start"] = ids[own[source]], start[source]
    raw_heads, raw_tails = heads.tobytes(), tails.tobytes()
    raw_prints = np.ascontiguousarray(prints.view(np.uint8).reshape(-1, 8)[:, :PRINT_BYTES]).tobytes()
    h, t = head_type.itemsize, SOURCE.itemsize
    payloads, kept = [], np.flatnonzero(~repeat)
    for i, a, n, settled in zip(kept.tolist(), head[kept].tolist(), sizes[kept].tolist(), moved[kept].tolist(), strict=True):
        tail = raw_tails[i * t : (i + 1) * t] if settled else raw_prints[a * PRINT_BYTES : (a + n) * PRINT_BYTES]
        payloads.append(raw_heads[i * h : (i + 1) * h] + tail)
    # Settled entries need no block: they are dealt out by their document.
    spread = np.where(moved, K.mix(ids[own].view(K.U64) + start.astype(K.U64)), keys)
    return K.signed(spread[kept]), payloads


def _fields(raw: np.ndarray, at: np.ndarray, kind: np.dtype) -> np.ndarray:
    return raw[at[:, None] + np.arange(kind.itemsize)].view(kind).ravel()


def block_factors(keys: np.ndarray, raw: np.ndarray, offsets: np.ndarray, head_type: np.dtype = TIED_HEAD) -> list[np.ndarray]:
    """Columns of the factors of whole groups of equal keys."""
    heads = _fields(raw, offsets[:-1], head_type)
    ties = heads["tie"] if "tie" in head_type.names else np.zeros(len(heads), np.int64)
    settled = np.flatnonzero(heads["n"] < 0)
    out = [[heads["doc_id"][settled], ties[settled], heads["start"][settled], -heads["n"][settled]]]
    source = _fields(raw, offsets[settled] + head_type.itemsize, SOURCE)
    out[0] += [source["doc_id"], source["start"]]
    open_ = np.flatnonzero(heads["n"] > 0)
    key = keys[open_]
    same = key[1:] == key[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(open_) else np.zeros(0, bool)
    rows, key = open_[shared], key[shared]
    if len(rows):
        n = heads["n"][rows].astype(np.int64)
        row = np.repeat(np.arange(len(rows)), n)
        step = _ragged(np.zeros(len(rows), np.int64), n)
        place = offsets[rows][row] + head_type.itemsize + step * PRINT_BYTES
        prints = np.zeros((len(place), 8), np.uint8)
        prints[:, :PRINT_BYTES] = raw[place[:, None] + np.arange(PRINT_BYTES)]
        prints = prints.view(np.uint64).ravel()
        doc, tie, pos = heads["doc_id"][rows][row], ties[rows][row], heads["start"][rows][row].astype(np.int64) + step
        order = np.lexsort((pos, tie, doc, prints, key[row]))
        new = np.concatenate([[True], (prints[order][1:] != prints[order][:-1]) | (key[row][order][1:] != key[row][order][:-1])])
        first = np.empty(len(order), np.int64)
        first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        found = np.flatnonzero((doc != doc[first]) | (tie != tie[first]) | (pos != pos[first]))
        if len(found):
            to_doc, to_pos, of, at = doc[first[found]], pos[first[found]], row[found], pos[found]
            cut = np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1) | (to_doc[1:] != to_doc[:-1]) | (to_pos[1:] != to_pos[:-1] + 1)])
            begin = np.flatnonzero(cut)
            out.append([doc[found][begin], tie[found][begin], at[begin], np.diff(np.append(begin, len(found))), to_doc[begin], to_pos[begin]])
    return [np.concatenate([np.asarray(o[c]) for o in out]) for c in range(6)]


def find_factors(docs: DataFrame, window: int = WINDOW_WORDS, ties: bool = True) -> DataFrame:
    """Factors of ``docs`` (doc_id with no null, tie, text): n windows from word ``start`` on stand earlier, at a source.

    ``ties`` says whether any tie is other than 0.
    """
    head_type = TIED_HEAD if ties else PLAIN_HEAD
    shared = docs.sparkSession.sparkContext.broadcast(hot_anchors(docs, window))
    rows = docs.select("doc_id", "tie", "text")

    def entries(part: pa.RecordBatch) -> pa.RecordBatch:
        keys, payloads = index_entries(part, window, head_type, shared.value)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(payloads, pa.binary())], names=["key", "entry"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.zeros(0, np.int64), pa.array([], pa.binary())
        names = [c.split()[0] for c in FACTOR_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]

        def answer(keys: np.ndarray, entries_: pa.Array) -> pa.RecordBatch:
            columns = block_factors(keys, *K.text_bytes(entries_), head_type)
            return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            held_keys = np.concatenate([held_keys, batch.column("key").to_numpy()])
            held = pa.concat_arrays([held, batch.column("entry")])
            whole = int(np.searchsorted(held_keys, held_keys[-1])) if len(held_keys) else 0
            if whole:
                yield answer(held_keys[:whole], held.slice(0, whole))
                held_keys, held = held_keys[whole:], held.slice(whole)
        if len(held_keys):
            yield answer(held_keys, held)

    index = K.map_texts(rows, entries, "key long, entry binary")
    return index.repartition(default_partitions(docs.sparkSession), "key").sortWithinPartitions("key").mapInArrow(blocks, FACTOR_SCHEMA)


def covered(n_words: int, factors: list[tuple[int, int]], window: int) -> np.ndarray:
    """Which words of a document its factors (first word, windows) cover."""
    step = np.zeros(n_words + 1, np.int64)
    for start, n in factors:
        step[start] += 1
        step[min(n_words, start + n - 1 + window)] -= 1
    return np.cumsum(step)[:-1] > 0


Run = tuple[int, int, int, int]  # first window, number of windows, source document, first window there


def merged_runs(found: list[dict]) -> list[Run]:
    """Runs in order, joined where one goes on in the next."""
    out: list[Run] = []
    for f in sorted(found, key=lambda f: f["start"]):
        start, n, source, at = f["start"], f["n"], f["source_id"], f["source_start"]
        if out and start == out[-1][0] + out[-1][1] and source == out[-1][2] and at == out[-1][3] + out[-1][1]:
            out[-1] = (out[-1][0], out[-1][1] + n, source, out[-1][3])
        else:
            out.append((start, n, source, at))
    return out


def touching_sources(own: int, runs: list[Run]) -> list[int]:
    """Sources of runs that touch another one: those whose own runs a parse asks for."""
    out = set()
    for a, b in zip(runs, runs[1:], strict=False):
        if a[0] + a[1] == b[0]:
            out |= {a[2], b[2]}
    return sorted(out - {own})


class Names:
    """The names of a document's windows: where each first occurs."""

    def __init__(self, document: int, runs: list[Run]):
        self.document, self.runs, self.starts = document, runs, [r[0] for r in runs]

    def at(self, window: int) -> tuple[int, int, int, bool]:
        """Document and place of a window's first occurrence, how many windows from here on go on there, and whether it is earlier."""
        i = bisect.bisect_right(self.starts, window) - 1
        if i >= 0 and window < self.runs[i][0] + self.runs[i][1]:
            start, n, source, at = self.runs[i]
            return source, at + window - start, start + n - window, True
        room = self.starts[i + 1] - window if i + 1 < len(self.starts) else 1 << 62
        return self.document, window, room, False


def parse(document: int, runs: list[Run], sources: dict[int, list[Run]]) -> list[Run]:
    """Factors of a document: at each place the longest match over the borders of runs, then on from its end.

    ``sources`` has the runs of other documents; one that it lacks has none.
    """
    own = Names(document, runs)
    others = {i: Names(i, their) for i, their in sources.items()} | {document: own}

    def reach(source: int, ahead: int, window: int) -> int:
        """Up to which window the text goes on as in ``source``, ``ahead`` windows on from the place here."""
        their = others.get(source) or Names(source, [])
        while window + ahead >= 0:
            name, place, room, earlier = own.at(window)
            other, there, width, _ = their.at(window + ahead)
            if not earlier or (name, place) != (other, there):
                break
            window += min(room, width)
        return window

    out: list[Run] = []
    i, window = 0, -1
    while i < len(runs):
        window = max(window, runs[i][0])
        best = runs[i]
        end = max(best[0] + best[1], reach(best[2], best[3] - best[0], window))
        while True:  # the run at the border, if its source holds what lies before it
            while i < len(runs) and runs[i][0] + runs[i][1] <= end:
                i += 1
            if i == len(runs) or runs[i][0] > end:
                break
            to = reach(runs[i][2], runs[i][3] - runs[i][0], window)
            if to <= end:
                break
            best, end = runs[i], to
        out.append((window, end - window, best[2], best[3] - best[0] + window))
        window = end
    return out


RUNS = "array<struct<start:int,n:int,source_id:bigint,source_start:int>>"


def _with_sources(per_doc: DataFrame, repeated: bool) -> DataFrame:
    """doc_id, tie and runs of documents with runs (doc_id, tie, found), and the runs of the sources whose runs touch.

    Where ids are ``repeated``, a source's id doesn't tell which row it is, and no source is asked.
    """
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("source_id", pa.int64()), ("source_start", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            ids = batch.column("doc_id").to_pylist()
            runs = [merged_runs(f) for f in batch.column("found").to_pylist()]
            wanted = [[] if repeated else touching_sources(i, r) for i, r in zip(ids, runs, strict=True)]
            rows = [[dict(zip(("start", "n", "source_id", "source_start"), x, strict=True)) for x in r] for r in runs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(rows, run_type), pa.array(wanted, pa.list_(pa.int64()))], names=["doc_id", "tie", "runs", "wanted"])

    merged = stage_table(per_doc.mapInArrow(work, f"doc_id long, tie long, runs {RUNS}, wanted array<long>"), "runs")
    asked = merged.select("doc_id", F.explode("wanted").alias("source_id"))
    theirs = merged.select(F.col("doc_id").alias("source_id"), F.col("runs").alias("source_runs"))
    got = asked.join(theirs, "source_id").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("source_id").alias("doc_id"), F.col("source_runs").alias("runs"))).alias("sources"))
    return merged.drop("wanted").join(got, "doc_id", "left")


def remove_duplicates(docs: DataFrame, window: int = WINDOW_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default doc_id) of every row, and n_words, n_removed, kept_sha256, n_factors, kept_text and factors.

    A word goes if a window of ``window`` words over it also starts earlier: in a row of smaller doc_id, or before in
    the same text.  Windows are those of the input.  kept_text is the text without these words and the white space
    behind them, and null where the text is; kept_sha256 digests the kept words with one space between.  Null or empty
    text: no words, nothing removed.  A text of any length is parsed whole.  No rows: no result.  A row without doc_id counts as later than all with one.  Rows that share a doc_id are in the order of a
    hash of their texts; rows equal in both are one place in the order, so none is removed for the other's sake.
    """
    keep = keep or ["doc_id"]
    used = docs.columns
    key, tie, text, found = (K.free_name(n, used) for n in ("_key", "_tie", "_text", "_factors"))
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    order = F.xxhash64(F.col("text").cast("string")) if repeated else F.lit(0).cast("long")
    rows = docs.select(*K.columns(keep), ids.alias(key), order.alias(tie), F.col("text").cast("string").alias(text))
    factors = find_factors(rows.select(F.col(key).alias("doc_id"), F.col(tie).alias("tie"), F.col(text).alias("text")), window, repeated)
    per_doc = _with_sources(factors.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "n", "source_id", "source_start")).alias("found")), repeated)
    per_doc = per_doc.select(F.col("doc_id").alias(key), F.col("tie").alias(tie), F.struct("runs", "sources").alias(found))
    stored = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*K.columns(keep)).schema]
    columns = [*keep, key, tie]

    def shrink(part: pa.RecordBatch) -> pa.RecordBatch:
        """Texts are the larger part of what the join shuffles, and zstandard makes them a third smaller than Spark does."""
        press = zstandard.ZstdCompressor(level=3)
        blobs = [None if t is None else press.compress(t.encode()) for t in part.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays([*(part.column(n) for n in columns), pa.array(blobs, pa.binary())], names=[*columns, text])

    small = K.map_texts(rows, shrink, ", ".join([*stored, f"`{key}` long", f"`{tie}` long", f"`{text}` binary"]), text=text)
    joined = small.join(per_doc, [key, tie], "left").select(*K.columns(keep), key, text, found)
    names = [K.free_name(n, keep) for n in ("n_words", "n_removed", "kept_sha256", "kept_text", "factors")]
    kinds = ["long", "long", "string", "string", "array<struct<start:int,length:int,source_id:bigint,source_start:int>>"]
    fields = [*stored, *(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))]
    factor_type = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source_id", pa.int64()), ("source_start", pa.int32())]))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        expand = zstandard.ZstdDecompressor()
        blobs = part.column(text).to_pylist()
        whole = [b"" if b is None else expand.decompress(b) for b in blobs]
        data, offsets = np.frombuffer(b"".join(whole), np.uint8), np.cumsum([0, *map(len, whole)])
        words = K.find_words(data, offsets, K.SPACED)
        removed, digests, texts, parsed = [], [], [], []
        for d, own_id in enumerate(part.column(key).to_pylist()):
            own = part.column(found)[d].as_py()
            a, b = int(words.first[d]), int(words.first[d + 1])
            begin, end = words.start[a:b], words.end[a:b]
            raw = whole[d]
            if not own:
                removed.append(0)
                texts.append(None if blobs[d] is None else raw)
                parsed.append([])
                digests.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                continue
            as_runs = lambda rows: [tuple(x.values()) for x in rows]
            factors_ = parse(own_id, as_runs(own["runs"]), {x["doc_id"]: as_runs(x["runs"]) for x in own["sources"] or ()})
            gone = covered(b - a, [f[:2] for f in factors_], window)
            base = int(offsets[d])
            split = [raw[x - base : y - base] for x, y, g in zip(begin.tolist(), end.tolist(), gone.tolist(), strict=True) if not g]
            following = np.append(begin[1:], offsets[d + 1])
            edge = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edge, begin[gone] - base, 1)
            np.add.at(edge, following[gone] - base, -1)
            left = np.frombuffer(raw, np.uint8)[np.cumsum(edge)[:-1] == 0].tobytes()
            removed.append(int(gone.sum()))
            texts.append(left)
            digests.append(hashlib.sha256(b" ".join(split)).hexdigest())
            parsed.append([{"start": s, "length": n - 1 + window, "source_id": None if i == LAST_ID else i, "source_start": p} for s, n, i, p in factors_])
        out = [pa.array(words.counts), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(parsed, factor_type)]
        return pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), *out], names=[*keep, *names])

    return K.map_texts(joined, work, ", ".join(fields), text=text, limit=K.SLICE_BYTES // 2)


