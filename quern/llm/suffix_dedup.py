"""Removal of repeated byte strings by a distributed suffix array with bucket-pointer refinement.

Suffixes are put into buckets by a q-gram, and a bucket is refined by sorting its suffixes on the bucket identifiers
(pointers) of their later offsets; refined pointers are used at once by what is refined after them, so the depth to
which suffixes are told apart at least doubles each time.  Here it ends at ``LENGTH`` bytes: suffixes that are still in
one bucket then begin with the same string of that length.

The initial buckets are spread over Spark.  Of all ``LENGTH``-byte windows with the same smallest ``GRAM``-gram hash at
the same place, a run of neighbours is one entry, so there are few entries and equal windows are in entries of one
bucket.  Buckets of one entry are singletons and need no refinement.  Entries that are equal throughout are combined
before they meet: within a slice of text, where they are settled at once, and then by a sum over the corpus; a bucket
needs the text of one of them.  A block is a number of whole buckets with the text of their entries.

A bucket that very many different entries share, as at the edge of a passage that a third of all rows hold, is refined
before it becomes a block: its windows are dealt into cells by where their gram stands, and keyed by the bytes that all
windows of a cell have in common.  A cell that is still too large falls apart into single windows, whose strings are
their buckets.  Nothing is left out at any level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage_table
from . import kernels as K

LENGTH = 400
GRAM = 64
CHUNK = 1 << 22  # bytes whose windows are looked at together
INDEX_BITS = 23
CELL = 32
BUCKET_LIMIT = 2048  # different entries of a bucket that one block takes
BLOCK_BYTES = 1 << 20
FIRST = 8  # bytes of the first buckets of a block
LAST_ID = (1 << 63) - 1
ENTRY = "bucket long, class long, n int, doc_id long, tie long, start int, size int, at int"
SPAN = "doc_id long, tie long, start int, end int"


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row, from minima up to and from on block borders."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one gram: text, start, number, place of the gram, bucket and hash of the whole.

    Starts and places count from the text's start.  Long texts are looked at in chunks, which may cut runs.
    """
    found = []
    width = LENGTH - GRAM + 1
    for lo in range(0, max(len(data), 1), CHUNK):
        part = data[lo : lo + CHUNK + LENGTH - 1]
        if len(part) < LENGTH:
            break
        hashes = K.ByteHashes(part)
        grams = hashes.of(np.arange(len(part) - GRAM + 1), GRAM)
        order = (grams >> K.U64(INDEX_BITS)) << K.U64(INDEX_BITS) | np.arange(len(grams), dtype=np.uint64)
        best = (sliding_minimum(order, width) & K.U64((1 << INDEX_BITS) - 1)).astype(np.int64)
        starts = np.arange(len(best))
        text = np.searchsorted(offsets, starts + lo, side="right") - 1
        inside = starts + lo + LENGTH <= offsets[text + 1]
        starts, best, text = starts[inside], best[inside], text[inside]
        if not len(starts):
            continue
        head = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (text[1:] != text[:-1])]))
        size = np.diff(np.append(head, len(starts)))
        first, gram, text = starts[head], best[head], text[head]
        whole = K.mix(hashes.of(first, size + LENGTH - 1) ^ K.mix((gram - first).astype(np.uint64)))
        found.append((text, first + lo - offsets[text], size, gram - first, grams[gram], whole))
    if not found:
        return (*(np.zeros(0, np.int64),) * 4, *(np.zeros(0, np.uint64),) * 2)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def merged(start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each group that touch or overlap, as one: group, start, end."""
    if not len(start):
        return group, start, end
    order = np.lexsort((start, group))
    start, end, group = start[order].astype(np.int64), end[order].astype(np.int64), group[order].astype(np.int64)
    room = int(end.max()) + 2
    reach = np.maximum.accumulate(end + group * room)
    head = np.flatnonzero(np.concatenate([[True], start[1:] + group[1:] * room > reach[:-1]]))
    return group[head], start[head], reach[np.append(head[1:], len(start)) - 1] - group[head] * room


def entries(part: pa.RecordBatch) -> pa.RecordBatch:
    """A slice's entries, equal ones as one with their number; and, without a bucket, the spans settled within the slice."""
    data, offsets = K.text_bytes(part.column("text"))
    text, start, size, at, bucket, whole = runs_of_windows(data, offsets)
    order = np.lexsort((bucket, whole))
    new = np.concatenate([[True], (whole[order][1:] != whole[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])])[: len(order)]
    head = np.flatnonzero(new)
    times = np.diff(np.append(head, len(order)))
    many = np.repeat(times > 1, times)
    gone_text, gone_start, gone_end = merged(start[order[many]], (start + size + LENGTH - 1)[order[many]], text[order[many]])
    one = np.sort(order[head])
    count = np.empty(len(order), np.int64)
    count[order[head]] = times
    ids, ties = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "tie"))
    zeros = np.zeros(len(gone_text), np.int64)
    join = lambda a, b, kind: pa.array(np.concatenate([a, b]).astype(kind))
    empty = np.concatenate([np.zeros(len(one), bool), np.ones(len(zeros), bool)])
    owner = np.concatenate([text[one], gone_text]).astype(np.int64)
    columns = [pa.array(np.concatenate([K.signed(bucket[one]), zeros]), mask=empty), join(K.signed(whole[one]), zeros, np.int64), join(count[one], zeros, np.int32), pa.array(ids[owner]), pa.array(ties[owner]), join(start[one], gone_start, np.int32), join(size[one], gone_end, np.int32), join(at[one], zeros, np.int32)]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in ENTRY.split(", ")])


def refine(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket pointers of all places of a block at depth ``length``: equal where the same ``length`` bytes follow.

    ``ends`` is for each place the end of the text it is in; where fewer bytes are left, the bucket is the place's own.
    """
    n = len(data)
    pointer = np.arange(n, dtype=np.int64) + n  # own buckets, apart from those of the sorted places
    depth = min(FIRST, length)
    live = np.flatnonzero(np.arange(n) + depth <= ends)
    key = np.zeros(len(live), np.uint64)
    for k in range(depth):
        key = key << K.U64(8) | data[live + k]
    base = np.zeros(len(live), np.int64)  # the pointer of the bucket that is refined
    while True:
        order = np.lexsort((key, base)) if base.any() else np.argsort(key)
        live, key, base = live[order], key[order], base[order]
        changed = (key[1:] != key[:-1]) | (base[1:] != base[:-1])
        head = np.flatnonzero(np.concatenate([[True], changed])[: len(live)])
        sizes = np.diff(np.append(head, len(live)))
        parent = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1]])[: len(live)])
        within = np.arange(len(live)) - np.repeat(parent, np.diff(np.append(parent, len(live))))
        pointer[live] = base + np.repeat(within[head], sizes)
        on = np.repeat(sizes > 1, sizes)
        if depth == length:
            return pointer
        step = min(depth, length - depth)
        live = live[on]
        depth += step
        fits = live + depth <= ends[live]
        base, key = pointer[live[fits]], pointer[live[fits] + step].astype(np.uint64)  # before own buckets are given out
        pointer[live[~fits]] = live[~fits] + n
        live = live[fits]
        if not len(live):
            return pointer


def repeated_windows(contexts: list[bytes], size: np.ndarray, n: np.ndarray, owner: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """For each context, which of its first ``size`` windows stand anywhere else.

    A context has been met n times and is shown where its first meeting starts in the document ``owner``; two contexts
    that show the same place of a document are one occurrence there.
    """
    lengths = np.array([len(c) for c in contexts])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    pointer = refine(np.frombuffer(b"".join(contexts), np.uint8), np.repeat(offsets[1:], lengths))
    which = np.repeat(np.arange(len(contexts)), size)
    step = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    bucket = pointer[offsets[which] + step]
    place = owner[which] << 32 | (start[which] + step)
    order = np.lexsort((place, bucket))
    head = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
    sizes = np.diff(np.append(head, len(order)))
    twice = (place[order[head]] != place[order[head + sizes - 1]]) | (np.maximum.reduceat(n[which][order], head) > 1)
    out = np.zeros(len(which), bool)
    out[order] = np.repeat(twice, sizes)
    return np.split(out, np.cumsum(size)[:-1])


def _refine_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the entries met once whose windows are repeated; rows come sorted by bucket, and blocks are whole buckets."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        _, n, ids, ties, start, size, contexts = zip(*rows, strict=True)
        owners: dict[tuple[int, int], int] = {}
        owner = np.array([owners.setdefault(k, len(owners)) for k in zip(ids, ties, strict=True)], np.int64)
        flags = repeated_windows(list(contexts), np.array(size), np.array(n), owner, np.array(start, np.int64))
        spans = []
        for i, f in enumerate(flags):
            if n[i] == 1 and f.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], f, [0]])))
                spans += [(ids[i], ties[i], start[i] + a, start[i] + b + LENGTH - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        columns = list(zip(*spans, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "tie", "start", "end"])

    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "doc_id", "tie", "start", "size", "context")), strict=True):
            if held >= BLOCK_BYTES and row[0] != rows[-1][0]:
                yield settle(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[-1])
    if rows:
        yield settle(rows)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of asked entries; those of buckets above the limit as cells, keyed by what the windows of a cell share."""
    names = ["bucket", "class", "n", "doc_id", "tie", "start", "size", "context", "cell"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
    for batch in batches:
        for part in K.text_slices(batch, "blob", K.SLICE_BYTES // 4):
            out: list[tuple] = []
            for doc_id, tie, blob, asked in zip(*(part.column(c).to_pylist() for c in ("doc_id", "tie", "blob", "asked")), strict=True):
                raw = zstandard.ZstdDecompressor().decompress(blob)
                data = np.frombuffer(raw, np.uint8)
                for x in asked:
                    start, size, at = x["start"], x["size"], x["at"]
                    if not x["hot"]:
                        out.append((x["bucket"], 0, x["n"], doc_id, tie, start, size, raw[start : start + size + LENGTH - 1], False))
                        continue
                    gram = start + at
                    base = max(0, start)
                    hashes = K.ByteHashes(data[base : start + size + LENGTH - 1])
                    first = np.arange(start, start + size)
                    cell = (gram - first) // CELL
                    head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                    number = np.diff(np.append(head, size))
                    core = hashes.of(gram - CELL * cell[head] - base, LENGTH - CELL + 1)
                    shared = K.mix(core ^ K.mix(cell[head].astype(np.uint64) + K.U64(x["bucket"] & K.FULL)))
                    own = K.mix(hashes.of(first[head] - base, number + LENGTH - 1) ^ K.mix((gram - first[head]).astype(np.uint64)))
                    for b, c, s, k in zip(K.signed(shared).tolist(), K.signed(own).tolist(), first[head].tolist(), number.tolist(), strict=True):
                        out.append((b, c, x["n"], doc_id, tie, s, k, raw[s : s + k + LENGTH - 1], True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(names), kinds, strict=True)], names=names)


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of a cell as an entry, with two hashes of its string for bucket and class."""
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in ("n", "doc_id", "tie", "start", "size", "context")}
        for n, doc_id, tie, start, size, context in zip(*columns.values(), strict=True):
            data = np.frombuffer(context, np.uint8)
            hashes, k = K.ByteHashes(data).of(np.arange(size), LENGTH), np.full(size, 1)
            halves = K.ByteHashes(data)
            second = K.mix(halves.of(np.arange(size), LENGTH // 2) + K.mix(halves.of(np.arange(size) + LENGTH // 2, LENGTH - LENGTH // 2)))
            made = [K.signed(hashes), K.signed(second), k * n, k * doc_id, k * tie, np.arange(start, start + size), k, k * 0]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(made, ("i8", "i8", "i4", "i8", "i8", "i4", "i4", "i4"), strict=True)], names=[f.split()[0] for f in ENTRY.split(", ")])


def _classes(found: DataFrame, *more: str) -> DataFrame:
    """Entries that are equal throughout as one, with their number and the first of their places."""
    agg = found.groupBy("bucket", "class").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "tie", "start", "size", *more)).alias("x"))
    return agg.select("bucket", "class", F.least("n", F.lit(2)).cast("int").alias("n"), "x.*")


def _met_again(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Spans of the entries that were met once in their slice and again elsewhere."""
    again = classes.where("n > 1").select("bucket", "class")
    return found.where("n = 1").join(again, ["bucket", "class"], "left_semi").select("doc_id", "tie", "start", (F.col("start") + F.col("size") + LENGTH - 1).alias("end"))


def _with_width(classes: DataFrame) -> DataFrame:
    """The classes of buckets with several of them, and how many these are."""
    width = classes.groupBy("bucket").agg(F.count("*").alias("width")).where("width > 1")
    return classes.join(width, "bucket")


def _blocks(contexts: DataFrame) -> DataFrame:
    columns = ("bucket", "n", "doc_id", "tie", "start", "size", "context")
    return contexts.select(*columns).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_refine_blocks, SPAN)


def repeated_spans(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Spans of bytes of the texts of ``rows`` (doc_id, tie, text) that a repeated string covers; they may overlap.

    ``blobs`` has the same texts compressed, by doc_id and tie.
    """
    found = stage_table(K.map_texts(rows, entries, ENTRY), "entries")
    settled = found.where("bucket is null").select("doc_id", "tie", "start", F.col("size").alias("end"))
    alone = found.where("bucket is not null")
    shared = alone.groupBy("bucket").agg(F.sum("n").alias("total")).where("total > 1").select("bucket")
    live = stage_table(alone.join(shared, "bucket", "left_semi"), "shared_entries")
    classes = stage_table(_classes(live, "at"), "entry_classes")
    asked = _with_width(classes).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("bucket", "n", "start", "size", "at", (F.col("width") > BUCKET_LIMIT).alias("hot"))).alias("asked"))
    columns = "bucket long, class long, n int, doc_id long, tie long, start int, size int, context binary, cell boolean"
    texts = stage_table(asked.join(blobs, ["doc_id", "tie"]).select("doc_id", "tie", "blob", "asked").mapInArrow(_contexts, columns), "contexts")
    spans = settled.unionByName(_met_again(live, classes)).unionByName(_blocks(texts.where(~F.col("cell"))))
    cells = texts.where("cell").drop("cell")
    if cells.limit(1).count():
        cell_classes = stage_table(_classes(cells, "context"), "cell_classes")
        wide = stage_table(_with_width(cell_classes), "wide_cells")
        spans = spans.unionByName(_met_again(cells, cell_classes)).unionByName(_blocks(wide.where(F.col("width") <= BUCKET_LIMIT)))
        windows = stage_table(wide.where(F.col("width") > BUCKET_LIMIT).mapInArrow(_single_windows, ENTRY), "single_windows")
        spans = spans.unionByName(_met_again(windows, _classes(windows)))
    return spans


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, with_bytes: bool = False) -> DataFrame:
    """``keep`` (default doc_id) of every row, and n_bytes, n_removed, n_spans, kept_sha256 and spans (and kept: the bytes).

    A byte of the text's UTF-8 goes if a string of ``LENGTH`` bytes over it also starts anywhere else: at another place
    of the same text, the two may overlap, or in another row, in one equal to this row too.  Matches don't reach over
    texts, and are those of the input.  spans are the longest runs of removed bytes.  Null and empty texts have no bytes
    and lose none.  Rows that share a doc_id or have none are texts each.  A text of any length is worked on whole.  No
    rows: no result.  Other columns, whatever their names, take no part.

    Strings are compared byte by byte within blocks; entries that are equal throughout are told by 128 hash bits.
    """
    keep = keep or ["doc_id"]
    key, tie, blob, spans = (K.free_name(n, docs.columns) for n in ("_key", "_tie", "_blob", "_spans"))
    text = F.col("text").cast("string")
    rows = docs.select(*K.columns(keep), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias(key), F.xxhash64(text).alias(tie), text.alias(blob))
    stored = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*K.columns(keep)).schema]

    def shrink(part: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3)
        made = [None if t is None else press.compress(t.encode()) for t in part.column(blob).to_pylist()]
        kept = [c for c in part.schema.names if c != blob]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(made, pa.binary())], names=[*kept, blob])

    bare = rows.select(F.col(key).alias("doc_id"), F.col(tie).alias("tie"), F.col(blob).alias("text"))
    texts = K.map_texts(bare.where("text is not null").withColumnRenamed("text", blob), shrink, f"doc_id long, tie long, `{blob}` binary", text=blob)
    found = repeated_spans(bare, texts.withColumnRenamed(blob, "blob"))
    per_doc = found.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "end")).alias(spans)).select(F.col("doc_id").alias(key), F.col("tie").alias(tie), spans)
    small = K.map_texts(rows, shrink, ", ".join([*stored, f"`{key}` long", f"`{tie}` long", f"`{blob}` binary"]), text=blob)
    names = [K.free_name(n, keep) for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")]
    kinds = ["long", "long", "long", "string", "array<struct<start:int,length:int>>", "binary"]
    used = 6 if with_bytes else 5
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.text_slices(batch, blob, K.SLICE_BYTES // 4):
                out: list[list] = [[] for _ in names]
                for packed, asked in zip(part.column(blob).to_pylist(), part.column(spans), strict=True):
                    raw = b"" if packed is None else zstandard.ZstdDecompressor().decompress(packed)
                    gone: list[tuple[int, int]] = []
                    if asked.is_valid:
                        pairs = asked.values
                        a, b = (pairs.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                        _, a, b = merged(a, b, np.zeros(len(a), np.int64))
                        gone = list(zip(a.tolist(), b.tolist(), strict=True))
                    edges = [0, *(e for span in gone for e in span), len(raw)]
                    left = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                    for column, value in zip(out, (len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), [{"start": a, "length": b - a} for a, b in gone], left if with_bytes else None), strict=True):
                        column.append(value)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span_type, pa.binary()]
                made = [pa.array(c, t) for c, t in zip(out, types, strict=True)][:used]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=[*keep, *names[:used]])

    fields = [*stored, *(f"`{n}` {t}" for n, t in zip(names[:used], kinds[:used], strict=True))]
    joined = small.join(per_doc, [key, tie], "left").select(*K.columns(keep), blob, spans)
    return K.map_batches(joined, cut, ", ".join(fields))
