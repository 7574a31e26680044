"""Vectorised text kernels that run inside Spark tasks.

Spark hands a task Arrow batches.  The kernels look at the UTF-8 bytes of a batch's text column as one numpy array, so
splitting, hashing and counting need no Python object per word.  A batch is worked on in slices of a megabyte; a
longer text is a slice of its own, so memory follows the longest text and never the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
U64 = np.uint64
FULL = (1 << 64) - 1

# Word alphabets as tables over byte values.
_ALL = np.arange(256)
SPACED = ~np.isin(_ALL, [0x20, *range(0x09, 0x0E)])  # [^\x20\x09-\x0D]
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
LOWER = _ALL.astype(np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(size, base, U64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the longs that Spark stores."""
    return np.ascontiguousarray(x, U64).view(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and the n + 1 offsets of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    n = len(column)
    if n == 0 or raw[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold at most ``limit`` bytes of text, or one text."""
    _, offsets = text_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Words of several texts: byte starts and ends, and for text ``d`` words ``first[d]`` up to ``first[d + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a polynomial over random byte codes, then mixed."""
        if not len(self.start):
            return np.zeros(0, U64)
        return ByteHashes(self.data).of(self.start, self.end - self.start)

    def ngram_hashes(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each word that has ``k - 1`` more behind it in its text: its index, and the hash of those ``k`` words."""
        hashes = self.hashes() if hashes is None else hashes
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        room = np.repeat(self.first[1:], self.counts)[:n] - np.arange(n) >= k
        return np.flatnonzero(room), rolling(hashes, k)[room]

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


class ByteHashes:
    """64-bit hashes of any byte ranges of an array, from one pass over it."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.multiply(_BYTE[data], up[:-1], out=self.sums[1:])
        np.add.accumulate(self.sums, out=self.sums)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start] + np.asarray(length).astype(U64))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k`` consecutive values, over text ends too."""
    n = len(hashes) - k + 1
    value = np.zeros(max(n, 0), U64)
    for j in range(k if n > 0 else 0):
        value *= _BASE
        value += hashes[j : j + n]
    return mix(value)


def find_words(data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray) -> Words:
    """Maximal runs of bytes of ``alphabet`` within each text."""
    n = len(data)
    inside = alphabet[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before &= ~edge[:-1]
        after &= ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def batch_words(batch: pa.RecordBatch, alphabet: np.ndarray, lower: bool, column: str = "text") -> Words:
    data, offsets = text_bytes(batch.column(column))
    return find_words(LOWER[data] if lower else data, offsets, alphabet)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; and from now on the session's Arrow batches have at most BATCH_ROWS rows and BATCH_BYTES bytes.

    Rows here are whole texts, and Spark's ten thousand of them, or 64 MB, at once would be held by JVM and worker on both
    ways.  The two settings are the session's and stay as they are if its owner has set other than Spark's own values.
    """
    conf = df.sparkSession.conf
    for name, spark_has, wanted in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", f"{64 << 20}b", BATCH_BYTES)):
        if conf.get(f"spark.sql.execution.arrow.{name}") == spark_has:
            conf.set(f"spark.sql.execution.arrow.{name}", str(wanted))
    return df


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType, *, text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Run ``work`` on every slice of every batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text, limit):
                out = work(part)
                if out is not None:
                    yield out

    return map_batches(small_batches(df), run, schema)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow``, which by itself cannot take columns whose names have a dot."""
    names = df.columns
    if not any("." in n or "`" in n for n in names):
        return df.mapInArrow(run, schema)
    return df.toDF(*(f"_{i}" for i in range(len(names)))).mapInArrow(lambda batches: run(b.rename_columns(names) for b in batches), schema)


def columns(names: list[str]) -> list[F.Column]:
    """Columns by their whole names, dots included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def with_columns(part: pa.RecordBatch, **columns: pa.Array | np.ndarray) -> pa.RecordBatch:
    """``part`` and more columns, without its text."""
    names = [n for n in part.schema.names if n != "text"] + [*columns]
    arrays = [part.column(n) for n in part.schema.names if n != "text"] + [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def documents_of(docs: DataFrame) -> DataFrame:
    """doc_id and text of a table of documents, whatever else it has."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def remainder(column: str = "doc_id") -> F.Column:
    """crc32(doc_id as text) mod 5, which splits training rows from held-out ones; a null id counts as the text null."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % 5).cast("int")


def free_name(wanted: str, taken: list[str]) -> str:
    """A column name like ``wanted`` that clashes with none of ``taken``, whatever their case."""
    used = {t.lower() for t in taken}
    while wanted.lower() in used:
        wanted = "_" + wanted
    return wanted
