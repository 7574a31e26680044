"""Token-id output in directly addressable codes.

An id is cut into chunks of eight bits, lowest first.  Level 0 holds the first chunk of every id, level 1 the second
chunk of those ids that have one, and so on.  Beside each level lies a bitmap that says whether an id goes on, and a
directory with the number of set bits before every 512th bit.  Reading id ``i`` follows one rank query per level, so
any token is read without decoding what lies before it.

A file is a Parquet file of segments.  A segment holds the codes of a bounded run of whole documents and their ids and
lengths.  Spark's own writer makes and commits the files, so a task that is lost or run twice leaves no half file, and
any store that Spark can write to will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import default_partitions, shared_root
from . import kernels as K
from .tokens import encode_batch

BLOCK_BITS = 512
SEGMENT_TOKENS = 1 << 18
SEGMENT_SCHEMA = "part int, segment int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<int>, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """The codes of non-negative ids below 2**32."""
    rest = np.ascontiguousarray(ids, np.uint32)
    levels: list[bytes] = []
    while True:
        on = rest >= 256
        bits = np.packbits(on, bitorder="little")
        blocks = np.add.reduceat(on, np.arange(0, len(on), BLOCK_BITS), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u4") if len(on) else np.zeros(0, "<u4")
        levels.append(struct.pack("<I", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not on.any():
            return struct.pack("<4sI", b"DAC1", len(levels)) + b"".join(levels)
        rest = rest[on] >> np.uint32(8)


class Codes:
    """Packed ids: ``codes[i]`` reads one, ``all()`` reads them all.  The bytes are used where they lie."""

    def __init__(self, raw: bytes):
        magic, n_levels = struct.unpack_from("<4sI", raw)
        if magic != b"DAC1":
            raise ValueError("not a run of directly addressable codes")
        self.levels, at = [], 8
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<I", raw, at)
            n_bits, n_blocks = (n + 7) // 8, (n + BLOCK_BITS - 1) // BLOCK_BITS
            chunk = np.frombuffer(raw, np.uint8, n, at + 4)
            bits = np.frombuffer(raw, np.uint8, n_bits, at + 4 + n)
            ranks = np.frombuffer(raw, "<u4", n_blocks, at + 4 + n + n_bits)
            self.levels.append((chunk, bits, ranks))
            at += 4 + n + n_bits + 4 * n_blocks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for depth, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * depth)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK_BITS
            within = int.from_bytes(bits[block * BLOCK_BITS // 8 : i // 8 + 1].tobytes(), "little") & ((1 << (i - block * BLOCK_BITS)) - 1)
            i = int(ranks[block]) + within.bit_count()
        return value

    def all(self) -> np.ndarray:
        value = np.zeros(0, np.uint32)
        for chunk, bits, _ in reversed(self.levels):
            here = chunk.astype(np.uint32)
            if len(value):
                here[np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)] |= value << np.uint32(8)
            value = here
        return value


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, partitions: int | None = None) -> None:
    """Encode every text of ``docs`` (doc_id, text) and write its ids, in ascending order of doc_id, under ``path``.

    A null text is empty, so it is its end id alone.  A null doc_id comes first.  Rows that share a doc_id stay rows of
    their own, in the order of a hash of their texts.  An empty table leaves a folder without segments.
    """
    rows = K.documents_of(docs)
    n = partitions or default_partitions(docs.sparkSession)
    # Range borders come from keys that Spark samples to the driver, so no key is a text.
    keyed = rows.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal segment, first
            ids = np.concatenate([h[1] for h in held])
            lengths = np.concatenate([h[2] for h in held]).astype(np.int32)
            doc_ids = pa.concat_arrays([h[0] for h in held])
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            out = [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), one(doc_ids), one(pa.array(lengths)), pa.array([pack(ids)], pa.binary())]
            segment, first = segment + 1, first + len(ids)
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=["part", "segment", "first_token", "n_tokens", "doc_ids", "doc_tokens", "payload"])

        size = 0
        for batch in batches:
            for piece in K.text_slices(batch):
                ids, offsets = encode_batch(tokenizer, piece, end_id)
                held.append((piece.column("doc_id"), ids, np.diff(offsets)))
                size += len(ids)
                if size >= SEGMENT_TOKENS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    ordered.mapInArrow(segments, SEGMENT_SCHEMA).write.option("compression", "zstd").parquet(path)


def segment_starts(spark: SparkSession, path: str) -> np.ndarray:
    """For each write partition the number of tokens before it: one sum per partition, whatever the corpus holds."""
    sums = {r["part"]: r["n"] for r in spark.read.schema(SEGMENT_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    per_part = np.zeros(max(sums, default=-1) + 2, np.int64)
    for part, n in sums.items():
        per_part[part + 1] = n
    return np.cumsum(per_part)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian bytes) of each document that was written."""
    before = segment_starts(spark, path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids = batch.column("doc_ids")[row].values
                lengths = batch.column("doc_tokens")[row].values.to_numpy(zero_copy_only=False).astype(np.int64)
                raw = Codes(batch.column("payload")[row].as_buffer()).all().astype("<u4")
                ends = np.cumsum(lengths)
                pieces = [raw[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                start = ends - lengths + batch.column("first_token")[row].as_py() + before[batch.column("part")[row].as_py()]
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start), pa.array(lengths), pa.array([zlib.crc32(p) for p in pieces], pa.int64()), pa.array(pieces, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return spark.read.schema(SEGMENT_SCHEMA).parquet(path).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The id at a place of the whole output: the one segment that holds it is read, and no block of it decoded."""
    before = segment_starts(spark, path)
    part = int(np.searchsorted(before, position, side="right")) - 1
    if position < 0 or part >= len(before) - 1:
        raise IndexError(position)
    local = position - int(before[part])
    row = spark.read.schema(SEGMENT_SCHEMA).parquet(path).where((F.col("part") == part) & (F.col("first_token") <= local) & (F.col("first_token") + F.col("n_tokens") > local)).select("payload", "first_token").first()
    return Codes(bytes(row["payload"]))[local - row["first_token"]]


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to files in the shared folder and describe each document as read back from them."""
    import uuid

    path = f"{shared_root(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path).drop("ids")
