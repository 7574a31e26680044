"""Exact cosine search for a set of queries.

Queries are dealt into groups of a bounded size and vectors into groups too; every pair of groups is a cell of a
shuffle.  A cell holds its queries and streams its vectors in blocks, so that a block's scores are one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dot
from ..storage import default_partitions

QUERY_BLOCK = 4096  # queries of a cell, about
BLOCK = 2048  # vectors scored at once
CLOSE = 2e-6  # scores that may be equal to six digits


def _unit(vector: Column) -> Column:
    """A vector in doubles, scaled to length 1; one without length stays as it is."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _best(scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the best ``top`` scores of each row, and of those that are close to the last of them."""
    if scores.shape[1] <= top:
        return np.divmod(np.arange(scores.size), scores.shape[1])
    last = np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]
    return np.nonzero(scores >= last[:, None] - CLOSE)


def search(vectors: DataFrame, queries: DataFrame, top: int = 20, exclude_self: bool = False) -> DataFrame:
    """query_id, vec_id, score (6 digits) and rank of the ``top`` vectors nearest to each query, equal scores by id.

    ``vectors`` has vec_id and embedding, ``queries`` query_id and query_vector.  A null vector takes no part; one without
    length is as near as one at a right angle.
    """
    parts = default_partitions(vectors.sparkSession)
    groups = max(1, -(-queries.count() // QUERY_BLOCK))
    deals = max(1, -(-parts // groups))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    asked = queries.where("query_vector is not null").select(F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group"), every(deals).alias("deal"), F.lit(True).alias("query"), "query_id", none(vectors, "vec_id").alias("vec_id"), _unit(F.col("query_vector")).alias("v"))
    there = vectors.where("embedding is not null").select(every(groups).alias("group"), F.pmod(F.xxhash64("vec_id"), F.lit(deals)).cast("int").alias("deal"), F.lit(False).alias("query"), none(queries, "query_id").alias("query_id"), "vec_id", _unit(F.col("embedding")).alias("v"))
    cells = asked.unionByName(there).withColumn("cell", F.col("group") * deals + F.col("deal")).drop("group", "deal")
    dealt = cells.repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell", F.desc("query"))
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("query_id", queries), ("vec_id", vectors))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, wanted = -1, [], None
        for batch in batches:
            cell_of, is_asked = batch.column("cell").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((cell_of[1:] != cell_of[:-1]) | (is_asked[1:] != is_asked[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if cell_of[a] != cell:
                    cell, held, wanted = cell_of[a], [], None
                if is_asked[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                if not held:
                    continue
                if wanted is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    wanted = table.column("query_id").combine_chunks(), _matrix(table.column("v").combine_chunks())
                for at in range(a, b, BLOCK):
                    part = batch.slice(at, min(BLOCK, b - at))
                    block = _matrix(part.column("v"))
                    width = min(block.shape[1], wanted[1].shape[1])
                    for first in range(0, len(wanted[1]), 512):
                        scores = wanted[1][first : first + 512, :width] @ block[:, :width].T
                        row, column = _best(scores, top + exclude_self)
                        yield pa.RecordBatch.from_arrays([wanted[0].take(pa.array(first + row)), part.column("vec_id").take(pa.array(column)), pa.array(scores[row, column])], names=["query_id", "vec_id", "score"])

    pairs = dealt.mapInArrow(run, ", ".join([*kinds, "score double"])).withColumn("score", F.round("score", 6))
    if exclude_self:
        pairs = pairs.where("query_id <> vec_id")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= top)
