"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

A component of a vector is a term: its postings are the vectors of a block with a weight other than zero there.  Queries
are dealt into groups of a bounded size and candidates into groups too, and every pair of groups is a cell, which is one
unit of a shuffle: the number of cells grows with the data, the plan and the driver's work do not.  A cell holds its
queries and streams its candidates in blocks: it walks their terms, and every query with a weight on the term scatters
weight times postings into a dense array of scores.  A cell selects its best k of each query; a window over these few
rows merges the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import default_partitions

QUERY_CHUNK = 16384  # queries of a cell, about
BLOCK = 4096  # candidates scored at once
QUERY_BLOCK = 256  # queries scored at once
LARGE = 1 << 25  # products of smaller weights fit a long in vectors of up to 4,096 components
LONG = (1 << 63) - 1


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and weights floor(scale * component); rows without an id or with a component that is no finite number are left out.

    A weight beyond a long is the nearest long.
    """
    doubles = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("_v")).where(F.col("vec_id").isNotNull() & _usable(F.col("_v")))
    return rows.select("vec_id", F.transform("_v", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("weights"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; a missing component of a shorter vector weighs nothing."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of every query with every candidate, a term at a time; a score beyond a long is the nearest long."""
    width = min(queries.shape[1], candidates.shape[1])
    queries, candidates = queries[:, :width], candidates[:, :width]
    most = [np.abs(x.astype(float)).max(axis=1, initial=0.0) for x in (queries, candidates)]
    large = [m >= LARGE / max(1.0, (width / 4096) ** 0.5) for m in most]
    if not (large[0].any() or large[1].any()):
        bound = most[0].max(initial=0.0) * most[1].max(initial=0.0) * max(width, 1)
        return _scatter(queries, candidates, np.int32 if bound < 2**31 - 1 else np.int64)
    # The few rows with very large weights are scored in whole numbers of any size.
    out = np.zeros((len(queries), len(candidates)), np.int64)
    small = [~x for x in large]
    out[np.ix_(small[0], small[1])] = _scatter(queries[small[0]], candidates[small[1]], np.int64)
    for rows, columns in ((large[0], np.ones(len(candidates), bool)), (small[0], large[1])):
        if rows.any() and columns.any():
            exact = queries[rows].astype(object) @ candidates[columns].astype(object).T
            out[np.ix_(rows, columns)] = np.clip(exact, -LONG - 1, LONG).astype(np.int64)
    return out


def _scatter(queries: np.ndarray, candidates: np.ndarray, kind: type) -> np.ndarray:
    queries, candidates = queries.astype(kind), candidates.astype(kind)
    scores = np.zeros((len(queries), len(candidates)), kind)
    for term in range(queries.shape[1]):
        rows = np.flatnonzero(queries[:, term])
        postings = np.flatnonzero(candidates[:, term])
        if not len(rows) or not len(postings):
            continue
        weights = candidates[postings, term]
        if len(postings) * 2 < len(candidates):
            scores[np.ix_(rows, postings)] += queries[rows, term][:, None] * weights
        else:
            column, line = candidates[:, term], np.empty(len(candidates), kind)
            for row in rows.tolist():
                np.multiply(column, queries[row, term], out=line)
                scores[row] += line
    return scores.astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, id and score of the best ``k`` candidates of each query but itself; equal scores by smaller id."""
    rows, found, values = [], [], []
    for q in range(len(scores)):
        s = scores[q]
        allowed = np.flatnonzero(ids != own[q])
        if len(allowed) > k:
            kth = np.partition(s[allowed], len(allowed) - k)[len(allowed) - k]
            allowed = allowed[s[allowed] >= kth]
        top = allowed[np.lexsort((ids[allowed], -s[allowed]))[:k]]
        rows.append(np.full(len(top), q))
        found.append(ids[top])
        values.append(s[top])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(values)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, query_chunk: int = QUERY_CHUNK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best other vectors of each query row.

    ``is_query`` is a condition on vec_id.  Every row is a candidate, rows with equal vec_id each on their own, but none
    with the query's own id.  Query rows with equal id and vector are one query; with equal id and other vectors each
    is answered.  Equal scores by smaller vec_id.  Fewer than ``k`` others: all of them.  No query or no vector: no row.
    Rows with a null id or vector, or with a component that is null or not finite, take no part; a component that is
    missing at the end of a shorter vector weighs nothing.  Weights and scores beyond a long are the nearest long.
    Other columns are not looked at.
    """
    parts = default_partitions(vectors.sparkSession)
    rows = quantised(vectors, scale)
    queries = rows.where(is_query).dropDuplicates()
    groups = max(1, -(-queries.count() // query_chunk))
    deals = max(1, -(-parts // groups))  # candidate groups, so that there are cells for all partitions
    own = F.xxhash64("vec_id", "weights")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.pmod(own, F.lit(groups)).cast("int").alias("group"), every(deals).alias("deal"), F.lit(True).alias("query"), "vec_id", F.xxhash64("weights").alias("version"), "weights")
    there = rows.select(every(groups).alias("group"), F.pmod(own, F.lit(deals)).cast("int").alias("deal"), F.lit(False).alias("query"), "vec_id", F.lit(0).cast("long").alias("version"), "weights")
    cells = asked.unionByName(there).withColumn("cell", F.col("group") * deals + F.col("deal")).drop("group", "deal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, wanted = -1, [], None
        best: list[tuple[np.ndarray, ...]] = []

        def answer() -> Iterator[pa.RecordBatch]:
            if best:
                q, i, s = _reduce(best, k)
                yield pa.RecordBatch.from_arrays([pa.array(wanted[0][q]), pa.array(wanted[1][q]), pa.array(i), pa.array(s)], names=["query_id", "version", "vec_id", "score"])
                best.clear()

        for batch in batches:
            cell_of = batch.column("cell").to_numpy()
            is_asked = batch.column("query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((cell_of[1:] != cell_of[:-1]) | (is_asked[1:] != is_asked[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if cell_of[a] != cell:
                    yield from answer()
                    cell, held, wanted = cell_of[a], [], None
                if is_asked[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                if not held:
                    continue
                if wanted is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    wanted = table.column("vec_id").to_numpy(), table.column("version").to_numpy(), _matrix(table.column("weights"))
                for at in range(a, b, BLOCK):
                    part = batch.slice(at, min(BLOCK, b - at))
                    block, ids = _matrix(part.column("weights")), part.column("vec_id").to_numpy()
                    for first in range(0, len(wanted[0]), QUERY_BLOCK):
                        scores = accumulate(wanted[2][first : first + QUERY_BLOCK], block)
                        q, i, s = best_of(scores, ids, wanted[0][first : first + QUERY_BLOCK], k)
                        best.append((q + first, i, s))
                if len(best) > 64:
                    best[:] = [_reduce(best, k)]
        yield from answer()

    dealt = cells.repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell", F.desc("query"))
    found = dealt.mapInArrow(run, "query_id long, version long, vec_id long, score long")
    by_query = Window.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reduce(best: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of each query among what several blocks gave."""
    q, i, s = (np.concatenate(x) for x in zip(*best, strict=True))
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    return q[place < k], i[place < k], s[place < k]
