"""Whitening of embeddings from an exact scatter matrix, by residue-number arithmetic.

Components become integers x.  A partition multiplies its rows' residues modulo several primes: for each prime a matrix
product of doubles, which are exact as long as the products of a block of rows sum up to less than 2^53.  A column of ones
beside the components makes the same product hold the sums and the number of rows.  The residues of all partitions are
added modulo each prime, spread over tasks by prime and tile.  Chinese remaindering then gives the sums as whole numbers,
however large: there are as many primes as the largest component and the number of rows ask for.  The covariance is a
quotient of whole numbers, rounded once, and ``eigh`` in double precision gives the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
PRIME_BITS = 22
BLOCK_ROWS = 1 << (53 - 2 * PRIME_BITS)  # so many products of two residues stay below 2^53
TILE = 256
LAYERS = 16  # partial sums of a tile are added by so many tasks before one adds theirs
LONG_MAX = (1 << 63) - 1


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2^PRIME_BITS, as many as tell apart all whole numbers from -bound to bound."""
    found: list[int] = []
    candidate = (1 << PRIME_BITS) - 1
    while prod(found) <= 2 * bound:
        if all(candidate % d for d in range(3, int(candidate**0.5) + 1, 2)):
            found.append(candidate)
        candidate -= 2
    return found


def from_residues(residues: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Whole numbers (of either sign) by Chinese remaindering, as an array of Python's."""
    m = prod(primes)
    total = sum(r.astype(object) * (m // p * pow(m // p, -1, p)) for r, p in zip(residues, primes, strict=True)) % m
    return np.where(total * 2 > m, total - m, total)


def whole(c: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100,000 of doubles as longs; what lies beyond a long is the nearest long."""
    with np.errstate(over="ignore"):
        f = np.floor(c * SCALE)
    high, low = f >= 2.0**63 - SHIFT - 1024, f < -(2.0**63)
    x = np.where(high | low, 0.0, f).astype(np.int64) + SHIFT
    x[high], x[low] = LONG_MAX, -LONG_MAX - 1 + SHIFT
    return x


def usable(vectors: DataFrame, keep: list[str], vector: str) -> DataFrame:
    """``keep`` and the vectors, as doubles, of the rows whose vector is not null, not empty and has only finite numbers."""
    doubles = F.col("embedding").cast("array<double>")
    rows = vectors.select(*K.columns(keep), doubles.alias(vector))
    held = F.col(vector)
    return rows.where(held.isNotNull() & (F.size(held) > 0) & F.forall(held, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def _rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have ``width`` components, and those as rows of longs."""
    lengths, flat = _lists(column)
    fits = lengths == width
    return fits, whole(flat[np.repeat(fits, lengths)].reshape(-1, width))


def shape_of(rows: DataFrame, vector: str) -> tuple[int, int, int] | None:
    """The number of components that most vectors have (of equal counts the larger), how many do, and a bound of |x|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, float]] = {}
        for batch in batches:
            lengths, flat = _lists(batch.column(vector))
            if len(lengths):
                most = np.maximum.reduceat(np.abs(whole(flat).astype(float)), np.cumsum(lengths) - lengths)
                for width in np.unique(lengths).tolist():
                    n, top = found.get(width, (0, 0.0))
                    found[width] = n + int((lengths == width).sum()), max(top, float(most[lengths == width].max()))
        yield pa.RecordBatch.from_pydict({"width": pa.array(list(found), pa.int32()), "n": pa.array([n for n, _ in found.values()], pa.int64()), "top": pa.array([t for _, t in found.values()], pa.float64())})

    widths = rows.select(vector).mapInArrow(run, "width int, n long, top double").groupBy("width").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    best = widths.orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    return (best[0].width, best[0].n, int(best[0].top * (1 + 2**-50)) + 1) if best else None


def scatter_residues(rows: DataFrame, vector: str, width: int, primes: list[int]) -> DataFrame:
    """prime, tile and the sums modulo the prime of the products of (x, 1) with itself, in that tile of the matrix."""
    tiles = -(-(width + 1) // TILE)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {p: np.zeros((width + 1, width + 1), np.int64) for p in primes}
        seen = False
        for batch in batches:
            _, x = _rows(batch.column(vector), width)
            seen |= len(x) > 0
            for p in primes:
                block = np.ones((len(x), width + 1))
                block[:, :width] = x % p
                for k in range(0, len(x), BLOCK_ROWS):
                    part = block[k : k + BLOCK_ROWS]
                    sums[p] += (part.T @ part).astype(np.int64) % p
                sums[p] %= p
        layer = TaskContext.get().partitionId() % LAYERS
        for p in primes if seen else ():
            for i in range(tiles):
                for j in range(i, tiles):
                    tile = sums[p][i * TILE : (i + 1) * TILE, j * TILE : (j + 1) * TILE]
                    yield pa.RecordBatch.from_pydict({"prime": [p], "tile": pa.array([i * tiles + j], pa.int32()), "layer": pa.array([layer], pa.int32()), "sums": [np.ascontiguousarray(tile).tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for p, tile, raw in zip(*(batch.column(c).to_pylist() for c in ("prime", "tile", "sums")), strict=True):
                more = np.frombuffer(raw, np.int64)
                total[p, tile] = (total[p, tile] + more) % p if (p, tile) in total else more
        for (p, tile), values in total.items():
            yield pa.RecordBatch.from_pydict({"prime": [p], "tile": pa.array([tile], pa.int32()), "layer": pa.array([0], pa.int32()), "sums": [values.tobytes()]})

    schema = "prime long, tile int, layer int, sums binary"
    parts = rows.select(vector).mapInArrow(multiply, schema).repartition("prime", "tile", "layer").mapInArrow(add, schema)
    return parts.repartition("prime", "tile").mapInArrow(add, schema).select("prime", "tile", "sums")


def exact_scatter(rows: DataFrame, vector: str, width: int, n: int, top: int) -> np.ndarray:
    """The matrix of sums of (x, 1) times (x, 1) over all rows, in whole numbers."""
    primes = primes_for(n * max(top, 1) ** 2)
    tiles = -(-(width + 1) // TILE)
    residues = {p: np.zeros((width + 1, width + 1), np.int64) for p in primes}
    for r in scatter_residues(rows, vector, width, primes).collect():  # bounded by the square of the dimension
        i, j = divmod(r.tile, tiles)
        at, to = slice(i * TILE, min((i + 1) * TILE, width + 1)), slice(j * TILE, min((j + 1) * TILE, width + 1))
        tile = np.frombuffer(r.sums, np.int64).reshape(at.stop - at.start, to.stop - to.start)
        residues[r.prime][at, to], residues[r.prime][to, at] = tile, tile.T
    return from_residues([residues[p] for p in primes], primes)


def principal(scatter: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance by falling size, their shares of the trace, and unit eigenvectors as columns.

    The entry of largest size of each vector is positive.  A value within rounding of zero is zero.
    """
    n, width = int(scatter[-1, -1]), len(scatter) - 1
    sums = scatter[-1, :-1]
    exact = n * scatter[:-1, :-1] - np.outer(sums, sums)  # n^2 times the covariance, whole
    covariance = np.array([[float(Fraction(int(v), n * n)) for v in row] for row in exact])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float(Fraction(int(sum(exact.diagonal())), n * n))
    values = np.where(values > trace * width * 2.0**-52, values, 0.0)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return values, values / trace if trace else values, vectors


def whiten(vectors: DataFrame, keep: list[str] | None = None, components: int = COMPONENTS) -> DataFrame:
    """``keep`` (default vec_id) of every row that takes part, for each component from 1 up to ``components``.

    n: rows that take part; deviation: the sum over dimensions of (n x - S)^2, S the sums of x (beyond a long: the nearest
    long); whitened: x - S / n projected on the component, over the root of its variance; explained: its share of the
    whole variance; identity_error: the largest difference between the covariance of what is whitened and the identity.

    Left out are rows whose vector is null, empty, or holds a null or a number that is not finite; of vectors of
    different lengths, those of the length that most have (of equal counts the longest) take part.  Repeated rows count
    each; a null id is kept as it is.  There are no more components than dimensions.  A component without variance
    (repeated rows only, or a single one) has whitened and explained 0 and is no part of identity_error.  No rows: no
    result.  Other columns take no part.  The scatter matrix visits the driver: its size is that of the dimension's square.
    """
    keep = keep or ["vec_id"]
    vector = K.free_name("_vector", keep)
    rows = usable(vectors, keep, vector)
    stored = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*K.columns(keep)).schema]
    names = [K.free_name(c, keep) for c in ("component", "n", "deviation", "whitened", "explained", "identity_error")]
    fields = [*stored, *(f"`{c}` {t}" for c, t in zip(names, ["int", "long", "long", "double", "double", "double"], strict=True))]
    shape = shape_of(rows, vector)
    if shape is None:
        return vectors.sparkSession.createDataFrame([], ", ".join(fields))
    width, n, top = shape
    scatter = exact_scatter(rows, vector, width, n, top)
    sums = scatter[-1, :-1]
    values, explained, axes = principal(scatter, components)
    roots = np.where(values > 0, np.sqrt(values), np.inf)
    narrow = n * top < 1 << 61  # n x - S fits a long

    def centred(x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        return n * x - sums.astype(np.int64) if narrow else n * x.astype(object) - sums

    def project(c: np.ndarray) -> np.ndarray:
        return (c if narrow else np.array([[float(Fraction(v, n)) for v in row] for row in c.tolist()]).reshape(c.shape) * n).astype(float) / n @ axes / roots

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(values) + 1,) * 2)
        for batch in batches:
            w = project(centred(_rows(batch.column(vector), width)[1]))
            w = np.column_stack([w, np.ones(len(w))])
            total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "v": total.ravel()})

    found = rows.select(vector).mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((len(values) + 1,) * 2)
    for r in found:  # the square of the number of components
        total[r.i, r.j] = r.v
    covariance = total[:-1, :-1] / n - np.outer(total[-1, :-1], total[-1, :-1]) / n**2
    live = values > 0
    error = float(np.abs(covariance - np.eye(len(values)))[np.ix_(live, live)].max(initial=0.0))

    def deviations(c: np.ndarray) -> np.ndarray:
        far = np.array([float(v) for v in np.abs(c).max(axis=1, initial=0)]) if len(c) else np.zeros(0)
        wide = far * far * width >= 2.0**62
        out = np.zeros(len(c), np.int64)
        near = c[~wide].astype(np.int64)
        out[~wide] = (near * near).sum(axis=1)
        out[wide] = [min(sum(v * v for v in row), LONG_MAX) for row in c[wide].tolist()]
        return out

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            fits, x = _rows(batch.column(vector), width)
            c = centred(x)
            m = len(x)
            which = pa.array(np.repeat(np.flatnonzero(fits), k))
            made = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n, np.int64), np.repeat(deviations(c), k), project(c).ravel(), np.tile(explained, m), np.full(m * k, error)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f).take(which) for f in keep), *map(pa.array, made)], names=[*keep, *names])

    return K.map_batches(rows, give, ", ".join(fields))
