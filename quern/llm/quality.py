"""Quality classification with random-indexing word vectors and a small network.

Every token has an index vector, a few signs at places that its hash gives.  The vector of a frequent token is the sum
of the index vectors of its neighbours over the whole corpus.  A document is the mean of its tokens' vectors, beside the
mean of its tokens' index vectors, which speaks for rare tokens.  A network of two layers, trained with numpy on a
bounded sample of labelled rows, gives a logit; a temperature fitted on labelled rows that it has not seen turns it into
a probability.

Tokens are runs of letters and digits, and runs of other characters; case is kept.
A token has a vector if its share of the corpus is at least ``TOKEN_SHARE``, so there are at most ``1 / TOKEN_SHARE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage_table
from . import kernels as K

DIM = 32
SIGNS = 2
NEIGHBOURS = (-2, -1, 1, 2)
TOKEN_SHARE = 2.0**-13
TRAINING_ROWS = 8192
HIDDEN = 24
_POINT = K.SPACED & ~(K.ALNUM | ((K._ALL >= 0x41) & (K._ALL <= 0x5A)))
_LETTER = K.SPACED & ~_POINT


def tokens_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text in order, and the offsets of the texts."""
    data, offsets = K.text_bytes(part.column("text"))
    letters, points = K.find_words(data, offsets, _LETTER), K.find_words(data, offsets, _POINT)
    start = np.concatenate([letters.start, points.start])
    order = np.argsort(start, kind="stable")
    hashes = np.concatenate([letters.hashes(), points.hashes()])[order]
    return hashes, letters.first + points.first


def index_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the places of its signs and the signs."""
    bits = K.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    step = np.arange(SIGNS, dtype=np.uint64)[:, None] * np.uint64(16)
    places = ((bits >> step) & np.uint64(DIM - 1)).astype(np.int64)
    return places, np.where((bits >> (step + np.uint64(8))) & np.uint64(1), 1.0, -1.0)


def frequent_tokens(docs: DataFrame) -> np.ndarray:
    """Hashes of the tokens with at least TOKEN_SHARE of the corpus, sorted."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found, n = np.unique(tokens_of(part)[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(K.signed(found)), pa.array(n)], names=["token", "n"])

    counts = stage_table(K.map_texts(docs.select("text"), work, "token long, n long", limit=2 * K.SLICE_BYTES).groupBy("token").agg(F.sum("n").alias("n")), "token-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = counts.where(F.col("n") >= max(total * TOKEN_SHARE, 2)).select("token").toArrow().column("token").to_numpy()
    return np.sort(held.view(np.uint64))


def _rows(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def context_vectors(docs: DataFrame, known: np.ndarray) -> np.ndarray:
    """The vector of each frequent token: neighbours' index vectors over the whole corpus, scaled to length 1."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        total = np.zeros(len(words) * DIM)
        for batch in batches:
            for part in K.text_slices(batch):
                hashes, first = tokens_of(part)
                rows, text = _rows(words, hashes), np.repeat(np.arange(part.num_rows), np.diff(first))
                places, signs = index_places(hashes)
                for step in NEIGHBOURS:
                    own = np.flatnonzero(rows >= 0)
                    own = own[(own + step >= 0) & (own + step < len(rows))]
                    own = own[text[own] == text[own + step]]
                    for j in range(SIGNS):
                        total += np.bincount(rows[own] * DIM + places[j, own + step], weights=signs[j, own + step], minlength=len(total))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words)), pa.int32()), *(pa.array(c) for c in total.reshape(-1, DIM).T)], names=["row", *names])

    names = [f"v{i}" for i in range(DIM)]
    out = np.zeros((len(known), DIM))
    if len(known):
        sums = docs.select("text").mapInArrow(run, "row int, " + ", ".join(f"{n} double" for n in names)).groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
        if sums.num_rows:
            out[sums.column("row").to_numpy()] = np.column_stack([sums.column(n).to_numpy() for n in names])
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(docs: DataFrame, known: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """doc_id, held and features of every row: the two means, the share of frequent tokens and the log of the length."""
    shared = docs.sparkSession.sparkContext.broadcast((known, vectors))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        words, table = shared.value
        hashes, first = tokens_of(part)
        rows, n = _rows(words, hashes), np.diff(first)
        text = np.repeat(np.arange(part.num_rows), n)
        out = np.zeros((part.num_rows, 2 * DIM + 2))
        some = np.flatnonzero(rows >= 0)
        if len(some):
            own = text[some]
            head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out[own[head], :DIM] = np.add.reduceat(table[rows[some]], head, axis=0)
        places, signs = index_places(hashes)
        for j in range(SIGNS):
            out[:, DIM : 2 * DIM] += np.bincount(text * DIM + places[j], weights=signs[j], minlength=part.num_rows * DIM).reshape(-1, DIM)
        out[:, : 2 * DIM] /= np.maximum(n, 1)[:, None]
        out[:, 2 * DIM] = np.bincount(text[some], minlength=part.num_rows) / np.maximum(n, 1)
        out[:, 2 * DIM + 1] = np.log1p(n)
        flat = pa.array(out.astype(np.float32).ravel())
        return K.with_columns(part, features=pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * out.shape[1], pa.int32()), flat))

    return K.map_texts(docs, work, "doc_id long, held_out boolean, features array<float>")


@dataclass
class Network:
    """Two layers, the scaling of the features, and the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum((x - self.mean) / self.scale @ a + b, 0.0) @ c + d

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, epochs: int = 60, seed: int = 7) -> Network:
    """Cross-entropy by Adam on the rows outside ``calibrate``, then the temperature with the best likelihood on those inside.

    Without labels of both kinds there is nothing to tell apart: every score is the share of label 1 (one half without rows).
    """
    width = x.shape[1]
    if len(y) < 2 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        zero = np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.log(share / (1 - share))
        return Network(np.zeros(width), np.ones(width), zero, 1.0)
    random = np.random.default_rng(seed)
    fit = ~calibrate if len({*y[~calibrate].tolist()}) == 2 else np.ones(len(y), bool)
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    xs, ys = (x[fit] - mean) / scale, y[fit].astype(float)
    weights = [random.normal(0, np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN), random.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(())]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for rows in np.array_split(random.permutation(len(ys)), max(1, len(ys) // 128)):
            a, b, c, d = weights
            hidden = np.maximum(xs[rows] @ a + b, 0.0)
            error = (1.0 / (1.0 + np.exp(-np.clip(hidden @ c + d, -30, 30))) - ys[rows]) / len(rows)
            back = error[:, None] * c * (hidden > 0)
            slopes = [xs[rows].T @ back + 1e-4 * a, back.sum(axis=0), hidden.T @ error + 1e-4 * c, error.sum()]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - 0.005 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, tuple(weights), 1.0)
    unseen = calibrate if calibrate.any() else fit
    logits, target = net.logits(x[unseen]), y[unseen]

    def loss(temperature: float) -> float:
        z = np.clip(logits / temperature, -30, 30)
        return float(np.mean(np.log1p(np.exp(-z)) * target + np.log1p(np.exp(z)) * (1 - target)))

    net.temperature = min(np.exp(np.linspace(np.log(0.25), np.log(16), 61)).tolist(), key=loss)
    return net


def score_quality(docs: DataFrame, labels: DataFrame, is_held_out: Column, threshold: float = 0.3, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Labels are learned from about ``training_rows`` rows that are not held out, those with the smallest hash of doc_id;
    a fifth of them sets the temperature.  Labels that are null, or whose rows disagree, teach nothing.  A null text is
    empty; it is scored like any other.  Rows that share a doc_id, or have none, are scored each on their own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    known = frequent_tokens(rows)
    vectors = context_vectors(rows, known)
    features = stage_table(pooled(rows, known, vectors), "quality-features")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    marked = features.where("not held_out").join(marks, "doc_id").withColumn("mark", F.xxhash64("doc_id"))
    count = marked.count()
    if count > training_rows:
        limit = (2.0 * training_rows / count - 1.0) * 2.0**63
        marked = marked.where(F.col("mark").cast("double") < limit)
    sample = marked.select("label", (F.pmod("mark", F.lit(5)) == 0).alias("calibrate"), "features", "doc_id").orderBy("doc_id").toArrow().combine_chunks()
    x = sample.column("features").combine_chunks().flatten().to_numpy().reshape(sample.num_rows, -1).astype(float) if sample.num_rows else np.zeros((0, 2 * DIM + 2))
    net = fit_network(x, sample.column("label").to_numpy().astype(float), sample.column("calibrate").to_numpy(zero_copy_only=False).astype(bool))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x_ = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(shared.value.probabilities(x_))], names=["doc_id", "held_out", "score"])

    scored = features.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
