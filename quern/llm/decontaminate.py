"""Benchmark decontamination with a distributed positional inverted index.

Test items are cut into windows of words.  The corpus frequency of every test term is counted, so each window knows its
rarest term.  Postings (term, document, position) of test terms are stored for the whole corpus where they can matter:
close enough to a rarest term to lie in its window, beside the next rarest term of that window.  A window's candidate places are its rarest term's postings moved by
the term's offset; they are intersected with the postings of the other terms at their own offsets.  With a slop of zero
what is left is the exact phrase; with more, terms may stand that far from their place.

Items are worked on in rounds of at most ``ROUND_WORDS`` words; what is broadcast is bounded by that.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stage_table
from . import kernels as K
from .tokens import HashIndex

WINDOW_WORDS = 10
ROUND_WORDS = 1 << 18


@dataclass
class Windows:
    """Windows of a round of items as arrays: a window's item, its terms (rows of ``terms``, -1 behind a short one)."""

    items: list[str]
    terms: np.ndarray
    item: np.ndarray
    members: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return (self.members >= 0).sum(axis=1)


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (the id as text) and the hashes of its words, for every item that has words."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        words = K.batch_words(part, K.ALNUM, lower=True)
        lists = pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), pa.array(K.signed(words.hashes())))
        return K.with_columns(part, words=lists)

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    return K.map_texts(rows, work, "item string, words array<long>").where(F.size("words") > 0)


def cut_windows(rows: list[tuple[str, list[int]]], length: int) -> Windows:
    """All runs of ``length`` words; an item that is shorter is one window."""
    terms, inverse = np.unique(np.concatenate([np.array(w, np.int64) for _, w in rows]), return_inverse=True)
    members, item, at = [], [], 0
    for k, (_, words) in enumerate(rows):
        own = inverse[at : at + len(words)]
        at += len(words)
        cut = np.lib.stride_tricks.sliding_window_view(own, length) if len(own) >= length else np.pad(own, (0, length - len(own)), constant_values=-1)[None]
        members.append(cut)
        item.append(np.full(len(cut), k))
    return Windows([i for i, _ in rows], terms.view(K.U64), np.concatenate(item), np.concatenate(members))


_indexes: dict[int, HashIndex] = {}


def _index(terms: np.ndarray) -> HashIndex:
    key = hash(terms.tobytes())
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = HashIndex()
        _indexes[key].add(terms)
    return _indexes[key]


def term_frequencies(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Occurrences in the whole corpus of each of a round's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = _index(shared.value).find(K.batch_words(part, K.ALNUM, lower=True).hashes())
        counts = np.bincount(rows[rows >= 0], minlength=len(shared.value))
        held = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held].astype(np.int64))], names=["term", "n"])

    counts = K.map_texts(docs, work, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    return out


def positional_postings(docs: DataFrame, terms: np.ndarray, anchors: np.ndarray, reach: int, beside: np.ndarray | None = None) -> DataFrame:
    """doc_key, doc_id, n_words and the postings (term, position) within ``reach`` words of an anchor term, per document.

    ``beside`` has rows (anchor term, distance, other term), sorted by the first: an anchor then counts only where one of
    its other terms, the next rarest of a window, stands at that distance.
    """
    shared = docs.sparkSession.sparkContext.broadcast((terms, anchors, beside))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        known, is_anchor, pairs = shared.value
        words = K.batch_words(part, K.ALNUM, lower=True)
        n = len(words.start)
        rows = _index(known).find(words.hashes())
        text_of = words.text_of
        at = np.flatnonzero((rows >= 0) & is_anchor[np.maximum(rows, 0)])
        if pairs is not None and len(at):
            low, high = (np.searchsorted(pairs[:, 0], rows[at], side=s) for s in ("left", "right"))
            mine = np.repeat(np.arange(len(at)), high - low)
            pair = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(len(mine))
            there = at[mine] + pairs[pair, 1]
            inside = (there >= words.first[text_of[at[mine]]]) & (there < words.first[text_of[at[mine]] + 1])
            met = inside & (rows[np.clip(there, 0, n - 1)] == pairs[pair, 2])
            at = at[np.unique(mine[met])]
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, np.maximum(at - reach, words.first[text_of[at]]), 1)
        np.add.at(step, np.minimum(at + reach + 1, words.first[text_of[at] + 1]), -1)
        near = np.flatnonzero((np.cumsum(step)[:n] > 0) & (rows >= 0))
        own = text_of[near]
        cuts = pa.array(np.searchsorted(own, np.arange(part.num_rows + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (rows[near], near - words.first[own])]
        return K.with_columns(part, n_words=words.counts, terms=lists[0], positions=lists[1])

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("doc_key"), "doc_id", "text")
    return K.map_texts(keyed, work, "doc_key long, doc_id long, n_words long, terms array<int>, positions array<int>")


def intersect(spark: SparkSession, postings: DataFrame, windows: Windows, rarest: np.ndarray, slop: int = 0, min_terms: float = 1.0, used: np.ndarray | None = None) -> DataFrame:
    """Places of windows: doc_key, item, start and length.  ``postings`` has doc_key, term and position.

    A place counts if at least ``min_terms`` of the window's terms stand within ``slop`` words of their offset.  Candidates
    are the places of the terms at the offsets ``rarest``, of the windows ``used`` (default all).
    """
    lengths = windows.lengths
    rows = np.arange(len(lengths)) if used is None else np.flatnonzero(used)
    held = pa.table({
        "window": pa.array(rows, pa.int32()), "item": pa.array([windows.items[i] for i in windows.item[rows].tolist()], pa.string()), "length": pa.array(lengths[rows], pa.int32()),
        "term": pa.array(windows.members[rows, rarest[rows]], pa.int32()), "offset": pa.array(rarest[rows], pa.int32()),
        "members": pa.array([m[:n].tolist() for m, n in zip(windows.members[rows], lengths[rows].tolist(), strict=True)], pa.list_(pa.int32())),
    })
    plan = F.broadcast(spark.createDataFrame(held))  # bounded by ROUND_WORDS
    candidates = postings.join(plan, "term").withColumn("start", F.col("position") - F.col("offset")).where("start >= 0")
    needed = candidates.select("doc_key", "window", "item", "length", "start", F.posexplode("members").alias("offset", "term"))
    here = postings.select("doc_key", "term", "position")
    if slop == 0:
        met = needed.withColumn("position", F.col("start") + F.col("offset")).join(here, ["doc_key", "term", "position"])
    else:
        met = needed.join(here, ["doc_key", "term"]).where(F.abs(F.col("position") - F.col("start") - F.col("offset")) <= slop)
    met = met.select("doc_key", "window", "item", "length", "start", "offset").distinct()
    places = met.groupBy("doc_key", "window", "item", "length", "start").agg(F.count("*").alias("n"))
    return places.where(F.col("n") >= F.ceil(F.col("length") * F.lit(min_terms))).select("doc_key", "item", "start", "length")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS, slop: int = 0, min_terms: float = 1.0) -> DataFrame:
    """doc_id, doc_key, n_words, n_hit, items (sorted texts) of every row of ``docs``.

    Null texts have no words, so they are neither hit nor hit others.  Rows that share a doc_id are rows of their own;
    rows equal in id and text get the same result.  An item with a null id is called ``null``; items that share an id
    are one item.  Without items nothing is hit.  A text of any length is looked at whole.  No rows: no result.
    """
    spark = docs.sparkSession
    rows = K.documents_of(docs)
    items = items_of(benchmark)
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    rounds = -(-total // ROUND_WORDS)
    places, base = [], None
    for r in range(rounds):
        own = items if rounds == 1 else items.where(F.pmod(F.xxhash64("item", "words"), F.lit(rounds)) == r)
        picked = own.distinct().collect()
        if not picked:
            continue
        windows = cut_windows([(x["item"], x["words"]) for x in picked], window_words)
        frequency = term_frequencies(rows, windows.terms)
        rarity = np.where(windows.members >= 0, frequency[np.maximum(windows.members, 0)], np.iinfo(np.int64).max)
        rarest = rarity.argmin(axis=1)
        alive = np.where(windows.members >= 0, frequency[np.maximum(windows.members, 0)] > 0, True).mean(axis=1) >= min_terms
        anchors = np.zeros(len(windows.terms), bool)
        anchors[windows.members[np.arange(len(rarest)), rarest][alive]] = True
        beside = None
        if min_terms < 1.0:
            anchors[:] = True
        elif slop == 0:
            rarity[np.arange(len(rarest)), rarest] = np.iinfo(np.int64).max
            second = np.where(windows.lengths > 1, rarity.argmin(axis=1), rarest)
            row = np.arange(len(rarest))[alive]
            beside = np.unique(np.column_stack([windows.members[row, rarest[alive]], (second - rarest)[alive], windows.members[row, second[alive]]]).astype(np.int64).reshape(-1, 3), axis=0)
        index = stage_table(positional_postings(rows, windows.terms, anchors, window_words - 1 + slop, beside), "postings")
        base = index.select("doc_key", "doc_id", "n_words") if base is None else base
        flat = index.select("doc_key", F.explode(F.arrays_zip("terms", "positions")).alias("p")).select("doc_key", F.col("p.terms").alias("term"), F.col("p.positions").alias("position"))
        if min_terms == 1.0:
            places.append(intersect(spark, flat, windows, rarest, slop))
            continue
        # Of any floor(n * (1 - min_terms)) + 1 terms one stands in a place that counts, so those that occur and are rarest do.
        occurs = np.where((windows.members >= 0) & (frequency[np.maximum(windows.members, 0)] > 0), frequency[np.maximum(windows.members, 0)], np.iinfo(np.int64).max)
        order = np.argsort(occurs, axis=1, kind="stable")
        needed = np.floor(windows.lengths * (1 - min_terms) + 1e-9).astype(int) + 1
        for k in range(int(needed.max())):
            used = alive & (k < needed) & (occurs[np.arange(len(order)), order[:, k]] < np.iinfo(np.int64).max)
            if used.any():
                places.append(intersect(spark, flat, windows, order[:, k], slop, min_terms, used))
    if base is None:
        count = lambda part: K.with_columns(part, n_words=K.batch_words(part, K.ALNUM, lower=True).counts)
        base = K.map_texts(rows.select(F.xxhash64("doc_id", "text").alias("doc_key"), "doc_id", "text"), count, "doc_key long, doc_id long, n_words long")
        return base.select("doc_id", "doc_key", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    found = reduce(DataFrame.unionByName, places).distinct() if places else spark.createDataFrame([], "doc_key long, item string, start int, length int")
    hit = found.select("doc_key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("word")).distinct().groupBy("doc_key").agg(F.count("*").alias("n_hit"))
    named = found.groupBy("doc_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = base.join(hit, "doc_key", "left").join(named, "doc_key", "left")
    return out.select("doc_id", "doc_key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination_digest(docs: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """The result of :func:`find_contamination` with its items as a count and a checksum."""
    found = find_contamination(docs, benchmark, window_words)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
