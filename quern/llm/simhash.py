"""SimHash near-duplicates with BK-trees.

Every document gets a 64-bit fingerprint of its word shingles.  Equal fingerprints are one node, so a group of copies
costs as much as one text.  Fingerprints at a small distance agree in whole bit blocks: with ``blocks`` blocks and
radius ``r`` at least ``blocks - r`` are equal, so every choice of that many blocks is a key under which near
fingerprints meet.  The scheme widens the keys with the number of fingerprints and so keeps the shards small.

A shard is the set of fingerprints with one key.  Its task builds a BK-tree (children keyed by their integer Hamming
distance to the parent) and follows for each fingerprint only the edges within the radius.  A tree covers all
fingerprints of its shard, so trees travel by shuffle: broadcasting them would need room for the whole corpus on every
machine.  The fingerprints of a shard above ``SHARD_LIMIT`` are keyed again by the bits that are not yet in the key.
A search leaves out every subtree that is already one component with what it looks for, so a dense group costs little
more than its first searches.  A shard returns one link per fingerprint to the smallest it is connected to, never all
pairs; alternating stars join these links to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, default_partitions, drop_stage, stage_table
from . import kernels as K

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
SHARD_LIMIT = 4096
SMALL_SHARD = 32  # up to here fingerprints are looked for one by one
SEARCHES = 1 << 18  # pairs of a fingerprint and a node that searches begin with at once
SALTS = 32
WIDE_WORDS, WIDE_RADIUS, WIDE_SHINGLE_WORDS, WIDE_SHARD_LIMIT = 4, 76, 5, 1024
KEYS = 8
LEAST_SHARE = 0.8
EXACT_BYTES = 1 << 23  # shingle hashes of a chunk


def fingerprint_batch(part: pa.RecordBatch, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The fingerprint of each text as an unsigned 64-bit number."""
    import xxhash

    words = K.batch_words(part, K.SPACED, lower=True)
    counts, first = words.counts, words.first[:-1]
    if not len(words.start):
        return np.zeros(len(counts), K.U64)
    sizes = words.end - words.start
    ends = np.cumsum(sizes + 1)  # the words again with one space behind each
    begins = ends - sizes - 1
    joined = np.full(int(ends[-1]), 0x20, np.uint8)
    joined[np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))] = words.data[np.repeat(words.start - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
    n_shingles = np.where(counts >= shingle_words, counts - shingle_words + 1, np.minimum(counts, 1))
    span = np.minimum(counts, shingle_words)
    shingle_first = np.cumsum(n_shingles) - n_shingles
    start = np.repeat(first - shingle_first, n_shingles) + np.arange(int(n_shingles.sum()))
    stop = start + np.repeat(span, n_shingles) - 1
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(begins[start].tolist(), (ends[stop] - 1).tolist(), strict=True)), K.U64, len(start))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = np.flatnonzero(n_shingles)
    ones = np.add.reduceat(bits, shingle_first[some], axis=0, dtype=np.int32)
    out = np.zeros(len(counts), K.U64)
    out[some] = np.packbits(ones * 2 > n_shingles[some][:, None], axis=1, bitorder="little").view(K.U64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a long) of every row; a text without words, or null, has fingerprint 0."""
    return K.map_texts(K.documents_of(docs), lambda part: K.with_columns(part, fp=K.signed(fingerprint_batch(part, shingle_words))), "doc_id long, fp long")


class BKTree:
    """Numbers by Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of the held values within ``radius``."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            for edge, child in self.children[node].items():
                if distance - radius <= edge <= distance + radius:
                    todo.append(child)
        return found

    def add(self, value: int) -> int:
        node = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while at != node:
            edge = (self.values[at] ^ value).bit_count()
            following = self.children[at].setdefault(edge, node)
            at = following
        return node


class TreeSearch:
    """Searches in a BK-tree for many of its own values at once, all of them going down a level at a time."""

    def __init__(self, tree: BKTree, values: np.ndarray):
        n = len(values)
        self.values = values
        self.sizes = np.array([len(c) for c in tree.children])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.edge = np.array([e for c in tree.children for e in c], np.int64)
        self.child = np.array([x for c in tree.children for x in c.values()], np.int64)
        self.up = np.zeros(n, np.int64)
        self.up[self.child] = np.repeat(np.arange(n), self.sizes)
        self.levels, level = [], np.zeros(1, np.int64)
        while len(level):
            self.levels.append(level)
            level = self._children(level)[1]

    def _children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the edges of all ``node``, and the nodes that they lead to."""
        n = self.sizes[node]
        step = np.repeat(self.first[node] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return step, self.child[step]

    def settled(self, label: np.ndarray) -> np.ndarray:
        """The label of each subtree that has only one, -1 for the others."""
        low, high = label.copy(), label.copy()
        for level in self.levels[:0:-1]:
            np.minimum.at(low, self.up[level], low[level])
            np.maximum.at(high, self.up[level], high[level])
        return np.where(low == high, low, -1)

    def near(self, asked: np.ndarray, radius: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (asked, node) within ``radius``, but for nodes in subtrees that have the label of what is asked throughout."""
        settled = self.settled(label)
        query, node = asked, np.zeros(len(asked), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            open_ = settled[node] != label[query]
            query, node = query[open_], node[open_]
            distance = np.bitwise_count(self.values[query] ^ self.values[node]).sum(axis=1, dtype=np.int64)
            hit = distance <= radius
            found.append((query[hit], node[hit]))
            step, child = self._children(node)
            query, distance = np.repeat(query, self.sizes[node]), np.repeat(distance, self.sizes[node])
            on = np.abs(self.edge[step] - distance) <= radius
            query, node = query[on], child[on]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def shard_links(nodes: np.ndarray, values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """For each of the distinct ``nodes`` that has company, a link to the smallest of those it is connected to.

    ``values`` has a row of 64-bit words for each node.  Everything is found in a BK-tree of the whole shard.
    """
    order = np.argsort(nodes)
    nodes, values = nodes[order], values[order]
    n = len(nodes)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(x: int, y: int) -> None:
        x, y = sorted((root(x), root(y)))
        parent[y] = x

    tree, numbers = BKTree(), [int.from_bytes(row.tobytes(), "little") for row in values]
    if n <= SMALL_SHARD:
        for x in range(n):
            for found in tree.near(numbers[x], radius):
                join(x, found)
            tree.add(numbers[x])
        label = np.array([root(x) for x in range(n)])
    else:
        for number in numbers:
            tree.add(number)
        search, label = TreeSearch(tree, values), np.arange(n)
        for first in range(0, n, step := max(1, SEARCHES // n)):
            query, node = search.near(np.arange(first, min(n, first + step)), radius, label)
            met = np.unique(np.column_stack([label[query], label[node]]), axis=0)
            for a, b in met[met[:, 0] != met[:, 1]].tolist():
                join(a, b)
            held, place = np.unique(label, return_inverse=True)
            label = np.array([root(x) for x in held.tolist()])[place]
    ids = nodes.tolist()
    return [(ids[i], ids[r]) for i, r in enumerate(label.tolist()) if r != i]


def key_scheme(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """(blocks, equal blocks) for ``n`` fingerprints, so that about 16 random ones share a key."""
    blocks = radius + 1
    while 64 * (blocks - radius) // blocks < np.log2(max(n, 2)) - 4 and blocks < 3 * radius + 2:
        blocks += 1
    return blocks, blocks - radius


def _masks(blocks: int, equal: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, equal)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _further(mask: int, radius: int) -> list[int]:
    """The bits outside ``mask`` in radius + 1 parts, one of which is equal in near fingerprints."""
    bits = [b for b in range(64) if not mask >> b & 1]
    edges = [round(len(bits) * i / (radius + 1)) for i in range(radius + 2)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(edges, edges[1:], strict=False)]


def linked_pairs(nodes: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (node, parent) between distinct values of ``fp`` whose connected sets are those of all pairs within ``radius``."""
    blocks, equal = key_scheme(nodes.count(), radius)
    masks = _masks(blocks, equal)
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(m)).alias("mask"), F.array(*[F.lit(_signed(x)) for x in _further(m, radius)]).alias("further")) for i, m in enumerate(masks)])
    # The place of the mask is part of the key, for equal bits mean nothing in other places.
    keyed = nodes.select(F.col("fp").alias("node"), F.explode(table).alias("m")).select("node", F.xxhash64("m.i", F.col("node").bitwiseAND(F.col("m.mask"))).alias("key"), "m.further")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    again = F.transform("further", lambda m, i: F.xxhash64("key", i, F.col("node").bitwiseAND(m)))
    keys = F.when(F.col("n") > limit, again).otherwise(F.array("key"))
    shards = keyed.join(counts, "key").select(F.explode(keys).alias("key"), "node")
    return search_shards(shards, ["key"], radius)


def shard_pairs(keyed: DataFrame, radius: int, limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (node, parent) within the shards of ``keyed`` (node, key, bits); a larger shard is cut into chunks, and every pair of them is a shard."""
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / limit).cast("int").alias("chunks"))
    met = keyed.join(counts, "key").withColumn("met", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    shards = met.select("key", F.least(own, "met").alias("low"), F.greatest(own, "met").alias("high"), "node", "bits")
    return search_shards(shards, ["key", "low", "high"], radius)


def search_shards(shards: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links (node, parent) within rows that have equal ``keys``; the fingerprint is ``bits``, or node if there is no such column."""
    wide, of = "bits" in shards.columns, len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def links(rows: np.ndarray, values: np.ndarray) -> pa.RecordBatch | None:
            change = np.flatnonzero((rows[1:, :of] != rows[:-1, :of]).any(axis=1)) + 1
            edges = np.concatenate([[0], change, [len(rows)]])
            found: list[tuple[int, int]] = []
            for k in np.flatnonzero(np.diff(edges) > 1).tolist():
                found += shard_links(rows[edges[k] : edges[k + 1], of], values[edges[k] : edges[k + 1]], radius)
            if found:
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["node", "parent"])
            return None

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in (*keys, "node")])
            values = K.text_bytes(batch.column("bits"))[0].reshape(len(rows), -1).copy().view(K.U64) if wide else rows[:, of:].copy().view(K.U64)
            held.append((rows, values))
            rows, values = (np.concatenate(x) for x in zip(*held, strict=True))
            same = (rows[:, :of] == rows[-1, :of]).all(axis=1)
            last = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last shard begins
            held = [(rows[last:], values[last:])]
            if last and (out := links(rows[:last], values[:last])) is not None:
                yield out
        if held and len(held[0][0]) > 1 and (out := links(*held[0])) is not None:
            yield out

    # A number of partitions of its own: the rows are few bytes but much work, and Spark would merge them by bytes.
    return shards.repartition(default_partitions(shards.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "node long, parent long").distinct()


def with_least(rows: DataFrame, group: str, value: Column, name: str, spread: str) -> DataFrame:
    """``rows`` with the smallest ``value`` of their ``group`` as ``name``; a large group is joined in parts, by the hash of ``spread``."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    parts = salted.groupBy(group, "_salt").agg(F.min(value).alias(name))
    whole = parts.groupBy(group).agg(F.min(name).alias(name), F.collect_set("_salt").alias("_salts"))
    return salted.join(whole.select(group, name, F.explode("_salts").alias("_salt")), [group, "_salt"]).drop("_salt")


def star_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that links to a smaller one, root being the smallest it is connected to.

    Large stars and small stars alternate until nothing changes.  Each round groups by node with a minimum, which is
    combined before the shuffle, and joins it back in parts, so no node's neighbours are gathered in one place.
    """

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("node", "parent"), F.lit(1 << 40)))).first())

    now = stage_table(links, "links")
    before = sign(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("parent").alias("node"), F.col("node").alias("parent")))
        least = with_least(both, "node", F.least("node", "parent"), "low", "parent")
        large = least.where(F.col("parent") > F.col("node")).select(F.col("parent").alias("node"), F.col("low").alias("parent")).distinct()
        large = stage_table(large, "links")
        lows = with_least(large, "node", F.col("parent"), "low", "parent")
        small = lows.select(F.when(F.col("parent") != F.col("low"), F.col("parent")).otherwise(F.col("node")).alias("node"), F.col("low").alias("parent"))
        following = stage_table(small.distinct(), "links")
        drop_stage(large)
        drop_stage(now)
        now, after = following, sign(following)
        if after == before:
            break
        before = after
    return now.withColumnRenamed("parent", "root")


def _components(prints: DataFrame, links: DataFrame, name: Column | None = None) -> DataFrame:
    """doc_id, fp and component_id of rows (doc_id, node, fp and others) from links between nodes; the others are kept.

    A component's id is the smallest ``name`` (default doc_id) of its rows.
    """
    nodes = prints.groupBy("node").agg(F.min(F.col("doc_id") if name is None else name).alias("first_id"))
    roots = star_components(links)
    # (node, root) of linked nodes, and of their roots too
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).distinct()
    firsts = with_least(linked.join(nodes, "node"), "root", F.col("first_id"), "root_id", "node")
    named = nodes.join(firsts.select("node", "root_id"), "node", "left").select("node", F.coalesce("root_id", "first_id").alias("component_id"))
    # As a table of its own it is broadcast if small, and else joined by a shuffle whose hot nodes Spark can split.
    named = broadcast_if_small(named, "components", 1 << 19)
    others = [c for c in prints.columns if c not in ("doc_id", "node", "fp")]
    return prints.join(named, "node", "left").select("doc_id", "fp", "component_id", *others)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links within ``radius`` bits lead to) of every row.

    Rows without words link like any other row, by fingerprint 0.  A row without a doc_id never names a component
    unless no row of its component has one.  Rows that share a doc_id, and repeated rows, are rows of their own.  A text
    of any length is fingerprinted whole.  No rows: no result.  Other columns are not looked at.
    """
    prints = stage_table(fingerprints(docs, shingle_words).withColumn("node", F.col("fp")), "fingerprints")
    return _components(prints, linked_pairs(prints.select("fp").distinct(), radius))


def shingle_batch(part: pa.RecordBatch, shingle_words: int = WIDE_SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within a text, and the text of each."""
    words = K.batch_words(part, K.SPACED, lower=True)
    hashes, counts, first = words.hashes(), words.counts, words.first[:-1]
    at, grams = words.ngram_hashes(shingle_words, hashes)
    owner = words.text_of[at]
    for size in range(1, shingle_words):  # a shorter text is one shingle
        short = np.flatnonzero(counts == size)
        if len(short):
            grams = np.concatenate([grams, K.rolling(hashes, size)[first[short]]])
            owner = np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])])[: len(grams)]
    return grams[new], owner[new]


def set_hashes(grams: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """A hash of each text's set of shingles, 0 for one without words."""
    out = np.zeros(texts, K.U64)
    if len(grams):
        head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[head]] = K.mix(np.add.reduceat(K.mix(grams ^ K.mix(np.array([99], K.U64))), head))
    return out


def wide_fingerprint_batch(part: pa.RecordBatch, shingle_words: int = WIDE_SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """256-bit fingerprints of each text's distinct shingles as rows of four words, the keys of the shards it belongs to,
    and the hash of its shingles.

    A key is the smallest of the shingles' hashes in one of KEYS orders: two texts of which a share of the shingles is
    common have the same one with that probability, so at a share of 0.8 all but 3 in a million pairs meet.
    """
    texts = part.num_rows
    grams, owner = shingle_batch(part, shingle_words)
    prints, keys = np.zeros((texts, WIDE_WORDS), K.U64), np.zeros((texts, KEYS), K.U64)
    if len(grams):
        head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        n = np.diff(np.append(head, len(owner)))
        for w in range(WIDE_WORDS):
            bits = np.unpackbits(K.mix(grams + K.U64(w + 1)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, head, axis=0, dtype=np.int32)
            prints[owner[head], w] = np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").view(K.U64).ravel()
        for i in range(KEYS):
            keys[owner[head], i] = K.mix(np.minimum.reduceat(K.mix(grams ^ K.mix(np.array([i + 101], K.U64))), head) + K.U64(i))
    return prints, keys, set_hashes(grams, owner, texts)


def exact_links(nodes: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], radius: int = WIDE_RADIUS) -> list[tuple[int, int]]:
    """For each of the ``nodes`` that has company, a link to the smallest of those it is connected to by pairs that share
    LEAST_SHARE of their shingles.  Pairs whose fingerprints are farther apart than ``radius`` are not compared."""
    order = np.argsort(nodes)
    nodes, prints, n = nodes[order], prints[order], len(nodes)
    sizes = np.array([len(sets[i]) for i in order])
    first = np.cumsum(sizes) - sizes
    distinct, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    mark, label = np.zeros(len(distinct), bool), np.arange(n)

    def similar(x: int, others: np.ndarray) -> np.ndarray:
        few, many = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
        others = others[few >= LEAST_SHARE * many]
        others = others[np.bitwise_count(prints[others] ^ prints[x]).sum(axis=1, dtype=np.int64) <= radius]
        if not len(others):
            return others
        own, size = flat[first[x] : first[x] + sizes[x]], sizes[others]
        head = np.cumsum(size) - size
        mark[own] = True
        both = np.add.reduceat(mark[flat[np.repeat(first[others] - head, size) + np.arange(int(size.sum()))]], head, dtype=np.int64)
        mark[own] = False
        return others[both / (sizes[x] + size - both) >= LEAST_SHARE]

    left = np.arange(n)
    while len(left):  # what is similar to a pivot is one cluster at once
        near = similar(int(left[0]), left[1:])
        label[near] = left[0]
        left = left[label[left] != left[0]]
    for x in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
        for other in np.unique(label[similar(x, np.flatnonzero(label != label[x]))]).tolist():
            low, high = sorted((int(label[x]), other))
            label[label == high] = low
    ids = nodes.tolist()
    return [(ids[i], ids[r]) for i, r in enumerate(label.tolist()) if r != i]


def similar_pairs(docs: DataFrame, members: DataFrame, shingle_words: int, limit: int = WIDE_SHARD_LIMIT) -> DataFrame:
    """Links (node, parent) whose connected sets are those of all pairs that share LEAST_SHARE of their shingles.

    ``members`` has node, root and bits: a pair is looked at if it has the same root.  The shingles of the members are
    fetched once from ``docs``; a root with many of them is cut into chunks, and every pair of chunks is a shard.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        grams, owner = shingle_batch(part, shingle_words)
        cuts = pa.array(8 * np.searchsorted(owner, np.arange(part.num_rows + 1)), pa.int32())
        held = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, cuts.buffers()[1], pa.py_buffer(grams.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(K.signed(set_hashes(grams, owner, part.num_rows))), held], names=["node", "shingles"])

    sets = K.map_texts(docs.select(F.col("text").cast("string").alias("text")), work, "node long, shingles binary")
    sets = sets.join(broadcast_if_small(members, "members", 1 << 19), "node").groupBy("node").agg(*(F.first(c).alias(c) for c in ("root", "bits", "shingles")))
    sets = stage_table(sets, "shingles")
    wanted = F.greatest(F.count("*") / limit, F.sum(F.length("shingles").cast("long")) / EXACT_BYTES)
    counts = sets.groupBy("root").agg(F.ceil(wanted).cast("int").alias("chunks"))
    met = sets.join(counts, "root").withColumn("met", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    keys = ["root", "low", "high"]
    shards = met.select("root", F.least(own, "met").alias("low"), F.greatest(own, "met").alias("high"), "node", "bits", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                prints = np.frombuffer(b"".join(h[1] for h in held), K.U64).reshape(len(held), -1)
                found = exact_links(np.array([h[0] for h in held], np.int64), prints, [np.frombuffer(h[2], K.U64) for h in held])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["node", "parent"])

        for batch in batches:
            columns = [batch.column(c) for c in (*keys, "node", "bits", "shingles")]
            for i in range(batch.num_rows):
                *now, node, bits, shingles = (c[i].as_py() for c in columns)
                if now != key:
                    yield from links()
                    key, held = now, []
                held.append((node, bits, shingles))
        yield from links()

    return shards.repartition(default_partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "node long, parent long").distinct()


def similar_documents(docs: DataFrame, radius: int = WIDE_RADIUS, shingle_words: int = WIDE_SHINGLE_WORDS, key: str | None = None) -> DataFrame:
    """doc_id, fp and component_id of every row, as :func:`near_duplicates`, by pairs of texts that have a share of 0.8 or
    more of their distinct five-word shingles in common.

    Texts with the same shingles are one node.  Fingerprints only find candidates: at a share of 0.8 those of 256 bits
    differ in 39 on average, of the shortest texts (four shingles of five) in 48, so nothing but a few pairs in a million
    is beyond the radius; the candidates' shingles are then compared.  Rows without words are one group.  A text of any
    length is compared whole.  No rows: no result.

    With ``key``, a column of longs that tells apart rows of one doc_id, there is a column row_key with it, and
    component_id is the (doc_id, row_key) that is smallest among rows with a doc_id, null if there are none.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        prints, keys, nodes = wide_fingerprint_batch(part, shingle_words)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * KEYS, pa.int32()), pa.array(K.signed(keys).ravel()))
        raw = np.ascontiguousarray(prints).tobytes()
        size = 8 * WIDE_WORDS
        return K.with_columns(part, fp=pa.array([raw[i * size : (i + 1) * size] for i in range(part.num_rows)], pa.binary()), keys=lists, node=K.signed(nodes))

    rows, held = K.documents_of(docs), ""
    if key is not None:
        rows, held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(key).alias("row_key")), "row_key long, "
    prints = K.map_texts(rows, work, f"doc_id long, {held}fp binary, keys array<long>, node long")
    prints = stage_table(prints, "wide-fingerprints")
    nodes = prints.groupBy("node").agg(F.first("fp").alias("bits"), F.first("keys").alias("keys"))
    roots = star_components(shard_pairs(nodes.select("node", "bits", F.explode("keys").alias("key")), radius, WIDE_SHARD_LIMIT))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = roots.join(nodes.select("node", "bits"), "node")
    name = None if key is None else F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row_key"))
    return _components(prints.drop("keys"), similar_pairs(docs, members, shingle_words), name)


def fingerprint_text(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


