"""BM25 over a corpus, for many queries at once, from an index of segments.

A segment is what one pass adds, and is written once: blocks of postings, ids of its documents, and its share of the
statistics.  A later segment may say which earlier documents are gone, and takes their share of the statistics off, so
sums over all segments are those of the documents that are left.

Documents of similar length are dealt into ranges, and a block has the postings of one token in one range; its head says
the largest term frequency and the smallest text in it, and so what the token can add to a score there.  A search looks at
heads first: the ranges with the largest sums over a query's tokens are scored, which gives a score that ``top`` documents
reach, and ranges whose sum stays below it are not read.  No document of the result is in one of them.

Where many tokens are asked for, hardly a range can be left out, and heads by query and token would outgrow the postings.
Then queries are dealt into groups of a bounded size and ranges are dealt too; a group and a deal are a cell of a shuffle,
which holds its queries, streams its ranges, and gives only what can be among the best of the cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lowered, search_tokens
from ..storage import broadcast_if_small, default_partitions, stage_path, stage_table

K1, B, EPSILON = 1.5, 0.75, 0.25
RANGE = 256  # documents of a range, about
LENGTHS = 16  # classes of length that most documents fall into
FIRST_RANGES = 4  # ranges that give a query its first bound
PUSHED_TOKENS = 2000  # so many tokens are looked for in the files' own statistics
FEW_ASKED = 256  # tokens of all queries up to which ranges are looked at by their heads
QUERY_BLOCK = 1024  # queries of a cell, about
TOGETHER, PAIRS = 128, 1 << 16  # queries scored at once, and their tokens, about
POSTINGS, DOCUMENTS = 1 << 17, 512  # postings gathered, documents scored at once
FOUND = 1 << 18  # documents of a cell that wait to be among its best
CLOSE = 2e-6  # scores that may be equal to six digits
SLICE, HELD = 1 << 20, 1 << 22  # bytes of text counted at once, bytes of counted words that become blocks together
HEAD = ["token", "part", "n", "top_tf", "low_tokens", "seq"]
_WORD = np.isin(np.arange(256), [*b"abcdefghijklmnopqrstuvwxyz0123456789_"])


@dataclass
class LexicalIndex:
    """blocks (HEAD, postings), terms (token, df, idf), documents (doc_id), and gone (doc_id, before: the segments it was in), if any."""

    blocks: DataFrame
    terms: DataFrame
    documents: DataFrame
    n_docs: int
    avg_tokens: float
    gone: DataFrame | None = None


def _tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_tokens and the sorted tokens of each document."""
    tokens = docs.select(F.col(id_col).alias("doc_id"), F.sort_array(search_tokens(text_col)).alias("tokens"))
    return tokens.withColumn("n_tokens", F.size("tokens").cast("long"))


def _counted(tokens: DataFrame) -> DataFrame:
    """token and tf beside the other columns.  Equal tokens stand together, so a document's are counted within its row."""
    place = F.transform("tokens", lambda x, i: F.when((i == 0) | (x != F.get("tokens", i - 1)), i))
    runs = tokens.withColumn("starts", F.filter(place, lambda i: i.isNotNull()))
    count = lambda i, k: F.struct(F.get("tokens", i).alias("token"), (F.coalesce(F.get("starts", k + 1), F.size("tokens")) - i).cast("long").alias("tf"))
    counted = runs.withColumn("counts", F.transform("starts", count)).drop("tokens", "starts")
    # explode would filter by the size of counts, which is worked out anew, by whole texts, for every token.
    return counted.withColumn("_c", F.explode_outer("counts")).drop("counts").where("_c is not null").withColumns({"token": F.col("_c.token"), "tf": F.col("_c.tf")}).drop("_c")


def _found(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The tokens of lower-case texts, as ``search_tokens`` has them, and the text of each; their order is another."""
    inside, edge = _WORD[data], np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])[: len(data)]))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]])[: len(data)])) + 1
    lead = np.flatnonzero((data >= 0xE4) & (data <= 0xE9))
    wide = data[lead[:, None] + np.arange(3)] if len(lead) else np.zeros((0, 3), np.uint8)
    code = (wide & [0x0F, 0x3F, 0x3F]).astype(np.int32) @ [1 << 12, 1 << 6, 1]
    kept = (code >= 0x4E00) & (code <= 0x9FFF)
    lead, wide = lead[kept], wide[kept]
    words, singles = (np.searchsorted(offsets, at, side="right") - 1 for at in (start, lead))
    next_too = np.flatnonzero(singles[1:] == singles[:-1])
    pairs = np.concatenate([wide[next_too], wide[next_too + 1]], axis=1)
    sizes = np.concatenate([[0], end - start, np.full(len(lead), 3), np.full(len(pairs), 6)])
    raw = np.concatenate([data[inside], wide.ravel(), pairs.ravel()])
    tokens = pa.StringArray.from_buffers(len(sizes) - 1, pa.py_buffer(np.cumsum(sizes).astype(np.int32)), pa.py_buffer(raw))
    return tokens, np.concatenate([words, singles, singles[next_too]])


def _counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_tokens, words (the different tokens, a space between two) and tfs of each document that has tokens."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), lowered(text_col).alias("low"))

    def counted(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        tokens, text = _found(data, offsets)
        coded = tokens.dictionary_encode()
        width = max(len(coded.dictionary), 1)
        key, times = np.unique(text * width + coded.indices.to_numpy(), return_counts=True)
        own, borders = key // width, np.searchsorted(key // width, np.arange(part.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(borders), coded.dictionary.take(pa.array(key % width)))
        tfs = pa.ListArray.from_arrays(pa.array(borders), pa.array(times.astype(np.int32)))
        total = np.bincount(own, weights=times, minlength=part.num_rows).astype(np.int64)
        made = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total), pc.binary_join(lists, " "), tfs], names=["doc_id", "n_tokens", "words", "tfs"])
        return made.filter(pa.array(total > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = batch.column("low").cast(pa.large_string())
            offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1] if len(low) else np.zeros(1, np.int64)
            raw, at = np.frombuffer(low.buffers()[2] or b"", np.uint8), 0
            while at < len(low):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
                yield counted(batch.slice(at, to - at), raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                at = to

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, words string, tfs array<int>")


def _blocks(counts: DataFrame) -> DataFrame:
    """Blocks of the documents of :func:`_counts`, whose ranges (part) are whole in a task and stand together."""
    kind = counts.schema["doc_id"].dataType.simpleString()

    def blocks(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(pieces).combine_chunks()
        part, n_tokens = (table.column(c).to_numpy() for c in ("part", "n_tokens"))
        ids, words, tfs = (table.column(c).combine_chunks() for c in ("doc_id", "words", "tfs"))
        lists = pc.split_pattern(words, " ")
        coded, tf = lists.flatten().dictionary_encode(), tfs.flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
        place = np.cumsum(np.concatenate([[0], part[1:] != part[:-1]]))
        key = place[doc] * len(coded.dictionary) + coded.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        key, doc, tf = key[order], doc[order], tf[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(head, len(key)))
        postings = pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(tf), pa.array(n_tokens[doc])], names=["doc_id", "tf", "n_tokens"])
        held = pa.ListArray.from_arrays(pa.array(np.append(head, len(key)).astype(np.int32)), postings)
        columns = {"token": coded.dictionary.take(pa.array(key[head] % len(coded.dictionary))), "part": pa.array(part[doc[head]]), "n": pa.array(sizes), "total": pa.array(np.add.reduceat(tf, head))}
        columns |= {"top_tf": pa.array(np.maximum.reduceat(tf, head)), "low_tokens": pa.array(np.minimum.reduceat(n_tokens[doc], head)), "postings": held}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, waiting, last = [], 0, None
        for batch in batches:
            part = batch.column("part").to_numpy()
            cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                if a == b:
                    continue
                if waiting >= HELD and part[a] != last:
                    yield blocks(pieces)
                    pieces, waiting = [], 0
                last = part[a]
                pieces.append(batch.slice(a, b - a))
                waiting += pc.sum(pc.binary_length(pieces[-1].column("words"))).as_py()
        if pieces:
            yield blocks(pieces)

    fields = f"token string, part int, n long, total long, top_tf long, low_tokens long, postings array<struct<doc_id:{kind},tf:bigint,n_tokens:bigint>>"
    return counts.select("doc_id", "part", "n_tokens", "words", "tfs").mapInArrow(run, fields)


def write_segment(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", gone: DataFrame | None = None, like: list[str] | None = None) -> None:
    """A segment of ``docs`` under ``path``; ``gone`` has documents (the same columns) of earlier segments that no longer count.

    A segment that takes the place of those at ``like`` has the sum of their statistics.
    """
    spark = docs.sparkSession
    docs.select(F.col(id_col).alias("doc_id")).write.mode("overwrite").parquet(f"{path}/documents")
    n_docs = spark.read.parquet(f"{path}/documents").count()
    among = max(1, -(-n_docs // (RANGE * LENGTHS)))
    length = F.floor(4 * F.log2(F.col("n_tokens") + 1.0)).cast("int")
    dealt = _counts(docs, id_col, text_col).withColumn("part", length * among + F.pmod(F.xxhash64("doc_id"), F.lit(among)).cast("int"))
    # Documents move to their range once, as counted words; its blocks are made there, and no posting moves.
    # Their tasks are numbered, as tasks that Spark puts together are too large to sort without spills.
    tasks = max(1, min(default_partitions(spark), -(-n_docs // (8 * RANGE))))
    blocks = _blocks(dealt.repartition(tasks, "part").sortWithinPartitions("part"))
    blocks.sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/blocks")
    if like:
        spark.read.parquet(*(f"{p}/terms" for p in like)).groupBy("token").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).write.mode("overwrite").parquet(f"{path}/terms")
        spark.read.parquet(*(f"{p}/numbers" for p in like)).agg(F.sum("n_docs").alias("n_docs")).write.mode("overwrite").parquet(f"{path}/numbers")
        return
    heads = spark.read.parquet(f"{path}/blocks").groupBy("token").agg(F.sum("n").alias("df"), F.sum("total").alias("total"))
    change = F.lit(n_docs).cast("long")
    if gone is not None:
        lost = stage_table(_counted(_tokens(gone, id_col, text_col)), "lost")
        heads = heads.unionByName(lost.groupBy("token").agg((-F.count("*")).alias("df"), (-F.sum("tf")).alias("total")))
        heads = heads.groupBy("token").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        change = change - gone.count()
    heads.write.mode("overwrite").parquet(f"{path}/terms")
    spark.range(1).select(change.alias("n_docs")).write.mode("overwrite").parquet(f"{path}/numbers")


def read_segments(spark: SparkSession, paths: dict[int, str], gone: DataFrame | None = None) -> LexicalIndex:
    """The index of the segments at ``paths``, by their order; ``gone`` (doc_id, before) names documents of segments below ``before``.

    An idf below zero becomes EPSILON times the mean idf of all terms.
    """

    def read(table: str) -> DataFrame:
        found = None
        for seq, path in sorted(paths.items()):
            one = spark.read.parquet(f"{path}/{table}").withColumn("seq", F.lit(seq))
            found = one if found is None else found.unionByName(one)
        return found

    terms = read("terms")
    if len(paths) > 1:  # a segment has a token once
        terms = terms.groupBy("token").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    terms = terms.where("df > 0")
    n_docs = read("numbers").agg(F.sum("n_docs")).first()[0]
    raw_idf = F.log(F.lit(float(n_docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = terms.withColumn("raw_idf", raw_idf)
    mean, total = terms.agg(F.coalesce(F.avg("raw_idf"), F.lit(0.0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    terms = terms.select("token", "df", F.when(F.col("raw_idf") < 0, EPSILON * mean).otherwise(F.col("raw_idf")).alias("idf"))
    documents = read("documents")
    if gone is not None:
        documents = _left(documents, gone)
    return LexicalIndex(read("blocks"), terms, documents.select("doc_id"), n_docs, total / n_docs if n_docs else 0.0, gone)


def _left(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (doc_id, seq) whose document was not gone later."""
    later = gone.select(F.col("doc_id").alias("_gone"), "before")
    return rows.join(later, (F.col("doc_id") == F.col("_gone")) & (F.col("seq") < F.col("before")), "left_anti")


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """An index of one segment."""
    write_segment(docs, path, id_col, text_col)


def read_index(spark: SparkSession, path: str) -> LexicalIndex:
    """An index as :func:`write_index` left it."""
    return read_segments(spark, {0: path})


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
    """An index for this session alone."""
    path = stage_path(docs.sparkSession, "lexical")
    write_index(docs, path, id_col, text_col)
    return read_index(docs.sparkSession, path)


def _part_score(index: LexicalIndex, tf: Column, n_tokens: Column) -> Column:
    return F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_tokens / F.lit(index.avg_tokens)))


def _postings(index: LexicalIndex, wanted: DataFrame) -> DataFrame:
    """query_id, doc_id and added of the postings of wanted blocks (HEAD, query_id, times, idf); those of lost documents are left out."""
    rows = index.blocks.join(wanted.select("token", "part", "seq", "query_id", "times", "idf"), ["token", "part", "seq"])
    rows = rows.select("query_id", "seq", "times", "idf", F.explode("postings").alias("p")).select("query_id", "seq", "times", "idf", "p.doc_id", "p.tf", "p.n_tokens")
    if index.gone is not None:
        rows = _left(rows, index.gone)
    return rows.select("query_id", "doc_id", _part_score(index, F.col("tf"), F.col("n_tokens")).alias("added"))


def choose_blocks(index: LexicalIndex, asked: DataFrame, top: int) -> DataFrame:
    """Blocks that can take part in a query's result, from the tokens asked for (query_id, token, times): HEAD, query_id, times, idf, bound, needed.

    ``needed`` says whether the block is read, which goes by its range.
    """
    weighted = broadcast_if_small(index.terms.join(asked, "token"), "query-terms")
    blocks = index.blocks
    tokens = weighted.select("token").distinct().limit(PUSHED_TOKENS + 1).collect()
    if len(tokens) <= PUSHED_TOKENS:  # then row groups without any of them are not read
        index.blocks = blocks = blocks.where(F.col("token").isin([r.token for r in tokens]))
    heads = blocks.select(*HEAD).join(weighted, "token").withColumn("bound", F.greatest(F.lit(0.0), _part_score(index, F.col("top_tf"), F.col("low_tokens"))))
    heads = stage_table(heads, "block-heads")
    sums = heads.groupBy("query_id", "seq", "part").agg(F.sum("bound").alias("most"), F.min("idf").alias("least"))
    order = Window.partitionBy("query_id").orderBy(F.desc("most"), "seq", "part")
    sums = stage_table(sums.withColumn("place", F.row_number().over(order)), "range-bounds")
    first = heads.join(sums.where(F.col("place") <= FIRST_RANGES), ["query_id", "seq", "part"])
    scores = _postings(index, first).groupBy("query_id", "doc_id").agg(F.sum("added").alias("sum"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("sum"), "doc_id")
    reached = scores.withColumn("_place", F.row_number().over(by_score)).where(F.col("_place") == top).select("query_id", F.col("sum").alias("reached"))
    # Scores are compared to six digits; a weight below zero bounds nothing.
    negative = F.min("least").over(Window.partitionBy("query_id")) < 0
    open_ = F.col("reached").isNull() | (F.col("most") >= F.col("reached") - CLOSE) | negative
    told = sums.join(broadcast_if_small(reached, "reached"), "query_id", "left").select("query_id", "seq", "part", open_.alias("needed"))
    return heads.join(told, ["query_id", "seq", "part"])


def _asked_of(table: pa.Table, top: int) -> list[dict]:
    """A cell's queries, so many at once that their weights are a small matrix: ids, tokens, weights (query by token), and the best scores so far."""
    query = table.column("query_id").combine_chunks().dictionary_encode()
    of, out, first = query.indices.to_numpy(), [], 0
    counts = np.bincount(of, minlength=len(query.dictionary))
    order, ends = np.argsort(of, kind="stable"), np.cumsum(counts)
    tokens, weights = table.column("token").combine_chunks(), table.column("weight").to_numpy()
    while first < len(counts):
        last = min(first + TOGETHER, max(first + 1, int(np.searchsorted(ends, ends[first] - counts[first] + PAIRS, "right"))))
        rows = order[ends[first] - counts[first] : ends[last - 1]]
        coded = tokens.take(pa.array(rows)).dictionary_encode()
        matrix = np.zeros((last - first, len(coded.dictionary)))
        np.add.at(matrix, (of[rows] - first, coded.indices.to_numpy()), weights[rows])
        out.append({"ids": query.dictionary.slice(first, last - first), "tokens": coded.dictionary, "weights": matrix, "signed": bool((weights[rows] <= 0).any()), "best": np.full((last - first, top), -np.inf), "found": []})
        first = last
    return out


def _best_found(held: dict) -> int:
    """Leaves of what a cell's queries found what their best scores so far let be in the result; the number left."""
    if held["found"]:
        query, ids, score = zip(*held["found"], strict=True)
        query, ids, score = np.concatenate(query), pa.concat_arrays(ids), np.concatenate(score)
        kept = np.flatnonzero(score >= held["best"].min(axis=1)[query] - CLOSE)
        held["found"] = [(query[kept], ids.take(pa.array(kept)), score[kept])]
    return sum(len(query) for query, _, _ in held["found"])


def _scores(held: dict, token: pa.Array, sizes: np.ndarray, doc: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query, document (its number) and score of what can be among the best, from blocks (token, size) of postings (doc, value)."""
    at = pc.index_in(token, held["tokens"]).fill_null(-1).to_numpy(zero_copy_only=False)
    row = np.repeat(at, sizes)
    kept = np.flatnonzero(row >= 0)
    kept = kept[np.argsort(doc[kept], kind="stable")]
    row, doc, value = row[kept], doc[kept], value[kept]
    numbers, starts = np.unique(doc, return_index=True)
    for first in range(0, len(numbers), DOCUMENTS):
        here = numbers[first : first + DOCUMENTS]
        a, b = starts[first], starts[first + DOCUMENTS] if first + DOCUMENTS < len(numbers) else len(doc)
        present, local = np.unique(row[a:b], return_inverse=True)
        block = np.zeros((len(present), len(here)))
        np.add.at(block, (local, np.searchsorted(here, doc[a:b])), value[a:b])
        weights = held["weights"][:, present]
        scores = weights @ block
        matched = ((weights != 0).astype(float) @ (block > 0)) > 0 if held["signed"] else scores > 0
        scores[~matched] = -np.inf
        top = held["best"].shape[1]
        both = np.concatenate([held["best"], scores], axis=1)
        held["best"] = np.partition(both, both.shape[1] - top, axis=1)[:, -top:]
        query, column = np.nonzero(matched & (scores >= held["best"].min(axis=1)[:, None] - CLOSE))
        yield query, here[column], scores[query, column]


def _in_cells(index: LexicalIndex, asked: DataFrame, top: int) -> DataFrame:
    """query_id, doc_id and added of the documents that can be among the best ``top``, from (query_id, token, times, idf)."""
    spark = index.blocks.sparkSession
    parts = default_partitions(spark)
    groups = max(1, -(-asked.select("query_id").distinct().count() // QUERY_BLOCK))
    deals = max(1, -(-parts // groups))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    blocks = index.blocks.join(broadcast_if_small(asked.select("token").distinct(), "asked-tokens"), "token", "left_semi")
    if index.gone is not None:  # blocks without the documents that are gone
        singles = _left(blocks.select("token", "part", "seq", F.explode("postings").alias("p")).select("token", "part", "seq", "p.*"), index.gone)
        blocks = singles.groupBy("token", "part", "seq").agg(F.collect_list(F.struct("doc_id", "tf", "n_tokens")).alias("postings"))
    id_type, query_type = index.documents.schema["doc_id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    cell = (F.col("group") * deals + F.col("deal")).alias("cell")
    rows = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group"), every(deals).alias("deal"), "query_id", "token", (F.col("times") * F.col("idf")).alias("weight"))
    rows = rows.select(cell, F.lit(-1).alias("seq"), F.lit(-1).alias("part"), "token", "query_id", "weight", none(f"array<{id_type}>").alias("ids"), none("array<int>").alias("tfs"), none("array<int>").alias("lengths"))
    there = blocks.select(every(groups).alias("group"), F.pmod(F.xxhash64("seq", "part"), F.lit(deals)).cast("int").alias("deal"), "seq", "part", "token", "postings")
    lists = F.col("postings.doc_id").alias("ids"), F.col("postings.tf").cast("array<int>").alias("tfs"), F.col("postings.n_tokens").cast("array<int>").alias("lengths")
    there = there.select(cell, F.col("seq").cast("int").alias("seq"), F.col("part").cast("int").alias("part"), "token", none(query_type).alias("query_id"), none("double").alias("weight"), *lists)
    dealt = rows.unionByName(there).repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell", "seq", "part")
    average = index.avg_tokens

    def told(held: list[dict], most: int = 0) -> Iterator[pa.RecordBatch]:
        if sum(_best_found(some) for some in held) > most:  # ties may be any number
            for some in held:
                for query, ids, score in some["found"]:
                    yield pa.RecordBatch.from_arrays([some["ids"].take(pa.array(query)), ids, pa.array(score)], names=["query_id", "doc_id", "added"])
                some["found"] = []

    def scored(held: list[dict], pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(pieces).combine_chunks()
        token, ids, tfs, lengths = (table.column(c).combine_chunks() for c in ("token", "ids", "tfs", "lengths"))
        coded = ids.flatten().dictionary_encode()
        tf, n = tfs.flatten().to_numpy().astype(float), lengths.flatten().to_numpy()
        value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / average))
        sizes, doc = np.diff(ids.offsets.to_numpy()), coded.indices.to_numpy()
        for some in held:
            for query, number, score in _scores(some, token, sizes, doc, value):
                some["found"].append((query, coded.dictionary.take(pa.array(number)), score))
        if sum(len(query) for some in held for query, _, _ in some["found"]) > FOUND:
            yield from told(held, FOUND // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asking, held, pieces, waiting, range_ = -1, [], [], [], 0, None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("cell", "seq", "part")])
            cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                cell, *this = place[:, a].tolist()
                if cell != now or (waiting >= POSTINGS and this != range_):
                    if pieces:  # whole ranges only, so that a document's postings are together
                        yield from scored(held, pieces)
                    pieces, waiting = [], 0
                if cell != now:
                    yield from told(held)
                    now, asking, held = cell, [], []
                range_ = this
                if this == [-1, -1]:
                    asking.append(batch.slice(a, b - a))
                    continue
                if asking:
                    held, asking = _asked_of(pa.Table.from_batches(asking), top), []
                if held:
                    pieces.append(batch.slice(a, b - a))
                    ends = pieces[-1].column("ids").offsets
                    waiting += ends[-1].as_py() - ends[0].as_py()
        if pieces:
            yield from scored(held, pieces)
        yield from told(held)

    return dealt.mapInArrow(run, f"query_id {query_type}, doc_id {id_type}, added double")


def search(index: LexicalIndex, queries: DataFrame, top: int = 20, matched_only: bool = False, id_col: str = "query_id", text_col: str = "question") -> DataFrame:
    """query_id, doc_id, score and rank of the best ``top`` documents of each query, equal scores (to 6 digits) by id.

    A query's repeated tokens count each time.  Unless ``matched_only``, documents without any query token fill up the
    list at score 0, smallest ids first; a query without tokens has no list.
    """
    index = LexicalIndex(**vars(index))
    asked = queries.select(F.col(id_col).alias("query_id"), F.explode(search_tokens(text_col)).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    asked = broadcast_if_small(asked, "query-tokens")
    if asked.count() <= FEW_ASKED:
        # Where the wanted blocks are few, postings stay where they are; else both sides meet by token and block.
        wanted = broadcast_if_small(choose_blocks(index, asked, top).where("needed"), "query-blocks")
        added = _postings(index, wanted)
    else:
        added = _in_cells(index, stage_table(index.terms.join(asked, "token").select("query_id", "token", "times", "idf"), "query-terms"), top)
    if not matched_only:
        # A list that is short of ``top`` matches finds its fill among the first 2 * top ids.
        fill = index.documents.orderBy("doc_id").limit(2 * top)
        added = added.unionByName(asked.select("query_id").distinct().crossJoin(F.broadcast(fill)).withColumn("added", F.lit(0.0)))
    scored = added.groupBy("query_id", "doc_id").agg(F.round(F.sum("added"), 6).alias("score"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)
