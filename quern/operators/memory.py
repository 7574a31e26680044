"""Memories of users: a table (id, user_id, content, tags, created_at) that is appended to, searched and deleted from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.text import memory_tokens
from ..storage import broadcast_if_small, default_partitions

QUERIES, ITEMS = 2048, 4096  # queries and memories of a cell, about
TOGETHER, TOKENS, BLOCK = 256, 1 << 15, 1024  # queries, about so many tokens of them, and memories that are compared at once

SCHEMA = "id string, user_id string, content string, tags array<string>, created_at timestamp"


def new_items(spark: SparkSession, rows: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Rows (user_id, content, tags) as memories with ids of their own."""
    given = spark.createDataFrame(rows, "user_id string, content string, tags array<string>")
    return given.select(F.concat(F.lit("mem_"), F.expr("uuid()")).alias("id"), "user_id", "content", "tags", F.current_timestamp().alias("created_at"))


def append(items: DataFrame, path: str) -> None:
    items.write.mode("append").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The stored memories.  A file that can't be read is an error, never an empty store."""
    return spark.read.schema(SCHEMA).parquet(path)


def without(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Memories but those of ``ids``."""
    return items.join(ids.select("id"), "id", "left_anti")


def search(items: DataFrame, queries: DataFrame, top: int = DEFAULT.memory_top) -> DataFrame:
    """query_id, id, score and rank of the ``top`` memories of each query's user that share a token with it.

    The score is the number of shared tokens over the root of the number of query tokens.  A user's queries and memories
    are dealt into groups of a bounded size, a pair of groups is a cell of a shuffle, and a cell gives its ``top`` of each
    query: what a query shares a frequent word with never becomes rows.
    """
    asked = queries.select("query_id", "user_id", memory_tokens("question").alias("tokens")).where(F.size("tokens") > 0)
    held = items.select("id", "user_id", memory_tokens(F.concat_ws(" ", F.col("content"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))).alias("tokens"))
    number = lambda df, of, size: df.groupBy("user_id").agg(F.ceil(F.count("*") / size).cast("int").alias(of))
    groups = number(queries, "groups", QUERIES).join(number(items, "deals", ITEMS), "user_id")
    groups = broadcast_if_small(groups, "memory-groups")
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    query_type, id_type = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (items, "id")))
    left = asked.join(groups, "user_id").select("user_id", dealt("query_id", "groups").alias("group"), every("deals").alias("deal"), F.lit(0).alias("kind"), "query_id", F.lit(None).cast(id_type).alias("id"), "tokens")
    right = held.join(groups, "user_id").select("user_id", every("groups").alias("group"), dealt("id", "deals").alias("deal"), F.lit(1).alias("kind"), F.lit(None).cast(query_type).alias("query_id"), "id", "tokens")
    cell = ["user_id", "group", "deal"]
    cells = left.unionByName(right).repartition(default_partitions(items.sparkSession), *cell).sortWithinPartitions(*cell, "kind", "id")
    # A cell begins where a row differs from the one before; batches may cut it, so each row carries what it belongs to.
    rows = cells.select(F.struct(*cell).alias("cell"), "kind", "query_id", "id", "tokens")
    rows = rows.select(F.to_json("cell").alias("cell"), "kind", "query_id", "id", "tokens")

    def best_of(some: dict, ids: pa.Array, tokens: pa.Array) -> None:
        """The best memories so far; ids come in order, so of equal numbers of shared tokens earlier ones stay."""
        at = pc.index_in(tokens.flatten(), some["tokens"]).fill_null(-1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))
        row, at = row[at >= 0], at[at >= 0]
        present, local = np.unique(at, return_inverse=True)
        block = np.zeros((len(present), len(tokens)), np.float32)
        block[local, row] = 1
        shared = (some["holds"][:, present] @ block).astype(np.int64)
        both = np.concatenate([some["shared"], shared], axis=1)
        # One number orders by shared tokens, then by place; places are below the width.
        width = both.shape[1]
        key = both * width + np.arange(width)[::-1]
        best = np.argsort(-key, axis=1, kind="stable")[:, :top] if width <= 4 * top else np.argpartition(-key, top, axis=1)[:, :top]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(key, best, axis=1), axis=1), axis=1)
        some["shared"] = np.take_along_axis(both, best, axis=1)
        known = some["ids"] + ids.to_pylist()
        places = np.concatenate([some["at"], np.broadcast_to(np.arange(len(some["ids"]), len(known)), shared.shape)], axis=1)
        kept, again = np.unique(np.take_along_axis(places, best, axis=1), return_inverse=True)
        some["ids"], some["at"] = [known[k] for k in kept], again.reshape(best.shape)

    def asked_of(pieces: list[pa.RecordBatch]) -> list[dict]:
        table = pa.Table.from_batches(pieces)
        out, first = [], 0
        ends = np.cumsum(pc.list_value_length(table.column("tokens")).to_numpy())
        while first < table.num_rows:
            before = ends[first - 1] if first else 0
            last = min(first + TOGETHER, max(first + 1, int(np.searchsorted(ends, before + TOKENS, "right"))))
            part, first = table.slice(first, last - first).combine_chunks(), last
            tokens = part.column("tokens").combine_chunks()
            coded = tokens.flatten().dictionary_encode()
            sizes = np.diff(tokens.offsets.to_numpy())
            holds = np.zeros((len(sizes), len(coded.dictionary)), np.float32)
            holds[np.repeat(np.arange(len(sizes)), sizes), coded.indices.to_numpy()] = 1
            out.append({"queries": part.column("query_id").combine_chunks(), "n": sizes, "tokens": coded.dictionary, "holds": holds, "shared": np.zeros((len(sizes), top), np.int64), "ids": [None], "at": np.zeros((len(sizes), top), np.int64)})
        return out

    def told(wanted: list[dict]) -> Iterator[pa.RecordBatch]:
        for some in wanted:
            row, column = np.nonzero(some["shared"])
            ids = [some["ids"][k] for k in some["at"][row, column].tolist()]
            yield pa.RecordBatch.from_arrays([some["queries"].take(pa.array(row)), pa.array(ids, kinds[id_type]), pa.array(some["shared"][row, column]), pa.array(some["n"][row].astype(np.int64))], names=["query_id", "id", "shared", "n"])

    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asking, wanted = None, [], []
        for batch in batches:
            name, kind = batch.column("cell").dictionary_encode(), batch.column("kind").to_numpy()
            place = name.indices.to_numpy()
            cuts = np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if (cell := name.dictionary[int(place[a])].as_py()) != now:
                    yield from told(wanted)
                    now, asking, wanted = cell, [], []
                if kind[a] == 0:
                    asking.append(batch.slice(a, b - a))
                    continue
                if asking:
                    wanted, asking = asked_of(asking), []
                for at in range(a, b, BLOCK):
                    part = batch.slice(at, min(BLOCK, b - at))
                    for some in wanted:
                        best_of(some, part.column("id"), part.column("tokens"))
        yield from told(wanted)

    met = rows.mapInArrow(run, f"query_id {query_type}, id {id_type}, shared long, n long")
    scored = met.select("query_id", "id", F.round(F.col("shared") / F.sqrt("n"), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def context_line(content: Column, tags: Column) -> Column:
    """A memory as a line of a prompt."""
    marks = F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ", ")
    return F.concat(F.lit("- "), content, F.when(marks != "", F.concat(F.lit(" ["), marks, F.lit("]"))).otherwise(F.lit("")))
