"""Recursive and parent-child chunking of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import fixed
from ..functions.text import numbered_part
from .indexing import chunk_id

SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Parts of a text, each with the separator before it at its head."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def split_text(text: str | None, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the first kind of separator that the text has.

    Pieces are merged while they fit.  A new chunk begins with the last pieces of the one before, as many as fit into
    ``overlap``.  A piece that is too large is cut at the kinds that come later.  Chunks are stripped, empty ones go.
    """
    if not text:
        return []
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    out: list[str] = []
    window: list[str] = []
    held = 0

    def close() -> None:
        if chunk := "".join(window).strip():
            out.append(chunk)

    for piece in _pieces(text, separators[at]):
        if len(piece) > size:
            close()
            window, held = [], 0
            out += split_text(piece, size, overlap, separators[at + 1 :] or ("",))
            continue
        if held + len(piece) > size:
            close()
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.pop(0))
        window.append(piece)
        held += len(piece)
    close()
    return out


def splitter(size: int, overlap: int) -> Column:
    """:func:`split_text` as an Arrow-batched function of a text column."""

    @F.pandas_udf("array<string>")
    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: split_text(t, size, overlap))

    return split


def chunk(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """source, ordinal, content and chunk_id of the chunks of documents (source, content)."""
    rows = docs.select("source", F.posexplode(splitter(config.chunk_size, config.chunk_overlap)("content")).alias("ordinal", "content"))
    return rows.withColumn("chunk_id", chunk_id(F.col("source"), F.col("ordinal"), F.col("content")))


def parents(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """parent_id, source, parent_ordinal and parent_text.  A document of role ``pdf_metadata`` is one parent as it is."""
    role = F.col("chunk_role") if "chunk_role" in docs.columns else F.lit(None).cast("string")
    whole = F.coalesce(role == "pdf_metadata", F.lit(False))
    parts = F.when(whole, F.array("content")).otherwise(splitter(config.parent_size, config.parent_overlap)(F.when(~whole, F.col("content"))))
    rows = docs.withColumn("_whole", whole).select("source", "_whole", F.posexplode(parts).alias("parent_ordinal", "parent_text"))
    identity = F.substring(F.sha2(F.concat_ws("\u0001", "source", F.col("parent_ordinal").cast("string"), "parent_text"), 256), 1, 12)
    return rows.select(identity.alias("parent_id"), "source", "parent_ordinal", "parent_text", F.col("_whole").alias("is_metadata"))


def children(parent_rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """chunk_id, parent_id, source, ordinal, content and chunk_role of the children of :func:`parents`.

    The parents' texts stay in their own table; :func:`with_parents` brings them to the few hits that are shown.
    """
    parts = F.when(F.col("is_metadata"), F.array("parent_text")).otherwise(splitter(config.child_size, config.child_overlap)("parent_text"))
    rows = parent_rows.select("parent_id", "source", "is_metadata", F.posexplode(parts).alias("ordinal", "content"))
    role = F.when(F.col("is_metadata"), "pdf_metadata").otherwise("child")
    return rows.select(chunk_id(F.col("parent_id"), F.col("ordinal"), F.col("content")).alias("chunk_id"), "parent_id", "source", "ordinal", "content", role.alias("chunk_role"))


def with_parents(hits: DataFrame, parent_rows: DataFrame) -> DataFrame:
    """Hits with their parent's text, or their own content where no parent is found."""
    both = hits.join(parent_rows.select("parent_id", "parent_text"), "parent_id", "left")
    return both.withColumn("shown_text", F.coalesce(F.when(F.col("parent_text") != "", F.col("parent_text")), F.col("content")))


def described(chunks: DataFrame, titles: DataFrame, model: Callable[[Column], Column], together: int = 5) -> DataFrame:
    """``chunks`` with ``_described``, a model's sentence about each; ``together`` neighbours of a source are one call.

    ``titles`` has source and title.
    """
    place = ["source", F.coalesce("parent_id", F.lit("")).alias("_parent"), F.floor(F.col("ordinal") / together).alias("_part")]
    groups = chunks.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.substring("content", 1, 600).alias("text"), "chunk_id"))).alias("_rows")).join(titles, "source", "left")
    lines = F.array_join(F.transform("_rows", lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]\n"), r.text)), "\n\n")
    replied = groups.withColumn("_reply", model(F.concat(F.lit(fixed.CONTEXT_RULES + "\n\n"), F.coalesce("title", F.lit("")), F.lit("\n\n"), lines)))
    each = replied.select("_reply", F.posexplode("_rows").alias("_at", "_row"))
    return chunks.join(each.select(F.col("_row.chunk_id").alias("chunk_id"), numbered_part(F.col("_reply"), F.col("_at") + 1).alias("_described")), "chunk_id", "left")


def contextualise(chunks: DataFrame, describe: Column) -> DataFrame:
    """Chunks with a model's description before their content, or a fixed mark where it gave none."""
    text = F.when(F.coalesce(F.trim(describe), F.lit("")) != "", describe).otherwise(F.lit(fixed.NO_CONTEXT))
    return chunks.withColumn("context", text).withColumn("content", F.concat(F.lit(fixed.CONTEXT_OPEN), F.col("context"), F.lit(fixed.CONTEXT_CLOSE), F.col("content")))
