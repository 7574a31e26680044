"""A training-data pipeline over documents: each stage works on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import decontaminate, kernels, language_id, packing, simhash, substring_dedup
from quern.storage import broadcast_if_small, stage_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without letters or with a narrow margin go.  The other columns stay as they are.

    Null and empty texts have no letters.  Repeated rows, and rows that share a doc_id or have none, are judged each on
    their own.  Labels in ``lang`` are learned from where there are some; without any, no row has a language.
    """
    names = [kernels.free_name(n, docs.columns) for n in ("lang_pred", "score", "margin", "accepted")]
    found = language_id.identify(docs, language_id.fit_dictionaries(docs), keep=docs.columns)
    return found.where(F.col(names[-1])).drop(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of smallest doc_id, and of those with that doc_id the one of smallest hash.

    Rows are told apart by a hash of all columns and of which of them are null; columns of any type take part.  Rows
    without a doc_id all stay.  Rows without words (null texts too) are one group.  Rows equal in all columns are one.
    """
    key = kernels.free_name("_row_key", docs.columns)
    fields = kernels.columns(docs.columns)
    values = [F.to_json(F.struct(c)) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) else c for c, f in zip(fields, docs.schema, strict=True)]
    keyed = docs.withColumn(key, F.xxhash64(F.array(*(c.isNull() for c in fields)), *values))
    found = stage_table(simhash.similar_documents(keyed, key=key).where("doc_id is not null"), "similar")
    gone = found.where(F.struct("doc_id", "row_key") != F.col("component_id")).select(F.col("row_key").alias(key)).distinct()
    gone = broadcast_if_small(gone, "near-copies")
    kept = keyed.join(gone, key, "left_anti")
    if found.groupBy("row_key").count().where("count > 1").limit(1).count():  # rows equal in all columns
        kept = kept.where("doc_id is not null").dropDuplicates([key]).unionByName(kept.where("doc_id is null"))
    return kept.select(*kernels.columns(docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier; a document of which no word is left goes.

    A null or empty text stays as it is.  Rows that share a doc_id come in the order of their texts' hashes; rows without
    one come last; repeated rows lose nothing to each other.
    """
    names = [kernels.free_name(n, docs.columns) for n in ("n_words", "n_removed", "kept_sha256", "kept_text", "factors")]
    words, removed, _, text, _ = (F.col(n) for n in names)
    found = substring_dedup.remove_duplicates(docs, keep=[c for c in docs.columns if c != "text"]).where((removed == 0) | (removed < words))
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(removed > 0, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumns(out).select(*kernels.columns(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands.

    Null and empty texts have no words and stay.  Rows are judged by doc_id and text, so repeated rows stay or go together.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(docs, benchmark).where("n_hit > 0").select("doc_key").distinct()
    found = broadcast_if_small(found, "contaminated")
    key = kernels.free_name("_doc_key", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return keyed.join(found.withColumnRenamed("doc_key", key), key, "left_anti").select(*kernels.columns(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of all documents that are left; a null text is empty, and every row is a document of its own."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Tokenisation and compression have no SQL form, so the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
