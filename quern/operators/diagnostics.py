"""Checks of a store and of its retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def role_counts(chunks: DataFrame) -> DataFrame:
    """chunk_role and n over all chunks."""
    return chunks.groupBy(F.coalesce("chunk_role", F.lit("none")).alias("chunk_role")).agg(F.count("*").alias("n"))


def collection_size(chunks: DataFrame, low: int = 30, high: int = 60, duplicated: int = 90) -> DataFrame:
    """n and verdict of a store that is expected to hold between ``low`` and ``high`` chunks."""
    n = F.col("n")
    verdict = F.when(n > duplicated, "duplicated").when((n < low) | (n > high), "unexpected").otherwise("ok")
    return chunks.agg(F.count("*").alias("n")).withColumn("verdict", verdict)


def retrieval_checks(lexical: DataFrame, dense: DataFrame, hybrid: DataFrame) -> DataFrame:
    """check, passed: both lists have hits, confidences lie in [0, 1], and rerank scores differ."""
    some = lambda df, name: df.agg((F.count("*") > 0).alias("passed")).select(F.lit(name).alias("check"), "passed")
    inside = hybrid.agg(F.coalesce(F.min(F.col("confidence").between(0, 1)), F.lit(False)).alias("passed")).select(F.lit("confidence").alias("check"), "passed")
    checks = some(lexical, "lexical").unionByName(some(dense, "dense")).unionByName(inside)
    if "rerank_score" in hybrid.columns:
        spread = hybrid.agg(F.coalesce(F.max("rerank_score") - F.min("rerank_score") > 0.001, F.lit(False)).alias("passed"))
        checks = checks.unionByName(spread.select(F.lit("rerank_spread").alias("check"), "passed"))
    return checks


def outline_totals(outlines: DataFrame) -> DataFrame:
    """files and bytes of an outline table."""
    return outlines.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
