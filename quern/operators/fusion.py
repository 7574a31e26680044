"""Reciprocal rank fusion of ranked lists, and what gives one hit per parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT


def reciprocal_rank_fusion(lists: list[DataFrame], top: int = DEFAULT.fused_top, k: int = DEFAULT.rrf_k, id_col: str = "doc_id") -> DataFrame:
    """query_id, id, rrf_score and rank of the best ``top`` of several lists (query_id, id, rank from 1, score).

    A hit of several lists adds up; ties go to the earlier list, then to the better rank.  score_0, score_1, ... are the
    scores that the lists gave.
    """
    merged = None
    for number, hits in enumerate(lists):
        one = hits.select("query_id", id_col, "rank", F.lit(number).alias("list_no"), *(F.when(F.lit(number == i), F.col("score")).alias(f"score_{i}") for i in range(len(lists))))
        merged = one if merged is None else merged.unionByName(one)
    fused = merged.groupBy("query_id", id_col).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf_score"), F.min(F.struct("list_no", "rank")).alias("first"), *(F.max(f"score_{i}").alias(f"score_{i}") for i in range(len(lists))))
    best = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "first", id_col)
    return fused.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).drop("first")


def fuse_by_parent(hits: DataFrame, k: int = DEFAULT.rrf_k) -> DataFrame:
    """One hit per parent from several lists of one query (query_id, list_no, rank from 1, id, parent_id, ...).

    Every occurrence of a parent adds to its score, twice in one list too.  The hit that stands for it is the first one
    by list and rank; its scores from before the fusion are dropped.
    """
    key = F.coalesce(F.when(F.col("parent_id") != "", F.col("parent_id")), F.col("id").cast("string"))
    kept = [c for c in hits.columns if c not in ("query_id", "list_no", "rank", "rerank_score", "confidence", "rrf_score")]
    fused = hits.withColumn("fusion_key", key).groupBy("query_id", "fusion_key").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf_score"), F.min_by(F.struct(*kept), F.struct("list_no", "rank")).alias("hit"), F.min(F.struct("list_no", "rank")).alias("first"))
    best = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "first")
    return fused.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "fusion_key", "rrf_score", "hit.*")


def first_per_parent(hits: DataFrame, id_col: str = "id") -> DataFrame:
    """The best ranked hit of each parent; hits without a parent's id and text all stay."""
    whole = (F.coalesce("parent_id", F.lit("")) != "") & (F.coalesce("parent_text", F.lit("")) != "")
    # The kind stands before the key, so an id that reads like a parent's id is no parent.
    keyed = hits.withColumn("_kind", whole).withColumn("_key", F.when(whole, F.col("parent_id")).otherwise(F.col(id_col).cast("string")))
    order = Window.partitionBy("query_id", "_kind", "_key").orderBy("rank")
    return keyed.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_kind", "_key", "_n")
