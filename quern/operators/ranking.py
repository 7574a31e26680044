"""Reranking, confidence, and hybrid retrieval put together from its parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import clamp
from . import dense, fusion, lexical


def rerank(candidates: DataFrame, score: Column | None, top_k: int = DEFAULT.top_k, id_col: str = "doc_id") -> DataFrame:
    """The ``top_k`` candidates of each query by ``score``; without one the first ``top_k`` as they stand."""
    if score is None:
        return candidates.where(F.col("rank") <= top_k)
    scored = candidates.withColumn("rerank_score", score)
    best = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.col("rank"), id_col)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


def with_confidence(hits: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Confidence in [0, 1] of the hits of each query.

    If the first hit has a rerank score, it is a weighted sum of that score and of the rrf score over the largest one of
    the hits returned; else ten times the rrf score, cut to 1.
    """
    per_query = Window.partitionBy("query_id")
    rerank_score = F.col("rerank_score") if "rerank_score" in hits.columns else F.lit(None).cast("double")
    first = F.first(rerank_score.isNotNull()).over(per_query.orderBy("rank"))
    finite = F.when(~F.isnan("rrf_score") & (F.abs("rrf_score") != float("inf")) & (F.col("rrf_score") > 0), F.col("rrf_score"))
    share = F.coalesce(finite / F.max(finite).over(per_query), F.lit(0.0))
    mixed = config.rerank_weight * clamp(rerank_score) + config.rrf_weight * clamp(share)
    return hits.withColumn("confidence", F.when(first, mixed).otherwise(clamp(F.col("rrf_score") * 10.0)))


def retrieve(index: lexical.LexicalIndex, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, reranker: Callable[[DataFrame], DataFrame] | None = None, config: Config = DEFAULT) -> DataFrame:
    """Hybrid retrieval for all queries: lexical and dense lists, fusion, rerank of the best, confidence.

    ``reranker`` adds ``pair_score`` to candidates (query_id, doc_id, ...); it sees only the fused list.
    """
    words = lexical.search(index, queries, config.lexical_top)
    near = dense.search(vectors, query_vectors, config.dense_top).withColumnRenamed("vec_id", "doc_id")
    fused = fusion.reciprocal_rank_fusion([words, near], config.fused_top, config.rrf_k)
    if reranker is not None and config.use_rerank:
        return with_confidence(rerank(reranker(fused), F.col("pair_score"), config.top_k), config)
    return with_confidence(rerank(fused, None, config.top_k), config)
