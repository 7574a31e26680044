"""Constants of the engine, and the switches that a session's configuration can turn."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    """Sizes are in characters, scores in [0, 1]."""

    chunk_size: int = 500
    chunk_overlap: int = 80
    parent_size: int = 1500
    parent_overlap: int = 100
    child_size: int = 200
    child_overlap: int = 30
    lexical_top: int = 20
    dense_top: int = 20
    fused_top: int = 30
    top_k: int = 5
    rrf_k: int = 60
    confidence_threshold: float = 0.30
    rerank_weight: float = 0.8
    rrf_weight: float = 0.2
    heuristic_floor: float = 0.10
    memory_top: int = 3
    history_turns: int = 4
    block_chars: int = 3500
    context_chars: int = 12000
    least_block_chars: int = 200
    debounce_seconds: float = 2.0
    embedding_dim: int = 512
    pdf_parser: str = "plain"
    embedder: str = "hashing"
    reranker: str = "overlap"
    llm: str = "none"
    use_rerank: bool = True
    use_parent_child: bool = False
    use_contextual: bool = False
    use_query_rewrite: bool = False
    use_answerability_check: bool = True
    use_critic: bool = False
    evaluate_answerability: bool = False

    def __post_init__(self) -> None:
        if self.embedding_dim <= 0 or self.top_k <= 0:
            raise ValueError("sizes must be positive")
        for size, overlap in ((self.chunk_size, self.chunk_overlap), (self.parent_size, self.parent_overlap), (self.child_size, self.child_overlap)):
            if not 0 <= overlap < size:
                raise ValueError("an overlap must be smaller than its chunk")

    @staticmethod
    def load(spark: SparkSession | None = None) -> Config:
        """Defaults, overridden by variables like ``QUERN_TOP_K``, and those by session settings like ``quern.top_k``."""
        values = {}
        for f in fields(Config):
            raw = os.environ.get(f"QUERN_{f.name.upper()}")
            if spark is not None:
                raw = spark.conf.get(f"quern.{f.name}", raw)
            if raw is not None:
                kind = type(f.default)
                values[f.name] = raw.strip().lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        return Config(**values)


DEFAULT = Config()
