"""All registered queries of the library's own operators, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analysis, corpus, parts, pdfs, retrieval

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return retrieval.QUERIES | corpus.QUERIES | analysis.QUERIES | parts.QUERIES | pdfs.QUERIES


def oracle_sql() -> dict[str, str]:
    return retrieval.SQL | corpus.SQL | analysis.SQL | parts.SQL | pdfs.SQL
