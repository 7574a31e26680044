"""What the registered queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: DuckDB expressions for the native tokenizers.
TOKENS = r"(regexp_extract_all(lower({0}), '[a-z0-9_]+') || regexp_extract_all({0}, '[一-鿿]'))"
MEMORY_TOKENS = r"list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
