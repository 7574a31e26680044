"""Labelled question sets and saved results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION_SCHEMA = "id string, question string, ground_truth_keywords array<string>, must_cite string, expect_reject boolean, negative_type string, difficulty string, expect_answerability string"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON list.  ``must_cite`` may be a string or a list; a set that can't be read is an error."""
    rows = spark.read.schema(QUESTION_SCHEMA).option("multiLine", True).json(path)
    listed = F.from_json("must_cite", "array<string>")
    cite = F.when(F.col("must_cite").isNull(), F.array().cast("array<string>")).when(F.col("must_cite").startswith("["), listed).otherwise(F.array("must_cite"))
    reject = F.coalesce("expect_reject", F.lit(False))
    return rows.select(
        F.coalesce("id", F.substring(F.sha2("question", 256), 1, 12)).alias("query_id"), "question", F.coalesce("ground_truth_keywords", F.array().cast("array<string>")).alias("keywords"), cite.alias("must_cite"), reject.alias("expect_reject"), "negative_type", "difficulty",
        F.coalesce("expect_answerability", F.when(reject, "UNANSWERABLE").otherwise("ANSWERABLE")).alias("expect_answerability"),
    )


def overlapping_sources(dev: DataFrame, holdout: DataFrame) -> DataFrame:
    """Patterns that both sets cite; none in sets that are kept apart."""
    patterns = lambda df: df.where("not expect_reject").select(F.explode("must_cite").alias("source"))
    return patterns(dev).intersect(patterns(holdout))


def save_run(rows: DataFrame, summary: DataFrame, root: str, run: str) -> None:
    """Rows and summary of a run as JSON, a folder for each run."""
    rows.withColumn("run", F.lit(run)).write.partitionBy("run").mode("append").json(f"{root}/rows")
    summary.withColumn("run", F.lit(run)).write.partitionBy("run").mode("append").json(f"{root}/summary")


def latest_runs(spark: SparkSession, root: str, n: int = 2) -> DataFrame:
    """The summaries of the last ``n`` runs by name."""
    runs = spark.read.json(f"{root}/summary")
    names = runs.select("run").distinct().orderBy(F.desc("run")).limit(n)
    return runs.join(F.broadcast(names), "run")
