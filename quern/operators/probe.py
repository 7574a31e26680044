"""Stability of answers over repeated runs, and faithfulness of their claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.text import answer_state, has_refusal_marker, unfenced

STATES = ("SYSTEM_REFUSE", "REDIRECTED", "REFUSED", "DELIVERED")


def classify(runs: DataFrame, threshold: float = DEFAULT.confidence_threshold) -> DataFrame:
    """Runs (question, type, run, answer, confidence, expect_reject, keywords) with refused and state."""
    state = answer_state("answer", F.col("confidence"), F.col("expect_reject"), F.col("keywords"), threshold)
    return runs.withColumn("refused", has_refusal_marker("answer")).withColumn("state", state)


def question_summary(states: DataFrame) -> DataFrame:
    """runs, refusals, their share, the state (MIXED if there are several) and counts of states, by question and type."""
    counts = F.map_from_arrays(F.array(*[F.lit(s) for s in STATES]), F.array(*[F.count_if(F.col("state") == s) for s in STATES]))
    grouped = states.where("state is not null").groupBy("question", "type").agg(F.count("*").alias("runs"), F.count_if("refused").alias("refused_count"), F.min("state").alias("low"), F.max("state").alias("high"), F.min("refused").alias("refused_low"), F.max("refused").alias("refused_high"), counts.alias("state_counts"))
    return grouped.select("question", "type", "runs", "refused_count", F.round(F.col("refused_count") / F.col("runs"), 2).alias("refused_ratio"), (F.col("refused_low") == F.col("refused_high")).alias("stable"), F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("MIXED").alias("state"), "state_counts")


def aggregate(states: DataFrame, threshold: float = DEFAULT.confidence_threshold) -> DataFrame:
    """One row over all runs that have a state: counts of every state, zeros too, and rates by polarity."""
    rows = states.where("state is not null")
    refused = F.col("state") == "SYSTEM_REFUSE"
    negative = F.coalesce("expect_reject", F.lit(False))
    delivered = F.col("state") == "DELIVERED"
    counts = rows.agg(
        F.count("*").alias("n_records"), *(F.count_if(F.col("state") == s).alias(s.lower()) for s in STATES), F.count_if("refused").alias("legacy_refused"),
        F.count_if(refused & (F.col("confidence") < threshold)).alias("refused_by_confidence"), F.count_if(refused & ~(F.col("confidence") < threshold)).alias("refused_by_template"),
        F.count_if(~negative).alias("positive_records"), F.count_if(~negative & delivered).alias("positive_delivered"),
        F.count_if(negative).alias("negative_records"), F.count_if(negative & delivered).alias("false_delivered"), F.count_if(negative & refused).alias("gate_blocked"), F.count_if(negative & ~refused & ~delivered).alias("self_refused"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.round(a / F.col(b), 3)).otherwise(F.lit(0.0))
    return counts.select(
        "*", share(F.col("positive_delivered"), "positive_records").alias("delivery_rate"), share(F.col("negative_records") - F.col("false_delivered"), "negative_records").alias("non_delivery_rate"),
        share(F.col("gate_blocked"), "negative_records").alias("gate_share"), share(F.col("self_refused"), "negative_records").alias("self_refusal_share"),
    )


CLAIMS_SCHEMA = "claims array<struct<text:string,supported:boolean,evidence:string>>, score double"


def judged_claims(reply: Column) -> Column:
    """score and unsupported claims of a model's JSON reply; the share of supported claims where it gives no score."""
    parsed = F.from_json(unfenced(reply), CLAIMS_SCHEMA)
    claims = F.coalesce(parsed.claims, F.array().cast("array<struct<text:string,supported:boolean,evidence:string>>"))
    supported = F.size(F.filter(claims, lambda c: F.coalesce(c.supported, F.lit(False))))
    score = F.coalesce(parsed.score, F.when(F.size(claims) > 0, supported / F.size(claims)))
    return F.struct(score.alias("score"), F.transform(F.filter(claims, lambda c: ~F.coalesce(c.supported, F.lit(False))), lambda c: c.text).alias("unsupported"))


def faithfulness_summary(rows: DataFrame) -> DataFrame:
    """n, mean score (4 digits) of the rows that have one, and parse_failures, the others."""
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.count_if(F.col("score").isNull()).alias("parse_failures"))


def contexts_of(contexts: Column, sources: Column) -> Column:
    """A result's contexts, or those of its sources: the context of each, else its snippet."""
    texts = F.filter(F.transform(F.coalesce(sources, F.array().cast("array<struct<snippet:string,context:string>>")), lambda s: F.coalesce(F.when(s.context != "", s.context), s.snippet)), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.size(F.coalesce(contexts, F.array().cast("array<string>"))) > 0, contexts).otherwise(texts)


def zip_by_position(left: Column, right: Column) -> Column:
    """Pairs of two lists up to the end of the shorter one."""
    n = F.least(F.size(left), F.size(right))
    return F.when(n > 0, F.arrays_zip(F.slice(left, F.lit(1), F.greatest(n, F.lit(0))).alias("left"), F.slice(right, F.lit(1), F.greatest(n, F.lit(0))).alias("right")))
