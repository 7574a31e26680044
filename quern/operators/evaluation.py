"""Measures of retrieval and rejection over labelled questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.text import keyword_hits


def metric_text(content: Column, parent_text: Column) -> Column:
    return F.coalesce(F.when(parent_text != "", parent_text), content, F.lit(""))


def cited(source: Column, must_cite: Column) -> Column:
    """Whether a source's path holds one of the wanted patterns."""
    return F.exists(must_cite, lambda p: F.contains(source, p))


def question_rows(questions: DataFrame, hits: DataFrame, threshold: float = DEFAULT.confidence_threshold) -> DataFrame:
    """One row of measures per question.

    ``questions``: query_id, keywords, must_cite, expect_reject, negative_type.  ``hits``: query_id, rank, source, text,
    confidence.  Precision is the share of hits with a keyword, recall the share of keywords in the joined texts (1
    without keywords), hit_at_k whether one of the first k sources is wanted.
    """
    joined = questions.select("query_id", "keywords", "must_cite").join(hits, "query_id")
    wanted = cited(F.col("source"), F.col("must_cite"))
    at = lambda k: F.max((wanted & (F.col("rank") <= k)).cast("int"))
    per = joined.groupBy("query_id").agg(
        F.avg((keyword_hits(F.col("text"), F.col("keywords")) > 0).cast("int")).alias("precision"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x.text), " ").alias("all_text"),
        F.max("confidence").alias("max_confidence"), at(1).alias("hit_at_1"), at(3).alias("hit_at_3"), at(5).alias("hit_at_5"),
    )
    rows = questions.join(per, "query_id", "left")
    n = F.size(F.coalesce("keywords", F.array().cast("array<string>")))
    recall = F.when(n == 0, F.lit(1.0)).otherwise(keyword_hits(F.col("all_text"), F.col("keywords")) / n)
    confidence = F.coalesce("max_confidence", F.lit(0.0))
    negative = F.coalesce("expect_reject", F.lit(False))
    hit = lambda k: F.coalesce(F.col(f"hit_at_{k}"), F.lit(0))
    answered = lambda k: ((confidence >= threshold) & (hit(k) == 1)).cast("int")
    return rows.select(
        "query_id", negative.alias("expect_reject"), "negative_type", F.round(F.coalesce("precision", F.lit(0.0)), 3).alias("context_precision"), F.round(recall, 3).alias("context_recall"),
        *(hit(k).alias(f"hit_at_{k}") for k in (1, 3, 5)), *(answered(k).alias(f"answer_hit_at_{k}") for k in (1, 3, 5)),
        confidence.alias("max_confidence"), F.when(negative, (confidence < threshold).cast("int")).alias("reject_correct"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """(metric, value) over all questions: means over the positive ones, and the share of rejections.

    The shares by kind of negative come from the same pass, by grouping sets.
    """
    means = ["context_precision", "context_recall", "hit_at_1", "hit_at_3", "hit_at_5", "answer_hit_at_1", "answer_hit_at_3", "answer_hit_at_5"]
    totals = rows.agg(*(F.round(F.avg(F.when(~F.col("expect_reject"), F.col(m))), 3).alias(m) for m in means), F.count_if(~F.col("expect_reject")).cast("double").alias("num_positive"), F.count_if(F.col("expect_reject")).cast("double").alias("num_negative"))
    names = [*means, "num_positive", "num_negative"]
    long = totals.selectExpr("stack({}, {}) as (metric, value)".format(len(names), ", ".join(f"'{n}', {n}" for n in names)))
    strata = reject_strata(rows)
    kind = F.when(F.col("stratum") == "all", F.lit("")).otherwise(F.concat(F.lit("_"), F.col("stratum")))
    shares = strata.select(F.concat(F.lit("reject_accuracy"), kind).alias("metric"), F.col("reject_accuracy").alias("value"))
    counts = strata.where("stratum <> 'all'").select(F.concat(F.lit("num_negative_"), F.col("stratum")).alias("metric"), F.col("n").cast("double").alias("value"))
    return long.unionByName(shares).unionByName(counts)


def reject_strata(rows: DataFrame) -> DataFrame:
    """stratum (``all``, or a kind of negative), n and reject_accuracy."""
    negatives = rows.where("expect_reject").select(F.coalesce("negative_type", F.lit("untyped")).alias("kind"), "reject_correct")
    grouped = negatives.groupingSets([[], [F.col("kind")]], F.col("kind")).agg(F.grouping("kind").alias("whole"), F.count("*").alias("n"), F.round(F.avg("reject_correct"), 3).alias("reject_accuracy"))
    return grouped.select(F.when(F.col("whole") == 1, "all").otherwise(F.col("kind")).alias("stratum"), "n", "reject_accuracy")


def answerability_summary(rows: DataFrame) -> DataFrame:
    """evaluated, definitive, coverage and accuracy of (status, expected) rows; only definite verdicts can be right."""
    definite = F.col("status").isin("ANSWERABLE", "UNANSWERABLE")
    counts = rows.agg(F.count("*").alias("evaluated"), F.count_if(definite).alias("definitive"), F.count_if(definite & (F.col("status") == F.col("expected"))).alias("correct"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 3)).otherwise(F.lit(0.0))
    return counts.select("evaluated", "definitive", share("definitive", "evaluated").alias("coverage"), share("correct", "definitive").alias("accuracy"))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, diff and improved of two runs (metric, value); null where a run lacks the metric."""
    both = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "full_outer")
    diff = F.round(F.col("after") - F.col("before"), 4)
    return both.select("metric", "before", "after", diff.alias("diff"), (diff > 0).alias("improved"))


def report_lines(compared: DataFrame) -> DataFrame:
    """metric and line: a row of fixed width with an arrow for better, worse or equal."""
    arrow = F.when(F.col("diff").isNull(), " ").when(F.col("diff") > 0, "↑").when(F.col("diff") < 0, "↓").otherwise("=")
    show = lambda c: F.lpad(F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))).otherwise("-"), 10, " ")
    return compared.select("metric", F.concat(F.rpad("metric", 36, " "), show("before"), show("after"), show("diff"), F.lit(" "), arrow).alias("line"))
