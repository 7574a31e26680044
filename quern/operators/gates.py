"""What decides whether retrieved hits may be answered from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import fixed
from .probe import zip_by_position


def confidence_gate(hits: DataFrame, threshold: float = DEFAULT.confidence_threshold) -> DataFrame:
    """query_id, max_confidence and rejected (strictly below the threshold) of each query."""
    best = hits.groupBy("query_id").agg(F.coalesce(F.max("confidence"), F.lit(0.0)).alias("max_confidence"))
    return best.withColumn("rejected", F.col("max_confidence") < threshold)


def heuristic_verdict(confidence: Column, floor: float = DEFAULT.heuristic_floor) -> Column:
    """YES, or NO for a hit of very small confidence: the critic without a model."""
    return F.when(confidence < floor, "NO").otherwise("YES")


def parsed_verdicts(reply: Column, n: Column) -> Column:
    """``n`` verdicts from a model's reply, one a line: what is neither NO nor MAYBE is YES, missing ones are YES.

    Blank lines are no verdicts, so they don't shift the following ones.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    verdicts = F.transform(lines, lambda x: F.when(x.startswith("NO"), "NO").when(x.startswith("MAYBE"), "MAYBE").otherwise("YES"))
    return F.slice(F.concat(verdicts, F.array_repeat(F.lit("YES"), n)), F.lit(1), n)


def critic_text(content: Column, parent_text: Column) -> Column:
    """What a critic reads of a hit: the parent's text if there is one, 500 characters on one line."""
    return F.translate(F.substring(F.coalesce(F.when(parent_text != "", parent_text), content), 1, 500), "\n", " ")


def model_verdicts(hits: DataFrame, questions: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """``hits`` with the ``verdict`` that a model gives each of them; a call for the few hits of a query, YES where it fails."""
    shown = F.struct("rank", critic_text(F.col("content"), F.col("parent_text")).alias("text"))
    asked = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(shown)).alias("_shown")).join(questions.select("query_id", "question"), "query_id")
    lines = F.array_join(F.transform("_shown", lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(h.text, F.lit("")))), "\n")
    replied = asked.withColumn("_reply", model(F.concat(F.lit(fixed.CRITIC_RULES + "\n\n"), "question", F.lit("\n\n"), lines)))
    ranks = F.transform("_shown", lambda h: h.rank)
    pairs = replied.select("query_id", F.explode(zip_by_position(ranks, parsed_verdicts(F.col("_reply"), F.size("_shown")))).alias("v"))
    return hits.join(pairs.select("query_id", F.col("v.left").alias("rank"), F.col("v.right").alias("verdict")), ["query_id", "rank"])


def apply_critic(hits: DataFrame, maybe_penalty: float = 1.0, no_penalty: float = 0.3) -> DataFrame:
    """Hits by their ``verdict``: NO goes, YES comes before MAYBE, MAYBE loses confidence.

    If every hit of a query has NO, the one of largest confidence stays with ``no_penalty`` of it, as ALL_NO_PENALTY.
    """
    whole = Window.partitionBy("query_id")
    marked = hits.withColumn("_kept", F.max((F.col("verdict") != "NO").cast("int")).over(whole)).withColumn("_best", F.row_number().over(whole.orderBy(F.desc("confidence"), "rank")))
    left = marked.where((F.col("verdict") != "NO") | ((F.col("_kept") == 0) & (F.col("_best") == 1)))
    lost = (F.col("_kept") == 0) & (F.col("verdict") == "NO")
    left = left.withColumn("confidence", F.when(lost, F.col("confidence") * no_penalty).when(F.col("verdict") == "MAYBE", F.col("confidence") * maybe_penalty).otherwise(F.col("confidence")))
    left = left.withColumn("critic_verdict", F.when(lost, "ALL_NO_PENALTY").otherwise(F.col("verdict")))
    order = whole.orderBy((F.col("verdict") == "MAYBE").cast("int"), "rank")
    return left.withColumn("rank", F.row_number().over(order)).drop("_kept", "_best", "verdict")


VERDICT_SCHEMA = "verdict string, evidence string"


def answerability(reply: Column, context: Column, has_hits: Column, failed: Column | None = None) -> Column:
    """status, evidence and reason of a model's JSON reply about a context.

    No hits or an empty context: UNANSWERABLE.  No reply: SKIPPED, or ERROR where the call failed.  A reply is taken
    only if it is one of the two verdicts, and ANSWERABLE only if its evidence, of at least four characters, stands
    literally in the context; else SKIPPED.
    """
    inner = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.when(inner != "", inner).otherwise(reply), VERDICT_SCHEMA)
    verdict, evidence = F.upper(F.trim(parsed.verdict)), F.trim(F.coalesce(parsed.evidence, F.lit("")))
    grounded = (F.length(evidence) >= 4) & F.contains(F.coalesce(context, F.lit("")), evidence)
    row = lambda status, reason, proof=None: F.struct(F.lit(status).alias("status"), (F.lit("") if proof is None else proof).alias("evidence"), F.lit(reason).alias("reason"))
    out = F.when(~has_hits | (F.trim(F.coalesce(context, F.lit(""))) == ""), row("UNANSWERABLE", "nothing was found"))
    if failed is not None:
        out = out.when(failed, row("ERROR", "the model call failed"))
    out = out.when(reply.isNull(), row("SKIPPED", "no model"))
    out = out.when(verdict == "UNANSWERABLE", row("UNANSWERABLE", "the model says so", evidence))
    out = out.when((verdict == "ANSWERABLE") & grounded, row("ANSWERABLE", "the evidence stands in the context", evidence))
    return out.otherwise(row("SKIPPED", "the reply can't be relied on"))


def answerability_gate(status: Column, enabled: bool = True, skipped_passes: bool = True) -> Column:
    """Whether a question is refused.  A check that was skipped lets pass unless the caller says otherwise."""
    allowed = ["ANSWERABLE", "SKIPPED"] if skipped_passes else ["ANSWERABLE"]
    return F.lit(enabled) & ~status.isin(allowed)
