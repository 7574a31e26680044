"""Contexts, sources and histories: what is put before a model and shown to a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import fixed
from ..functions.text import heading_at, lines_around, outline
from .fusion import first_per_parent


def _shown(hits: DataFrame) -> DataFrame:
    """One hit per parent, and the text that stands for it."""
    once = first_per_parent(hits)
    whole = (F.coalesce("parent_id", F.lit("")) != "") & (F.coalesce("parent_text", F.lit("")) != "")
    return once.withColumn("_whole", whole).withColumn("_shown", F.trim(F.when(whole, F.col("parent_text")).otherwise(F.coalesce("content", F.lit("")))))


def _ordered(rows: DataFrame, *columns: str) -> DataFrame:
    """An array per query of a bounded list of hits, in rank order."""
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("_hits"))


def model_context(hits: DataFrame) -> DataFrame:
    """query_id and context: numbered blocks with source and confidence, a blank line between them."""
    rows = _ordered(_shown(hits).withColumn("_source", F.coalesce("source", F.lit("unknown"))), "_source", "confidence", "_shown", "_whole")
    block = lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h._source, F.when(h._whole, F.lit(f" (parent chunk, {fixed.CONFIDENCE_MARK}")).otherwise(F.lit(f" ({fixed.CONFIDENCE_MARK}")), F.format_string("%.2f", F.coalesce(h.confidence, F.lit(0.0))), F.lit(")\n"), h._shown)
    return rows.select("query_id", F.array_join(F.transform("_hits", block), "\n\n").alias("context"))


def bounded_context(hits: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """query_id and context for a check of evidence: blocks cut to a size, until a total is reached.

    The block that would exceed the total is cut to what is left, if that is enough for a block; else it ends there.
    """
    rows = _ordered(_shown(hits).where("_shown <> ''").withColumn("_source", F.coalesce("source", F.lit("unknown"))), "_source", "_shown")
    start = F.struct(F.array().cast("array<string>").alias("blocks"), F.lit(0).alias("total"), F.lit(False).alias("done"))

    def add(state: Column, h: Column) -> Column:
        block = F.concat(F.lit("["), (F.size(state.blocks) + 1).cast("string"), F.lit("] "), h._source, F.lit("\n"), F.substring(h._shown, 1, config.block_chars))
        room = F.lit(config.context_chars) - state.total
        cut = F.when(F.length(block) > room, F.substring(block, F.lit(1), room)).otherwise(block)
        stop = state.done | ((F.length(block) > room) & (room < config.least_block_chars))
        return F.when(stop, F.struct(state.blocks.alias("blocks"), state.total.alias("total"), F.lit(True).alias("done"))).otherwise(F.struct(F.concat(state.blocks, F.array(cut)).alias("blocks"), (state.total + F.length(cut)).alias("total"), F.lit(False).alias("done")))

    return rows.select("query_id", F.array_join(F.aggregate("_hits", start, add).blocks, "\n\n").alias("context"))


def sources_of(hits: DataFrame, files: DataFrame | None = None, snippet_chars: int = 300, context: int = 2) -> DataFrame:
    """query_id, index, source, confidence, snippet, heading, line, context of each hit, one per parent.

    ``files`` (path, content) gives heading and lines around ``start_line`` for Markdown sources.
    """
    once = first_per_parent(hits)
    numbered = once.withColumn("index", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    line = F.coalesce("start_line", F.lit(0)) if "start_line" in hits.columns else F.lit(0)
    rows = numbered.select("query_id", "index", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.substring("content", 1, snippet_chars).alias("snippet"), line.alias("line"))
    if files is None:
        return rows.select("query_id", "index", "source", "confidence", "snippet", F.lit(None).cast("string").alias("heading"), "line", F.lit("").alias("context"))
    marked = files.where(F.lower("path").endswith(".md")).select(F.col("path").alias("source"), "content")
    both = rows.join(marked, "source", "left")
    heading = F.when(F.col("line") > 0, heading_at(outline("content"), F.col("line")).title)
    around = F.when(F.col("content").isNull(), "").otherwise(lines_around("content", F.greatest(F.lit(1), F.col("line")), context))
    return both.select("query_id", "index", "source", "confidence", "snippet", heading.alias("heading"), "line", around.alias("context"))


def history(messages: DataFrame, turns: int = DEFAULT.history_turns) -> DataFrame:
    """conv_id and history: the last ``2 * turns`` messages, one a line with who speaks."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = messages.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= 2 * turns)
    line = F.concat(F.when(F.col("role") == "user", F.lit(fixed.USER_LINE)).otherwise(F.lit(fixed.ASSISTANT_LINE)), F.coalesce("text", F.lit("")))
    rows = recent.select("conv_id", "turn", line.alias("line")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("lines"))
    return rows.select("conv_id", F.array_join(F.transform("lines", lambda x: x.line), "\n").alias("history"))


def prompt(question: Column, context: Column, memory: Column | None = None, past: Column | None = None) -> Column:
    """The text of a model call: the rules of an answer, history, memories and context, then the question."""
    known = context if memory is None else F.when(F.coalesce(memory, F.lit("")) != "", F.concat(memory, F.lit("\n\n"), context)).otherwise(context)
    before = F.coalesce(past, F.lit(fixed.NO_HISTORY)) if past is not None else F.lit(fixed.NO_HISTORY)
    return F.concat(F.lit(fixed.ANSWER_RULES + "\n\n"), before, F.lit("\n\n"), known, F.lit("\n\n"), question)


def refusal(max_confidence: Column) -> Column:
    """The fixed text that stands for an answer below the confidence gate."""
    return F.concat(F.lit(fixed.NOT_FOUND_HEAD), F.format_string("%.2f", max_confidence), F.lit(fixed.NOT_FOUND_TAIL))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, width: float) -> DataFrame:
    """Rows of ``left`` with ``value`` of the right row that has the same keys and the largest ``at`` not above theirs, else null.

    Of right rows at the same place that with the largest value counts.  Both sides have ``keys`` and a number ``at``.
    Places are cut into stretches of ``width``, and a key's rows are ordered within a stretch only: a key of any size is
    spread over tasks, and what a stretch begins with comes from the last value of the stretches before it.
    """
    stretch = F.floor(F.col(at) / F.lit(width)).cast("long")
    marks = right.groupBy(*keys, at).agg(F.max(value).alias("_value")).withColumn("_stretch", stretch)
    lasts = marks.groupBy(*keys, "_stretch").agg(F.max_by("_value", at).alias("_last"))
    rows = left.withColumn("_stretch", stretch).withColumn("_left", F.lit(True))
    # Stretches of a key are few; those with left rows only take part to be told what came before.
    held = rows.select(*keys, "_stretch").distinct().join(lasts, [*keys, "_stretch"], "full_outer")
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    carried = held.withColumn("_before", before).where("_before is not null").select(*keys, "_stretch", "_before")
    both = rows.unionByName(marks.select(*keys, at, "_stretch", "_value"), allowMissingColumns=True)
    in_order = Window.partitionBy(*keys, "_stretch").orderBy(F.col(at), F.col("_left").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_value", ignorenulls=True).over(in_order)).where("_left").drop("_left", "_value")
    joined = seen.join(carried, [*keys, "_stretch"], "left")
    return joined.select(*left.columns, F.coalesce("_seen", "_before").alias(value))
