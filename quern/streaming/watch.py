"""Re-indexing when files change: change events are grouped into bursts, and each burst starts one pass.

On a table of events a burst is a session window.  On a stream a session would stay open until a later event moves the
watermark; there a timer in processing time, set anew by every event, ends a burst when nothing came for the gap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT
from ..operators.indexing import listing_changes
from ..sources.files import SUFFIXES, listing
from ..storage import drop_stage, stage_table

EVENT_SCHEMA = "path string, op string, ts timestamp"
BURST_SCHEMA = "first timestamp, last timestamp, n long"


def relevant(path: F.Column) -> F.Column:
    """Whether a file of a kind that is indexed changed; all kinds that are read are watched."""
    return F.lower(path).rlike(r"\.(" + "|".join(SUFFIXES) + ")$")


def snapshot_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change events (path, op, ts) between two listings (path, length, modified): a source of events that sees deletions too."""
    op = F.when(F.col("status") == "new", "created").when(F.col("status") == "changed", "modified").otherwise("deleted")
    return listing_changes(after, before).where("status <> 'unchanged'").select("path", op.alias("op"), F.current_timestamp().alias("ts"))


def bursts(events: DataFrame, gap_seconds: float = DEFAULT.debounce_seconds, key: str | None = None) -> DataFrame:
    """Runs of a table's events with at most ``gap_seconds`` between neighbours: first, last, n (and the key)."""
    window = F.session_window("ts", f"{int(gap_seconds * 1000)} milliseconds")
    grouped = events.groupBy(window, *([key] if key else [])).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return grouped.select(*([key] if key else []), "first", "last", "n")


def settled(events: DataFrame, gap_seconds: float = DEFAULT.debounce_seconds) -> DataFrame:
    """Bursts of a stream's events (first, last, n), each given out once nothing came for ``gap_seconds``.

    There is one timer, as one pass serves all changes.  Its state is three values, and a task first makes one row of the
    events it has, so a burst of any size is small where it meets.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, last = 0, None, None
        for batch in batches:
            times = [t for t in batch.column("ts").to_pylist() if t is not None]
            n += batch.num_rows
            first, last = min([*times, *([first] if first else [])], default=None), max([*times, *([last] if last else [])], default=None)
        if n:
            zoned = pa.timestamp("us", "UTC")
            yield pa.RecordBatch.from_pydict({"first": pa.array([first], zoned), "last": pa.array([last], zoned), "n": [n]})

    def wait(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, None, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"first": pd.to_datetime([held[0]]), "last": pd.to_datetime([held[1]]), "n": [held[2]]})
            return
        for frame in frames:
            first, last = frame["first"].dropna(), frame["last"].dropna()
            low, high = [x for x in (held[0], *first) if x is not None], [x for x in (held[1], *last) if x is not None]
            held = (min(low, default=None), max(high, default=None), held[2] + int(frame["n"].sum()))
        state.update(held)
        state.setTimeoutDuration(max(1, int(gap_seconds * 1000)))

    rows = events.select("ts").mapInArrow(combine, BURST_SCHEMA).withColumn("timer", F.lit(0))
    return rows.groupBy("timer").applyInPandasWithState(wait, BURST_SCHEMA, BURST_SCHEMA, "append", GroupStateTimeout.ProcessingTimeTimeout)


def start(events: DataFrame, reindex: Callable[[], None], gap_seconds: float = DEFAULT.debounce_seconds, checkpoint: str | None = None, once: bool = False, on_error: Callable[[Exception], None] | None = None) -> StreamingQuery:
    """Run ``reindex`` at the beginning and then once for every burst of relevant events.

    A failing pass is reported and does not end the stream.  With ``once`` what is there already counts as one burst for
    each micro-batch, no timer is waited for, and the stream ends when it has caught up.
    """

    def safely() -> None:
        try:
            reindex()
        except Exception as e:  # a pass that fails is tried again with the next change
            (on_error or (lambda x: print(f"re-indexing failed: {x}")))(e)

    safely()
    def serve(batch: DataFrame, _: int) -> None:
        if batch.count():  # all of it is run, as each partition's state has to be written for the next batch
            safely()

    wanted = events.where(relevant(F.col("path")))
    grouped = wanted if once else settled(wanted, gap_seconds)
    writer = grouped.writeStream.outputMode("append").foreachBatch(serve)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(50, int(gap_seconds * 250))} milliseconds")).start()


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of events from JSON lines that a notifier drops into a folder."""
    return spark.readStream.schema(EVENT_SCHEMA).json(folder)


def poll(spark: SparkSession, docs_root: str, folder: str, known: DataFrame | None = None) -> DataFrame:
    """Compare ``docs_root`` with ``known`` (a listing), drop the changes as events into ``folder``, and return what is there now.

    Names, lengths and times of change are compared; no file is read.
    """
    now = stage_table(listing(spark, docs_root), "polled")
    events = now.limit(0) if known is None else snapshot_events(known, now)
    if known is not None and not events.isEmpty():
        events.coalesce(1).write.mode("append").json(folder)
    return now


def poll_events(spark: SparkSession, docs_root: str, folder: str, seconds: float = DEFAULT.debounce_seconds) -> StreamingQuery:
    """A stream that looks at ``docs_root`` every ``seconds`` and drops what changed where :func:`read_events` finds it."""
    held = {"known": poll(spark, docs_root, folder)}

    def look(batch: DataFrame, _: int) -> None:
        before = held["known"]
        held["known"] = poll(spark, docs_root, folder, before)
        drop_stage(before)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(look).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()
