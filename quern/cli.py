"""Command line: ``python -m quern.cli COMMAND ...``.  Every command is one call of the library."""

from __future__ import annotations

import argparse
import json
import os
import time
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engine, providers
from .config import Config
from .operators import diagnostics, evaluation, memory, probe
from .sources import labelled, notion
from .streaming import watch


def _show(df: DataFrame) -> None:
    for row in df.toJSON().toLocalIterator():
        print(row)


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    """Bring a store up to date with a folder, and tell the webhook."""
    began = time.time()
    done = engine.reindex(engine.Store(spark, a.store), a.docs, force=a.force).first().asDict() | {"elapsed": round(time.time() - began, 2)}
    print(json.dumps(done))
    providers.notify(a.webhook, "index_done", done)


def query(spark: SparkSession, a: argparse.Namespace) -> None:
    """Answer one question."""
    asked = spark.createDataFrame([(0, a.question)], "query_id int, question string")
    _show(engine.answer(engine.Store(spark, a.store), asked, a.top_k))


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Measure a labelled set, or the one that is held out; with --save keep rows and summary under a name with the time."""
    questions = labelled.read_questions(spark, a.questions)
    if a.holdout:
        held = labelled.read_questions(spark, a.holdout)
        shared = [r["source"] for r in labelled.overlapping_sources(questions, held).collect()]
        if shared:
            raise SystemExit(f"both sets cite {', '.join(sorted(shared))}")
        questions = held
    config = Config.load(spark)
    if a.answerability:
        config = replace(config, evaluate_answerability=True)
    rows, summary = engine.evaluate(engine.Store(spark, a.store), questions, config)
    _show(summary)
    if a.save:
        labelled.save_run(rows, summary, a.save, datetime.now().strftime("%Y%m%d-%H%M%S"))


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    """Compare two saved runs, by default the last two."""
    names = a.runs or [r["run"] for r in labelled.latest_runs(spark, a.root).select("run").distinct().orderBy("run").collect()]
    if len(names) != 2:
        raise SystemExit("two runs are needed")
    saved = spark.read.json(f"{a.root}/summary")
    before, after = (saved.where(F.col("run") == n) for n in names)
    for row in evaluation.report_lines(evaluation.compare_runs(before, after)).orderBy("metric").toLocalIterator():
        print(row["line"])


def watch_folder(spark: SparkSession, a: argparse.Namespace) -> None:
    """Re-index at once and after every burst of change events."""
    store = engine.Store(spark, a.store)
    if a.poll:
        os.makedirs(a.events, exist_ok=True)
        watch.poll_events(spark, a.docs, a.events, a.poll)
    started = watch.start(watch.read_events(spark, a.events), lambda: print(engine.reindex(store, a.docs).first()), checkpoint=a.checkpoint, once=a.once)
    started.awaitTermination()


def remember(spark: SparkSession, a: argparse.Namespace) -> None:
    """Add to, search, list or delete from a memory table."""
    if a.action == "add":
        memory.append(memory.new_items(spark, [(a.user, a.text, a.tags or [])]), a.table)
        return
    items = memory.load(spark, a.table)
    if a.action == "search":
        asked = spark.createDataFrame([(0, a.user, a.text)], "query_id int, user_id string, question string")
        _show(memory.search(items, asked).join(items, "id").orderBy("rank"))
    elif a.action == "list":
        _show(items.where(F.col("user_id") == a.user).orderBy("created_at"))
    else:
        found = items.where(F.col("id") == a.text).limit(1).count() > 0
        if found:
            left = spark.createDataFrame([(a.text,)], "id string")
            kept = engine.stage_table(memory.without(items, left), "memories")
            kept.write.mode("overwrite").parquet(a.table)
        print(json.dumps({"deleted": found}))


def diagnose(spark: SparkSession, a: argparse.Namespace) -> None:
    """Size and roles of a store's chunks; with questions every check, and how many passed."""
    store = engine.Store(spark, a.store)
    _show(diagnostics.collection_size(store.chunks()))
    _show(diagnostics.role_counts(store.chunks()))
    if a.questions:
        checks = engine.stage_table(engine.diagnose(store, labelled.read_questions(spark, a.questions)), "checks")
        _show(checks)
        _show(checks.agg(F.count_if("passed").alias("passed"), F.count("*").alias("checks")))


def faithfulness(spark: SparkSession, a: argparse.Namespace) -> None:
    """Share of supported claims in saved results, as the model judges them."""
    schema = "question string, answer string, contexts array<string>, sources array<struct<snippet:string,context:string>>"
    results = spark.read.schema(schema).option("multiLine", True).json(a.results)
    judged = engine.stage_table(engine.faithfulness(results, Config.load(spark)), "faithfulness")
    _show(probe.faithfulness_summary(judged))
    _show(judged)
    if a.save:
        judged.coalesce(1).write.mode("overwrite").json(a.save)


def probes(spark: SparkSession, a: argparse.Namespace) -> None:
    """States of saved answers of repeated runs."""
    runs = spark.read.schema("question string, type string, run int, answer string, confidence double, expect_reject boolean, keywords array<string>").json(a.runs)
    states = probe.classify(runs)
    questions, totals = probe.question_summary(states), probe.aggregate(states)
    _show(questions)
    _show(totals)
    if a.save:
        questions.coalesce(1).write.mode("overwrite").json(f"{a.save}/questions")
        totals.coalesce(1).write.mode("overwrite").json(f"{a.save}/totals")


def import_notes(spark: SparkSession, a: argparse.Namespace) -> None:
    """Write the pages of a note-service dump as a table of Markdown texts; with --database the dump is fetched first, with --sync only what was edited since."""
    if a.database:
        (notion.sync_dump if a.sync else notion.fetch_dump)(spark, a.database, a.token or "", a.dump, a.url)
    notion.markdown_files(notion.read_dump(spark, a.dump)).write.mode("overwrite").parquet(a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quern")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name, call, *options):
        p = sub.add_parser(name, help=call.__doc__)
        for flags, settings in options:
            p.add_argument(*flags, **settings)
        p.set_defaults(call=call)

    store, docs = (("--store",), {"required": True}), (("--docs",), {"required": True})
    add("index", index, store, docs, (("--force",), {"action": "store_true"}), (("--webhook",), {}))
    add("query", query, store, (("question",), {}), (("--top-k",), {"type": int, "default": Config().top_k}))
    add("evaluate", evaluate, store, (("questions",), {}), (("--save",), {}), (("--holdout",), {}), (("--answerability",), {"action": "store_true"}))
    add("compare", compare, (("root",), {}), (("runs",), {"nargs": "*"}))
    add("watch", watch_folder, store, docs, (("--events",), {"required": True}), (("--checkpoint",), {}), (("--once",), {"action": "store_true"}), (("--poll",), {"type": float}))
    add("memory", remember, (("action",), {"choices": ["add", "search", "list", "delete"]}), (("text",), {"nargs": "?", "default": ""}), (("--table",), {"required": True}), (("--user",), {"default": "default"}), (("--tags",), {"nargs": "*"}))
    add("diagnose", diagnose, store, (("--questions",), {}))
    add("faithfulness", faithfulness, (("results",), {}), (("--save",), {}))
    add("probe", probes, (("runs",), {}), (("--save",), {}))
    add("notes", import_notes, (("dump",), {}), (("out",), {}), (("--database",), {}), (("--token",), {}), (("--url",), {"default": "https://api.notion.com/v1"}), (("--sync",), {"action": "store_true"}))
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = parser().parse_args(args)
    given.call(spark or SparkSession.builder.appName("quern").getOrCreate(), given)


if __name__ == "__main__":
    main()
