"""Pages of a note service, from dumps of its JSON, as Markdown."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stage_table

BLOCK = "type string, text string, language string, checked boolean"
PAGE_SCHEMA = f"id string, title string, blocks array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>"
# What stands before a block's text.
PREFIXES = {"paragraph": "", "heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ", "numbered_list_item": "1. ", "quote": "> "}


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """id, title and blocks of pages stored as one JSON object a line (``id``, ``properties``, ``_blocks``).

    Of a page that was stored more than once, the one edited last counts.
    """
    rich = "rich_text array<struct<plain_text:string>>, language string, checked boolean"
    kinds = [*PREFIXES, "code", "to_do"]
    fields = rich.replace(" ", ":", 1).replace(", ", ",").replace("language ", "language:").replace("checked ", "checked:")
    block = "type:string," + ",".join(f"{k}:struct<{fields}>" for k in kinds)
    schema = f"id string, last_edited_time string, properties map<string,struct<type:string,title:array<struct<plain_text:string>>>>, _blocks array<struct<{block}>>"
    pages = spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    # Whole pages stay where they are: only ids and times are compared, and most dumps hold each page once.
    last = pages.groupBy("id").agg(F.max(F.coalesce("last_edited_time", F.lit(""))).alias("_t"), F.count("*").alias("times"))
    again = last.where("times > 1").select("id", "_t")
    pages = pages.join(again, "id", "left").where(F.col("_t").isNull() | (F.coalesce("last_edited_time", F.lit("")) == F.col("_t"))).drop("_t")
    joined = lambda texts: F.array_join(F.transform(F.coalesce(texts, F.array().cast("array<struct<plain_text:string>>")), lambda t: F.coalesce(t.plain_text, F.lit(""))), "")
    titles = F.filter(F.map_values("properties"), lambda p: p.type == "title")
    title = F.when(F.size(titles) > 0, joined(F.element_at(titles, 1).title)).otherwise("Untitled")

    def plain(b: Column) -> Column:
        text, language, checked = F.lit(""), F.lit(None).cast("string"), F.lit(None).cast("boolean")
        for k in kinds:
            text = F.when(b.type == k, joined(b[k].rich_text)).otherwise(text)
        language = F.when(b.type == "code", b["code"].language)
        checked = F.when(b.type == "to_do", b["to_do"].checked)
        return F.struct(b.type.alias("type"), text.alias("text"), language.alias("language"), checked.alias("checked"))

    return pages.select("id", title.alias("title"), F.transform(F.coalesce("_blocks", F.expr(f"cast(array() as array<struct<{block}>>)")), plain).alias("blocks"))


def block_markdown(b: Column) -> Column:
    """One block (type, text, language, checked) as Markdown; an unknown type is empty."""
    out = F.lit("")
    for kind, prefix in PREFIXES.items():
        out = F.when(b.type == kind, F.concat(F.lit(prefix), b.text)).otherwise(out)
    out = F.when(b.type == "code", F.concat(F.lit("```"), F.coalesce(b.language, F.lit("")), F.lit("\n"), b.text, F.lit("\n```"))).otherwise(out)
    out = F.when(b.type == "to_do", F.concat(F.when(F.coalesce(b.checked, F.lit(False)), "- [x] ").otherwise("- [ ] "), b.text)).otherwise(out)
    return F.when(b.type == "divider", "---").otherwise(out)


def page_markdown(title: Column, blocks: Column) -> Column:
    """A title and the blocks that are not empty, a blank line between them."""
    body = F.array_join(F.filter(F.transform(blocks, block_markdown), lambda x: x != ""), "\n\n")
    return F.concat(F.lit("# "), title, F.lit("\n\n"), body, F.lit("\n"))


def safe_filename(title: Column) -> Column:
    """A title as a file name of at most 80 characters."""
    name = F.substring(F.trim(F.regexp_replace(title, r"[^\-_.() a-zA-Z0-9]", "_")), 1, 80)
    return F.when(name == "", "untitled").otherwise(name)


def markdown_files(pages: DataFrame) -> DataFrame:
    """path and content of pages (id, title, blocks); of those with one name the last by id stays."""
    rows = pages.select("id", F.concat(safe_filename(F.col("title")), F.lit(".md")).alias("path"), page_markdown(F.col("title"), F.col("blocks")).alias("content"))
    return rows.groupBy("path").agg(F.max_by("content", "id").alias("content"))


def _pages(url: str, token: str, body: dict | None) -> Iterator[dict]:
    """The results of a listing, page by page as its cursor says."""
    cursor = None
    while True:
        more = {"page_size": 100} | ({"start_cursor": cursor} if cursor else {})
        where = url if body is not None else f"{url}?{urllib.parse.urlencode(more)}"
        headers = {"Authorization": f"Bearer {token}", "Content-Type": "application/json", "Notion-Version": "2022-06-28"}
        with urllib.request.urlopen(urllib.request.Request(where, json.dumps(body | more).encode() if body is not None else None, headers), timeout=60) as answer:
            found = json.load(answer)
        yield from found.get("results", [])
        cursor = found.get("next_cursor")
        if not found.get("has_more") or not cursor:
            return


def _fetched(spark: SparkSession, database: str, token: str, url: str, body: dict) -> DataFrame:
    """page (its JSON), id and last_edited_time of the pages of a database that ``body`` asks for.

    A cursor can only be followed by one task, so one task lists the pages.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column("database").to_pylist():
                for page in _pages(f"{url}/databases/{one}/query", token, body):
                    yield pa.RecordBatch.from_pydict({"page": [json.dumps(page)], "id": pa.array([page.get("id")], pa.string()), "last_edited_time": pa.array([page.get("last_edited_time")], pa.string())})

    return spark.createDataFrame([(database,)], "database string").mapInArrow(listed, "page string, id string, last_edited_time string")


def _filled(pages: DataFrame, token: str, url: str, partitions: int) -> DataFrame:
    """Pages with their blocks, which many tasks fetch."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in map(json.loads, batch.column("page").to_pylist()):
                yield pa.RecordBatch.from_pydict({"value": [json.dumps(page | {"_blocks": list(_pages(f"{url}/blocks/{page['id']}/children", token, None))})]})

    return pages.select("page").repartition(partitions, "page").mapInArrow(fill, "value string")


def fetch_dump(spark: SparkSession, database: str, token: str, path: str, url: str = "https://api.notion.com/v1", partitions: int = 8) -> None:
    """Write the pages of a database of the note service as a dump for :func:`read_dump`, in place of what is there."""
    _filled(_fetched(spark, database, token, url, {}), token, url, partitions).write.mode("overwrite").text(path)


def sync_dump(spark: SparkSession, database: str, token: str, path: str, url: str = "https://api.notion.com/v1", partitions: int = 8) -> int:
    """Add to a dump what was edited since; the number of pages whose blocks were fetched.

    The service is asked for pages from the last time of edit in the dump on; of those, pages that are in it with that
    very time are left out.  Pages that were deleted stay in the dump: :func:`fetch_dump` begins anew.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    schema = "id string, last_edited_time string"
    known = spark.read.schema(schema).option("recursiveFileLookup", True).json(path) if there else spark.createDataFrame([], schema)
    since = known.agg(F.max("last_edited_time")).first()[0]
    body = {"filter": {"timestamp": "last_edited_time", "last_edited_time": {"on_or_after": since}}} if since else {}
    edited = stage_table(_fetched(spark, database, token, url, body).join(known.distinct(), ["id", "last_edited_time"], "left_anti"), "edited-notes")
    n = edited.count()
    if n:
        _filled(edited, token, url, partitions).write.mode("append").text(path)
    return n
