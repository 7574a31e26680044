"""Queries over files, indexing passes, Markdown structure, pages and change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_page_text, expanded_variants, heading_at, html_text, infer_title, lines_around, outline
from ..operators import diagnostics, indexing
from ..sources import notion
from ..streaming.watch import bursts
from .common import Registry, table

R = Registry()

FILES = """
cur AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256 FROM documents WHERE doc_id % 11 <> 0),
old AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS sha256 FROM documents WHERE doc_id % 7 <> 0)"""


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files of two passes: some are gone in the second, some new, some changed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    before = docs.where("doc_id % 7 <> 0").withColumn("content", F.when(F.col("doc_id") % 13 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return indexing.manifest_of(docs.where("doc_id % 11 <> 0")), indexing.manifest_of(before)


@R.query(f"""WITH {FILES} SELECT coalesce(cur.path, old.path) AS path, CASE WHEN old.path IS NULL THEN 'new' WHEN cur.path IS NULL THEN 'deleted' WHEN cur.sha256 <> old.sha256 THEN 'changed' ELSE 'unchanged' END AS status FROM cur FULL OUTER JOIN old USING (path)""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.diff(*_files(spark, sf_dir))


@R.query(f"""WITH {FILES} SELECT cur.path, cur.sha256 FROM cur LEFT JOIN old USING (path) WHERE cur.sha256 IS DISTINCT FROM old.sha256""")
def manifest_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.changed_files(*_files(spark, sf_dir))


@R.query(f"WITH {FILES} SELECT path FROM old WHERE path NOT IN (SELECT path FROM cur)")
def manifest_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.deleted_files(*_files(spark, sf_dir))


@R.query(f"WITH {FILES} SELECT doc_id, source FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT path FROM old WHERE path NOT IN (SELECT path FROM cur))")
def keyed_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = indexing.deleted_files(*_files(spark, sf_dir))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), "doc_id", F.col("source").alias("folder"))
    return indexing.without_sources(chunks, gone).select("doc_id", F.col("folder").alias("source"))


@R.query(f"""WITH {FILES} SELECT (SELECT count(*) FROM cur) AS total_files, (SELECT count(*) FROM cur LEFT JOIN old USING (path) WHERE cur.sha256 IS DISTINCT FROM old.sha256) AS new_or_changed,
(SELECT count(*) FROM old WHERE path NOT IN (SELECT path FROM cur)) AS deleted, (SELECT count(*) FROM cur LEFT JOIN old USING (path) WHERE cur.sha256 IS DISTINCT FROM old.sha256) AS chunks_added""")
def index_pass_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, before = _files(spark, sf_dir)
    return indexing.index_summary(indexing.diff(current, before), indexing.changed_files(current, before))


MARKDOWN = """
md AS (SELECT doc_id, '# Title ' || doc_id || chr(10) || text || chr(10) || '## Part ' || source || chr(10) || 'end' AS content FROM documents),
lines AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM md),
heads AS (SELECT doc_id, length(regexp_extract(line, '^(#{1,6})\\s+(.+)$', 1)) AS level, trim(regexp_extract(line, '^(#{1,6})\\s+(.+)$', 2)) AS title, n AS line FROM lines WHERE regexp_matches(line, '^(#{1,6})\\s+(.+)$'))"""


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a heading before and behind their text, as the data has none."""
    content = F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n"), "text", F.lit("\n## Part "), "source", F.lit("\nend"))
    return table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))


@R.query(f"WITH {MARKDOWN} SELECT doc_id, CAST(level AS BIGINT) AS level, title, CAST(line AS BIGINT) AS line FROM heads")
def outline_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _markdown(spark, sf_dir).select("doc_id", F.explode(outline("content")).alias("h"))
    return rows.select("doc_id", F.col("h.level").cast("long").alias("level"), "h.title", F.col("h.line").cast("long").alias("line"))


@R.query(f"WITH {MARKDOWN} SELECT m.doc_id, (SELECT arg_max(title, line) FROM heads h WHERE h.doc_id = m.doc_id AND h.line <= 3) AS title FROM md m")
def heading_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markdown(spark, sf_dir).select("doc_id", heading_at(outline("content"), F.lit(3)).title.alias("title"))


@R.query(f"WITH {MARKDOWN} SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS around FROM lines WHERE n BETWEEN 1 AND 4 GROUP BY doc_id")
def line_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markdown(spark, sf_dir).select("doc_id", lines_around("content", F.lit(2), 2).alias("around"))


@R.query(f"WITH {MARKDOWN} SELECT count(*) AS files, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes FROM md")
def outline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.outline_totals(_markdown(spark, sf_dir).select(F.octet_length("content").cast("long").alias("size")))


@R.query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS content FROM pages""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_text("html").alias("content"))


@R.query(r"""WITH b AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN '## ' || text WHEN 1 THEN text WHEN 2 THEN '- ' || text WHEN 3 THEN '- [x] ' || text WHEN 4 THEN '```sql' || chr(10) || text || chr(10) || '```' ELSE '---' END AS md FROM conversations)
SELECT conv_id, '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg(md, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE md <> '') || chr(10) AS content, 'Conversation ' || conv_id AS filename FROM b GROUP BY conv_id""")
def notion_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as blocks of pages."""
    kind = F.col("turn") % 6
    block = F.struct(
        F.when(kind == 0, "heading_2").when(kind == 1, "paragraph").when(kind == 2, "bulleted_list_item").when(kind == 3, "to_do").when(kind == 4, "code").otherwise("divider").alias("type"),
        F.col("text"), F.lit("sql").alias("language"), F.lit(True).alias("checked"),
    )
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", block.alias("block")).alias("b")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b.block).alias("blocks"))
    title = F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))
    return pages.select("conv_id", notion.page_markdown(title, F.col("blocks")).alias("content"), notion.safe_filename(title).alias("filename"))


@R.query(r"""WITH e AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 3600000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, burst""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each user's events with at most an hour between neighbours."""
    return bursts(table(spark, sf_dir, "events"), 3600, key="user_id")


@R.query(r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(substr(text, 1, 500), chr(10))), ' ') AS line, generate_subscripts(string_split(substr(text, 1, 500), chr(10)), 1) AS n FROM documents)
SELECT d.doc_id, coalesce((SELECT arg_min(CASE WHEN starts_with(line, '# ') THEN trim(substr(line, 3)) ELSE line END, n) FROM l WHERE l.doc_id = d.doc_id AND (starts_with(line, '# ') OR (line <> '' AND NOT starts_with(line, '#') AND length(line) <= 80))), '') AS title FROM documents d""")
def inferred_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", infer_title("text").alias("title"))


@R.query()
def cleaned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", clean_page_text("text").alias("content"))


@R.query()
def query_variants_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variants of every benchmark item behind a vague question, as a list."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("What amount is due? "), "text").alias("question"))
    return rows.withColumn("variants", expanded_variants(F.col("question")))


QUERIES, SQL = R.queries, R.sql
