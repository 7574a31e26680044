"""Queries over PDF and .doc files, which tasks make of the given tables' rows before they are read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, pdf
from ..sources.doc import made_doc
from ..sources.made_pdf import grid_page, made_pdf, text_page
from ..storage import default_partitions
from .common import Registry, table

R = Registry()
WORDS_A_LINE, LINES_A_PAGE, ROWS_A_TABLE = 4, 45, 12
BATCH_BYTES = 1 << 22  # of files that a task gives on together
_FILE = "path string, content binary"


def _made(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in rows], pa.string()), "content": pa.array([c for _, c in rows], pa.binary())})


def _in_batches(made: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for row in made:
        rows.append(row)
        held += len(row[1])
        if held >= BATCH_BYTES:
            yield _made(rows)
            rows, held = [], 0
    if rows:
        yield _made(rows)


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over all tasks, however few files or row groups they lie in: a reader's work is far more than moving a text."""
    return table(spark, sf_dir, "documents").repartition(default_partitions(spark), "doc_id")


def _document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PDF file for each document: its words in lines on the left side of pages, and a title and a subject."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            for doc_id, text, lang in zip(*(batch.column(c) for c in ("doc_id", "text", "lang")), strict=True):
                doc_id, lang, words = doc_id.as_py(), lang.as_py(), (text.as_py() or "").split()
                lines = [" ".join(words[i : i + WORDS_A_LINE]) for i in range(0, len(words), WORDS_A_LINE)]
                contents = [text_page(lines[i : i + LINES_A_PAGE], size=5) for i in range(0, max(len(lines), 1), LINES_A_PAGE)]
                yield f"{doc_id}.pdf", made_pdf(contents, {"Title": f"Document {doc_id}", "Author": "(anonymous)", "Subject": lang or " "}, packed=doc_id % 2 == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(made(batches))

    return _spread(spark, sf_dir).select("doc_id", "text", "lang").mapInArrow(run, _FILE)


@R.query(f"""
WITH words AS (SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\x0B\\x0C]+') AS words FROM documents),
sized AS (SELECT *, greatest(1, CAST(ceil(ceil(len(words) / {WORDS_A_LINE}) / {LINES_A_PAGE}) AS INTEGER)) AS total_pages FROM words),
lines AS (SELECT doc_id, total_pages, line, array_to_string(list_slice(words, line * {WORDS_A_LINE} + 1, (line + 1) * {WORDS_A_LINE}), ' ') AS said
    FROM (SELECT *, unnest(range(CAST(ceil(len(words) / {WORDS_A_LINE}) AS BIGINT))) AS line FROM sized)),
pages AS (SELECT doc_id, CAST(line // {LINES_A_PAGE} + 1 AS INTEGER) AS page, total_pages, string_agg(said, chr(10) ORDER BY line) AS content FROM lines
    WHERE NOT regexp_matches(said, '^([0-9]+|[0-9]+ */ *[0-9]+)$') GROUP BY ALL)
SELECT doc_id, page, total_pages, 'single-column' AS layout, content FROM pages
UNION ALL SELECT doc_id, 0, 0, '', 'PDF Metadata:' || chr(10) || 'Title: Document ' || doc_id || CASE WHEN lang IS NULL THEN '' ELSE chr(10) || 'Subject: ' || lang END FROM documents""")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.parse(_document_files(spark, sf_dir)).where("error is null")
    return found.select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("doc_id"), "page", F.coalesce("total_pages", F.lit(0)).alias("total_pages"), F.coalesce("layout", F.lit("")).alias("layout"), "content")


@R.query(f"""
WITH rows AS (SELECT s_suppkey // {ROWS_A_TABLE} AS part, s_suppkey, s_name, CASE WHEN s_nationkey % 4 = 0 THEN '' ELSE CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier),
said AS (SELECT part, string_agg(rtrim(s_suppkey || ' ' || s_name || ' ' || nation), chr(10) ORDER BY s_suppkey) AS lines, string_agg('| ' || s_suppkey || ' | ' || s_name || ' | ' || nation || ' |', chr(10) ORDER BY s_suppkey) AS cells FROM rows GROUP BY part)
SELECT part, 'key name nation' || chr(10) || lines || chr(10) || '[Tables]' || chr(10) || '| key | name | nation |' || chr(10) || '| --- | --- | --- |' || chr(10) || cells AS content FROM said""")
def pdf_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").withColumn("part", F.floor(F.col("s_suppkey") / ROWS_A_TABLE).cast("long"))
    nation = F.when(F.col("s_nationkey") % 4 == 0, "").otherwise(F.col("s_nationkey").cast("string"))
    parts = rows.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name", nation.alias("nation")))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for part, held in zip(batch.column("part").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                cells = [["key", "name", "nation"], *([str(r["s_suppkey"]), r["s_name"], r["nation"]] for r in held)]
                made.append((f"{part}.pdf", made_pdf([grid_page(cells)])))
            yield _made(made)

    return files.parse(parts.mapInArrow(run, _FILE)).select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("part"), "content")


@R.query("""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\x0B\\x0C]+') AS words FROM documents)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, sha256(array_to_string(words, ' ')) AS words_sha256 FROM docs""")
def pdf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pdf.words(_document_files(spark, sf_dir), "path", "page", "text").select("path", "page", F.size("text").alias("n"), F.array_join("text", " ").alias("said"))
    pages = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("page", "said"))))
    per_file = found.groupBy("path").agg(F.sum("n").alias("n_words"), F.array_join(F.transform(pages, lambda p: p["said"]), " ").alias("said"))
    return per_file.select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), F.sha2("said", 256).alias("words_sha256"))


@R.query("""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
stripped AS (SELECT doc_id, n, regexp_replace(line, '^[\\s]+|[\\s]+$', '', 'g') AS line FROM lines)
SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS content FROM stripped WHERE line <> '' GROUP BY doc_id""")
def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A .doc file for each document, a paragraph for each of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            yield _made([(f"{doc_id}.doc", made_doc((text or "").split("\n"), wide=doc_id % 3 == 0)) for doc_id, text in rows])

    found = files.parse(_spread(spark, sf_dir).select("doc_id", "text").mapInArrow(run, _FILE), pdfs=False)
    return found.where("error is null").select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("doc_id"), "content")


QUERIES, SQL = R.queries, R.sql
