"""Queries over single steps: page layout, tables, verdicts, replies of models, manifests, memories and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import EXPANSIONS, clean_page_text, expanded_variants, numbered_part, rewritten_variants, search_tokens
from ..operators import chunking, context, evaluation, gates, indexing, memory, probe
from ..sources import files, labelled
from ..streaming.watch import relevant
from .common import Registry, table
from .corpus import FILES, _files
from .retrieval import PARENTED, _parented

R = Registry()
SUFFIXES = ("md", "TXT", "csv", "docx", "py", "Md", "pdf", "mdx")
SUFFIX_SQL = f"list_value({', '.join(repr(s) for s in SUFFIXES)})[doc_id % {len(SUFFIXES)} + 1]"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of several kinds."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), suffix).alias("path"), F.col("text").cast("binary").alias("content"))


@R.query(f"SELECT 'f' || doc_id || '.' || {SUFFIX_SQL} AS path, text AS content FROM documents WHERE lower({SUFFIX_SQL}) IN ('md', 'txt')")
def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.text_documents(_paths(spark, sf_dir))


@R.query(f"SELECT doc_id FROM documents WHERE lower({SUFFIX_SQL}) IN ('md', 'txt', 'csv', 'docx', 'pdf')")
def watched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(relevant(F.col("path"))).select("doc_id")


# Line items stand for words: the part is the page, quantity and line number the place.
WORDS = "words AS (SELECT l_partkey % 97 AS page, 600.0::double AS page_width, 800.0::double AS page_height, CASE WHEN l_partkey % 97 % 3 = 0 THEN l_quantity * 5 ELSE l_quantity * 12 END::double AS x0, l_linenumber * 100.0::double AS top FROM lineitem)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("l_partkey") % 97
    x0 = F.when(page % 3 == 0, F.col("l_quantity") * 5).otherwise(F.col("l_quantity") * 12).cast("double")
    return table(spark, sf_dir, "lineitem").select(page.alias("page"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"), x0.alias("x0"), (F.col("l_linenumber") * 100.0).cast("double").alias("top"))


@R.query(f"""WITH {WORDS}, sides AS (SELECT page, count(*) AS n, count(*) FILTER (WHERE x0 < 280) AS l, count(*) FILTER (WHERE x0 > 320) AS r FROM words GROUP BY page)
SELECT page, n >= 30 AND l > 15 AND r > 15 AND abs(l - r) / greatest(l, r) < 0.6::double AS two_column FROM sides""")
def two_column_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.two_column_pages(_words(spark, sf_dir))


@R.query(f"WITH {WORDS} SELECT page, CAST(CASE WHEN top < 144 THEN 0 WHEN x0 < 290 THEN 1 WHEN x0 > 310 THEN 2 WHEN x0 < 300 THEN 1 ELSE 2 END AS INTEGER) AS band, count(*) AS n FROM words GROUP BY ALL")
def reading_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.reading_order(_words(spark, sf_dir)).groupBy("page", "band").agg(F.count("*").alias("n"))


@R.query("""SELECT s_suppkey, '| name | nation |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || s_name || ' | ' || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE CAST(s_nationkey AS VARCHAR) END || ' |' AS content FROM supplier""")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.array(F.col("s_name"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_nationkey").cast("string")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", files.markdown_table(F.array(F.array(F.lit("name"), F.lit("nation")), row)).alias("content"))


@R.query("""SELECT s_suppkey, concat_ws(chr(10), 'Title: ' || s_name, CASE WHEN s_suppkey % 3 > 0 THEN 'Author(s): A' || s_nationkey END, CASE WHEN s_suppkey % 2 = 0 THEN 'Subject: S' END, 'Keywords: k' || s_suppkey) AS content FROM supplier""")
def pdf_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    author = F.when(key % 3 > 0, F.concat(F.lit("A"), F.col("s_nationkey").cast("string"))).otherwise("(Anonymous)")
    subject = F.when(key % 2 == 0, F.lit("S")).otherwise("(unspecified)")
    return table(spark, sf_dir, "supplier").select("s_suppkey", files.pdf_metadata_text(F.col("s_name"), author, subject, F.concat(F.lit("k"), key.cast("string"))).alias("content"))


@R.query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
k AS (SELECT doc_id, n, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l),
j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS content FROM k WHERE line <> '' AND NOT regexp_matches(line, '(?i)^\s*\d+\s*$|^\s*page\s*\d+|^\s*\d+\s*/\s*\d+\s*$') GROUP BY doc_id)
SELECT d.doc_id, coalesce(replace(j.content, '-' || chr(10), ''), '') AS content FROM documents d LEFT JOIN j USING (doc_id)""")
def cleaned_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", clean_page_text("text").alias("content"))


@R.query(r"""WITH t AS (SELECT doc_id, list_value('合同金额三千', '装', '', '登山a装备')[doc_id % 4 + 1] AS x, text FROM documents),
i AS (SELECT doc_id, text || ' ' || x AS text, regexp_replace(text || ' ' || x, '[^一-鿿]', '', 'g') AS c FROM t)
SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+') || list_filter(string_split(c, ''), lambda s: s <> '') || list_transform(range(1, greatest(length(c), 1)), lambda k: substr(c, k, 2)), ' ') AS tokens FROM i""")
def ideograph_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ideographs behind their text, as the data has none: single ones and bigrams."""
    more = F.element_at(F.array(*[F.lit(x) for x in ("合同金额三千", "装", "", "登山a装备")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(search_tokens(F.concat(F.col("text"), F.lit(" "), more)), " ").alias("tokens"))


@R.query(f"""WITH {FILES}, fresh AS (SELECT path, sha256 FROM cur WHERE CAST(path AS BIGINT) % 3 = 0)
SELECT path, sha256 FROM fresh UNION ALL SELECT path, sha256 FROM old WHERE path NOT IN (SELECT path FROM fresh) AND path IN (SELECT path FROM cur)""")
def manifest_after_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass that parsed every third file."""
    current, before = _files(spark, sf_dir)
    return indexing.next_manifest(before, current, current.where(F.col("path").cast("long") % 3 == 0).select("path"), indexing.deleted_files(current, before))


@R.query(f"""WITH {FILES}, changed AS (SELECT cur.path FROM cur LEFT JOIN old USING (path) WHERE cur.sha256 IS DISTINCT FROM old.sha256), parsed AS (SELECT path FROM changed WHERE CAST(path AS BIGINT) % 5 <> 0)
SELECT path AS source, 'new' AS content FROM parsed UNION ALL SELECT path, 'old' FROM old WHERE path IN (SELECT path FROM cur) AND path NOT IN (SELECT path FROM parsed)""")
def chunks_after_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth changed file fails to parse and keeps its old chunk."""
    current, before = _files(spark, sf_dir)
    chunk = lambda df, content: df.select(F.col("path").alias("source"), F.lit(content).alias("content"))
    new = chunk(indexing.changed_files(current, before).where(F.col("path").cast("long") % 5 != 0), "new")
    return indexing.apply_changes(chunk(before, "old"), new, indexing.deleted_files(current, before))


@R.query("SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS id, '- ' || text || CASE WHEN turn % 3 = 0 THEN ' [a, b]' ELSE '' END AS line FROM conversations WHERE turn % 4 <> 0")
def memory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories but every fourth one, as lines of a prompt."""
    turn = F.col("turn")
    items = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + turn).cast("string").alias("id"), F.col("text").alias("content"), F.when(turn % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("tags"), turn.alias("turn"))
    return memory.without(items, items.where("turn % 4 = 0")).select("id", memory.context_line(F.col("content"), F.col("tags")).alias("line"))


REPLIES = ("YES\nno, not that\n\nMaybe", "  no\nYES", "perhaps\nNO", "")


@R.query("""WITH r AS (SELECT doc_id, doc_id % 4 AS k, doc_id % 3 + 2 AS n FROM labels),
v AS (SELECT doc_id, n, CASE k WHEN 0 THEN ['YES', 'NO', 'MAYBE'] WHEN 1 THEN ['NO', 'YES'] WHEN 2 THEN ['YES', 'NO'] ELSE [] END AS v FROM r)
SELECT doc_id, array_to_string(list_slice(v || list_transform(range(n), lambda i: 'YES'), 1, n), ',') AS verdicts, CASE WHEN n = 2 THEN '' WHEN n = 3 THEN 'p1' ELSE 'p1,p2' END AS zipped FROM v""")
def model_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of replies with blank lines, too few and too many of them, and what pairs up with a shorter list."""
    reply = F.element_at(F.array(*[F.lit(r) for r in REPLIES]), (F.col("doc_id") % 4 + 1).cast("int"))
    n = (F.col("doc_id") % 3 + 2).cast("int")
    rows = table(spark, sf_dir, "labels").select("doc_id", n.alias("n"), gates.parsed_verdicts(reply, n).alias("v"))
    names = F.slice(F.array(F.lit("p1"), F.lit("p2")), F.lit(1), F.col("n") - 2)
    zipped = F.coalesce(F.transform(probe.zip_by_position(names, F.col("v")), lambda z: z.left), F.array().cast("array<string>"))
    return rows.select("doc_id", F.array_join("v", ",").alias("verdicts"), F.array_join(zipped, ",").alias("zipped"))


@R.query("""WITH r AS (SELECT d.doc_id, CASE WHEN d.doc_id % 6 = 5 THEN NULL ELSE d.text END AS context, CASE d.doc_id % 5 WHEN 0 THEN 'ANSWERABLE' WHEN 1 THEN 'ANSWERABLE' WHEN 2 THEN 'UNANSWERABLE' WHEN 3 THEN 'OTHER' END AS verdict,
CASE d.doc_id % 5 WHEN 0 THEN trim(substr(d.text, 3, 12), ' ') WHEN 1 THEN '§§§§§' ELSE '' END AS evidence, d.doc_id % 7 = 3 AS failed FROM documents d),
s AS (SELECT doc_id, CASE WHEN context IS NULL OR trim(context, ' ') = '' THEN 'UNANSWERABLE' WHEN failed THEN 'ERROR' WHEN verdict IS NULL THEN 'SKIPPED' WHEN verdict = 'UNANSWERABLE' THEN 'UNANSWERABLE'
WHEN verdict = 'ANSWERABLE' AND length(evidence) >= 4 AND contains(context, evidence) THEN 'ANSWERABLE' ELSE 'SKIPPED' END AS status FROM r)
SELECT doc_id, status, status NOT IN ('ANSWERABLE', 'SKIPPED') AS refused FROM s""")
def answerability_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with a literal quotation, with an invented one, without, of another kind, and none; some calls fail."""
    k = F.col("doc_id") % 5
    verdict = F.when(k <= 1, "ANSWERABLE").when(k == 2, "unanswerable ").when(k == 3, "OTHER")
    evidence = F.when(k == 0, F.trim(F.substring("text", 3, 12))).when(k == 1, "§§§§§").otherwise("")
    reply = F.when(k < 4, F.concat(F.lit("My reply:\n"), F.to_json(F.struct(verdict.alias("verdict"), evidence.alias("evidence"))), F.lit("\nThat is all.")))
    shown = F.when(F.col("doc_id") % 6 != 5, F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", gates.answerability(reply, shown, F.lit(True), F.col("doc_id") % 7 == 3).status.alias("status"))
    return rows.withColumn("refused", gates.answerability_gate(F.col("status")))


@R.query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 5 = 0 THEN '' ELSE text END AS metric_text,
replace(substr(CASE WHEN doc_id % 3 = 0 THEN source ELSE text END, 1, 500), chr(10), ' ') AS critic_text FROM documents""")
def hit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What measures and the critic read of a hit: its parent if it has one."""
    key = F.col("doc_id")
    parent = F.when(key % 3 == 0, F.col("source")).otherwise("")
    own = F.when((key % 3 != 0) & (key % 5 == 0), F.lit(None)).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", evaluation.metric_text(own, parent).alias("metric_text"), gates.critic_text(F.col("text"), parent).alias("critic_text"))


@R.query("""SELECT item_id, CASE item_id % 3 WHEN 0 THEN q || '|first way|second way|third way' WHEN 1 THEN q || '|only way' ELSE q END AS variants FROM (SELECT item_id, replace(text, chr(10), ' ') AS q FROM benchmark)""")
def rewritten_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with bullets, numbers, blanks, the question itself, and more lines than are taken."""
    k = F.col("item_id") % 3
    reply = F.when(k == 0, "1. first way\n\n- second way\n* third way\n4) fourth way").when(k == 1, F.concat(F.lit("- "), "text", F.lit("\n2: only way\n  ")))
    return table(spark, sf_dir, "benchmark").withColumn("text", F.translate("text", "\n", " ")).select("item_id", F.array_join(rewritten_variants(reply, F.col("text")), "|").alias("variants"))


def _expansion_sql(question: str, columns: str) -> str:
    """Columns of the variants v of a question q, a common table for each vague word: of those met while there are fewer than three, two terms each."""
    steps, last = [], "s0"
    for i, (word, terms) in enumerate((w, t[:2]) for w, t in EXPANSIONS.items() if t):
        place = f"strpos(q, '{word}')"
        new = ", ".join(f"substr(q, 1, {place} - 1) || '{t}' || substr(q, {place} + {len(word)})" for t in terms)
        steps.append(f"s{i + 1} AS (SELECT item_id, q, CASE WHEN len(v) < 3 AND contains(lower(q), '{word.lower()}') AND {place} > 0 THEN v || list_filter([{new}], lambda x: x <> q) ELSE v END AS v FROM {last})")
        last = f"s{i + 1}"
    return f"WITH s0 AS (SELECT item_id, {question} AS q, CAST([] AS VARCHAR[]) AS v FROM benchmark), {', '.join(steps)} SELECT {columns} FROM {last}"


@R.query(_expansion_sql("'What amount is due? ' || text", "item_id, q AS question, CAST(1 + least(len(v), 3) AS INTEGER) AS n_variants, v[1] AS second"))
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of variants and the second one of every benchmark item behind a vague question."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("What amount is due? "), "text").alias("question"))
    variants = rows.withColumn("v", expanded_variants(F.col("question")))
    return variants.select("item_id", "question", F.size("v").alias("n_variants"), F.get("v", F.lit(1)).alias("second"))


@R.query(_expansion_sql("CASE item_id % 3 WHEN 0 THEN 'What amount is due? ' WHEN 1 THEN '合同金额? ' ELSE '' END || text", "item_id, array_to_string([q] || v[1:3], '|') AS variants"))
def question_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item behind a vague question, two of them, or none."""
    k = F.col("item_id") % 3
    question = F.concat(F.when(k == 0, "What amount is due? ").when(k == 1, "合同金额? ").otherwise(""), "text")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(expanded_variants(question), "|").alias("variants"))


@R.query(f"""SELECT doc_id, '【' || CASE doc_id % 3 WHEN 0 THEN 'about ' || source WHEN 1 THEN 'last' ELSE '{fixed.NO_CONTEXT}' END || '】' || chr(10) || chr(10) || source AS content FROM documents""")
def contextual_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a reply by their number; the third part is missing."""
    reply = F.concat(F.lit("--- 第2段 ---\nlast\n--- 第1段 ---\n about "), "source", F.lit(" \n"))
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("content"), numbered_part(reply, (F.col("doc_id") % 3 + 1).cast("int")).alias("told"))
    return chunking.contextualise(chunks, F.col("told")).select("doc_id", "content")


@R.query("""SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'c1|c2' ELSE string_agg(CASE WHEN turn % 2 = 0 THEN text ELSE 's' || turn END, '|' ORDER BY turn) END AS contexts FROM conversations GROUP BY conv_id""")
def result_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of saved results: their own, or of each source its context, else its snippet."""
    turn = F.col("turn")
    source = F.struct(F.concat(F.lit("s"), turn.cast("string")).alias("snippet"), F.when(turn % 2 == 0, F.col("text")).otherwise("").alias("context"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", source.alias("s")))), lambda x: x.s).alias("sources"))
    own = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("c1"), F.lit("c2")))
    return rows.select("conv_id", F.array_join(probe.contexts_of(own, F.col("sources")), "|").alias("contexts"))


@R.query("SELECT DISTINCT 'n' || c_nationkey AS source FROM customer WHERE c_custkey % 4 <> 0 AND c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 <> 0)")
def shared_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers stand for two question sets, nations for what they cite; rejected questions don't count."""
    rows = lambda name, key, nation, k: table(spark, sf_dir, name).select(F.array(F.concat(F.lit("n"), F.col(nation).cast("string"))).alias("must_cite"), (F.col(key) % k == 0).alias("expect_reject"))
    return labelled.overlapping_sources(rows("customer", "c_custkey", "c_nationkey", 4), rows("supplier", "s_suppkey", "s_nationkey", 3))


SHOWN = f"""{PARENTED}, once AS (SELECT p.*, d.source, d.text, row_number() OVER (PARTITION BY query_id, parent_id IS NULL, coalesce(parent_id, CAST(p.doc_id AS VARCHAR)) ORDER BY rank) AS k FROM parented p JOIN documents d USING (doc_id)),
shown AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM once WHERE k = 1)"""


def _shown_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parented(spark, sf_dir).select("query_id", "rank", F.col("doc_id").alias("id"), "source", F.col("text").alias("content"), "parent_id", F.col("parent_id").alias("parent_text"), (F.col("rank") / 30.0).alias("confidence"))


@R.query(f"""WITH {SHOWN} SELECT query_id, string_agg('[' || i || '] ' || source || CASE WHEN parent_id IS NULL THEN ' (' ELSE ' (parent chunk, ' END || '{fixed.CONFIDENCE_MARK}' || printf('%.2f', rank / 30.0::double) || ')' || chr(10) || trim(coalesce(parent_id, text), ' '), chr(10) || chr(10) ORDER BY i) AS context FROM shown GROUP BY query_id""")
def model_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.model_context(_shown_hits(spark, sf_dir))


@R.query(f"WITH {SHOWN} SELECT query_id, CAST(i AS BIGINT) AS index, source, round(rank / 30.0::double, 4) AS confidence, substr(text, 1, 300) AS snippet FROM shown WHERE i <= 2")
def refused_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two sources that a refused answer shows."""
    rows = context.sources_of(_shown_hits(spark, sf_dir)).where("index <= 2")
    return rows.select("query_id", F.col("index").cast("long").alias("index"), "source", F.round("confidence", 4).alias("confidence"), "snippet")


@R.query("""WITH v AS (SELECT user_id, ts, max(event_id) AS viewed FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT p.event_id, p.user_id, coalesce(v.viewed, -1) AS viewed FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def last_view_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last thing each user viewed up to a purchase, as a hit finds the last heading above it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    viewed = events.where("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("viewed"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    return context.as_of(bought, viewed, ["user_id"], "at", "viewed", 7 * 86400e6).select("event_id", "user_id", F.coalesce("viewed", F.lit(-1)).alias("viewed"))


QUERIES, SQL = R.queries, R.sql
