"""Queries over evaluation, stability, faithfulness, memories and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LEADING_REFUSAL, REFUSAL_MARKERS
from ..operators import context, diagnostics, evaluation, memory, probe
from ..storage import broadcast_if_small
from .common import MEMORY_TOKENS, Registry, table
from .retrieval import BM25, _lexical

R = Registry()

# Questions are benchmark items with labels of our own: three keywords, one wanted source, every third a negative.
QUESTIONS = """
qs AS (SELECT item_id AS query_id, list_slice(regexp_extract_all(lower(text), '[a-z]{4,}'), 1, 3) AS keywords, 'src' || (item_id % 20) AS wanted, item_id % 3 = 0 AS expect_reject, CASE WHEN item_id % 3 <> 0 THEN NULL WHEN item_id % 2 = 0 THEN 'off_topic' WHEN item_id % 5 = 0 THEN NULL ELSE 'no_answer' END AS negative_type FROM benchmark),
hits AS (SELECT b.query_id, b.rank, d.source, lower(d.text) AS text, least(1, greatest(0, b.score / 60)) AS confidence FROM bm25 b JOIN documents d USING (doc_id) WHERE b.rank <= 5),
joined AS (SELECT q.query_id, h.rank, h.text, h.confidence, contains(h.source, q.wanted) AS cited, len(list_filter(q.keywords, lambda k: contains(h.text, k))) > 0 AS has FROM qs q JOIN hits h USING (query_id)),
per AS (SELECT query_id, avg(CAST(has AS INT)) AS precision, string_agg(text, ' ' ORDER BY rank) AS all_text, max(confidence) AS max_confidence, max(CAST(cited AND rank <= 1 AS INT)) AS h1, max(CAST(cited AND rank <= 3 AS INT)) AS h3, max(CAST(cited AND rank <= 5 AS INT)) AS h5 FROM joined GROUP BY query_id),
rows AS (SELECT q.query_id, q.expect_reject, q.negative_type, round(coalesce(precision, 0), 3) AS context_precision,
  round(CASE WHEN len(keywords) = 0 THEN 1.0::double ELSE len(list_filter(keywords, lambda k: contains(coalesce(all_text, ''), k)))::double / len(keywords) END, 3) AS context_recall,
  coalesce(h1, 0) AS hit_at_1, coalesce(h3, 0) AS hit_at_3, coalesce(h5, 0) AS hit_at_5, coalesce(max_confidence, 0) AS max_confidence,
  CASE WHEN expect_reject THEN CAST(coalesce(max_confidence, 0) < 0.30::double AS INT) END AS reject_correct FROM qs q LEFT JOIN per USING (query_id))"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1)), 1, 3)
    kind = F.when(item % 3 != 0, F.lit(None)).when(item % 2 == 0, "off_topic").when(item % 5 == 0, F.lit(None)).otherwise("no_answer")
    questions = table(spark, sf_dir, "benchmark").select(item.alias("query_id"), words.alias("keywords"), F.array(F.concat(F.lit("src"), (item % 20).cast("string"))).alias("must_cite"), (item % 3 == 0).alias("expect_reject"), kind.alias("negative_type"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    hits = broadcast_if_small(_lexical(spark, sf_dir).where("rank <= 5"), "lexical").join(texts, "doc_id").select("query_id", "rank", "source", "text", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") / 60)).alias("confidence"))
    return evaluation.question_rows(questions, hits)


@R.query(f"WITH {BM25}, {QUESTIONS} SELECT query_id, hit_at_1, hit_at_3, hit_at_5, CAST(hit_at_1 = 1 AND max_confidence >= 0.30::double AS INT) AS answer_hit_at_1 FROM rows")
def eval_hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("query_id", "hit_at_1", "hit_at_3", "hit_at_5", "answer_hit_at_1")


@R.query(f"WITH {BM25}, {QUESTIONS} SELECT query_id, context_precision, context_recall, round(max_confidence, 4) AS max_confidence FROM rows")
def eval_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("query_id", "context_precision", "context_recall", F.round("max_confidence", 4).alias("max_confidence"))


@R.query(f"WITH {BM25}, {QUESTIONS} SELECT CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS stratum, count(*) AS n, round(avg(reject_correct), 3) AS reject_accuracy FROM (SELECT coalesce(negative_type, 'untyped') AS kind, reject_correct FROM rows WHERE expect_reject) GROUP BY GROUPING SETS ((), (kind))")
def eval_reject_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.reject_strata(_rows(spark, sf_dir))


MEANS = ("context_precision", "context_recall", "hit_at_1", "hit_at_3", "hit_at_5")


@R.query(f"WITH {BM25}, {QUESTIONS} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 3) AS value FROM rows WHERE NOT expect_reject" for m in MEANS))
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(_rows(spark, sf_dir)).where(F.col("metric").isin(*MEANS))


@R.query("""WITH a AS (SELECT 'q' || quality AS metric, CAST(count(*) AS DOUBLE) AS value FROM labels WHERE quality IS NOT NULL GROUP BY quality UNION ALL SELECT 'only_before', 1.0),
b AS (SELECT 'q' || toxic AS metric, CAST(count(*) AS DOUBLE) AS value FROM labels WHERE toxic IS NOT NULL GROUP BY toxic UNION ALL SELECT 'only_after', 2.0)
SELECT metric, a.value AS before, b.value AS after, round(b.value - a.value, 4) AS diff, round(b.value - a.value, 4) > 0 AS improved FROM a FULL OUTER JOIN b USING (metric)""")
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two labels stand for the measures of two runs."""
    labels = table(spark, sf_dir, "labels")
    run = lambda c, extra, value: labels.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").cast("double").alias("value")).select(F.concat(F.lit("q"), F.col(c).cast("string")).alias("metric"), "value").unionByName(spark.createDataFrame([(extra, value)], "metric string, value double"))
    return evaluation.compare_runs(run("quality", "only_before", 1.0), run("toxic", "only_after", 2.0))


@R.query("""WITH s AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'ANSWERABLE' WHEN 1 THEN 'UNANSWERABLE' WHEN 2 THEN 'SKIPPED' ELSE 'ERROR' END AS status, CASE WHEN quality = 1 THEN 'ANSWERABLE' ELSE 'UNANSWERABLE' END AS expected FROM labels)
SELECT count(*) AS evaluated, count(*) FILTER (WHERE status IN ('ANSWERABLE', 'UNANSWERABLE')) AS definitive, round(count(*) FILTER (WHERE status IN ('ANSWERABLE', 'UNANSWERABLE'))::double / count(*), 3) AS coverage,
round(count(*) FILTER (WHERE status = expected)::double / count(*) FILTER (WHERE status IN ('ANSWERABLE', 'UNANSWERABLE')), 3) AS accuracy FROM s""")
def answerability_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in ("ANSWERABLE", "UNANSWERABLE", "SKIPPED", "ERROR")]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "labels").select(status.alias("status"), F.when(F.col("quality") == 1, "ANSWERABLE").otherwise("UNANSWERABLE").alias("expected"))
    return evaluation.answerability_summary(rows)


# Assistant turns are answers; some get a refusal before them, a confidence and a polarity come from their place.
PROBES = r"""
answers AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN '未找到相关内容。' || substr(text, 1, 40) WHEN 1 THEN '无法回答。' ELSE text END AS answer, (conv_id * 7 + turn) % 10 / 10.0::double AS confidence, conv_id % 3 = 0 AS expect_reject, 'the' AS keyword FROM conversations WHERE role = 'assistant'),
parts AS (SELECT *, list_bool_or([contains(answer, m) FOR m IN [REFUSAL_MARKERS]]) AS refused, regexp_replace(answer, 'LEADING_REFUSAL', '') AS residual FROM answers),
states AS (SELECT conv_id, turn, confidence, expect_reject, refused, CASE WHEN confidence < 0.30::double THEN 'SYSTEM_REFUSE' WHEN trim(answer, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'REFUSED' WHEN NOT expect_reject AND contains(lower(answer), keyword) THEN 'DELIVERED' WHEN expect_reject AND NOT refused THEN 'DELIVERED'
  WHEN length(regexp_replace(residual, '[*_`#>\[\]()\-•·\s]+', '', 'g')) >= 12 THEN 'REDIRECTED' ELSE 'REFUSED' END AS state FROM parts)""".replace("REFUSAL_MARKERS", ", ".join(f"'{m}'" for m in REFUSAL_MARKERS)).replace("LEADING_REFUSAL", LEADING_REFUSAL)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    place = (c + t) % 5
    answer = F.when(place == 0, F.concat(F.lit("未找到相关内容。"), F.substring("text", 1, 40))).when(place == 1, "无法回答。").otherwise(F.col("text"))
    runs = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", c.cast("string").alias("question"), F.when(c % 3 == 0, "off_topic").otherwise("positive").alias("type"), answer.alias("answer"), ((c * 7 + t) % 10 / 10.0).alias("confidence"), (c % 3 == 0).alias("expect_reject"), F.array(F.lit("the")).alias("keywords"))
    return probe.classify(runs)


@R.query(f"WITH {PROBES} SELECT conv_id, turn, refused, state FROM states")
def probe_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("conv_id", "turn", "refused", "state")


@R.query(f"WITH {PROBES} SELECT CAST(conv_id AS VARCHAR) AS question, count(*) AS runs, count(*) FILTER (WHERE refused) AS refused_count, round(count(*) FILTER (WHERE refused)::double / count(*), 2) AS refused_ratio, count(DISTINCT refused) = 1 AS stable, CASE WHEN count(DISTINCT state) = 1 THEN min(state) ELSE 'MIXED' END AS state FROM states GROUP BY conv_id")
def probe_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.question_summary(_states(spark, sf_dir)).drop("type", "state_counts")


@R.query(f"""WITH {PROBES} SELECT count(*) AS n_records, count(*) FILTER (WHERE state = 'SYSTEM_REFUSE') AS system_refuse, count(*) FILTER (WHERE state = 'REDIRECTED') AS redirected, count(*) FILTER (WHERE state = 'REFUSED') AS refused, count(*) FILTER (WHERE state = 'DELIVERED') AS delivered,
round(count(*) FILTER (WHERE NOT expect_reject AND state = 'DELIVERED')::double / count(*) FILTER (WHERE NOT expect_reject), 3) AS delivery_rate, round(count(*) FILTER (WHERE expect_reject AND state <> 'DELIVERED')::double / count(*) FILTER (WHERE expect_reject), 3) AS non_delivery_rate,
round(count(*) FILTER (WHERE expect_reject AND state = 'SYSTEM_REFUSE')::double / count(*) FILTER (WHERE expect_reject), 3) AS gate_share FROM states""")
def probe_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.aggregate(_states(spark, sf_dir)).select("n_records", "system_refuse", "redirected", "refused", "delivered", "delivery_rate", "non_delivery_rate", "gate_share")


@R.query("""WITH last AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations QUALIFY n <= 8)
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '用户: ' ELSE '助手: ' END || text, chr(10) ORDER BY turn) AS history FROM last GROUP BY conv_id""")
def history_last8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.history(table(spark, sf_dir, "conversations"))


@R.query(f"""WITH m AS (SELECT conv_id * 1000 + turn AS id, conv_id % 10 AS user_id, {MEMORY_TOKENS.format("text")} AS t FROM conversations WHERE role = 'assistant'),
q AS (SELECT conv_id AS query_id, conv_id % 10 AS user_id, {MEMORY_TOKENS.format("text")} AS t FROM conversations WHERE role = 'user' AND turn = 0 OR role = 'user' AND turn = 1),
s AS (SELECT query_id, id, round(len(list_intersect(m.t, q.t)) / sqrt(len(q.t)), 6) AS score FROM q JOIN m USING (user_id) WHERE len(list_intersect(m.t, q.t)) > 0)
SELECT query_id, CAST(id AS VARCHAR) AS id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(id AS VARCHAR)) AS rank FROM s QUALIFY rank <= 3""")
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    user = (F.col("conv_id") % 10).cast("string")
    items = talk.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"), user.alias("user_id"), F.col("text").alias("content"), F.array().cast("array<string>").alias("tags"))
    asked = talk.where("role = 'user' and turn <= 1").select(F.col("conv_id").alias("query_id"), user.alias("user_id"), F.col("text").alias("question"))
    return memory.search(items, asked).select("query_id", "id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@R.query("""WITH c AS (SELECT conv_id, count(*) AS claims, count(*) FILTER (WHERE turn % 3 <> 0) AS supported FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
s AS (SELECT CASE WHEN conv_id % 9 = 0 THEN NULL ELSE supported::double / claims END AS score FROM c)
SELECT count(*) AS n, round(avg(score), 4) AS mean_score, count(*) FILTER (WHERE score IS NULL) AS parse_failures FROM s""")
def faithfulness_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns are claims, two in three supported; every ninth reply can't be parsed."""
    claims = F.struct(F.lit("c").alias("text"), (F.col("turn") % 3 != 0).alias("supported"), F.lit("").alias("evidence"))
    replies = table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(claims).alias("claims"))).alias("reply"))
    reply = F.when(F.col("conv_id") % 9 == 0, "no JSON").otherwise(F.concat(F.lit("```json\n"), "reply", F.lit("\n```")))
    return probe.faithfulness_summary(replies.select(probe.judged_claims(reply).score.alias("score")))


@R.query("SELECT role AS chunk_role, count(*) AS n FROM conversations GROUP BY role")
def role_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.role_counts(table(spark, sf_dir, "conversations").select(F.col("role").alias("chunk_role")))


@R.query("SELECT count(*) AS n, CASE WHEN count(*) > 90 THEN 'duplicated' WHEN count(*) NOT BETWEEN 30 AND 60 THEN 'unexpected' ELSE 'ok' END AS verdict FROM documents")
def collection_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.collection_size(table(spark, sf_dir, "documents"))


QUERIES, SQL = R.queries, R.sql
