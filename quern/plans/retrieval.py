"""Queries over lexical and dense retrieval, fusion, confidence, gates and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dot, search_tokens
from ..operators import chunking, context, dense, fusion, gates, lexical, ranking
from ..providers import overlap_reranker, score_pairs
from ..storage import broadcast_if_small, stage_path
from .common import TOKENS, Registry, table

R = Registry()
DOC_TOKENS = TOKENS.format("text")

BM25 = f"""
toks AS (SELECT doc_id, unnest({DOC_TOKENS}) AS token FROM documents),
sized AS (SELECT doc_id, CAST(len({DOC_TOKENS}) AS BIGINT) AS n_tokens FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(n_tokens) AS avg_tokens FROM sized),
post AS (SELECT token, doc_id, count(*) AS tf FROM toks GROUP BY ALL),
raw AS (SELECT token, count(*) AS df, ln(max(n_docs) - count(*) + 0.5::double) - ln(count(*) + 0.5::double) AS raw_idf FROM post, stats GROUP BY token),
terms AS (SELECT token, df, CASE WHEN raw_idf < 0 THEN 0.25::double * (SELECT avg(raw_idf) FROM raw) ELSE raw_idf END AS idf FROM raw),
asked AS (SELECT item_id AS query_id, token, count(*) AS times FROM (SELECT item_id, unnest({DOC_TOKENS}) AS token FROM benchmark) GROUP BY ALL),
matched AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * n_tokens / avg_tokens))), 6) AS score
  FROM asked JOIN terms USING (token) JOIN post USING (token) JOIN sized USING (doc_id), stats GROUP BY query_id, doc_id),
scored AS (SELECT q.query_id, d.doc_id, coalesce(m.score, 0) AS score FROM (SELECT DISTINCT query_id FROM asked) q CROSS JOIN documents d LEFT JOIN matched m ON m.query_id = q.query_id AND m.doc_id = d.doc_id),
bm25 AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 20)"""

DENSE = """
vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))) AS cos FROM vec q, vec d WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
dense AS (SELECT query_id, vec_id, round(cos, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 6) DESC, vec_id) AS rank FROM near QUALIFY rank <= 20)"""

FUSED = """
both_lists AS (SELECT query_id, doc_id, rank, 0 AS list_no FROM bm25 UNION ALL SELECT query_id, vec_id, rank, 1 FROM dense),
summed AS (SELECT query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) AS rrf_score, min(list_no * 1000 + rank) AS first FROM both_lists GROUP BY ALL),
fused AS (SELECT query_id, doc_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first, doc_id) AS rank FROM summed QUALIFY rank <= 30)"""

RERANKED = f"""
pairs AS (SELECT f.query_id, f.doc_id, f.rrf_score, f.rank AS fused_rank, list_distinct({TOKENS.format("b.text")}) AS a, list_distinct({TOKENS.format("d.text")}) AS b FROM fused f JOIN benchmark b ON b.item_id = f.query_id JOIN documents d ON d.doc_id = f.doc_id),
judged AS (SELECT query_id, doc_id, rrf_score, fused_rank, CASE WHEN len(a) + len(b) = 0 THEN 0.0::double ELSE len(list_intersect(a, b))::double / (len(a) + len(b) - len(list_intersect(a, b))) END AS rerank_score FROM pairs),
top5 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank, doc_id) AS rank FROM judged QUALIFY rank <= 5),
hits AS (SELECT *, 0.8::double * greatest(0, least(1, rerank_score)) + 0.2::double * rrf_score / max(rrf_score) OVER (PARTITION BY query_id) AS confidence FROM top5)"""


_stored: dict[tuple, str] = {}


def _stored_path(spark: SparkSession, sf_dir: str, label: str, write) -> str:
    """Where a table or index of this session's documents lies; it is written once for each state of the files."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark", "embeddings")]
    state = [p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p) for p in paths]
    key = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", ""), sf_dir, label, *((s.getLen(), s.getModificationTime()) for s in state)
    if key not in _stored:
        path = stage_path(spark, label)
        write(path)
        _stored[key] = path
    return _stored[key]


def _index(spark: SparkSession, sf_dir: str) -> lexical.LexicalIndex:
    return lexical.read_index(spark, _stored_path(spark, sf_dir, "bm25", lambda path: lexical.write_index(table(spark, sf_dir, "documents"), path)))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_index(spark, sf_dir), _questions(spark, sf_dir))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of equal id stand in for the questions, as the data pairs none with texts."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.join(_questions(spark, sf_dir).select(F.col("query_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return dense.search(vectors, asked)


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion([_lexical(spark, sf_dir), _dense(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")])


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranked hits with confidence, kept for the queries that begin with them."""

    def write(path: str) -> None:
        fused = broadcast_if_small(_fused(spark, sf_dir), "fused")  # so texts stay where they are
        scored = score_pairs(fused, _questions(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), overlap_reranker)
        ranking.with_confidence(ranking.rerank(scored, F.col("pair_score"))).write.parquet(path)

    return spark.read.parquet(_stored_path(spark, sf_dir, "hits", write))


@R.query(f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {DOC_TOKENS} AS t FROM documents)""")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", search_tokens("text").alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@R.query(f"WITH {BM25} SELECT token, df, round(idf, 6) AS idf FROM terms")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).terms.select("token", "df", F.round("idf", 6).alias("idf"))


@R.query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bm25")
def bm25_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@R.query(f"WITH {DENSE} SELECT query_id, vec_id, score, rank FROM dense")
def dense_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@R.query("SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS squared_length FROM embeddings")
def vector_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("squared_length"))


@R.query(f"WITH {BM25}, {DENSE}, {FUSED} SELECT query_id, doc_id, round(rrf_score, 6) AS rrf_score, rank FROM fused")
def rrf_fuse_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("query_id", "doc_id", F.round("rrf_score", 6).alias("rrf_score"), F.col("rank").cast("long").alias("rank"))


@R.query(f"WITH {BM25}, {DENSE}, {FUSED}, {RERANKED} SELECT query_id, doc_id, rank, round(rerank_score, 4) AS rerank_score, round(confidence, 4) AS confidence FROM hits")
def hybrid_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("rerank_score", 4).alias("rerank_score"), F.round("confidence", 4).alias("confidence"))


@R.query(f"WITH {BM25}, {DENSE}, {FUSED} SELECT query_id, doc_id, rank, round(least(1, rrf_score * 10), 4) AS confidence FROM fused WHERE rank <= 5")
def hybrid_confidence_unranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ranking.with_confidence(ranking.rerank(_fused(spark, sf_dir), None))
    return hits.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("confidence", 4).alias("confidence"))


@R.query(f"WITH {BM25}, {DENSE}, {FUSED}, {RERANKED} SELECT query_id, round(max(confidence), 4) AS max_confidence, max(confidence) < 0.30::double AS rejected FROM hits GROUP BY query_id")
def conf_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.confidence_gate(_hits(spark, sf_dir)).withColumn("max_confidence", F.round("max_confidence", 4))


@R.query(f"""WITH {BM25}, {DENSE}, {FUSED}, {RERANKED},
voted AS (SELECT *, CASE WHEN confidence < 0.10::double THEN 'NO' WHEN doc_id % 3 = 0 THEN 'MAYBE' WHEN doc_id % 7 = 0 THEN 'NO' ELSE 'YES' END AS verdict FROM hits),
counted AS (SELECT *, max(CASE WHEN verdict <> 'NO' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS kept, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, rank) AS best FROM voted)
SELECT query_id, doc_id, round(CASE WHEN verdict = 'NO' THEN confidence * 0.3::double WHEN verdict = 'MAYBE' THEN confidence * 0.5::double ELSE confidence END, 4) AS confidence,
CASE WHEN verdict = 'NO' THEN 'ALL_NO_PENALTY' ELSE verdict END AS critic_verdict, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN verdict = 'MAYBE' THEN 1 ELSE 0 END, rank) AS rank
FROM counted WHERE verdict <> 'NO' OR (kept = 0 AND best = 1)""")
def critic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.col("confidence")
    verdict = F.when(gates.heuristic_verdict(confidence) == "NO", "NO").when(F.col("doc_id") % 3 == 0, "MAYBE").when(F.col("doc_id") % 7 == 0, "NO").otherwise("YES")
    left = gates.apply_critic(_hits(spark, sf_dir).withColumn("verdict", verdict), maybe_penalty=0.5)
    return left.select("query_id", "doc_id", F.round("confidence", 4).alias("confidence"), "critic_verdict", F.col("rank").cast("long").alias("rank"))


PARENTED = f"""{BM25}, parented AS (SELECT b.query_id, b.doc_id, b.rank, CASE WHEN b.doc_id % 4 = 0 THEN NULL ELSE d.source END AS parent_id FROM bm25 b JOIN documents d USING (doc_id))"""


def _parented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical hits whose source stands for a parent; every fourth document has none."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return broadcast_if_small(_lexical(spark, sf_dir), "lexical").join(texts, "doc_id").withColumn("parent_id", F.when(F.col("doc_id") % 4 != 0, F.col("source")))


@R.query(f"""WITH {PARENTED}, kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id IS NULL, coalesce(parent_id, CAST(doc_id AS VARCHAR)) ORDER BY rank) AS n FROM parented)
SELECT query_id, doc_id, rank, coalesce(parent_id, '') AS parent FROM kept WHERE n = 1""")
def parent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _parented(spark, sf_dir).withColumn("parent_text", F.col("parent_id"))
    return fusion.first_per_parent(hits, "doc_id").select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.coalesce("parent_id", F.lit("")).alias("parent"))


@R.query(f"""WITH {PARENTED}, lists AS (SELECT query_id // 2 AS query_id, query_id % 2 AS list_no, rank, doc_id, parent_id FROM parented),
keyed AS (SELECT *, coalesce(parent_id, CAST(doc_id AS VARCHAR)) AS fusion_key FROM lists),
summed AS (SELECT query_id, fusion_key, round(sum(1.0::double / (60 + rank)), 9) AS rrf_score, min(list_no * 1000 + rank) AS first, arg_min(doc_id, list_no * 1000 + rank) AS doc_id FROM keyed GROUP BY query_id, fusion_key)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first) AS rank, fusion_key, round(rrf_score, 6) AS rrf_score, doc_id AS id FROM summed""")
def multi_query_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring questions stand for two ways to ask one."""
    hits = _parented(spark, sf_dir).select(F.floor(F.col("query_id") / 2).alias("query_id"), (F.col("query_id") % 2).alias("list_no"), "rank", F.col("doc_id").alias("id"), "parent_id")
    fused = fusion.fuse_by_parent(hits)
    return fused.select("query_id", F.col("rank").cast("long").alias("rank"), "fusion_key", F.round("rrf_score", 6).alias("rrf_score"), "id")


@R.query(f"""WITH {PARENTED}, shown AS (SELECT p.query_id, p.rank, d.source, substr(trim(d.text), 1, 3500) AS content, row_number() OVER (PARTITION BY p.query_id ORDER BY p.rank) AS i FROM parented p JOIN documents d USING (doc_id) WHERE p.rank <= 3 AND trim(d.text) <> '')
SELECT query_id, string_agg('[' || i || '] ' || source || chr(10) || content, chr(10) || chr(10) ORDER BY i) AS context FROM shown GROUP BY query_id""")
def bounded_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three blocks of at most 3,500 characters stay below the total."""
    hits = _parented(spark, sf_dir).where("rank <= 3").select("query_id", "rank", F.col("doc_id").alias("id"), "source", F.col("text").alias("content"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("parent_text"))
    return context.bounded_context(hits)


@R.query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.col("text").alias("content"))
    return chunking.chunk(docs).select("source", "ordinal", F.length("content").alias("n_chars"), "chunk_id")


@R.query()
def chunk_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.col("text").alias("content"))
    return chunking.children(chunking.parents(docs)).select("source", "parent_id", "ordinal", F.length("content").alias("n_chars"), "chunk_role")


QUERIES, SQL = R.queries, R.sql
