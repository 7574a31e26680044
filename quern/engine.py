"""From files to chunks, and from questions to cited answers, for whole tables of questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import providers
from .config import Config
from .functions import fixed
from .functions.text import expanded_variants, infer_title, rewritten_variants
from .operators import chunking, context, dense, diagnostics, evaluation, fusion, gates, indexing, lexical, probe, ranking
from .sources import files as file_source
from .storage import stage_table
from .store import MANIFEST_SCHEMA, PARENT_SCHEMA, Store

READ_BY_PATH = 10_000  # up to so many changed files are read by their paths, more by a scan of the folder


def reindex(store: Store, docs_root: str, force: bool = False, config: Config | None = None) -> DataFrame:
    """Bring a store up to date with a folder; one row that says what was done.

    Files whose length and time of change are as noted are not read.  Of the others, those whose digest changed are
    parsed.  Old chunks go once a file was parsed, also if nothing was in it; a file that fails to parse keeps what it
    had and is tried again in the next pass.  A pass that finds nothing to do writes nothing.  ``force`` begins anew.
    """
    spark = store.spark
    config = config or Config.load(spark)
    now = stage_table(file_source.listing(spark, docs_root), "listing")
    known = spark.createDataFrame([], MANIFEST_SCHEMA) if force else stage_table(store.manifest(), "manifest")
    suspects = stage_table(now.join(indexing.listing_changes(now, known).where("status in ('new', 'changed')"), "path", "left_semi"), "suspects")
    paths = [r.path for r in suspects.select("path").limit(READ_BY_PATH + 1).collect()]
    found = file_source.scan(spark, docs_root, only=paths if len(paths) <= READ_BY_PATH else None)
    hashed = stage_table(suspects.join(indexing.manifest_of(found.join(suspects.select("path"), "path", "left_semi")), "path"), "hashed")
    changed, deleted = stage_table(indexing.changed_files(hashed, known), "changed"), stage_table(indexing.deleted_files(now, known), "deleted")
    documents = stage_table(file_source.parse(found.join(changed.select("path"), "path", "left_semi"), config.pdf_parser), "documents")
    failed = documents.groupBy("path").agg(F.max(F.col("content").isNotNull()).alias("some"), F.max(F.col("error").isNotNull()).alias("bad")).where("bad and not some")
    noted = stage_table(hashed.join(failed.select("path"), "path", "left_anti"), "noted")  # parsed, or touched only
    counted = Observation("pass")
    chunks, parents = made_chunks(documents, config)
    chunks = stage_table(chunks.observe(counted, F.count("*").alias("chunks")), "chunks")
    statuses = now.select("path").join(changed.select("path", F.lit("changed").alias("status")), "path", "left").select("path", F.coalesce("status", F.lit("unchanged")).alias("status"))
    summary = indexing.file_counts(statuses.unionByName(deleted.select("path", F.lit("deleted").alias("status")))).withColumn("chunks_added", F.lit(counted.get["chunks"]).cast("long"))
    if force or not noted.isEmpty() or not deleted.isEmpty():
        gone = changed.select("path").join(noted.select("path"), "path", "left_semi").unionByName(deleted.select("path")).withColumnRenamed("path", "source")
        lost = deleted.select("path", *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in MANIFEST_SCHEMA.split(", ")[1:])))
        store.write(chunks, parents, noted.select(*lost.columns).unionByName(lost), gone, replace=force)
    return summary


def made_chunks(documents: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """Chunks with embeddings, and parents, of parsed documents."""
    spark = documents.sparkSession
    texts = documents.where("content is not null").select(F.col("path").alias("source"), "content", "chunk_role")
    if config.use_parent_child:
        parents = chunking.parents(texts, config)
        chunks = chunking.children(parents, config)
    else:
        parents = spark.createDataFrame([], PARENT_SCHEMA)
        chunks = chunking.chunk(texts, config).withColumns({"parent_id": F.lit(None).cast("string"), "chunk_role": F.lit(None).cast("string")})
    # Equal parts of one file, such as slides that say the same, have one id and are one chunk.
    chunks = chunks.dropDuplicates(["chunk_id"])
    if config.use_contextual:
        titles = documents.where("content is not null").groupBy(F.col("path").alias("source")).agg(infer_title(F.min_by("content", "ordinal")).alias("title"))
        told = stage_table(chunking.described(chunks, titles, providers.chosen(providers.MODELS, config.llm)), "described")
        chunks = chunking.contextualise(told, F.col("_described")).drop("_described", "context")
    embed = providers.chosen(providers.EMBEDDERS, config.embedder)(config.embedding_dim)
    return chunks.withColumn("embedding", embed(F.col("content"))).select("chunk_id", "source", "parent_id", "ordinal", "content", "chunk_role", "embedding"), parents


def retrieve(store: Store, questions: DataFrame, top_k: int | None = None, config: Config | None = None) -> DataFrame:
    """Hits of questions (query_id, question): query_id, rank, id, source, content, parent, scores and confidence.

    With query rewriting each question is asked in several ways, the lists are fused by parent, and the fused ones are
    reranked against the question as it was asked.
    """
    config = config or Config.load(store.spark)
    top_k = top_k or config.top_k
    chunks, parents = store.chunks(), store.parents()
    embed = providers.chosen(providers.EMBEDDERS, config.embedder)(config.embedding_dim)
    score = providers.chosen(providers.RERANKERS, config.reranker)
    index = store.index() or lexical.build_index(chunks, "chunk_id", "content")
    vectors = chunks.select(F.col("chunk_id").alias("vec_id"), "embedding")
    asked = questions.select("query_id", "question")
    if config.use_query_rewrite:
        variants = expanded_variants(F.col("question"))
        if config.llm != "none":
            model = providers.chosen(providers.MODELS, config.llm)
            asked = stage_table(asked.withColumn("_reply", model(F.concat(F.lit(fixed.REWRITE_RULES + "\n\n"), "question"))), "rewritten")
            variants = rewritten_variants(F.col("_reply"), F.col("question"))
        asked = asked.select("query_id", F.posexplode(variants).alias("list_no", "question")).withColumn("whole_id", F.col("query_id")).withColumn("query_id", F.concat_ws("\u0001", F.col("query_id").cast("string"), "list_no"))
    shown = chunking.with_parents(chunks.select("chunk_id", "source", "parent_id", "ordinal", "content", "chunk_role"), parents).drop("shown_text")
    query_vectors = asked.select("query_id", embed(F.col("question")).alias("query_vector"))

    def reranked(hits: DataFrame, by: DataFrame) -> DataFrame:
        return providers.score_pairs(hits, by, chunks.select(F.col("chunk_id").alias("doc_id"), "content"), score)

    hits = ranking.retrieve(index, vectors, asked.select("query_id", "question"), query_vectors, lambda h: reranked(h, asked.select("query_id", "question")), config)
    if config.use_query_rewrite:
        lists = hits.join(asked.select("query_id", "whole_id", "list_no"), "query_id").drop("query_id").withColumnRenamed("whole_id", "query_id")
        lists = lists.join(shown.select(F.col("chunk_id").alias("doc_id"), "parent_id"), "doc_id").withColumnRenamed("doc_id", "id")
        fused = fusion.fuse_by_parent(lists.select("query_id", "list_no", "rank", "id", "parent_id")).withColumnRenamed("id", "doc_id").drop("parent_id", "fusion_key")
        hits = ranking.with_confidence(ranking.rerank(reranked(fused, questions.select("query_id", "question")), F.col("pair_score"), top_k), config)
    out = hits.where(F.col("rank") <= top_k).join(shown.withColumnRenamed("chunk_id", "doc_id"), "doc_id")
    return out.withColumnRenamed("doc_id", "id")


def answer(store: Store, questions: DataFrame, top_k: int | None = None, memories: DataFrame | None = None, past: DataFrame | None = None, config: Config | None = None) -> DataFrame:
    """query_id, question, answer, confidence, status and sources of questions (query_id, question).

    ``memories`` and ``past`` have query_id and memory or history.  Without any hit the store counts as empty; below the
    confidence gate, or where the answerability gate refuses, the answer is a fixed text and shows two sources.
    """
    config = config or Config.load(store.spark)
    model = providers.chosen(providers.MODELS, config.llm)
    hits = stage_table(retrieve(store, questions, top_k, config), "hits")
    if config.use_critic:
        hits = criticised(hits, questions, config)
    gate = gates.confidence_gate(hits, config.confidence_threshold)
    rows = questions.select("query_id", "question").join(gate, "query_id", "left").join(context.model_context(hits), "query_id", "left").join(context.bounded_context(hits).withColumnRenamed("context", "evidence_context"), "query_id", "left")
    for extra, name in ((memories, "memory"), (past, "history")):
        rows = rows.withColumn(name, F.lit(None).cast("string")) if extra is None else rows.join(extra.select("query_id", name), "query_id", "left")
    open_ = F.col("max_confidence").isNotNull() & ~F.coalesce("rejected", F.lit(False))
    rows = stage_table(rows.withColumn("_check", model(F.when(open_ & F.lit(config.use_answerability_check), checked_prompt()))), "checked")
    failed = open_ & F.col("_check").isNull() & F.lit(config.llm != "none")
    checked = gates.answerability(F.col("_check"), F.col("evidence_context"), F.col("max_confidence").isNotNull(), failed)
    rows = rows.withColumn("status", F.when(F.lit(config.use_answerability_check), checked.status).otherwise("SKIPPED"))
    refused = gates.answerability_gate(F.col("status"), config.use_answerability_check)
    asks = open_ & ~refused
    reply = model(F.when(asks, context.prompt(F.col("question"), F.col("context"), F.col("memory"), F.col("history"))))
    text = (
        F.when(F.col("max_confidence").isNull(), fixed.EMPTY_STORE)
        .when(F.col("rejected"), context.refusal(F.col("max_confidence")))
        .when(refused, fixed.UNCONFIRMED)
        .otherwise(F.coalesce(reply, F.col("context")))
    )
    rows = rows.select("query_id", "question", text.alias("answer"), F.coalesce("max_confidence", F.lit(0.0)).alias("confidence"), "status", asks.alias("delivered"))
    cited = context.sources_of(hits).join(rows.select("query_id", "delivered"), "query_id").where("delivered or index <= 2")
    sources = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", "source", "confidence", "snippet", "heading", "line", "context"))).alias("sources"))
    return rows.join(sources, "query_id", "left")


def checked_prompt() -> Column:
    """What a model is asked about ``evidence_context`` and ``question``."""
    return F.concat_ws("\n\n", F.lit(fixed.ANSWERABILITY_RULES), "evidence_context", "question")


def criticised(hits: DataFrame, questions: DataFrame, config: Config) -> DataFrame:
    """Hits that the critic leaves: a model's verdicts if there is a model, else the rule of least confidence."""
    if config.llm == "none":
        return gates.apply_critic(hits.withColumn("verdict", gates.heuristic_verdict(F.col("confidence"))))
    return gates.apply_critic(stage_table(gates.model_verdicts(hits, questions, providers.chosen(providers.MODELS, config.llm)), "verdicts"))


def answerability_rows(hits: DataFrame, questions: DataFrame, config: Config) -> DataFrame:
    """query_id, status and expected of labelled questions (expect_answerability)."""
    model = providers.chosen(providers.MODELS, config.llm)
    rows = questions.join(context.bounded_context(hits).withColumnRenamed("context", "evidence_context"), "query_id", "left")
    rows = stage_table(rows.withColumn("_check", model(F.when(F.col("evidence_context").isNotNull(), checked_prompt()))), "checked")
    failed = F.col("evidence_context").isNotNull() & F.col("_check").isNull() & F.lit(config.llm != "none")
    checked = gates.answerability(F.col("_check"), F.col("evidence_context"), F.col("evidence_context").isNotNull(), failed)
    return rows.select("query_id", checked.status.alias("status"), F.col("expect_answerability").alias("expected"))


def evaluate(store: Store, test_set: DataFrame, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows and summary of a labelled set (query_id, question, keywords, must_cite, expect_reject, negative_type)."""
    config = config or Config.load(store.spark)
    hits = stage_table(retrieve(store, test_set, 5, config), "hits")
    if config.use_critic:
        hits = criticised(hits, test_set, config)
    texts = hits.select("query_id", "rank", "source", evaluation.metric_text(F.col("content"), F.col("parent_text")).alias("text"), "confidence")
    rows = stage_table(evaluation.question_rows(test_set, texts, config.confidence_threshold), "evaluation")
    summary = evaluation.summary(rows)
    if config.evaluate_answerability:
        checked = evaluation.answerability_summary(answerability_rows(hits, test_set, config))
        names = ("evaluated", "definitive", "coverage", "accuracy")
        long = "stack({}, {}) as (metric, value)".format(len(names), ", ".join(f"'answerability_{n}', double({n})" for n in names))
        summary = summary.unionByName(checked.selectExpr(long))
    return rows, summary


def faithfulness(results: DataFrame, config: Config) -> DataFrame:
    """question, score and unsupported claims of saved results (question, answer, contexts, sources), as a model judges them."""
    model = providers.chosen(providers.MODELS, config.llm)
    passages = F.array_join(F.transform(probe.contexts_of(F.col("contexts"), F.col("sources")), lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n\n")
    replied = stage_table(results.withColumn("_reply", model(F.concat_ws("\n\n", F.lit(fixed.CLAIM_RULES), passages, "question", "answer"))), "claims")
    return replied.select("question", probe.judged_claims(F.col("_reply")).alias("j")).select("question", "j.score", "j.unsupported")


def diagnose(store: Store, questions: DataFrame, config: Config | None = None) -> DataFrame:
    """check and passed: the store's size, each list, confidences, spread of rerank scores, and a small evaluation.

    ``questions`` has query_id, question and must_cite; the small evaluation passes if every first hit is a wanted one.
    """
    config = config or Config.load(store.spark)
    chunks, asked = store.chunks(), questions.select("query_id", "question")
    index = store.index() or lexical.build_index(chunks, "chunk_id", "content")
    embed = providers.chosen(providers.EMBEDDERS, config.embedder)(config.embedding_dim)
    near = dense.search(chunks.select(F.col("chunk_id").alias("vec_id"), "embedding"), asked.select("query_id", embed(F.col("question")).alias("query_vector")), 5)
    hits = stage_table(retrieve(store, questions, 5, config), "hits")
    checks = diagnostics.retrieval_checks(lexical.search(index, asked, 5, matched_only=True), near, hits)
    size = diagnostics.collection_size(chunks).select(F.lit("collection").alias("check"), (F.col("verdict") == "ok").alias("passed"))
    first = questions.join(hits.where("rank = 1").select("query_id", "source"), "query_id", "left")
    mini = first.agg(F.coalesce(F.bool_and(F.coalesce(evaluation.cited(F.col("source"), F.col("must_cite")), F.lit(False))), F.lit(False)).alias("passed"))
    return size.unionByName(checks).unionByName(mini.select(F.lit("mini_eval").alias("check"), "passed"))
