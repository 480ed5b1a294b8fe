"""The operators put together: indexing a corpus, retrieving for a batch of queries, checking and scoring the result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import chunking, evaluation, guard, hybrid, lexical, prompts
from millrace.operators.models import embed_texts, rerank_with_fallback


@dataclass(frozen=True)
class Retrieval:
    """How many are retrieved, and what is done to them. Each arm gives twice top_k, at least 20."""

    top_k: int = 10
    top_n: int = 5
    rrf_k: int = 60
    mmr: bool = True
    mmr_weight: float = 0.7
    rerank: bool = True
    expand: bool = True

    @property
    def arm(self) -> int:
        return max(2 * self.top_k, 20)


@dataclass
class Index:
    chunks: DataFrame
    terms: DataFrame
    stats: DataFrame
    weights: DataFrame


def build_index(documents: DataFrame, options: chunking.Options = chunking.Options(), model=None) -> Index:
    """Chunks of the documents with, if a model is given, vectors of their texts under their headers; and the
    statistics and weights of their terms. Statistics count parents and windows too."""
    chunks = chunking.chunk_documents(documents, options)
    if model is not None:
        chunks = embed_texts(chunks, "embed_text", "vector", model)
    posted = lexical.postings(chunks, "id", "text")
    stats = lexical.corpus_stats(chunks, "text")
    return Index(chunks, lexical.term_ids(lexical.term_frequencies(posted)), stats, lexical.document_weights(posted, stats, "id"))


def retrieve(queries: DataFrame, chunks: DataFrame, options: Retrieval = Retrieval(), model=None) -> tuple[DataFrame, DataFrame]:
    """The retrieved chunks of each query (query_id, query, query_vector) and the arms' agreement.

    chunks: id, text, document_id, parent_chunk, strategy, source, language, topic, vector. Rows: query_id,
    id, scores and ranks of both arms, fused_score, rank_before, rerank_score, rank_after, parent_text and the chunk's columns.
    """
    child = F.coalesce("strategy", F.lit("")) != "parent"
    sparse = lexical.bm25_top_k(queries, chunks, options.arm, searched=child)
    dense = hybrid.dense_top_k(queries, chunks.filter(child), options.arm)
    fused = hybrid.reciprocal_rank_fusion(dense, sparse, options.rrf_k)
    agreement = hybrid.arm_agreement(fused)
    about = chunks.select("id", "text", "document_id", "parent_chunk", "source", "language", "topic")
    rows = fused.join(about, "id").join(queries.select("query_id", "query"), "query_id")
    if options.mmr:
        chosen = hybrid.maximal_marginal_relevance(rows, options.top_k, options.mmr_weight)
        rows = rows.join(chosen, ["query_id", "id"]).drop("rank").withColumnRenamed("mmr_rank", "rank_before")
    else:
        rows = rows.filter(F.col("rank") <= options.top_k).withColumnRenamed("rank", "rank_before")
    if options.rerank:
        rows, _, _ = rerank_with_fallback(rows, "query", "text", "fused_score", model)
    else:
        rows = rows.withColumn("rerank_score", F.col("fused_score"))
    rows = lexical.top_k(rows, options.top_n, score="rerank_score").withColumnRenamed("rank", "rank_after")
    rows = hybrid.expand_parents(rows, chunks.select("id", "text")) if options.expand else rows.withColumn("parent_text", F.lit(None).cast("string"))
    return rows, agreement


def verify(queries: DataFrame, rows: DataFrame, agreement: DataFrame, answers: DataFrame, refusal: str) -> DataFrame:
    """Evidence checks, groundedness of the answers (query_id, answer) in what was retrieved, confidence and status of each query."""
    from millrace.functions.text import tokenize

    checks = guard.evidence_checks(queries, rows, agreement)
    context = rows.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(tokenize(F.concat_ws(" ", "text", F.coalesce("parent_text", F.lit("")))))) ).alias("context"))  # top_n chunks
    judged = checks.join(answers, "query_id", "left").join(context, "query_id", "left").withColumn("groundedness", guard.groundedness(F.col("answer"), F.col("context"))).drop("context")
    scored = guard.confidence(judged)
    return scored.withColumn("status", F.when(F.col("similarity_verdict") == "block", "unverified").otherwise(guard.outcome(F.col("answer"), F.col("sufficient"), refusal)))


def score(rows: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """Retrieval quality of each query against its expected documents."""
    ranked = evaluation.best_ranks(rows.select("query_id", "document_id", F.col("rank_after").alias("rank")))
    return evaluation.ranking_metrics(ranked, expected, k)


def prompt(queries: DataFrame, rows: DataFrame, refusal: str) -> DataFrame:
    blocks = prompts.context_blocks(rows.withColumn("rank", F.col("rank_after")).withColumn("score", F.col("rerank_score")))
    return prompts.user_messages(queries, blocks, refusal)
