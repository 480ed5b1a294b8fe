"""The queries of the core operators, by name, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.fixtures import FIXTURES
from millrace.functions import text as X
from millrace.functions.vector import clamp01, normalize_vector, sigmoid
from millrace.operators import analytics as A
from millrace.operators import chunking as C
from millrace.operators import evaluation as E
from millrace.operators import guard as G
from millrace.operators import hybrid as H
from millrace.operators import lexical as L
from millrace.operators import prompts as P
from millrace.operators import records as R
from millrace.oracles import ORACLES
from millrace.oracles_chains import CHAINS
from millrace.plans.lineage import cut
from millrace.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
K, ARM, TOP_N = 10, 20, 5
REFUSAL = G.INSUFFICIENT


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def fixture(spark: SparkSession, name: str) -> DataFrame:
    """Rows written in the repository, for what the tables never hold."""
    schema, rows = FIXTURES[name]
    return spark.createDataFrame(rows, schema)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk once, as indexed last."""
    return R.latest(read_table(spark, d, "chunks"), "id", "indexed_at", "token_count", "topic", "query_text")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "evaluation_cases")


def _child():
    return F.coalesce(F.col("strategy"), F.lit("")) != "parent"


# --- lexical search -------------------------------------------------------------------------------


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return L.bm25_top_k(_cases(spark, d), _chunks(spark, d), K, searched=_child()).select("query_id", "id", "rank", "score")


@query
def bm25_distinct_topk(spark: SparkSession, d: str) -> DataFrame:
    return L.bm25_top_k(_cases(spark, d), read_table(spark, d, "documents"), K, key="doc_id", distinct=True).select("query_id", "doc_id", "rank", "score")


@query
def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return L.term_ids(L.term_frequencies(L.postings(read_table(spark, d, "documents"), "doc_id", "text")))


@query
def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return L.corpus_stats(read_table(spark, d, "documents"), "text")


@query
def doc_vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    weights = L.document_weights(L.postings(docs, "doc_id", "text"), L.corpus_stats(docs, "text"), "doc_id")
    return weights.select("doc_id", "term", F.round("weight", 9).alias("weight"))


@query
def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    weights = L.query_weights(_cases(spark, d), L.term_frequencies(L.postings(docs, "doc_id", "text")), L.corpus_stats(docs, "text"), "query_id", "query")
    return weights.select("query_id", "term", F.round("idf", 9).alias("idf"))


# --- text -----------------------------------------------------------------------------------------


@query
def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return read_table(spark, d, "documents").select("doc_id", F.size(X.tokenize(t)).alias("tokens"), F.size(F.array_distinct(X.tokenize(t))).alias("terms"), F.size(X.content_tokens(t)).alias("content_tokens"))


@query
def normalize_ws(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.md5(X.normalize_whitespace(F.col("text"))).alias("digest"))


@query
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", X.truncate(F.col("text"), 90).alias("short"), X.clamp_query(F.col("text")).alias("clamped"))


@query
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("estimate"))


@query
def script_detect(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "source_documents").select("document_id", X.script_of(F.col("text")).alias("script"))


@query
def language_names(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "source_documents").groupBy("language").agg(F.count(F.lit(1)).alias("n")).select("language", X.language_name(F.col("language")).alias("name"), "n")


@query
def trigram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select("query_id", F.round(X.trigram_similarity(F.col("query"), F.col("english_query")), 9).alias("similarity"))


@query
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    q, answer = F.coalesce("query", F.lit("")), X.tokenize(F.coalesce("answer", F.lit("")))
    shared = X.let(F.struct(X.tokenize(q).alias("a"), answer.alias("b")), lambda x: X.jaccard(x["a"], x["b"]))
    return _cases(spark, d).select("query_id", F.round(shared, 9).alias("jaccard"), F.round(X.coverage(X.content_tokens(q), answer), 9).alias("coverage"))


@query
def chunk_uuid(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("::", "document_id", "passage_id", "strategy", "chunk_index")
    return _chunks(spark, d).select("id", X.uuid_of(key).alias("made"))


@query
def metadata_headers(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).withColumn("t", X.topic_of(F.col("query_text"), F.col("topic"), F.coalesce("text", F.lit(""))))
    header = X.metadata_header(F.col("t"), F.col("language"), F.col("source"))
    return rows.select("id", F.col("t").alias("topic"), header.alias("header"), F.md5(X.with_header(header, F.coalesce("text", F.lit("")))).alias("embedded"))


@query
def rough_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").select("doc_id", F.explode(X.sentences(F.coalesce("text", F.lit("")))).alias("s"))
    return rows.select("doc_id", F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"), F.md5("s.text").alias("digest"))


@query
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, "pages").select("page_id", X.strip_html(F.col("html")).alias("plain"), X.snippet_of(F.col("html"), 60).alias("snippet"))


@query
def html_results(spark: SparkSession, d: str) -> DataFrame:
    pattern = r'(?is)<a[^>]+class="result__a"[^>]+href="([^"]+)"[^>]*>(.*?)</a>.*?<a[^>]+class="result__snippet"[^>]*>(.*?)</a>'
    rows = fixture(spark, "pages").select("page_id", F.posexplode(F.arrays_zip(*(F.regexp_extract_all("html", F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(("url", "title", "snippet"), 1)))).alias("n", "r"))
    made = rows.select("page_id", F.col("n").alias("position"), "r.url", X.strip_html(F.col("r.title")).alias("title"), X.snippet_of(F.col("r.snippet")).alias("snippet"))
    return made.filter(F.length("snippet") >= 30)


@query
def speech_texts(spark: SparkSession, d: str) -> DataFrame:
    """Of every document and of written answers with all kinds of markup."""
    rows = read_table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), "text").unionByName(fixture(spark, "answers").select(F.concat(F.lit("a"), "answer_id").alias("key"), F.col("answer").alias("text")))
    return rows.select("key", F.md5(X.speech_text(F.col("text"))).alias("spoken"))


@query
def speech_pieces(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("array<string>")
    def pieces(texts):
        return texts.map(lambda t: C.speech_chunks(t or ""))

    rows = read_table(spark, d, "documents").select("doc_id", F.posexplode(pieces(X.speech_text(F.coalesce("text", F.lit("")), None))).alias("piece", "t"))
    return rows.select("doc_id", "piece", F.length("t").alias("chars"), F.md5("t").alias("digest"))


@query
def speech_languages(spark: SparkSession, d: str) -> DataFrame:
    from millrace.functions.speech import speech_language, speech_speaker

    rows = fixture(spark, "voices")
    return rows.select("voice_id", speech_language(F.col("language")).alias("language"), speech_speaker(F.col("speaker")).alias("speaker"))


@query
def formatted(spark: SparkSession, d: str) -> DataFrame:
    from millrace.functions import display as V

    rows = fixture(spark, "numbers")
    x = F.col("x")
    return rows.select("n", V.milliseconds(x).alias("ms"), V.percent(x, 1).alias("percent"), V.compact(x).alias("compact"), V.size_in_bytes(x).alias("bytes"), V.minutes(x).alias("minutes"), V.grouped_number(x).alias("grouped"))


# --- dense search and fusion ----------------------------------------------------------------------


@query
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings")
    asked = rows.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return H.dense_top_k(asked, rows, K, key="vec_id", vector="embedding")


@query
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = normalize_vector(F.col("vector"))
    return read_table(spark, d, "vector_records").filter(F.size("vector") > 0).groupBy("id").agg(F.first("vector").alias("vector")).select("id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.element_at(v, 1), 6).alias("head"))


def _query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for query embeddings: the vector of the least chunk id of each case's query."""
    rows = read_table(spark, d, "vector_records").filter(F.size("vector") == 96)
    return rows.groupBy(F.col("metadata.query_id").alias("query_id")).agg(F.min_by("vector", "id").alias("query_vector")).join(_cases(spark, d).select("query_id"), "query_id", "left_semi")


def _dense(spark: SparkSession, d: str) -> DataFrame:
    children = read_table(spark, d, "vector_records").filter(H.search_filter(F.col("is_parent"))).dropDuplicates(["id"])
    return H.dense_top_k(_query_vectors(spark, d), children, ARM)


def _hybrid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both arms fused, at most 2 * ARM rows a query, and the chunks. Both are written once: statistics, search and all
    later steps read the chunks again, which would otherwise be made of the table's repeated rows each time."""
    chunks = cut(_chunks(spark, d).select("id", "text", "document_id", "parent_chunk", "strategy", "source", "language", "topic"))
    sparse = L.bm25_top_k(_cases(spark, d), chunks, ARM, searched=_child())
    return cut(H.reciprocal_rank_fusion(_dense(spark, d), sparse)), chunks


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d)[0]


@query
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).filter(F.col("rank") <= K).select("query_id", "id", "rank", F.round("fused_score", 9).alias("fused_score"), "dense_rank", "sparse_rank", F.array_join("matched_by", "+").alias("matched_by"))


@query
def arm_agreement(spark: SparkSession, d: str) -> DataFrame:
    return H.arm_agreement(_fused(spark, d)).select("query_id", F.round("agreement", 9).alias("agreement"))


def _candidates(spark: SparkSession, d: str, found: tuple[DataFrame, DataFrame], k: int | None = K) -> DataFrame:
    """The best k fused candidates with their texts; without k all of them."""
    fused, chunks = found
    return (fused if k is None else fused.filter(F.col("rank") <= k)).join(chunks.drop("strategy"), "id").join(_cases(spark, d).select("query_id", "query"), "query_id")


def _reranked(spark: SparkSession, d: str, found: tuple[DataFrame, DataFrame]) -> DataFrame:
    scored = L.heuristic_rerank(_candidates(spark, d, found), "query", "text", "fused_score").withColumnRenamed("rank", "rank_before")
    return L.top_k(scored, TOP_N, score="rerank_score").withColumnRenamed("rank", "rank_after")


@query
def heuristic_rerank(spark: SparkSession, d: str) -> DataFrame:
    rows = _reranked(spark, d, _hybrid(spark, d))
    return rows.select("query_id", "id", "rank_before", "rank_after", (F.col("rank_before") - F.col("rank_after")).alias("gain"), F.round("rerank_score", 6).alias("rerank_score"))


@query
def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    return H.maximal_marginal_relevance(_candidates(spark, d, _hybrid(spark, d), None), K)


@query
def candidate_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of a query's candidates, which diversity compares: their trigrams are made once each, before the join."""
    rows = _candidates(spark, d, _hybrid(spark, d), None).select("query_id", "rank", X.trigrams(F.coalesce("text", F.lit(""))).alias("grams"))
    a, b = (rows.select("query_id", F.col("rank").alias(f"rank_{x}"), F.col("grams").alias(f"grams_{x}")) for x in "ab")
    return a.join(b, "query_id").filter("rank_a < rank_b").select("query_id", "rank_a", "rank_b", F.round(X.jaccard(F.col("grams_a"), F.col("grams_b")), 9).alias("similarity"))


@query
def parent_expansion(spark: SparkSession, d: str) -> DataFrame:
    found = _hybrid(spark, d)
    hits = _reranked(spark, d, found).select("query_id", "id", "parent_chunk")
    return H.expand_parents(hits, found[1].select("id", "text")).select("query_id", "id", F.coalesce(F.length("parent_text"), F.lit(0)).alias("parent_chars"))


@query
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "vector_records")
    wanted = H.search_filter(F.col("is_parent"), languages=(F.col("metadata.language"), ["hin_Deva", "tam_Taml"]), strategies=(F.col("metadata.strategy"), ["overlap", "semantic", "recursive"]))
    return rows.filter(wanted).select("id", F.col("metadata.language").alias("language")).distinct()


@query
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    wanted = _chunks(spark, d).filter("parent_chunk IS NOT NULL").select(F.col("parent_chunk").alias("id"))
    return R.lookup(_chunks(spark, d).select("id", "document_id", "strategy"), wanted, "id")


@query
def exact_cache(spark: SparkSession, d: str) -> DataFrame:
    """Requests that one of the last five minutes with the same form answers."""
    log = A.once_each(read_table(spark, d, "request_log")).withColumns({"at": A.event_time(F.col("created_at")), "form": X.cache_form(F.coalesce("query", F.lit(""))), "options_key": H.options_key(F.lit(10), F.lit(5), F.lit(True), F.lit(True), F.lit(True), F.array("language"))})
    log = log.filter(F.col("at").isNotNull() & (F.col("form") != ""))
    # an entry can only answer within its time to live: both sides are keyed by slots of that length, so that a hot query is many keys
    slot = F.floor(F.unix_millis("at") / 300_000)
    entries = log.select("form", F.col("at").alias("stored_at"), "options_key", F.explode(F.array(slot, slot + 1)).alias("slot")).select("form", "stored_at", F.concat_ws("#", "options_key", F.col("slot").cast("string")).alias("options_key")).distinct()
    asked = log.select("request_id", "form", "at", F.concat_ws("#", "options_key", slot.cast("string")).alias("options_key"))
    hits = H.exact_cache_hits(asked, entries)
    return hits.select("request_id", F.unix_millis("stored_at").alias("stored_ms"))


@query
def semantic_cache(spark: SparkSession, d: str) -> DataFrame:
    """Requests: the vector of each case's least chunk id, asked when that was indexed. Entries: all vectors, under their language.
    The table's times lie days apart, so an entry serves a month."""
    rows = read_table(spark, d, "vector_records").filter((F.size("vector") == 96) & ~F.col("is_parent")).groupBy("id").agg(F.first("vector").alias("vector"), F.max("upserted_at").alias("at"), F.min("metadata.query_id").alias("query_id"), F.min("metadata.language").alias("options_key"))
    rows = rows.withColumn("vector", normalize_vector(F.col("vector")))
    asked = rows.groupBy("query_id").agg(F.min_by(F.struct("options_key", "vector", "at"), "id").alias("r")).join(_cases(spark, d).select("query_id"), "query_id", "left_semi")
    entries = rows.select(F.col("id").alias("entry_id"), "options_key", "vector", F.col("at").alias("stored_at"))
    return H.semantic_cache_hits(asked.select(F.col("query_id").alias("request_id"), "r.*"), entries, ttl_ms=30 * 86_400_000)


@query
def retrieve_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Both arms, fusion, diversity, reranking and expansion in one plan."""
    from millrace.plans.pipelines import retrieve

    vectors = read_table(spark, d, "vector_records").filter(F.size("vector") == 96).dropDuplicates(["id"]).select("id", "vector")
    chunks = _chunks(spark, d).select("id", "text", "document_id", "parent_chunk", "strategy", "source", "language", "topic").join(vectors, "id", "left")
    asked = _cases(spark, d).select("query_id", "query").join(_query_vectors(spark, d), "query_id", "left")
    rows, _ = retrieve(asked, chunks)
    return rows.select("query_id", "id", "document_id", "rank_before", "rank_after", F.round("rerank_score", 6).alias("rerank_score"), F.coalesce(F.length("parent_text"), F.lit(0)).alias("parent_chars"))


# --- evaluation -----------------------------------------------------------------------------------


def _expected(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select("query_id", F.explode("expected_document_ids").alias("document_id")).distinct()


def _ranked_documents(spark: SparkSession, d: str) -> DataFrame:
    hits = bm25_topk(spark, d).join(_chunks(spark, d).select("id", "document_id"), "id")
    return E.best_ranks(hits)


@query
def dedupe_best_rank(spark: SparkSession, d: str) -> DataFrame:
    return _ranked_documents(spark, d)


@query
def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    m = E.ranking_metrics(_ranked_documents(spark, d), _expected(spark, d))
    return m.select("query_id", "relevant", *(F.round(c, 9).alias(c) for c in ("recall", "precision", "reciprocal_rank", "ndcg")), "hit")


@query
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    at5 = E.ranking_metrics(_ranked_documents(spark, d), _expected(spark, d), 5)
    at10 = E.ranking_metrics(_ranked_documents(spark, d), _expected(spark, d), 10).select("query_id", F.col("recall").alias("recall10"))
    mean = lambda c: F.round(F.avg(c), 6)
    return at5.join(at10, "query_id").agg(mean("recall").alias("recall_at_5"), mean("recall10").alias("recall_at_10"), mean("precision").alias("precision_at_5"), mean("reciprocal_rank").alias("mrr"), mean("ndcg").alias("ndcg_at_5"), mean(F.col("hit").cast("int")).alias("hit_rate"), F.count(F.lit(1)).alias("queries"))


@query
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return E.stride_sample(_cases(spark, d).select("query_id", "language"), 25, "query_id")


# --- analytics ------------------------------------------------------------------------------------


def _log(spark: SparkSession, d: str) -> DataFrame:
    return A.once_each(read_table(spark, d, "request_log"))


@query
def stage_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.stage_stats(_log(spark, d)).withColumn("mean", F.round("mean", 4))


@query
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").select("event_type", F.col("value").alias("ms"))
    return A.percentile_rows(rows, "ms", ["event_type"]).withColumn("mean", F.round("mean", 4))


@query
def throughput_hourly(spark: SparkSession, d: str) -> DataFrame:
    return A.hourly_throughput(_log(spark, d)).withColumn("average_ms", F.round("average_ms", 4))


@query
def analytics_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return A.snapshot(_log(spark, d)).withColumns({c: F.round(c, 4) for c in ("average_ms", "average_confidence")})


@query
def recent_requests(spark: SparkSession, d: str) -> DataFrame:
    return A.recent(_log(spark, d), 1000).select("recency", "request_id", "status")


@query
def rate_limits(spark: SparkSession, d: str) -> DataFrame:
    rows = _log(spark, d).withColumn("client", R.query_id_of(F.col("query_id")))
    return A.minute_limits(rows, "client", {"general": 60, "query": 20, "voice": 12})


@query
def budget_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return A.budget_verdicts(A.stage_stats(_log(spark, d))).withColumn("peak", F.round("peak", 4))


@query
def latest_vs_median(spark: SparkSession, d: str) -> DataFrame:
    return A.latest_and_upper_median(_log(spark, d).withColumn("status", F.coalesce("status", F.lit("none"))), "total", "status")


@query
def transcript_confidence(spark: SparkSession, d: str) -> DataFrame:
    return A.transcript_confidence(fixture(spark, "transcripts"), "transcript_id", "words", "probability").withColumn("confidence", F.round("confidence", 9))


# --- guardrails -----------------------------------------------------------------------------------


@query
def guardrail_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every rule on every document and on written cases of each rule."""
    docs = read_table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), F.col("text").alias("query"))
    rows = docs.unionByName(fixture(spark, "prompts").select("key", "query")).filter(F.col("query").isNotNull())
    groups = ("prompt_injection", "jailbreak", "toxicity", "out_of_scope")
    hits = F.concat(*(G.rule_hits(F.col("query"), g) for g in groups))
    return rows.select("key", F.explode(hits).alias("rule"))


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    """The query of every request once, and written cases of each rule."""
    asked = read_table(spark, d, "request_log").groupBy(F.concat(F.lit("r"), "request_id").alias("key")).agg(F.min("query").alias("query"))
    return asked.unionByName(fixture(spark, "prompts").select("key", "query"))


@query
def guardrail_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = _prompts(spark, d)
    return G.input_report(rows, "key", "query").select("key", "guard", F.round("score", 4).alias("score"), "verdict", F.array_join("evidence", " ; ").alias("evidence"))


@query
def guardrail_reports(spark: SparkSession, d: str) -> DataFrame:
    rows = _prompts(spark, d)
    return G.merge_reports(G.input_report(rows, "key", "query"), "key")


@query
def guardrail_events(spark: SparkSession, d: str) -> DataFrame:
    rows = _prompts(spark, d)
    return G.input_report(rows, "key", "query").filter("verdict <> 'pass'").groupBy("guard").agg(F.count(F.lit(1)).alias("events"))


@query
def latest_guardrails(spark: SparkSession, d: str) -> DataFrame:
    return G.latest_results(fixture(spark, "staged_results"), "key", "seq").select("key", "guard", "verdict", "score")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    fused, chunks = found = _hybrid(spark, d)
    hits = H.expand_parents(_reranked(spark, d, found), chunks.select("id", "text"))
    return G.evidence_checks(_cases(spark, d), hits, H.arm_agreement(fused))


@query
def evidence_guardrails(spark: SparkSession, d: str) -> DataFrame:
    rows = _evidence(spark, d)
    return rows.select("query_id", "chunks", *(F.round(c, 6).alias(c) for c in ("top_score", "mean_score", "agreement", "coverage", "off_topic_score", "verification_score")), "similarity_verdict", "off_topic_verdict", "verification_verdict")


def _grounded(spark: SparkSession, d: str) -> DataFrame:
    """Of each case: how much of its answer the texts of its expected documents support."""
    texts = read_table(spark, d, "source_documents").select("document_id", "text").dropDuplicates(["document_id"])
    context = _expected(spark, d).join(texts, "document_id").groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(X.tokenize(F.coalesce("text", F.lit("")))))).alias("context"))  # a query's expected documents
    rows = _cases(spark, d).join(context, "query_id", "left")
    return rows.select("query_id", G.groundedness(F.col("answer"), F.col("context")).alias("groundedness"))


@query
def groundedness(spark: SparkSession, d: str) -> DataFrame:
    return _grounded(spark, d).select("query_id", F.round("groundedness", 9).alias("groundedness"), (F.col("groundedness") < G.GROUNDEDNESS).alias("hallucinated"))


@query
def confidence_blend(spark: SparkSession, d: str) -> DataFrame:
    rows = G.confidence(fixture(spark, "signals"))
    return rows.select("key", "confidence", "sufficient", "worst", G.outcome(F.col("answer"), F.col("sufficient"), REFUSAL).alias("status"), G.final_answer(F.col("answer"), F.col("sufficient")).alias("final"), F.round(G.unverified_confidence(F.col("groundedness")), 6).alias("unverified"))


@query
def answer_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain on the labelled cases, their answers standing for generated ones."""
    rows = _evidence(spark, d).join(_grounded(spark, d), "query_id").join(_cases(spark, d).select("query_id", "answer"), "query_id")
    rows = G.confidence(rows)
    return rows.select("query_id", F.round("confidence", 3).alias("confidence"), "worst", G.outcome(F.col("answer"), F.col("sufficient"), REFUSAL).alias("status"), F.md5(G.final_answer(F.col("answer"), F.col("sufficient"))).alias("final"))


@query
def score_clamps(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return fixture(spark, "numbers").select("n", F.round(clamp01(x), 9).alias("clamped"), F.round(sigmoid(F.coalesce(x, F.lit(0.0))), 9).alias("sigmoid"))


# --- prompts --------------------------------------------------------------------------------------


def _blocks(spark: SparkSession, d: str, budget: int = P.CONTEXT) -> DataFrame:
    found = _hybrid(spark, d)
    hits = H.expand_parents(_reranked(spark, d, found), found[1].select("id", "text"))
    return P.context_blocks(hits.select("query_id", "id", "document_id", F.col("rank_after").alias("rank"), "text", "parent_text", "source", "language", "topic", F.col("rerank_score").alias("score")), budget=budget)


@query
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("query_id", "index", "id", "document_id", "used", F.md5("snippet").alias("snippet"), F.md5("block").alias("block"))


@query
def context_budget_tight(spark: SparkSession, d: str) -> DataFrame:
    """Under a budget that most queries exceed, so that the last block is cut."""
    return _blocks(spark, d, 1_000).select("query_id", "index", "id", "used")


@query
def prompt_messages(spark: SparkSession, d: str) -> DataFrame:
    """The whole prompt, with the latest requests of the same query for its conversation."""
    log = A.once_each(read_table(spark, d, "request_log")).filter("query_id IS NOT NULL")
    turns = log.select("query_id", F.struct("created_at", "request_id").alias("turn"), F.lit("user").alias("role"), F.coalesce("query", F.lit("")).alias("content"))
    made = P.messages(_cases(spark, d), _blocks(spark, d), REFUSAL, turns)
    return made.select("query_id", "blocks", F.size("messages").alias("messages"), "estimated_tokens", F.md5(F.element_at("messages", -1)["content"]).alias("asked"))


@query
def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    return P.recent_turns(fixture(spark, "turns"), "conversation_id", "turn", 3).select("conversation_id", "turn", "place", "content")


@query
def web_results(spark: SparkSession, d: str) -> DataFrame:
    return R.merge_web_results(fixture(spark, "web_tiers")).select("query_id", "place", "url", "title")


@query
def web_contexts(spark: SparkSession, d: str) -> DataFrame:
    return R.web_context(R.merge_web_results(fixture(spark, "web_tiers")))


# --- records and index ----------------------------------------------------------------------------


def _records(spark: SparkSession) -> DataFrame:
    return R.normalize_rows(fixture(spark, "raw_rows"))


@query
def normalized_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark)
    return rows.select("query_id", "query_type", "language", "query", "english_query", F.size("passages").alias("passages"), F.size(F.filter("passages", lambda p: p["selected"])).alias("selected"))


@query
def flattened_documents(spark: SparkSession, d: str) -> DataFrame:
    return R.to_documents(_records(spark), "corpus", "dev").select("document_id", "passage_id", "text", "language", "source", "topic", "is_selected")


@query
def cases_from_records(spark: SparkSession, d: str) -> DataFrame:
    return R.cases_from_records(_records(spark)).select("query_id", "query", "answer", F.array_join("expected_document_ids", ",").alias("expected"))


@query
def cases_from_index(spark: SparkSession, d: str) -> DataFrame:
    return R.cases_from_index(_chunks(spark, d)).select("query_id", "query", "language", F.array_join("expected_document_ids", ",").alias("expected"))


@query
def suggestions(spark: SparkSession, d: str) -> DataFrame:
    return R.suggestions(_chunks(spark, d))


@query
def suggestion_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.suggestion_pairs(R.suggestions(_chunks(spark, d)))


@query
def suggestion_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.sample_suggestions(R.suggestions(_chunks(spark, d)), 5, "a")


@query
def language_quota(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "source_documents").dropDuplicates(["document_id"]).select("document_id", "language")
    return R.language_quota(rows, 100, 11, "language", "document_id")


@query
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "vector_records").select("id", "upserted_at", "is_parent")
    return R.upsert(rows.filter("is_parent"), rows, "id", "upserted_at").select("id", "is_parent", F.unix_micros(F.col("upserted_at").cast("timestamp")).alias("upserted_us"))


@query
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.index_stats(_chunks(spark, d))


@query
def index_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.index_counts(_chunks(spark, d))


@query
def dataset_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "source_documents").dropDuplicates(["document_id"])
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("passages"), F.count_if("is_selected").alias("selected"))


@query
def grouped_parents(spark: SparkSession, d: str) -> DataFrame:
    return R.grouped_parents(_chunks(spark, d).select("id", "parent_chunk", "document_id"), 2).select("id", "document_id")


@query
def new_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).select("id", "document_id", "passage_id", "text", "strategy")
    return R.new_windows(rows.filter("strategy = 'sliding_window'"), rows.filter("strategy <> 'sliding_window'")).select("id")


@query
def request_batches(spark: SparkSession, d: str) -> DataFrame:
    return R.batches(_cases(spark, d).select("query_id"), 16, "query_id")


@query
def form_booleans(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, "fields").select("n", R.form_boolean(F.col("value"), True).alias("on"), R.form_boolean(F.col("value"), False).alias("off"))


@query
def request_validation(spark: SparkSession, d: str) -> DataFrame:
    return R.validate_requests(fixture(spark, "form_requests")).select("n", "top_k", "top_n", F.array_join("problems", ",").alias("problems"))


@query
def health_status(spark: SparkSession, d: str) -> DataFrame:
    return R.health(fixture(spark, "services"))


@query
def event_frames(spark: SparkSession, d: str) -> DataFrame:
    from millrace.streaming.frames import parse_frames

    return parse_frames(fixture(spark, "sse"), "stream_id", "body").select("stream_id", "frame", "type", "payload")


# --- chunking -------------------------------------------------------------------------------------


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "source_documents").dropDuplicates(["document_id"])


@query
def chunk_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_documents(_passages(spark, d)).select("id", "document_id", "strategy", "chunk_index", "parent_chunk", "token_count", "char_start", "char_end")


def _steps(method: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: C.spans_by(_passages(spark, d), "document_id", "text", method)


QUERIES |= {"recursive_chunk": _steps("structural"), "semantic_chunk": _steps("topical"), "sliding_window": _steps("sliding"), "overlap_chunk": _steps("overlap"), "parent_chunk": _steps("parents")}

SQL: dict[str, str] = {name: sql for name, sql in {**ORACLES, **CHAINS}.items() if name in QUERIES}
