"""The queries of this subpackage, by name, and the SQL of those that SQL expresses on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import estimate_tokens
from millrace.llm.canonical import canonical_text, look_alike_classes, look_alike_pairs
from millrace.llm.mixing import canonical_source, mix_sources
from millrace.llm.neighbours import mutual_pairs, nearest_neighbours
from millrace.llm.oracles import SQL as SQL
from millrace.llm.packing import pack_containers
from millrace.llm.quantiles import build_sketches, merge_sketches, sketch_percentiles
from millrace.llm.segments import recut, split_oversized
from millrace.llm.sentences import split_sentences
from millrace.llm.spans import passage_members, shared_occurrences, shared_share, sharing_pairs
from millrace.llm.tokens import count_tokens, token_totals
from millrace.sources.tables import read_table

CONTAINER = 2048
STAGES = ("total", "dense_retrieval", "reranking", "time_to_first_token")
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def _passages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """source_documents, a row a document: repeated rows have the same text and language."""
    return read_table(spark, d, "source_documents").select("document_id", "text", "language", *columns).dropDuplicates(["document_id"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    sampled = read_table(spark, d, "sentence_samples").select("document_id")
    docs = _passages(spark, d).join(sampled, "document_id", "left_anti")
    return split_sentences(docs, keep=["document_id"]).select("document_id", "char_start", "char_end")


def p1_sampled(spark: SparkSession, d: str) -> DataFrame:
    """The units of the documents that were split by hand."""
    sampled = read_table(spark, d, "sentence_samples").select("document_id").distinct()
    return split_sentences(_passages(spark, d).join(sampled, "document_id", "left_semi"), keep=["document_id"]).select("document_id", "char_start", "char_end", "text")


def p1_sentences(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(_passages(spark, d))


def _stage_times(spark: SparkSession, d: str) -> DataFrame:
    """log_date, stage, value: each request once; what is not a measurement is left out."""
    log = read_table(spark, d, "request_log")
    stamp = F.expr("unix_micros(try_to_timestamp(created_at))")
    day = F.date_format(F.date_from_unix_date(F.floor(stamp / 86_400_000_000).cast("int")), "yyyy-MM-dd")
    rows = log.select(F.coalesce("request_id", F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))).alias("request_id"), F.struct(day.alias("log_date"), *STAGES).alias("r"))
    once = rows.groupBy("request_id").agg(F.min("r").alias("r")).select("r.*")
    long = once.select("log_date", F.inline(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("value")) for s in STAGES))))
    return long.filter(F.col("log_date").isNotNull() & (F.col("value") >= 0))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return build_sketches(_stage_times(spark, d), ["log_date", "stage"], "value")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    read = sketch_percentiles(_daily(spark, d), {"p50": 0.5, "p95": 0.95})
    return read.filter("p95 >= 3 * p50").select("log_date", "stage")


def p2_daily(spark: SparkSession, d: str) -> DataFrame:
    return sketch_percentiles(_daily(spark, d), PERCENTILES)


def p2_weekly(spark: SparkSession, d: str) -> DataFrame:
    """The days' sketches combined to weeks (of Monday)."""
    weekly = _daily(spark, d).withColumn("week", F.date_format(F.date_trunc("week", F.to_timestamp("log_date")), "yyyy-MM-dd"))
    return sketch_percentiles(merge_sketches(weekly, ["week", "stage"]), PERCENTILES)


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return nearest_neighbours(read_table(spark, d, "vector_records"), "id", "vector")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return mutual_pairs(p3_neighbours(spark, d), 0.92)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The estimate comes from the pieces' characters, which the trie carries beside the token states, summed by text."""
    chunks = read_table(spark, d, "chunks").select("id", "text", "token_count")
    estimates = count_tokens(chunks.dropDuplicates(["id"]), "id").filter("tokens IS NOT NULL").select("id", "estimate")
    wrong = F.col("token_count").isNull() | (F.abs(F.col("token_count") - F.col("estimate")) > 0.25 * F.col("estimate"))
    return chunks.select("id", "token_count").join(estimates, "id").filter(wrong).select(F.col("id").alias("chunk_id")).distinct()


def _counted(spark: SparkSession, d: str) -> DataFrame:
    """Every text of chunks and documents once: record_kind, id, source, language, strategy, domain, tokens, chars, estimate."""
    chunks = read_table(spark, d, "chunks").select(F.lit("chunk").alias("record_kind"), "id", "source", "language", "strategy", F.lit(None).cast("string").alias("domain"), "text").dropDuplicates(["id"])
    documents = read_table(spark, d, "documents").select(F.lit("document").alias("record_kind"), F.col("doc_id").cast("string").alias("id"), canonical_source(F.col("source")).alias("source"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("strategy"), "domain", "text")
    rows = chunks.unionByName(documents).withColumn("key", F.concat_ws(":", "record_kind", "id"))
    counts = count_tokens(rows, "key")
    return rows.drop("text").join(counts, "key").drop("key")


def p4_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d).select("record_kind", "id", "tokens", "estimate", "chars")


def p4_sizes(spark: SparkSession, d: str) -> DataFrame:
    """What the trie counts beside tokens."""
    return _counted(spark, d).select("record_kind", "id", "chars", "estimate")


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    # chunk sources are repository/split#query: the part before # is the source
    rows = _counted(spark, d).withColumn("source", F.substring_index("source", "#", 1))
    slices = [["record_kind", *x] for x in ([], ["source"], ["language"], ["strategy"], ["domain"], ["source", "language"], ["source", "language", "domain"])]
    return token_totals(rows, slices)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    documents = read_table(spark, d, "source_documents").select(F.lit("document").alias("kind"), F.col("document_id").alias("id"), "text")
    chunks = read_table(spark, d, "chunks").select(F.lit("chunk").alias("kind"), "id", "text")
    return documents.unionByName(chunks)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(_texts(spark, d), "kind", "id")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_classes(_texts(spark, d), "kind", "id")


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical_text(_passages(spark, d)).select("document_id", "canonical")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = read_table(spark, d, "chunks").filter("strategy IS NULL OR strategy <> 'parent'")
    # rows of a repeated id have the same text and offsets
    cut_anew = recut(pieces.dropDuplicates(["id"]), _passages(spark, d))
    # what was cut anew, and what cannot be, for want of a passage
    return cut_anew.filter((F.size("pieces") > 0) | F.array_contains("faults", "offsets")).select(F.col("id").alias("chunk_id"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(_passages(spark, d), "document_id")


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each passage that was cut: whether all pieces are within the limit, are counted rightly, cover the passage and overlap."""
    passages = _passages(spark, d)
    pieces = split_oversized(passages, "document_id").join(passages.select("document_id", F.col("text").alias("passage")), "document_id")
    order = W.partitionBy("document_id").orderBy("char_start", "char_end")
    before = F.lag("char_end").over(order)
    cut_out = F.expr("substring(passage, char_start + 1, char_end - char_start)")
    pieces = pieces.withColumns({"joined": before.isNull() | (F.col("char_start") < before), "size": estimate_tokens(cut_out)})
    return pieces.groupBy("document_id").agg(
        (F.max("size") <= 220).alias("within"), (F.max(F.abs(F.col("size") - F.col("token_count"))) == 0).alias("counted"), F.min("joined").alias("overlapping"),
        ((F.trim(F.expr("substring(first(passage), 1, min(char_start))")) == "") & (F.trim(F.expr("substring(first(passage), max(char_end) + 1)")) == "")).alias("whole"),
    )


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return pack_containers(docs, "doc_id", estimate_tokens(F.col("text")), CONTAINER)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing, at the end of its rounds, holds in more than one container."""
    held = _packed(spark, d).filter("container IS NOT NULL").groupBy("doc_id", "nth").agg(F.min("container").alias("one"), F.max("container").alias("other"))
    return held.filter("one <> other").select("doc_id").distinct()


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).drop("nth")


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row: what went in and came out of the containers, and whether none is too full and none but an oversized item is divided."""
    packed = p7_containers(spark, d)
    held = packed.filter("container IS NOT NULL").groupBy("container").agg(F.sum("part_size").alias("fill"))
    full = held.agg((F.max("fill") <= CONTAINER).alias("fits"), (F.count(F.lit(1)) * CONTAINER * 0.95 <= F.sum("fill")).alias("dense"))
    sums = packed.agg(F.count_distinct("doc_id").alias("documents"), F.sum("part_size").alias("units"), F.count(F.lit(1)).alias("parts"), (F.count_if((F.col("parts") > 1) != (F.col("size") > CONTAINER)) == 0).alias("divided_rightly"))
    return sums.crossJoin(full)  # a row each


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, d, "documents")
    return mix_sources(docs, "doc_id", "source", estimate_tokens(F.col("text")), read_table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources of which the schedule, all repeats used, took less than wanted."""
    return _mixed(spark, d)[1].filter("taken < wanted").select("source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    """What each target wants and its source has, and whether the mixture took it: all of it, or all repeats, but for less than a document."""
    shares = _mixed(spark, d)[1]
    took = F.when(F.col("reachable"), (F.col("taken") >= F.col("wanted")) & (F.col("repeats") <= F.col("max_repeats"))).otherwise(F.col("taken") == F.col("max_repeats") * F.col("size"))
    return shares.select("source", "documents", "size", "total", F.round("wanted", 3).alias("wanted"), "reachable", took.alias("taken_rightly"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    return shared_occurrences(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sharing_pairs(_occurrences(spark, d))


def p9_members(spark: SparkSession, d: str) -> DataFrame:
    return passage_members(_occurrences(spark, d)).withColumnRenamed("doc", "doc_id")


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    return shared_share(read_table(spark, d, "documents"), _occurrences(spark, d), "doc_id").withColumn("spans", F.to_json("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_sampled, p1_sentences, p2_found, p2_daily, p2_weekly, p3_found, p3_neighbours, p4_found, p4_sizes, p4_tokens, p4_totals, p5_found, p5_classes, p5_canonical, p6_found, p6_checks, p6_pieces, p7_found, p7_checks, p7_containers, p8_found, p8_sources, p8_shares, p8_mixture, p9_found, p9_members, p9_shared)
}
