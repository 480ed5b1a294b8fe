"""Analytics of a request log: latency percentiles by stage, throughput, outcomes, windows and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.evaluation import running_counts

# Ranks of the reported percentiles.
RANKS = {"p50": 0.5, "p70": 0.7, "p95": 0.95, "p99": 0.99}
#: A retrieval path within this many milliseconds keeps the budget.
BUDGET_MS = 50.0


def measured(x: Column) -> Column:
    """A time, or null for what is not a measurement: null, NaN, infinite or negative."""
    x = x.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")), x)


def retrieval_ms(row: str = "") -> Column:
    """The slower arm, as both run at once, and fusion."""
    c = lambda n: F.coalesce(measured(F.col(row + n)), F.lit(0.0))
    return F.greatest(c("dense_retrieval"), c("sparse_retrieval")) + c("fusion")


def log_entries(requests: DataFrame) -> DataFrame:
    """``requests`` as they are logged: the query's first 300 characters, whole milliseconds in total, the retrieval path to two digits.

    requests: request_id, query, status, confidence, total, tokens_used, chunk_count, voice, created_at and the stage times.
    """
    return requests.withColumns({"query": F.substring("query", 1, 300), "total_latency_ms": F.floor(F.col("total") + 0.5), "retrieval_path_ms": F.floor(retrieval_path_ms() * 100 + 0.5) / 100})


def retrieval_path_ms(row: str = "") -> Column:
    """From query text to ranked context: input guards, embedding, the slower arm, fusion, diversity, reranking, expansion."""
    c = lambda n: F.coalesce(measured(F.col(row + n)), F.lit(0.0))
    return c("guardrails_pre") + c("embedding") + retrieval_ms(row) + c("diversity") + c("reranking") + c("expansion")


def once_each(log: DataFrame, key: str = "request_id") -> DataFrame:
    """Each request once: repeated rows have the same values but for the time they were logged. Null keys stay as they are."""
    alone = log.filter(F.col(key).isNull())
    return log.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(alone)


def percentile_rows(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, count, mean, least, p50, p70, p95, p99, p100: nearest-rank percentiles, exact.

    Equal values are counted before the shuffle; the distinct ones are ranked by running counts over
    ranges of values, so that a group of all rows is spread over all tasks. For very large columns use sketches.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    running = running_counts(counted, value, by)
    # the least value whose running count reaches the rank
    at = {name: F.min(F.when(F.col("_upto") >= F.ceil(F.lit(r) * F.col("_all")), F.col(value))).alias(name) for name, r in RANKS.items()}
    return running.groupBy(*by).agg(
        F.sum("_n").alias("count"), (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"), F.min(value).alias("least"), *at.values(), F.max(value).alias("p100")
    )


def stage_stats(log: DataFrame) -> DataFrame:
    """stage, and its percentiles, of embedding, retrieval, reranking, generation, transcription, retrieval_path and total."""
    stages = {
        "embedding": measured(F.col("embedding")),
        "retrieval": retrieval_ms(),
        "reranking": measured(F.col("reranking")),
        "generation": measured(F.col("generation")),
        "transcription": measured(F.col("transcription")),
        "retrieval_path": retrieval_path_ms(),
        "total": measured(F.col("total")),
    }
    long = log.select(F.inline(F.array(*(F.struct(F.lit(n).alias("stage"), F.round(v, 2).alias("ms")) for n, v in stages.items()))))
    return percentile_rows(long, "ms", ["stage"])


def event_time(created_at: Column) -> Column:
    """The instant of an ISO time with an offset; null if it is none."""
    return F.try_to_timestamp(created_at)


def hourly_throughput(log: DataFrame) -> DataFrame:
    """hour (UTC, ISO), requests, average_ms."""
    hour = F.date_format(F.timestamp_seconds(F.floor(F.unix_seconds(event_time(F.col("created_at"))) / 3600) * 3600), "yyyy-MM-dd'T'HH:00")
    rows = log.select(hour.alias("hour"), measured(F.col("total_latency_ms")).alias("ms")).filter(F.col("hour").isNotNull())
    return rows.groupBy("hour").agg(F.count(F.lit(1)).alias("requests"), F.avg("ms").alias("average_ms"))


def snapshot(log: DataFrame) -> DataFrame:
    """One row of totals by outcome, averages and token sums. An empty log gives zeros."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return log.agg(
        F.count(F.lit(1)).alias("total_requests"),
        is_("answered").alias("answered"),
        is_("blocked").alias("blocked"),
        is_("low_confidence", "insufficient_context").alias("low_confidence"),
        is_("failed", "error").alias("failed"),
        zero(F.avg(measured(F.col("total_latency_ms")))).alias("average_ms"),
        zero(F.avg(F.when(~F.isnan("confidence"), F.col("confidence")))).alias("average_confidence"),
        F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens_used"),
        F.count_if("voice").alias("voice_requests"),
    )


def recent(log: DataFrame, n: int, at: str = "created_at", key: str = "request_id") -> DataFrame:
    """The n latest requests with recency from 1: a partial top-n in every partition, then one of those."""
    latest = log.withColumn("_at", event_time(F.col(at))).orderBy(F.desc_nulls_last("_at"), F.desc(key)).limit(n)
    return latest.withColumn("recency", F.row_number().over(W.orderBy(F.desc_nulls_last("_at"), F.desc(key)))).drop("_at")  # n rows


def minute_limits(log: DataFrame, client: str, limits: dict[str, int]) -> DataFrame:
    """client, minute, requests and, of each named limit, how many requests beyond it a fixed one-minute window had."""
    minute = F.timestamp_seconds(F.floor(F.unix_seconds(event_time(F.col("created_at"))) / 60) * 60)
    counts = log.select(F.col(client).alias("client"), minute.alias("minute")).filter(F.col("minute").isNotNull()).groupBy("client", "minute").agg(F.count(F.lit(1)).alias("requests"))
    return counts.select("client", F.date_format("minute", "yyyy-MM-dd'T'HH:mm").alias("minute"), "requests", *(F.greatest(F.lit(0), F.col("requests") - n).alias(f"{name}_refused") for name, n in limits.items()))


def budget_verdicts(stats: DataFrame, budget: float = BUDGET_MS) -> DataFrame:
    """``stats`` with peak (the greater of p100 and the budget, and a twentieth), within and which percentiles breach it."""
    names = [*RANKS, "p100"]
    over = F.array_compact(F.array(*(F.when(F.col(n) > budget, F.lit(n)) for n in names)))
    return stats.select("stage", (F.greatest("p100", F.lit(budget)) * 1.05).alias("peak"), (F.col("p100") <= budget).alias("within"), F.array_join(over, ",").alias("breaches"))


def latest_and_upper_median(log: DataFrame, value: str, by: str) -> DataFrame:
    """by, latest, upper_median (place n/2 from 0 of the sorted values): through counts of equal values, not through sorted lists."""
    rows = log.select(by, F.round(measured(F.col(value)), 2).alias("v"), event_time(F.col("created_at")).alias("at"), "request_id").filter(F.col("v").isNotNull())
    latest = rows.groupBy(by).agg(F.max_by("v", F.struct("at", "request_id")).alias("latest"))
    counted = running_counts(rows.groupBy(by, "v").agg(F.count(F.lit(1)).alias("_n")), "v", [by])
    median = counted.groupBy(by).agg(F.min(F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col("v"))).alias("upper_median"))
    return latest.join(median, by)


def transcript_confidence(df: DataFrame, key: str, words: str, probability: str) -> DataFrame:
    """key, confidence: exp of the spoken words' mean log probability, three quarters, and the language's, one; either alone if the other is missing."""
    from millrace.functions.vector import clamp01

    spoken = F.filter(words, lambda w: (w["type"] == "word") & w["logprob"].isNotNull())
    mean = F.aggregate(spoken, F.lit(0.0), lambda s, w: s + w["logprob"]) / F.size(spoken)
    word = clamp01(F.exp(mean))
    p = F.col(probability)
    score = F.when(F.coalesce(F.size(spoken), F.lit(0)) <= 0, F.when(p.isNull(), 0.0).otherwise(clamp01(p))).when(p.isNull(), word).otherwise(clamp01(0.75 * word + 0.25 * clamp01(p)))
    return df.select(key, score.alias("confidence"))
