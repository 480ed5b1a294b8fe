"""Retrieval quality of ranked lists against expected documents, all queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.plans.lineage import cut


def best_ranks(hits: DataFrame, query_key: str = "query_id", doc: str = "document_id", rank: str = "rank") -> DataFrame:
    """Each document once a query, at its best rank, ranked again from 1."""
    best = hits.groupBy(query_key, doc).agg(F.min(rank).alias("_best"))
    return best.withColumn(rank, F.row_number().over(W.partitionBy(query_key).orderBy("_best", doc))).drop("_best")


def ranking_metrics(ranked: DataFrame, expected: DataFrame, k: int = 5, query_key: str = "query_id", doc: str = "document_id", rank: str = "rank") -> DataFrame:
    """query key, relevant, recall, precision, reciprocal_rank, ndcg (binary gain), hit of every query of ``expected``
    (query key, doc, distinct). Queries without hits get zeros; those without expected documents are not in it."""
    relevant = expected.groupBy(query_key).agg(F.count(F.lit(1)).alias("relevant"))
    marked = ranked.join(expected.withColumn("_good", F.lit(True)), [query_key, doc], "left").withColumn("_good", F.coalesce("_good", F.lit(False)))
    inside = F.col(rank) <= k
    sums = marked.groupBy(query_key).agg(
        F.count_if(F.col("_good") & inside).alias("found"),
        F.count_if(inside).alias("shown"),
        F.min(F.when(F.col("_good"), F.col(rank))).alias("first"),
        F.sum(F.when(F.col("_good") & inside, 1 / F.log2(F.col(rank) + 1)).otherwise(0.0)).alias("gain"),
    )
    rows = relevant.join(sums, query_key, "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("relevant").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        query_key,
        "relevant",
        zero(F.col("found") / F.col("relevant")).alias("recall"),
        zero(F.when(F.col("shown") > 0, F.col("found") / F.col("shown"))).alias("precision"),
        zero(1 / F.col("first")).alias("reciprocal_rank"),
        zero(F.col("gain") / ideal).alias("ndcg"),
        F.col("first").isNotNull().alias("hit"),
    )


def stride_sample(cases: DataFrame, size: int, order: str) -> DataFrame:
    """Every (n / size)-th case in the order of ``order``; all if there are no more than ``size``.

    Places come from range partitions and their sizes, so that no task sorts all cases.
    """
    placed = numbered(cases, order).withColumn("_i", F.col("_place") - 1)
    n = cases.agg(F.count(F.lit(1)).alias("_n"))
    rows = placed.crossJoin(F.broadcast(n))  # one row
    # place i is drawn if some j has floor(j * n / size) = i
    j = F.ceil(F.col("_i") * size / F.col("_n")).cast("long")
    drawn = (F.col("_n") <= size) | ((j < size) & (F.floor(j * F.col("_n") / F.lit(size)) == F.col("_i")))
    return rows.filter(drawn).drop("_i", "_n", "_place")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """``df`` with _place, from 1 in the order of ``order`` (unique)."""
    # the ranges are drawn from a sample, anew each time the plan runs: they are fixed before they are used twice
    ranged = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    inside = ranged.withColumn("_nth", F.row_number().over(W.partitionBy("_part").orderBy(order)))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))  # a row a partition
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    return inside.join(starts, "_part").withColumn("_place", F.col("_start") + F.col("_nth")).drop("_part", "_nth", "_start")


def running_counts(counted: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``counted`` (by, value, _n; a row a value) with _upto, the count of values up to it, and _all, that of its group.

    Values are put in ranges, so that no task sorts a whole group; groups add up over the ranges' sums.
    """
    ranged = cut(counted.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    inside = ranged.withColumn("_upto", F.sum("_n").over(W.partitionBy("_part", *by).orderBy(value)))
    sums = ranged.groupBy("_part", *by).agg(F.sum("_n").alias("_sum"))  # a row a partition and group
    w = W.partitionBy(*by)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_sum").over(w)).drop("_sum")
    same = [inside[c].eqNullSafe(starts[c]) for c in ("_part", *by)]
    joined = inside.join(starts, reduce(Column.__and__, same))
    return joined.select(*(inside[c] for c in (*by, value, "_n")), (F.col("_upto") + F.col("_start")).alias("_upto"), "_all")
