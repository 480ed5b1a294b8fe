"""BM25 over a whole collection for a batch of queries.

Statistics are two aggregations; a query meets only postings of its own terms (an equi-join on
the term); the tf side is weighted once a posting, the idf side once a query term.
Scores are rounded to nine digits before they are ranked, with the id for a tie, so that the order of
summation does not show.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import content_tokens, let, tokenize
from millrace.functions.vector import inverse_document_frequency
from millrace.operators.evaluation import numbered
from millrace.plans.lineage import cut

K1, B, DIGITS = 1.2, 0.75, 9
#: Queries whose weights one task holds, and cells of scores it makes at a time.
QUERY_BLOCK, DENSE = 4_096, 2_000_000


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, length (tokens of the text) of every term of every row. Null and empty texts have none."""
    rows = docs.select(F.col(key), tokenize(F.col(text)).alias("_tokens"))
    terms = rows.select(key, F.size("_tokens").alias("length"), F.explode("_tokens").alias("term"))
    return terms.groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: documents, average_length (at least 1, also of an empty collection). Rows without tokens count as documents."""
    size = F.coalesce(F.size(tokenize(F.col(text))), F.lit(0))
    counted = docs.select(F.greatest(size, F.lit(0)).alias("n")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"))
    return counted.select("documents", F.when(F.col("documents") > 0, F.greatest(F.lit(1.0), F.col("tokens") / F.col("documents"))).otherwise(1.0).alias("average_length"))


def term_frequencies(posted: DataFrame) -> DataFrame:
    """term, frequency: in how many documents."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))


def term_ids(frequencies: DataFrame) -> DataFrame:
    """term, term_id from 1 in the order of terms, frequency."""
    return numbered(frequencies, "term").select("term", F.col("_place").alias("term_id"), "frequency")


def document_weights(posted: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """key, term, weight: the tf side of BM25."""
    saturation = K1 * (1 - B + B * F.col("length") / F.col("average_length"))
    return posted.crossJoin(F.broadcast(stats)).select(key, "term", (F.col("tf") * (K1 + 1) / (F.col("tf") + saturation)).alias("weight"))  # stats is one row


def query_weights(queries: DataFrame, frequencies: DataFrame, stats: DataFrame, key: str, text: str, distinct: bool = False) -> DataFrame:
    """key, term, idf: summed over a term's occurrences (once if ``distinct``); terms of no document are left out."""
    tokens = F.array_distinct(tokenize(F.col(text))) if distinct else tokenize(F.col(text))
    counts = queries.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    idf = inverse_document_frequency(F.col("documents"), F.col("frequency"))
    return counts.join(frequencies, "term").crossJoin(F.broadcast(stats)).select(key, "term", (F.col("n") * idf).alias("idf")).filter("idf > 0")


def bm25_scores(queries: DataFrame, docs: DataFrame, query_key: str = "query_id", query_text: str = "query", key: str = "id", text: str = "text", searched: Column | None = None, distinct: bool = False) -> DataFrame:
    """query key, key, score of every document that shares a term with the query.

    Statistics are those of all ``docs``; only rows for which ``searched`` holds are found (all without it).
    """
    tokens = docs.select(key, (F.lit(True) if searched is None else F.coalesce(searched, F.lit(False))).alias("_searched"), tokenize(F.col(text)).alias("_tokens"))
    terms = tokens.select(key, "_searched", F.size("_tokens").alias("length"), F.explode("_tokens").alias("term"))
    # terms that no query has are dropped before anything is counted or shuffled
    wanted = queries.select(F.explode(tokenize(F.col(query_text))).alias("term")).distinct()
    posted = terms.join(wanted, "term", "left_semi").groupBy(key, "_searched", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = corpus_stats(docs, text)
    asked = query_weights(queries, term_frequencies(posted), stats, query_key, query_text, distinct)
    saturation = K1 * (1 - B + B * F.col("length") / F.col("average_length"))
    product = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + saturation)
    # what is not searched counts in the statistics: kept out of the sum, not of the postings, so that both uses share one exchange
    score = F.round(F.sum(F.when(F.col("_searched"), product).otherwise(0.0)), DIGITS)
    matched = posted.join(asked, "term").crossJoin(F.broadcast(stats))  # one row
    return matched.groupBy(query_key, key).agg(score.alias("score")).filter("score > 0")


def _statistics(docs: DataFrame, queries: DataFrame, text: str, query_text: str) -> tuple[DataFrame, DataFrame]:
    """The corpus row, and frequencies of the queries' terms, from one pass over the texts: every row has a null among its terms that carries its length."""
    tokens = docs.select(F.coalesce(tokenize(F.col(text)), F.array().cast("array<string>")).alias("_tokens"))
    terms = tokens.select(F.size("_tokens").alias("n"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("_tokens"))).alias("term"))
    wanted = queries.select(F.explode(tokenize(F.col(query_text))).alias("term")).unionByName(queries.sparkSession.createDataFrame([(None,)], "term string")).distinct()
    kept = terms.join(wanted.withColumnRenamed("term", "_wanted"), F.col("term").eqNullSafe(F.col("_wanted")), "left_semi")
    counted = cut(kept.groupBy("term").agg(F.count(F.lit(1)).alias("frequency"), F.sum("n").alias("n")))
    stats = counted.filter("term IS NULL").agg(F.coalesce(F.max("frequency"), F.lit(0)).alias("documents"), F.max("n").alias("n"))
    average = F.when(F.col("documents") > 0, F.greatest(F.lit(1.0), F.col("n") / F.col("documents"))).otherwise(1.0)
    return stats.select("documents", average.alias("average_length")), counted.filter("term IS NOT NULL").select("term", "frequency")


def bm25_top_k(queries: DataFrame, docs: DataFrame, k: int, query_key: str = "query_id", query_text: str = "query", key: str = "id", text: str = "text", searched: Column | None = None, distinct: bool = False) -> DataFrame:
    """query key, key, score, rank: the k best of each query, as ``top_k`` of ``bm25_scores`` gives.

    The queries are a stated set, taken in blocks. Each batch of documents meets a block as one sparse product, of which
    a task keeps k rows a query: a common term costs work where its documents lie, but no shuffle, and is in no hot group.
    """
    spark = docs.sparkSession
    stats, frequencies = _statistics(docs, queries, text, query_text)
    average = stats.first()["average_length"]  # one row
    weights = query_weights(queries, frequencies, stats, query_key, query_text, distinct).select(F.col(query_key).alias("q"), "term", "idf")
    rows = docs.filter(F.lit(True) if searched is None else F.coalesce(searched, F.lit(False))).select(F.col(key).alias("d"), tokenize(F.col(text)).alias("tokens")).filter("size(tokens) > 0")
    schema = T.StructType([T.StructField("q", queries.schema[query_key].dataType), T.StructField("d", docs.schema[key].dataType), T.StructField("score", T.DoubleType())])
    asked = queries.select(F.col(query_key).alias("q")).distinct()
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        held = spark.sparkContext.broadcast(_Block(weights.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).toPandas()))

        def search(batches, held=held):
            best = None
            for batch in batches:
                best = held.value.best_of(batch, k, average, best)
            if best is not None and len(best):
                yield pa.RecordBatch.from_arrays([pa.array(best["q"].map(held.value.names.__getitem__)), pa.array(best["d"]), pa.array(best["score"])], names=["q", "d", "score"])

        one = rows.mapInArrow(search, schema)
        found = one if found is None else found.unionByName(one)
    return top_k(found.select(F.col("q").alias(query_key), F.col("d").alias(key), "score"), k, query_key, key)


class _Block:
    """The weights of a block's terms, term by term."""

    def __init__(self, weights: pd.DataFrame):
        self.names = sorted(weights["q"].unique())
        place = {q: i for i, q in enumerate(self.names)}
        weights = weights.sort_values(["term", "q"], kind="stable")
        self.terms = weights["term"].unique().tolist()
        counts = weights.groupby("term", sort=True).size().to_numpy() if len(weights) else np.empty(0, "i8")
        self.starts = np.concatenate([[0], np.cumsum(counts)]).astype("i8")
        self.query, self.idf = weights["q"].map(place).to_numpy(dtype="i8"), weights["idf"].to_numpy(dtype="f8")

    def best_of(self, batch: pa.RecordBatch, k: int, average: float, best: pd.DataFrame | None) -> pd.DataFrame:
        """The best k of each query among those kept so far and the batch."""
        lists = batch.column(1)
        codes = pc.index_in(lists.flatten(), value_set=pa.array(self.terms, pa.string()))
        lengths = np.diff(lists.offsets.to_numpy())
        document = np.repeat(np.arange(len(lists)), lengths)
        known = codes.is_valid().to_numpy(zero_copy_only=False)
        pairs, tf = np.unique(document[known] * max(1, len(self.terms)) + codes.drop_null().to_numpy(), return_counts=True)
        document, code = np.divmod(pairs, max(1, len(self.terms)))
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[document] / average))
        width = max(1, len(self.names))
        parts = [best] if best is not None else []
        step = max(1, DENSE // width)
        for low in range(0, len(lists), step):
            own = slice(*np.searchsorted(document, [low, low + step]))
            first, size = self.starts[code[own]], self.starts[code[own] + 1] - self.starts[code[own]]
            at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
            cell = np.repeat(document[own] - low, size) * width + self.query[at]
            n = min(step, len(lists) - low)
            score = np.round(np.bincount(cell, weights=np.repeat(weight[own], size) * self.idf[at], minlength=n * width).reshape(n, width), DIGITS)
            least = np.partition(score, n - k, axis=0)[n - k] if n > k else np.zeros(width)
            d, q = np.nonzero((score > 0) & (score >= least))
            parts.append(pd.DataFrame({"q": q, "d": batch.column(0).take(pa.array(d + low)).to_pandas(), "score": score[d, q]}))
        rows = pd.concat(parts).sort_values(["q", "score", "d"], ascending=[True, False, True], kind="stable")
        return rows[rows.groupby("q").cumcount() < k]


def top_k(scored: DataFrame, k: int, query_key: str = "query_id", key: str = "id", score: str = "score") -> DataFrame:
    """The best k of each query with their rank from 1; ties by key. A limit a group, applied before the shuffle too."""
    order = W.partitionBy(query_key).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def heuristic_rerank(candidates: DataFrame, query: str, text: str, prior: str, query_key: str = "query_id") -> DataFrame:
    """``candidates`` with rerank_score: half the coverage of the query's content terms, a fifth their
    proximity, three tenths the prior as a share of the query's best. Without content terms: the prior.

    Proximity: 1 if the first places of the terms found are as close as can be, falling by the
    superfluous distance over the text's length; a half for a single term, 0 for none.
    """
    terms, tokens = F.array_distinct(content_tokens(F.col(query))), tokenize(F.col(text))
    rows = candidates.withColumns({"_terms": terms, "_tokens": tokens})
    places = let(F.struct("_terms", "_tokens"), lambda x: F.filter(F.transform(x["_terms"], lambda t: F.array_position(x["_tokens"], t)), lambda p: p > 0))
    rows = rows.withColumn("_places", places).withColumn("_top", F.greatest(F.max(prior).over(W.partitionBy(query_key)), F.lit(1e-9)))
    n = F.size("_places")
    spread = F.array_max("_places") - F.array_min("_places")
    near = F.when(n == 0, 0.0).when(n == 1, 0.5).when(spread <= n - 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (spread - (n - 1)) / F.size("_tokens")))
    score = 0.5 * n / F.size("_terms") + 0.2 * near + 0.3 * F.col(prior) / F.col("_top")
    blended = F.when(F.size("_terms") == 0, F.col(prior)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return rows.withColumn("rerank_score", F.round(blended, DIGITS)).drop("_terms", "_tokens", "_places", "_top")
