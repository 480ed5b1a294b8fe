"""Dense search, fusion of ranked lists, diversity, parent expansion and caches, for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

RRF_K, DIGITS = 60, 9
#: Queries whose vectors one task holds; more are taken in blocks, one after the other.
QUERY_BLOCK = 4_096


def search_filter(is_parent: Column, include_parents: bool = False, **wanted: tuple[Column, list[str]]) -> Column:
    """No parents unless asked for, and for each named (column, values) one of the values; no values: any."""
    condition = F.lit(True) if include_parents else ~is_parent
    for column, values in wanted.values():
        if values:
            condition = condition & column.isin(*values)
    return condition


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, query_key: str = "query_id", query_vector: str = "query_vector", key: str = "id", vector: str = "vector") -> DataFrame:
    """query key, key, score (dot product in double, nine digits), rank: the exact k best of each query.

    The queries are a stated set. They are spread over blocks of bounded size and every block meets
    every row once, as one matrix product a batch, of which a task keeps only k rows a query. Vectors of
    another length than the query's, null and empty ones are not compared.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col(query_key).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).filter(F.size("v") > 0)
    q_type, k_type = asked.schema["q"].dataType, vectors.schema[key].dataType
    schema = T.StructType([T.StructField("q", q_type), T.StructField("d", k_type), T.StructField("score", T.DoubleType())])
    rows = vectors.select(F.col(key).alias("d"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("d").isNotNull() & (F.size("v") > 0))
    found = None
    for part in _blocks(asked, "q"):
        held = spark.sparkContext.broadcast((part["q"].to_numpy(), [np.asarray(v, dtype="f8") for v in part["v"]]))

        def search(frames, held=held):
            names, asked_vectors = held.value
            sizes = {len(v) for v in asked_vectors}
            groups = {n: [i for i, v in enumerate(asked_vectors) if len(v) == n] for n in sizes}
            matrices = {n: np.stack([asked_vectors[i] for i in g]) for n, g in groups.items()}
            best: dict[int, list[tuple[float, object]]] = {}
            for frame in frames:
                lengths = frame["v"].map(len)
                for n, g in groups.items():
                    own = frame[lengths == n]
                    if not len(own):
                        continue
                    scores = np.round(matrices[n] @ np.stack(own["v"].to_numpy()).T, DIGITS)
                    ids = own["d"].to_numpy()
                    for i, line in zip(g, scores):
                        top = np.flatnonzero(line >= np.partition(line, -k)[-k]) if len(line) > k else np.arange(len(line))
                        kept = best.get(i, []) + [(line[j], ids[j]) for j in top]
                        best[i] = sorted(kept, key=lambda x: (-x[0], x[1]))[:k]
            yield pd.DataFrame([(names[i], d, s) for i, kept in best.items() for s, d in kept], columns=["q", "d", "score"])

        one = rows.mapInPandas(search, schema)
        found = one if found is None else found.unionByName(one)
    order = W.partitionBy("q").orderBy(F.desc("score"), "d")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_key), F.col("d").alias(key), "score", "rank")


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, k: int = RRF_K, query_key: str = "query_id", key: str = "id") -> DataFrame:
    """Two ranked lists (query key, key, score, rank) as one: fused_score, both scores and ranks (null where not found), matched_by, rank."""
    side = lambda df, n: df.select(query_key, key, F.col("score").alias(f"{n}_score"), F.col("rank").alias(f"{n}_rank"))
    both = side(dense, "dense").join(side(sparse, "sparse"), [query_key, key], "full_outer")
    part = lambda n: F.coalesce(1 / (F.lit(k) + F.col(f"{n}_rank")), F.lit(0.0))
    matched = F.array_compact(F.array(F.when(F.col("dense_rank").isNotNull(), F.lit("dense")), F.when(F.col("sparse_rank").isNotNull(), F.lit("sparse"))))
    fused = both.withColumns({"fused_score": F.round(part("dense") + part("sparse"), 12), "matched_by": matched})
    order = W.partitionBy(query_key).orderBy(F.desc("fused_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), key)
    return fused.withColumn("rank", F.row_number().over(order))


def arm_agreement(fused: DataFrame, query_key: str = "query_id") -> DataFrame:
    """query key, agreement: the share of all hits that both arms found; 0 if an arm found none."""
    d, s = F.count("dense_rank"), F.count("sparse_rank")
    both = F.count_if(F.col("dense_rank").isNotNull() & F.col("sparse_rank").isNotNull())
    return fused.groupBy(query_key).agg(F.when((d == 0) | (s == 0), 0.0).otherwise(both / (d + s - both)).alias("agreement"))


def _grams(text: str) -> np.ndarray:
    """The set of runs of three characters as numbers."""
    codes = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("i8")
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]) if len(codes) > 2 else np.empty(0, "i8")


def diversify(relevance: list[float], texts: list[str], limit: int, weight: float, vectors: list | None = None) -> list[int]:
    """The places of the candidates chosen, one at a time: the greatest weight × relevance (scaled to 0..1)
    - (1 - weight) × likeness to the nearest one chosen; the first of equal ones. Likeness is the cosine
    if there are vectors, else the trigrams' Jaccard share."""
    n = len(relevance)
    if n <= 1 or limit <= 1:
        return list(range(min(n, limit)))
    r = np.asarray(relevance, dtype="f8")
    r = (r - r.min()) / ((r.max() - r.min()) or 1.0)
    if vectors is not None and all(v is not None for v in vectors):
        m = np.asarray(vectors, dtype="f8")
        like = np.maximum(0.0, m @ m.T)
    else:
        grams = [_grams(t or "") for t in texts]
        every, place = np.unique(np.concatenate(grams), return_inverse=True)
        marks = np.zeros((n, max(1, len(every))), dtype="f4")
        marks[np.repeat(np.arange(n), [len(g) for g in grams]), place] = 1
        shared, sizes = marks @ marks.T, marks.sum(axis=1)
        like = shared.astype("f8") / np.maximum(1, sizes[:, None] + sizes[None, :] - shared)
    nearest, chosen, open_ = np.zeros(n), [], np.ones(n, dtype=bool)
    while len(chosen) < limit and open_.any():
        score = np.where(open_, weight * r - (1 - weight) * nearest, -np.inf)
        best = int(score.argmax())
        chosen.append(best)
        open_[best] = False
        nearest = np.maximum(nearest, like[best])
    return chosen


def maximal_marginal_relevance(candidates: DataFrame, limit: int, weight: float = 0.7, query_key: str = "query_id", key: str = "id", relevance: str = "fused_score", text: str = "text", rank: str = "rank") -> DataFrame:
    """query key, key, mmr_rank of at most ``limit`` candidates a query. A query's candidates, a short list, are in one group.

    Queries with no more than ``limit`` candidates keep their order.
    """
    rows = candidates.select(F.col(query_key).alias("q"), F.col(key).alias("d"), F.col(relevance).cast("double").alias("r"), F.col(text).alias("t"), F.col(rank).cast("int").alias("n"))
    schema = T.StructType([rows.schema["q"], rows.schema["d"], T.StructField("mmr_rank", T.IntegerType())])

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "d"], kind="stable")
        order = diversify(frame["r"].tolist(), frame["t"].tolist(), limit, weight) if len(frame) > limit else range(len(frame))
        out = frame.iloc[list(order)][["q", "d"]]
        return out.assign(mmr_rank=np.arange(1, len(out) + 1, dtype="i4"))

    return rows.groupBy("q").applyInPandas(choose, schema).select(F.col("q").alias(query_key), F.col("d").alias(key), "mmr_rank")


def expand_parents(hits: DataFrame, chunks: DataFrame, key: str = "id") -> DataFrame:
    """``hits`` (with parent_chunk) with parent_text, null where there is no parent in ``chunks``."""
    parents = chunks.select(F.col(key).alias("parent_chunk"), F.col("text").alias("parent_text"))
    return hits.join(parents, "parent_chunk", "left")


def options_key(top_k: Column, top_n: Column, rerank: Column, mmr: Column, expand: Column, languages: Column) -> Column:
    """The retrieval options that change a result, as one string."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws("|", text(top_k), text(top_n), text(rerank), text(mmr), text(expand), F.coalesce(F.array_join(languages, "+"), F.lit("")))


def exact_cache_hits(requests: DataFrame, entries: DataFrame, ttl_ms: int = 300_000, key: str = "request_id") -> DataFrame:
    """The requests (key, options_key, form, at) that an entry (options_key, form, stored_at) answers: the latest
    stored before the request and no longer ago than the time to live."""
    a, b = requests.alias("a"), entries.alias("b")
    age = F.unix_millis("a.at") - F.unix_millis("b.stored_at")
    joined = a.join(b, (F.col("a.options_key") == F.col("b.options_key")) & (F.col("a.form") == F.col("b.form")) & (age > 0) & (age < ttl_ms))
    return joined.groupBy(F.col(f"a.{key}").alias(key)).agg(F.max("b.stored_at").alias("stored_at"))


def _blocks(asked: DataFrame, key: str) -> Iterator[pd.DataFrame]:
    """A stated set of queries in blocks of about QUERY_BLOCK rows."""
    n = max(1, -(-asked.count() // QUERY_BLOCK))
    for block in range(n):
        yield asked.filter(F.pmod(F.xxhash64(key), F.lit(n)) == block).toPandas()


def semantic_cache_hits(requests: DataFrame, entries: DataFrame, least: float = 0.97, ttl_ms: int = 300_000, key: str = "request_id") -> DataFrame:
    """The nearest entry (entry_id, options_key, vector, stored_at) of each request (key, options_key, vector, at) under the same
    options, stored before it and no longer ago than the time to live, if its cosine is above ``least``: key, entry_id, similarity;
    the lesser entry of equal ones.

    Requests are a stated set, taken in blocks: every entry meets a block in one matrix product, of which a task keeps one
    row a request, so that it does not matter how many share their options.
    """
    spark = requests.sparkSession
    asked = requests.select(F.col(key).alias("q"), "options_key", F.unix_millis(F.col("at").cast("timestamp")).alias("at"), F.col("vector").cast("array<double>").alias("v")).filter("size(v) > 0 AND options_key IS NOT NULL AND at IS NOT NULL")
    rows = entries.select(F.col("entry_id").alias("d"), "options_key", F.unix_millis(F.col("stored_at").cast("timestamp")).alias("at"), F.col("vector").cast("array<double>").alias("v")).filter("size(v) > 0 AND options_key IS NOT NULL AND at IS NOT NULL AND d IS NOT NULL")
    schema = T.StructType([T.StructField("q", asked.schema["q"].dataType), T.StructField("d", rows.schema["d"].dataType), T.StructField("score", T.DoubleType())])
    found = None
    for part in _blocks(asked, "q"):
        held = spark.sparkContext.broadcast(part)

        def search(frames, held=held):
            block = held.value
            best: dict[int, tuple[float, object]] = {}
            sizes = block["v"].map(len)
            for frame in frames:
                lengths = frame["v"].map(len)
                for n in sizes.unique():
                    at, own = np.flatnonzero(sizes == n), frame[lengths == n].sort_values("d", kind="stable")
                    if not len(own):
                        continue
                    score = np.round(np.stack(block["v"].iloc[at].to_numpy()) @ np.stack(own["v"].to_numpy()).T, DIGITS)
                    age = block["at"].to_numpy()[at][:, None] - own["at"].to_numpy()[None, :]
                    same = block["options_key"].to_numpy()[at][:, None] == own["options_key"].to_numpy()[None, :]
                    score[~same | (age <= 0) | (age >= ttl_ms) | (score <= least)] = -2.0
                    top, ids = score.argmax(axis=1), own["d"].tolist()
                    for i, (q, j) in enumerate(zip(at.tolist(), top.tolist())):
                        s = float(score[i, j])
                        if s > -2.0 and (q not in best or (-s, ids[j]) < (-best[q][0], best[q][1])):
                            best[q] = (s, ids[j])
            names = block["q"].tolist()
            yield pd.DataFrame([(names[q], d, s) for q, (s, d) in best.items()], columns=["q", "d", "score"])

        one = rows.mapInPandas(search, schema)
        found = one if found is None else found.unionByName(one)
    return found.groupBy(F.col("q").alias(key)).agg(F.min_by("d", F.struct(-F.col("score"), F.col("d"))).alias("entry_id"), F.max("score").alias("similarity"))
