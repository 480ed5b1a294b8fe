"""Models as pluggable functions over batches: embedding of distinct texts, reranking with a fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.lexical import heuristic_rerank

#: Characters that a model's token stands for at most, texts in a batch of a model.
CHARS_PER_MODEL_TOKEN, BATCH = 8, 8
# What precedes a text of either kind.
PREFIXES = {"query": "query: ", "passage": "passage: "}
# The tokens that a model takes of either kind.
MODEL_TOKENS = {"query": 96, "passage": 512}


def prepared(text: Column, kind: str) -> Column:
    """The text with its kind's prefix, cut to what the model can take."""
    return F.concat(F.lit(PREFIXES[kind]), F.substring(F.coalesce(text, F.lit("")), 1, CHARS_PER_MODEL_TOKEN * MODEL_TOKENS[kind]))


def embed_texts(df: DataFrame, text: str, output: str, model: Callable[[], Callable[[list[str]], list[list[float]]]], kind: str = "passage", batch: int = BATCH) -> DataFrame:
    """``df`` with the unit vector of ``text`` in ``output``; each distinct text goes through the model once.

    ``model`` is called once a task and gives a function of a list of texts. Null texts have null vectors.
    """

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model()
        for part in parts:
            texts = part.tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in run(texts[i : i + batch])], index=part.index, dtype=object)

    from millrace.functions.vector import normalize_vector

    keyed = df.withColumn("_key", F.when(F.col(text).isNotNull(), F.sha1(prepared(F.col(text), kind))))
    texts = keyed.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.first(prepared(F.col(text), kind)).alias("_text"))
    vectors = texts.select("_key", embed("_text").alias("_vector")).select("_key", normalize_vector(F.col("_vector")).alias(output))
    return keyed.drop(output).join(vectors, "_key", "left").drop("_key")


def reembed(index: DataFrame, model, text: str = "text", vector: str = "vector") -> DataFrame:
    """The index with new vectors, all other columns as they were."""
    return embed_texts(index, text, vector, model).select(*index.columns)


def model_rerank(candidates: DataFrame, query: str, text: str, model: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], limit: int = 2_000, batch: int = 4) -> DataFrame:
    """``candidates`` with rerank_score, the sigmoid of the model's score of (query, text cut to ``limit``)."""
    from millrace.functions.vector import sigmoid

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        run = model()
        for q, t in parts:
            pairs = list(zip(q.fillna("").tolist(), t.fillna("").tolist()))
            yield pd.Series([float(x) for i in range(0, len(pairs), batch) for x in run(pairs[i : i + batch])], index=q.index, dtype="f8")

    return candidates.withColumn("_logit", score(F.col(query), F.substring(text, 1, limit))).withColumn("rerank_score", sigmoid(F.col("_logit"))).drop("_logit")


def rerank_with_fallback(candidates: DataFrame, query: str, text: str, prior: str, model=None, query_key: str = "query_id") -> tuple[DataFrame, str, bool]:
    """The reranked candidates, who ranked them, and whether that is the fallback: the model is tried once, here, before the batch."""
    if model is not None:
        try:
            model()([("probe", "probe")])
            return model_rerank(candidates, query, text, model), "model", False
        except Exception:  # noqa: BLE001
            pass
    return heuristic_rerank(candidates, query, text, prior, query_key), "heuristic", model is not None
