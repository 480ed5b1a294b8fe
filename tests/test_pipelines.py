"""The composed plans, with a toy model: hashed words as a vector."""

import zlib

from pyspark.sql import functions as F

from millrace.operators.models import embed_texts, prepared, reembed, rerank_with_fallback
from millrace.plans import pipelines as P


def words_model():
    def run(texts):
        out = []
        for t in texts:
            v = [0.0] * 64
            for w in t.lower().split():
                v[zlib.crc32(w.strip(".?,").encode()) % 64] += 1.0
            out.append(v)
        return out

    return run


PASSAGES = [
    ("1-0-eng_Latn", "The water mill turns a wheel. The wheel grinds the grain. Millers keep the weir.", "how does a mill work"),
    ("2-0-eng_Latn", "A ledger lists every tariff. The treasury sums the ledger. Clerks copy the totals.", "what is a ledger"),
    ("3-0-eng_Latn", "Pears ripen in autumn. Pickers carry baskets. The orchard rests in winter.", "when do pears ripen"),
    ("4-0-eng_Latn", None, None),
]


def corpus(spark):
    rows = [(d, "0", t, "eng_Latn", "s", None, q) for d, t, q in PASSAGES]
    return spark.createDataFrame(rows, "document_id string, passage_id string, text string, language string, source string, topic string, query_text string")


def test_index_retrieve_verify_and_score(spark):
    index = P.build_index(corpus(spark), model=words_model)
    assert index.chunks.count() == 3 and index.stats.first()["documents"] == 3
    asked = spark.createDataFrame([("1", "how does a mill wheel work"), ("2", "who sums the ledger"), ("9", "zzz qqq")], "query_id string, query string")
    queries = embed_texts(asked, "query", "query_vector", words_model, "query")
    rows, agreement = P.retrieve(queries, index.chunks)
    best = {r["query_id"]: r["document_id"] for r in rows.filter("rank_after = 1").collect()}
    assert best["1"] == "1-0-eng_Latn" and best["2"] == "2-0-eng_Latn"
    answers = spark.createDataFrame([("1", "The wheel grinds the grain."), ("2", "Unicorns vanish quickly tonight.")], "query_id string, answer string")
    got = {r["query_id"]: r for r in P.verify(asked, rows, agreement, answers, "No.").collect()}
    assert got["1"]["groundedness"] == 1.0 and got["2"]["groundedness"] == 0.0 and got["9"]["status"] in ("unverified", "insufficient_context")
    expected = spark.createDataFrame([("1", "1-0-eng_Latn"), ("2", "2-0-eng_Latn")], "query_id string, document_id string")
    assert all(r["reciprocal_rank"] == 1.0 and r["recall"] == 1.0 for r in P.score(rows, expected).collect())
    assert P.prompt(asked, rows, "No.").count() == 3


def test_each_text_is_embedded_once_and_nulls_stay(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id int, text string")
    got = {r["id"]: r["v"] for r in embed_texts(df, "text", "v", words_model).collect()}
    assert got[1] == got[2] and got[3] is None and abs(sum(x * x for x in got[1]) - 1) < 1e-9
    again = reembed(embed_texts(df, "text", "vector", words_model), words_model)
    assert again.columns == ["id", "text", "vector"] and again.count() == 3
    assert df.select(prepared(F.col("text"), "query")).first()[0] == "query: a b"


def test_rerank_falls_back(spark):
    df = spark.createDataFrame([("1", "a", "mill", "the mill", 0.1), ("1", "b", "mill", None, 0.2)], "query_id string, id string, query string, text string, p double")

    def broken():
        raise RuntimeError

    def overlap():
        return lambda pairs: [float(len(set(q.split()) & set(t.split()))) for q, t in pairs]

    assert rerank_with_fallback(df, "query", "text", "p", broken)[1:] == ("heuristic", True)
    assert rerank_with_fallback(df, "query", "text", "p")[1:] == ("heuristic", False)
    rows, who, degraded = rerank_with_fallback(df, "query", "text", "p", overlap)
    got = {r["id"]: r["rerank_score"] for r in rows.collect()}
    assert (who, degraded) == ("model", False) and got["b"] == 0.5 and got["a"] > 0.7
