"""Text and vector expressions against plain Python and written cases."""

import math
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.vector import clamp01, dot, normalize_vector, sigmoid


def values(spark, expression, *rows, schema="t string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_estimate(spark):
    texts = ["", None, "a", "abcde", "नमस्ते दुनिया", "hello नमस्ते", "👍👍👍"]
    dense = re.compile("[ऀ-ॣ०-ॿ]")
    want = [0 if not t else max(1, math.ceil(len(t) / (4 - 1.4 * len(dense.findall(t)) / len(t)))) for t in texts]
    assert values(spark, X.estimate_tokens(F.col("t")), *texts) == want


def test_normalize_whitespace(spark):
    got = values(spark, X.normalize_whitespace(F.col("t")), "  a\t b\r\nc\rd\n\n\n\ne​f ", "", None, "   ")
    assert got == ["a b\nc\nd\n\nef", "", None, ""]


def test_tokens(spark):
    assert values(spark, X.tokenize(F.col("t")), "Mill-race, कॉर्पोरेशन 42!", "", "…") == [["mill", "race", "कॉर्पोरेशन", "42"], [], []]
    assert values(spark, X.content_tokens(F.col("t")), "the mill and the mill x") == [["mill", "mill"]]


def test_truncate(spark):
    assert values(spark, X.truncate(F.col("t"), 10), "short", "exactly10!", "one two three", "a bcdefghijkl", "abcdefghijklm") == ["short", "exactly10!", "one two…", "a bcdefghi…", "abcdefghij…"]
    assert values(spark, X.clamp_query(F.col("t"), 10), "  one two three ", "x") == ["one two", "x"]


def test_trigrams(spark):
    assert values(spark, F.size(X.trigrams(F.col("t"))), "", "ab", "abc", "aaaa", " A  b c ") == [0, 0, 1, 1, 3]
    assert values(spark, X.trigram_similarity(F.col("t"), F.lit("abcd")), "abcd", "", "abce", None) == [1.0, 0.0, pytest.approx(1 / 3), 0.0]


def test_sets(spark):
    assert values(spark, X.coverage(F.split("t", " "), F.array(F.lit("a"), F.lit("b"))), "a a c", "b") == [pytest.approx(2 / 3), 1.0]
    assert values(spark, X.jaccard(F.split("t", " "), F.array(F.lit("a"), F.lit("b"))), "a a c", "b") == [pytest.approx(1 / 3), 0.5]


def test_script_and_names(spark):
    assert values(spark, X.script_of(F.col("t")), "abc नमस्ते", "12", None, "سلام", "ab नम") == ["Devanagari", "Unknown", "Unknown", "Arabic", "Latin"]
    assert values(spark, X.language_name(F.col("t")), "hin_Deva", "xx") == ["Hindi", "xx"]


def test_rough_sentences(spark):
    got = values(spark, F.transform(X.sentences(F.col("t")), lambda s: F.concat_ws("|", s["text"], s["start"], s["end"])), "The first one goes here. The second one follows it! OK.", "नमस्ते दुनिया कैसे हो। और कुछ नया बताओ।", "", "  ", "no end")
    assert got[0] == ["The first one goes here.|0|24", "The second one follows it! OK.|24|55"]
    assert [len(x) for x in got] == [2, 2, 0, 0, 1]


def test_rough_sentences_agree_with_python(spark):
    from millrace.operators.chunking import sentence_spans

    texts = ["A first sentence is here. Then (a second one.) “And a third?” No. …", "x" * 50, "...", "एक वाक्य यहाँ है। दूसरा वाक्य वहाँ है॥ Third is Latin. \n\n Fourth one!"]
    got = values(spark, F.transform(X.sentences(F.col("t")), lambda s: F.struct(s["text"], s["start"], s["end"])), *texts)
    assert [[tuple(s) for s in row] for row in got] == [[(s.text, s.start, s.end) for s in sentence_spans(t)] for t in texts]


def test_uuid(spark):
    from millrace.operators.chunking import uuid_from

    keys = ["a::0::overlap::1", "", "नमस्ते"]
    assert values(spark, X.uuid_of(F.col("t")), *keys) == [uuid_from(k) for k in keys]
    assert all(u[14] == "5" and u[19] in "89ab" for u in map(uuid_from, keys))


def test_headers(spark):
    row = spark.createDataFrame([("t", None, "s")], "a string, b string, c string")
    assert row.select(X.metadata_header(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "[topic: t | source: s]"
    assert values(spark, X.topic_of(F.col("t"), F.lit("topic"), F.lit("text")), ". . query", "", None) == ["query", "text", "topic"]


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0, 9.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = row.select(dot(F.col("a"), F.col("b")), normalize_vector(F.col("a")), normalize_vector(F.col("z"))).first()
    assert got[0] == 11.0 and got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0]
    assert values(spark, clamp01(F.col("t")), None, float("nan"), float("inf"), -1.0, 0.5, 2.0, schema="t double") == [0, 0, 0, 0, 0.5, 1]
    assert values(spark, sigmoid(F.col("t")), -800.0, 0.0, 800.0, schema="t double") == [0.0, 0.5, 1.0]


def test_display(spark):
    from millrace.functions import display as V

    xs = (0.4, 12.3, 1250.0, 59000.0, 125000.0, None)
    assert values(spark, V.milliseconds(F.col("t")), *xs, schema="t double") == ["<1ms", "12ms", "1.25s", "59.0s", "2m 5s", "—"]
    assert values(spark, V.compact(F.col("t")), 5.0, 12400.0, 3.1e6, float("nan"), schema="t double") == ["5", "12.4K", "3.1M", "—"]
    assert values(spark, V.size_in_bytes(F.col("t")), 0.0, 512.0, 2048.0, 3 * 1024.0**3, schema="t double") == ["0 B", "512 B", "2.0 KB", "3.0 GB"]
    assert values(spark, V.minutes(F.col("t")), 65.0, -1.0, None, 6000.0, schema="t double") == ["01:05", "00:00", "00:00", "100:00"]


def test_html(spark):
    assert values(spark, X.strip_html(F.col("t")), "<p>a&nbsp;&amp; <b>b</b></p>", "&lt;x&gt;", "") == ["a & b", "<x>", ""]
