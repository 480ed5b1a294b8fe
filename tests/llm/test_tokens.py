import os

import pytest
from pyspark.sql import functions as F

from millrace.llm.tokens import TOKENIZERS, VOCABULARY, count_tokens, load_bpe, token_totals

PATH = f"{TOKENIZERS}/{VOCABULARY}"
needs = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")
TEXTS = ["Hello world, it's 42!", "नमस्ते दुनिया  \n\n कैसे", "日本語のテキスト。", "aaaaaaaaaaaaaaaaaaaaaaa", "", None, "   ", "tab\t\tnew\r\nline", "👍🏽 emoji", "x" * 3000, "don't they'll I'd", " lead", "Ａ１ ﬁ"]


def reference():
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_bpe(PATH).ranks, special_tokens={})


@needs
@pytest.mark.parametrize("common", [1_000_000, 12, 0])
def test_counts_equal_the_tokenizer(spark, monkeypatch, common):
    monkeypatch.setattr("millrace.llm.tokens.COMMON_PIECES", common)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "id int, text string, tokens string")
    got = {r["id"]: r for r in count_tokens(df, "id").collect()}
    enc = reference()
    assert [got[i]["tokens"] for i in range(len(TEXTS))] == [len(enc.encode_ordinary(t or "")) for t in TEXTS]
    assert [got[i]["chars"] for i in range(len(TEXTS))] == [len(t or "") for t in TEXTS]


@needs
def test_incremental_states_equal_whole_encodings():
    bpe, enc = load_bpe(PATH), reference()
    words = sorted({w for t in TEXTS if t for w in t.split()} | {"mill", "mills", "miller", "millers", "milling", "mil"})
    last, count, before = [-1], [0], b""
    for w in words:
        b = w.encode()
        bpe.extend(b, len(os.path.commonprefix((before, b))), last, count)
        before = b
        assert count[-1] == len(enc._core_bpe.encode_single_piece(b))


def test_estimates_without_a_vocabulary(spark):
    from millrace.functions.text import estimate_tokens

    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    got = {r["id"]: r["estimate"] for r in count_tokens(df, "id", vocabulary=None).collect()}
    assert got == {r["id"]: r["e"] for r in df.select("id", estimate_tokens(F.col("text")).alias("e")).collect()}
    assert count_tokens(df.limit(0), "id", vocabulary=None).count() == 0


def test_totals(spark):
    df = spark.createDataFrame([("a", None, 3, 9), ("a", "x", 4, 10), ("b", "x", 5, 11)], "source string, domain string, tokens long, chars long")
    got = {(r["slice"], r["value"]): (r["texts"], r["tokens"], r["chars"]) for r in token_totals(df, [[], ["source"], ["source", "domain"]]).collect()}
    assert got[("all", "all")] == (3, 12, 30) and got[("source", "a")] == (2, 7, 19) and got[("source|domain", "a|(none)")] == (1, 3, 9) and len(got) == 6
