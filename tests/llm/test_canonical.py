import unicodedata

from millrace.llm.canonical import canonical_text, look_alike_classes, look_alike_pairs
from millrace.llm.lookalikes import lookalikes

SAME = [
    ("The mill", "The mill"), ("The mill", "Тhе mіll"), ("Mill 42", "Ｍｉｌｌ　４２"), ("café", "café"), ("office", "oﬃce"), ("mill", "mi​l­l﻿"), ("ガ", "ガ"), ("ガ", "ｶﾞ"), ("क़", "क़"),
    ("a-b", "a‑b"), ("a\nb", "a\r\nb"), ("ли", "л⁠и"), ("ëx", "ёx"), ("كيف", "کیف"), ("Mill", "𝐌𝗂𝓁𝓁"), ("so", "ѕօ"), ("WELT", "ᎳꓰꓡᎢ"), ("a", "a\U000E0101"), ("a", "a\U000E0061"),
]
DIFFERENT = [("Mill", "mill"), ("cafe", "café"), ("a 1", "a 2"), ("a, b", "a. b"), ("a b", "a  b"), ("क्ष", "क्‍ष"), ("one", "two"), ("“a”", '"a"'), ("ı", "i"), ("ι", "i"), ("υ", "u"), ("O", "0"), ("l", "I"), ("l", "1"), ("بھ", "بہ")]


def forms(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "i int, text string, mapped string, Canonical string")
    return [r["out"] for r in canonical_text(df, output="out").orderBy("i").collect()]


def test_same_and_different_looks(spark):
    flat = [t for pair in SAME + DIFFERENT for t in pair]
    got = forms(spark, flat)
    for n, (a, b) in enumerate(SAME + DIFFERENT):
        assert (got[2 * n] == got[2 * n + 1]) == (n < len(SAME)), (a, b, got[2 * n], got[2 * n + 1])
    assert all(unicodedata.is_normalized("NFC", t) for t in got)
    assert forms(spark, got) == got  # once is enough


def test_null_empty_and_long(spark):
    assert forms(spark, [None, "", "Ａ" * 100_000]) == [None, "", "A" * 100_000]


def test_pairs(spark):
    rows = [("d", "1", "mill a"), ("d", "2", "mill a"), ("d", "2", "mill a"), ("d", "3", "mill a"), ("c", "4", "mill a"), ("d", "5", None), ("d", "6", " "), ("d", "7", " "), ("d", "8", "​"), ("d", None, "mill a"), ("c", "9", "mill b")]
    df = spark.createDataFrame(rows, "kind string, id string, text string")
    got = sorted(tuple(r) for r in look_alike_pairs(df, "kind", "id").collect())
    assert got == [("d", "1", "2"), ("d", "2", "3")]
    assert look_alike_pairs(df.limit(0), "kind", "id").count() == 0


def test_look_alikes_come_from_the_confusables_data(spark):
    found = lookalikes(spark)
    assert len(found) > 400 and all(found[c].isupper() for c in "ΑԌᎪꓮ") and found["ӏ"] == "l" and found["Ӏ"] == "I"
    assert not any(c.isascii() for c in found) and all(p not in found for p in found.values())


def test_classes(spark):
    rows = [("d", "1", "mill a"), ("d", "2", "mill\u00a0a"), ("d", "2", "mill\u00a0a"), ("d", "3", "mill\u00a0a"), ("c", "4", "mill a"), ("d", "5", None), ("d", "6", " "), ("d", "7", "mill b")]
    df = spark.createDataFrame(rows, "kind string, id string, text string")
    got = {(r["record_kind"], r["id"]): (r["class_id"], r["links"]) for r in look_alike_classes(df, "kind", "id").collect()}
    assert {k: n for k, (_, n) in got.items()} == {("d", "1"): 2, ("d", "2"): 1, ("d", "3"): 1, ("c", "4"): 0, ("d", "7"): 0}
    assert got["d", "1"][0] == got["d", "2"][0] != got["d", "7"][0]
    assert look_alike_classes(df.limit(0), "kind", "id").count() == 0
