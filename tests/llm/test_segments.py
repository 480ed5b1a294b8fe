import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.segments import LIMIT, _Passage, cut_passage, recut, split_oversized

TOPIC_A = "The river mill turns the wheel and grinds the grain beside the river weir. "
TOPIC_B = "A ledger lists the tariff of the market and the treasury sums the ledger. "


def check(text, language, limit=LIMIT, overlap=32):
    pieces = cut_passage(text, language, limit, overlap)
    p = _Passage(text, language)
    before = 0
    for n, (a, b, size) in enumerate(pieces):
        assert 0 <= a < b <= len(text) and size == p.estimate(a, b) <= limit
        assert (a == 0) if n == 0 else (a < before < b)
        before = b
    assert before == len(text)
    return pieces, p


def test_cuts_at_the_change_of_topic():
    text = (TOPIC_A * 8 + TOPIC_B * 8).strip()
    pieces, _ = check(text, "eng_Latn")
    assert any(abs(b - len(TOPIC_A * 8)) <= 1 for _, b, _ in pieces)


def test_natural_boundaries():
    text = "alpha beta, gamma delta " * 200
    pieces, p = check(text.strip(), "eng_Latn")
    assert all(p.legal(a) and p.legal(b) for a, b, _ in pieces)


def test_no_boundary_at_all():
    check("x" * 5000, "eng_Latn")
    check("字" * 3000, "zho_Hans")
    check("क" * 3000, "hin_Deva")


def test_very_long_passages():
    import time

    began = time.time()
    check(TOPIC_A * 6_000, "eng_Latn")
    check("字。" * 100_000, "zho_Hans")
    assert time.time() - began < 120


def test_small_null_and_empty():
    assert cut_passage("", None) == [] and cut_passage("short", None) == [(0, 5, 2)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["mill", "wheel,", "grain.", "\n\n", "नमस्ते", "字字。", "x" * 60, "é"]), min_size=5, max_size=300), st.sampled_from(["eng_Latn", "zho_Hans", "hin_Deva", None]))
def test_any_text(words, language):
    check(" ".join(words), language, 60, 12)


def test_operator(spark):
    df = spark.createDataFrame([("a", TOPIC_A * 40, "eng_Latn", 1), ("b", "small", "eng_Latn", 2), ("c", None, None, 3), ("d", "", None, 4)], "id string, text string, language string, piece int")
    rows = split_oversized(df, "id").collect()
    assert {r["id"] for r in rows} == {"a"} and [r["piece"] for r in rows] == list(range(len(rows)))
    assert split_oversized(df.limit(0), "id").count() == 0


def test_recut_finds_every_fault(spark):
    passage = (TOPIC_A * 30).strip()
    at = lambda n: passage.index(" ", n)
    inside = next(i for i in range(402, 420) if regex.match(r"\w\w", passage[i - 1 : i + 1]))
    rows = [
        ("ok", 0, 0, at(150), set()),
        ("next", 1, at(100), at(300), set()),
        ("gap", 2, at(300), at(380), {"no_overlap"}),
        ("word", 3, at(360), inside, {"inside_word"}),
        ("large", 4, at(380), at(1500), {"oversized"}),
        ("off", 5, at(1400), 5000, {"offsets"}),
        ("none", 6, None, None, {"offsets"}),
        ("last", 9, at(1800), len(passage), set()),
    ]
    chunks = spark.createDataFrame([(i, "d", "eng_Latn", n, passage[a:b] if a is not None else "x", a, b) for i, n, a, b, _ in rows], "id string, document_id string, language string, chunk_index int, text string, char_start int, char_end int")
    docs = spark.createDataFrame([("d", passage)], "document_id string, text string")
    assert {r["id"]: set(r["faults"]) for r in recut(chunks, docs).collect()} == {i: f for i, _, _, _, f in rows if f}
    new = recut(chunks, docs).filter("id = 'none'").first()["pieces"]
    assert new[0]["char_start"] == 0 and new[-1]["char_end"] == len(passage) and all(p["token_count"] <= LIMIT for p in new)
