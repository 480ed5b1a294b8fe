"""Chunking steps: written cases and properties."""

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import chunking as C

O = C.Options()


def sentence(words, n):
    return f"{' '.join(f'{words}{i}' for i in range(n))}."


def test_structural_prefers_coarse_separators():
    text = sentence("alpha", 90) + "\n\n" + sentence("beta", 90)
    spans = C.structural(text, O)
    assert [s.text.split()[0] for s in spans] == ["alpha0", "beta0"] and all(text[s.start : s.end] == s.text for s in spans)
    assert all(s.tokens <= O.target * C.MERGED + 2 for s in C.structural("word " * 2000, O))
    assert C.structural("  ", O) == []


def test_small_neighbours_merge():
    o = C.Options(target=20, least=10)
    spans = [C.Span("a" * 20, 0, 20), C.Span("b" * 20, 21, 41), C.Span("c" * 100, 42, 142)]
    assert [s.text for s in C.merge_small(spans, o)] == ["a" * 20 + " " + "b" * 20, "c" * 100]


def test_topical_cuts_where_words_change():
    text = " ".join([sentence("mill", 30)] * 3 + [sentence("ledger", 30)] * 3)
    spans = C.topical(text, O)
    assert len(spans) == 2 and "ledger" not in spans[0].text and "mill" not in spans[1].text


def test_overlap_is_capped_and_moved_to_a_space():
    text = " ".join([sentence("mill", 60), sentence("ledger", 60)])
    cut = text.index(" ledger0") + 1
    spans = [C.Span(text[: cut - 1], 0, cut - 1), C.Span(text[cut:], cut, len(text))]
    first, second = C.with_overlap(spans, text, O)
    assert (first.start, first.end) == (0, cut - 1) and second.start < cut - 1 and text[second.start] == " " and second.end == len(text)
    assert cut - second.start <= max(0.35 * (len(text) - cut), 0) + C.SNAP
    assert C.with_overlap(spans, text, C.Options(overlap=0)) == spans and C.with_overlap(spans[:1], text, O) == spans[:1]


def test_parents_hold_runs_of_children():
    text = " ".join(sentence(f"w{i}", 80) for i in range(6))
    spans = C.sentence_spans(text)
    parents, of = C.grouped(spans, text, C.Options(parent=2 * spans[0].tokens + 5))
    assert of == [0, 0, 1, 1, 2, 2] and parents[0].end == spans[1].end and C.grouped([], text, O) == ([], [])


def test_windows_step_and_stop():
    units = [sentence(f"word{i}x", 20) for i in range(8)]
    text = " ".join(units)
    size = C.sentence_spans(text)[0].tokens
    spans = C.sliding(text, C.Options(window=3 * size + 1, stride=size))
    assert [s.units[0] for s in spans] == list(range(len(spans))) and spans[-1].units[-1] == 7 and all(len(s.units) <= 3 for s in spans)
    assert C.sliding("", O) == []


def test_pipeline_rows():
    text = " ".join([sentence("mill", 40)] * 5 + [sentence("ledger", 40)] * 5)
    rows = list(C.chunk_passage(text, "d::0", O))
    kinds = {r["strategy"] for r in rows}
    assert "overlap" in kinds and len({r["id"] for r in rows}) == len(rows)
    parents = {r["id"] for r in rows if r["strategy"] == "parent"}
    children = [r for r in rows if r["strategy"] == "overlap"]
    assert all(r["parent_chunk"] is None or r["parent_chunk"] in parents for r in children)
    assert len({r["text"] for r in rows if r["strategy"] == "sliding_window"} & {r["text"] for r in children}) == 0
    assert list(C.chunk_passage("", "d::0", O)) == [] and [r["strategy"] for r in C.chunk_passage("One short line", "d::0", O)] == ["recursive"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["mill", "wheel.", "नमस्ते।", "\n\n", "\n", "ledger,", "x" * 80, "Stop!", "字。"]), max_size=200))
def test_any_text(words):
    text = " ".join(words).strip()
    o = C.Options(target=40, least=8, overlap=8, parent=90, window=30, stride=15)
    for r in C.chunk_passage(text, "d", o):
        assert r["text"] and 0 <= r["char_start"] < r["char_end"] and r["token_count"] == C.estimate(r["text"])
    for s in C.structural(text, o):
        assert s.start < s.end <= len(text)


def test_very_long_text():
    import time

    began = time.time()
    rows = list(C.chunk_passage(" ".join(sentence(f"w{i % 50}", 12) for i in range(8_000)), "d", O))
    assert len(rows) > 1_000 and time.time() - began < 60


def test_operator(spark):
    rows = [("d", "0", "A mill. " * 3, "eng_Latn", "s", None, "what is a mill", "x")] * 2 + [("e", "0", None, "eng_Latn", "s", None, None, "x"), ("f", "1", "", None, None, None, None, "x")]
    df = spark.createDataFrame(rows, "document_id string, passage_id string, text string, language string, source string, topic string, query_text string, id string")
    got = C.chunk_documents(df).collect()
    assert len(got) == 1 and got[0]["embed_text"].startswith("[topic: what is a mill | language: eng_Latn | source: s]\n") and got[0]["id"] == C.uuid_from("d::0::recursive::0")
    assert C.chunk_documents(df.limit(0)).count() == 0
