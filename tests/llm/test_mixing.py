from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import mixing
from millrace.llm.mixing import frames, mix_sources, schedule, slots_from


@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(0, 40), min_size=1))
def test_every_prefix_is_within_one_block(blocks):
    order = schedule(blocks)
    total = sum(blocks.values())
    assert sorted(s for s, _, _ in order) == sorted(s for s, n in blocks.items() for _ in range(n))
    seen = dict.fromkeys(blocks, 0)
    for slot, (s, k, at) in enumerate(order):
        assert at == slot and k == seen[s]
        seen[s] += 1
        for x, n in blocks.items():
            assert abs(seen[x] - Fraction(n, total) * (slot + 1)) < 1


def mixture(spark, docs, targets, block=mixing.BLOCK):
    df = spark.createDataFrame(docs, "id long, source string, n int, size string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixed, report = mix_sources(df, "id", "source", F.col("n"), t, block, buckets=4)
    return mixed.toPandas(), {r["source"]: r for r in report.collect()}


def test_shares_repeats_and_spelling(spark):
    docs = [(i, ["Big", " big ", "BIG"][i % 3], 10, "x") for i in range(300)] + [(1000 + i, "small", 10, "x") for i in range(10)] + [(2000, None, 10, "x"), (2001, "other", 10, "x"), (2002, "small", 0, "x")]
    mixed, report = mixture(spark, docs, [("big", 0.8, 1), ("small", 0.2, 3), ("none", 0.0, 2)])
    assert set(mixed["source"]) == {"big", "small"}
    small = report["small"]
    # 3100 tokens in all: small may give 300 of the 620 wanted
    assert (small["size"], small["taken"], small["repeats"], small["reachable"]) == (100, 300, 3, False)
    assert mixed[mixed["source"] == "small"].groupby("id").size().tolist() == [3] * 10
    big = report["big"]
    assert big["taken"] == 2480 and big["reachable"] and big["repeats"] == 1
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1.0)
    assert report["none"]["size"] == 0 and report["none"]["taken"] == 0


def test_interleaved_evenly(spark):
    docs = [(i, "a" if i % 4 else "b", 7, "x") for i in range(2000)]
    mixed, _ = mixture(spark, docs, [("a", 0.5, 2), ("b", 0.5, 3)], block=7)
    mixed = mixed.sort_values(["slot", "slot_start"])
    share = (mixed["source"] == "a").cumsum() / range(1, len(mixed) + 1)
    assert (share.iloc[100:] - share.iloc[-1]).abs().max() < 0.02


def test_empty(spark):
    mixed, report = mixture(spark, [(1, "x", 1, "x")], [("a", 1.0, 2)])
    assert len(mixed) == 0 and report["a"]["taken"] == 0


@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(0, 40), min_size=1), st.integers(1, 30))
def test_frames_give_the_same_schedule(blocks, length):
    parts = [x for start, begun in frames(blocks, length) for x in slots_from(blocks, begun, start, start + length)]
    assert parts == schedule(blocks)


def test_small_blocks_and_frames(spark, monkeypatch):
    """The deviation is bounded by the block that is asked for, however many there are."""
    monkeypatch.setattr(mixing, "FRAME", 50)
    docs = [(i, "abc"[i % 3], 7, "x") for i in range(3000)]
    df = spark.createDataFrame(docs, "id long, source string, n int, size string")
    t = spark.createDataFrame([("a", 0.2, 2), ("b", 0.3, 2), ("c", 0.5, 3)], "source string, target_share double, max_repeats int")
    mixed = mix_sources(df, "id", "source", F.col("n"), t, block=21)[0].toPandas().sort_values(["slot", "slot_start"])
    assert mixed["slot"].max() >= 990  # 21,000 tokens
    tokens = mixed["size"].cumsum()
    for s, share in (("a", 0.2), ("b", 0.3), ("c", 0.5)):
        assert ((mixed["size"] * (mixed["source"] == s)).cumsum() - share * tokens).abs().max() <= 21 + 7 * 4
