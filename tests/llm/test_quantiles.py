import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.quantiles import Sketch, build_sketches, merge_sketches, sketch_percentiles

RANKS = (0.01, 0.25, 0.5, 0.9, 0.95, 0.99, 0.999, 0.9999)


@pytest.mark.parametrize("kind", ["lognormal", "sorted", "reversed", "few"])
def test_relative_rank_error(kind):
    rng = np.random.default_rng(7)
    v = rng.integers(0, 40, 300_000).astype(float) if kind == "few" else rng.lognormal(0, 1, 300_000)
    v = np.sort(v) if kind == "sorted" else np.sort(v)[::-1] if kind == "reversed" else v
    total = Sketch()
    for part in np.array_split(v, 37):
        total.merge(Sketch.unpack(Sketch().update(part).pack()))
    assert total.n == len(v) and total.held < 6_000
    assert sum(c.size << h for h, c in enumerate(total.levels)) == len(v)
    s = np.sort(v)
    for r, q in zip(RANKS, total.quantiles(RANKS)):
        low, high = np.searchsorted(s, q, "left") / len(s), np.searchsorted(s, q, "right") / len(s)
        assert max(0.0, low - r, r - high) <= 0.06 * (1 - r)
    assert total.quantiles([0, 1]) == [s[0], s[-1]]


def test_small_counts_are_exact():
    for n in (1, 2, 3, 50):
        v = np.arange(1.0, n + 1)
        assert Sketch().update(v).quantiles([0.5, 0.95]) == [np.ceil(0.5 * n), np.ceil(0.95 * n)]
    assert np.isnan(Sketch().quantiles([0.5])[0])


def test_operator(spark):
    rows = [("a", float(x), "u") for x in range(1, 101)] + [("a", None, "u"), ("a", float("nan"), "u"), ("a", float("inf"), "u"), (None, 5.0, "u")]
    df = spark.createDataFrame(rows, "day string, value double, n string").repartition(5)
    out = {r["day"]: r for r in sketch_percentiles(build_sketches(df, ["day"], "value"), {"p50": 0.5, "p95": 0.95}).collect()}
    assert (out["a"]["n"], out["a"]["p50"], out["a"]["p95"]) == (100, 50.0, 95.0) and out[None]["p50"] == 5.0
    assert build_sketches(df.limit(0), ["day"], "value").count() == 0


def test_days_combine(spark):
    df = spark.range(40_000).select((F.col("id") % 4).cast("string").alias("day"), F.lit("w").alias("week"), F.rand(3).alias("value"))
    week = sketch_percentiles(merge_sketches(build_sketches(df, ["day", "week"], "value"), ["week"]), {"p50": 0.5, "p99": 0.99}).first()
    assert week["n"] == 40_000 and abs(week["p50"] - 0.5) < 0.03 and abs(week["p99"] - 0.99) < 0.002
