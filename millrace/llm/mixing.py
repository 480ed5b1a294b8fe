"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form a stream in hash order, repeated up to its cap, of which the mixture
takes as many tokens as the target asks for and the cap allows. The stream is cut into blocks of
equal size, a parameter in tokens. Block k of a source of weight w is released at floor(k / w) and due at
ceil((k + 1) / w); the released block due first goes first. As the weights sum to 1 every deadline is met
(earliest deadline first is optimal on one processor), so at any slot each source is less than one
block from its share.

The state of the schedule at a slot is the next block of each source. The driver walks the slots once and keeps this
state at the start of every frame of FRAME slots; the frames are scheduled again, in parallel, where the rows are needed.
Sums run over (source, bucket) pairs, so no source is ever in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.plans.lineage import cut

#: Tokens of a block, and slots of a frame. The driver takes about a microsecond a block: larger blocks suit corpora beyond some 10**11 tokens.
BLOCK, FRAME = 8_192, 65_536
#: Documents of a source that are sorted in one task, on average.
BUCKET = 20_000
#: More sources than this are refused: their plan is made on the driver.
MAX_SOURCES = 10_000


def canonical_source(source: Column) -> Column:
    """The spelling that sources are compared in: lower case, no outer white space."""
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def source_sizes(df: DataFrame, source: str, size: Column, targets: DataFrame) -> DataFrame:
    """Of each target: source, target_share, max_repeats, documents, size, total (of all targets' sources), wanted, reachable.

    A source without documents has size 0. Null sources and sources without a target take no part;
    a target given twice counts once.
    """
    sums = df.select(canonical_source(F.col(source)).alias("source"), size.cast("long").alias("_size")).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("_size").alias("size"))
    wanted = targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"])
    joined = wanted.join(sums, "source", "left").withColumns({"documents": F.coalesce("documents", F.lit(0)), "size": F.coalesce("size", F.lit(0))})
    total = joined.agg(F.sum("size").alias("total"))
    joined = joined.crossJoin(F.broadcast(total))  # one row
    want = F.col("target_share") * F.col("total")
    return joined.withColumns({"wanted": want, "reachable": F.col("max_repeats") * F.col("size") >= want})


def slots_from(blocks: dict[str, int], begun: dict[str, int], slot: int, stop: int) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) of the slots from ``slot`` to ``stop``, earliest deadline first among the blocks released by each.

    ``begun``: the next block of each source at ``slot``; it is kept up to date.
    """
    total = sum(blocks.values())
    release = lambda s, k: k * total // blocks[s]
    deadline = lambda s, k: -(-(k + 1) * total // blocks[s])
    left = [(s, begun.get(s, 0)) for s in sorted(blocks) if begun.get(s, 0) < blocks[s]]
    coming = [(release(s, k), s, k) for s, k in left if release(s, k) > slot]
    ready = [(deadline(s, k), s, k) for s, k in left if release(s, k) <= slot]
    heapq.heapify(coming)
    heapq.heapify(ready)
    for at in range(slot, min(stop, total)):
        while coming and coming[0][0] <= at:
            _, s, k = heapq.heappop(coming)
            heapq.heappush(ready, (deadline(s, k), s, k))
        _, s, k = heapq.heappop(ready)
        yield s, k, at
        begun[s] = k + 1
        if k + 1 < blocks[s]:
            heapq.heappush(coming, (release(s, k + 1), s, k + 1))


def schedule(blocks: dict[str, int]) -> list[tuple[str, int, int]]:
    """The whole schedule."""
    return list(slots_from(blocks, {}, 0, sum(blocks.values())))


def frames(blocks: dict[str, int], length: int) -> list[tuple[int, dict[str, int]]]:
    """The first slot of each frame and the state there."""
    out, begun = [], {}
    for start in range(0, sum(blocks.values()), length):
        out.append((start, dict(begun)))
        for _ in slots_from(blocks, begun, start, start + length):
            pass
    return out


def _slot_rows(spark, blocks: dict[str, int]) -> DataFrame:
    """source, block, slot of the whole schedule, made frame by frame."""
    names, length = sorted(blocks), FRAME
    states = [(start, [begun.get(s, 0) for s in names]) for start, begun in frames(blocks, length)]
    rows = spark.createDataFrame(states, "start long, begun array<long>")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for start, begun in zip(part["start"], part["begun"]):
                yield pd.DataFrame(slots_from(blocks, dict(zip(names, map(int, begun))), int(start), int(start) + length), columns=["source", "block", "slot"])

    return rows.repartition(max(1, len(states)), "start").mapInPandas(run, "source string, block long, slot long")


def mix_sources(df: DataFrame, key: str, source: str, size: Column, targets: DataFrame, block: int = BLOCK, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    Mixture: slot, slot_start (tokens from the block's start), source, key, repeat (from 0), size; ordered by
    slot, slot_start it is the interleaved stream. Report: the columns of ``source_sizes`` with taken,
    actual_share, repeats. A source that cannot reach its target gives all its repeats, and the
    report says so. Documents of no size take no part; repeated rows of a key count each. ``block``: tokens of a block, whatever
    the data: documents are not divided, so a source is within a block and one document of its share at any place.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), canonical_source(F.col(source)).alias("source"), size.cast("long").alias("size"))
    rows = cut(rows.join(F.broadcast(targets.select("source").distinct().limit(MAX_SOURCES + 1)), "source"))
    # after the checkpoint: a filter on the size before it would measure the texts twice
    rows = rows.filter("size > 0")
    buckets = buckets or max(16, -(-rows.count() // BUCKET))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "source"), F.lit(buckets)).cast("int"))
    plan = source_sizes(rows, "source", F.col("size"), targets)
    plan = plan.withColumn("quota", F.least(F.ceil("wanted"), F.col("max_repeats") * F.col("size")).cast("long"))
    plan_rows = plan.limit(MAX_SOURCES + 1).collect()  # a row a target
    if len(plan_rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    slot_rows = _slot_rows(spark, {r["source"]: -(-r["quota"] // block) for r in plan_rows if r["quota"]})
    # where each bucket of a source starts: sums over buckets, of which there is a bounded number
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
    inside = W.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["source", "bucket"])
    quotas = F.broadcast(spark.createDataFrame([(r["source"], r["size"], r["quota"]) for r in plan_rows] or [("", 0, 0)], "source string, whole long, quota long"))
    placed = placed.join(quotas, "source").filter("whole > 0").withColumn("start", F.col("start") + F.col("offset"))
    repeats = F.sequence(F.lit(0), F.ceil(F.col("quota") / F.col("whole")).cast("int"))
    stream = placed.select("source", "key", "size", "start", "whole", "quota", F.explode(repeats).alias("repeat")).withColumn("start", F.col("start") + F.col("repeat") * F.col("whole")).filter("start < quota")
    mixture = stream.withColumn("block", F.floor(F.col("start") / F.lit(block)).cast("long")).join(slot_rows, ["source", "block"])
    mixture = mixture.select("slot", (F.col("start") - F.col("block") * block).alias("slot_start"), "source", F.col("key").alias(key), "repeat", "size")
    got = mixture.groupBy("source").agg(F.sum("size").alias("taken"), (F.max("repeat") + 1).alias("repeats"))
    report = plan.join(got, "source", "left").withColumns({"taken": F.coalesce("taken", F.lit(0)), "repeats": F.coalesce("repeats", F.lit(0))})
    all_taken = report.agg(F.sum("taken").alias("all_taken"))
    report = report.crossJoin(F.broadcast(all_taken)).withColumn("actual_share", F.col("taken") / F.greatest(F.col("all_taken"), F.lit(1)))
    return mixture, report.select("source", "target_share", "max_repeats", "documents", "size", "total", "wanted", "reachable", "taken", "actual_share", "repeats")
