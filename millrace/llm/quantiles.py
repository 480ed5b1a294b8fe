"""Percentiles of very large columns from mergeable sketches with relative rank error.

A sketch is a stack of relative compactors. A compactor keeps a sorted buffer whose upper sections
are protected: a compaction halves only the lowest part, and the more often it has happened the
further up it reaches, by the trailing ones of the compaction counter. The error of a rank is
therefore a fraction of its distance from the top, so the 99.9th percentile is as sure as the
median. Sketches of partitions and days merge level by level.

Shuffled are sketches, some kilobytes each, not values.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTION, SECTIONS = 32, 3
#: Values that a partition's sketches may hold before they are sent on.
HELD = 4_000_000
#: The groups of partitions by which a key's sketches merge, level by level: of a million partitions no group has more than about 250 sketches.
FANS = (4_096, 64)


class _Compactor:
    __slots__ = ("buffer", "fresh", "section", "sections", "state")

    def __init__(self, section: float = SECTION, sections: int = SECTIONS, state: int = 0, buffer: np.ndarray | None = None):
        self.section, self.sections, self.state = section, sections, state
        self.buffer = np.empty(0) if buffer is None else buffer
        self.fresh: list[np.ndarray] = []

    @property
    def size(self) -> int:
        return len(self.buffer) + sum(map(len, self.fresh))

    @property
    def capacity(self) -> int:
        return 2 * self.sections * self._width()

    def _width(self) -> int:
        return max(4, 2 * round(self.section / 2))

    def sort(self) -> None:
        if self.fresh:
            self.buffer = np.sort(np.concatenate([self.buffer, *self.fresh]), kind="stable")
            self.fresh = []

    def compact(self) -> np.ndarray:
        """Takes out the lowest part and returns every other value of it, to count twice."""
        self.sort()
        reach = min((~self.state & (self.state + 1)).bit_length(), self.sections)  # trailing ones and one more
        keep = self.capacity // 2 + (self.sections - reach) * self._width()
        low = len(self.buffer) - keep
        low -= low & 1
        coin = (self.state ^ (self.state >> 1)).bit_count() & 1  # alternates: the errors of neighbouring compactions cancel
        out, self.buffer = self.buffer[coin:low:2], self.buffer[low:]
        self.state += 1
        self.grow()
        return out

    def grow(self) -> None:
        """Once the counter has run through the sections there are twice as many, each narrower by the root of two."""
        while self.state >= 1 << (self.sections - 1) and self.section / 2**0.5 >= 4:
            self.section /= 2**0.5
            self.sections *= 2


class Sketch:
    """Of doubles that are numbers. ``n`` counts them; least and most are exact."""

    __slots__ = ("levels", "most", "least", "n")

    def __init__(self) -> None:
        self.levels = [_Compactor()]
        self.n, self.least, self.most = 0, np.inf, -np.inf

    def update(self, values: np.ndarray) -> Sketch:
        for part in np.array_split(values, max(1, len(values) // 65536)) if len(values) else ():
            self.n += len(part)
            self.least, self.most = min(self.least, float(part.min())), max(self.most, float(part.max()))
            self.levels[0].fresh.append(part.astype("f8"))
            self._compress()
        return self

    def merge(self, other: Sketch) -> Sketch:
        for h, theirs in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(_Compactor())
            mine = self.levels[h]
            theirs.sort()
            mine.fresh.append(theirs.buffer)
            mine.state |= theirs.state
            if theirs.sections > mine.sections:
                mine.section, mine.sections = theirs.section, theirs.sections
            mine.grow()
        self.n += other.n
        self.least, self.most = min(self.least, other.least), max(self.most, other.most)
        self._compress()
        return self

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            while self.levels[h].size >= self.levels[h].capacity:
                if h + 1 == len(self.levels):
                    self.levels.append(_Compactor())
                up = self.levels[h].compact()
                if not len(up):
                    break
                self.levels[h + 1].fresh.append(up)
            h += 1

    @property
    def held(self) -> int:
        return sum(c.size for c in self.levels)

    def quantiles(self, ranks: Iterable[float]) -> list[float]:
        """Nearest-rank values; none if there are no values."""
        ranks = list(ranks)
        if not self.n:
            return [float("nan")] * len(ranks)
        for c in self.levels:
            c.sort()
        values = np.concatenate([c.buffer for c in self.levels])
        weights = np.concatenate([np.full(len(c.buffer), 1 << h, dtype="i8") for h, c in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        values, above = values[order], np.cumsum(weights[order])
        at = np.searchsorted(above, [np.ceil(r * self.n) for r in ranks])
        out = values[np.minimum(at, len(values) - 1)]
        return [self.least if r <= 0 else self.most if r >= 1 else float(v) for r, v in zip(ranks, out)]

    def pack(self) -> bytes:
        parts = [struct.pack("<qddi", self.n, self.least, self.most, len(self.levels))]
        for c in self.levels:
            c.sort()
            parts += [struct.pack("<diqi", c.section, c.sections, c.state, len(c.buffer)), c.buffer.astype("<f8").tobytes()]
        return b"".join(parts)

    @classmethod
    def unpack(cls, data: bytes) -> Sketch:
        out = cls()
        out.n, out.least, out.most, levels = struct.unpack_from("<qddi", data)
        at, out.levels = struct.calcsize("<qddi"), []
        for _ in range(levels):
            section, sections, state, size = struct.unpack_from("<diqi", data, at)
            at += struct.calcsize("<diqi")
            out.levels.append(_Compactor(section, sections, state, np.frombuffer(data, "<f8", size, at).copy()))
            at += 8 * size
        return out


def _schema(df: DataFrame, keys: list[str], *more: T.StructField) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), *more])


def build_sketches(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One sketch for each combination of ``keys``: columns keys, n, sketch.

    Nulls, NaN and infinities are no values; null keys are a group of their own; an empty table gives
    no rows. Every partition makes its own sketches, which merge in a tree of three levels, so that a hot key
    brings no more than a bounded number of sketches to one task.
    """
    fields = _schema(df, keys, T.StructField("_part", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType()))
    rows = df.select(*keys, F.col(value).cast("double").alias("_value")).filter(F.col("_value").isNotNull() & ~F.isnan("_value") & (F.abs("_value") < float("inf")))

    def partials(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyspark

        part = (pyspark.TaskContext.get() or 0) and pyspark.TaskContext.get().partitionId()
        held: dict[tuple, Sketch] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*k, part, s.n, s.pack()) for k, s in held.items()], columns=[*keys, "_part", "n", "sketch"])
            held.clear()
            return out

        for frame in frames:
            for key, group in frame.groupby(keys, dropna=False, sort=False)["_value"]:
                key = tuple(None if x is None or x != x else x for x in key)
                held.setdefault(key, Sketch()).update(group.to_numpy())
            if sum(s.held for s in held.values()) > HELD:
                yield flush()
        if held:
            yield flush()

    made = rows.mapInPandas(partials, fields)
    for fan in FANS:
        made = _merged(made, [*keys, "_part"], fan)
    return merge_sketches(made, keys)


def _merged(sketches: DataFrame, keys: list[str], fan: int | None = None) -> DataFrame:
    """Sketches merged by ``keys``, of which the last counts in groups of ``fan`` if one is given."""
    if fan:
        sketches = sketches.withColumn(keys[-1], F.pmod(F.col(keys[-1]), F.lit(fan)))
    fields = _schema(sketches, keys, T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType()))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = reduce(Sketch.merge, map(Sketch.unpack, frame["sketch"]), Sketch())
        row = frame.iloc[:1][keys].copy()
        row["n"], row["sketch"] = total.n, [total.pack()]
        return row

    return sketches.groupBy(*keys).applyInPandas(merge, fields)


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer keys (days, partitions) combined to those of ``keys``."""
    return _merged(sketches.select(*keys, "n", "sketch"), keys)


def sketch_percentiles(sketches: DataFrame, ranks: dict[str, float]) -> DataFrame:
    """``sketches`` with a double column for each name of ``ranks`` (0 to 1) instead of the sketch."""
    names, wanted = list(ranks), list(ranks.values())

    @F.pandas_udf(T.StructType([T.StructField(x, T.DoubleType()) for x in names]))
    def read(packed: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([Sketch.unpack(x).quantiles(wanted) for x in packed], columns=names)

    others = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*others, read("sketch").alias("_percentiles")).select(*others, "_percentiles.*")
