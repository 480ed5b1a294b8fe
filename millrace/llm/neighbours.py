"""The most similar vectors of every vector, by collision counting over query-centred windows.

A region is the unit of work: fine pivots, fitted on a bounded sample, are grouped by their own nearness into
regions of some thousand rows; a vector goes to the regions of its nearest pivots, mostly one. In a region every
line (a direction fitted to the region's own rows) is a sorted array of the projections of the rows that lie
furthest along it. Around the projections of a query on its lines windows expand level by level (virtual
rehashing: the radius grows, nothing is hashed again, and only the newly entered ends are counted). Objects with
enough collisions are verified by their exact cosine. A query ends at the first level whose radius holds its k best.

Queries that are neighbours in a sorted array share a block: their windows are one coverage of the arrays, an
object's collisions are counted over the block, and what exceeds the threshold is verified by one matrix product.

Copies of one direction are one vector with members. Regions beyond a bounded size are a grid of blocks, so
that crowded ones are shared by many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.plans.lineage import cut

#: Bounds of the fit: vectors in the sample, pivots. Every vector is indexed, and asked, whatever the fit.
SAMPLE, PIVOTS = 16_384, 2_048
#: Vectors a pivot and a region on average; the most rows of a region that one task takes as objects or as queries.
CELL, REGION, BLOCK_ROWS = 400, 16_384, 65_536
#: A vector is in the regions of so many nearest pivots, as far as they are nearly as near as the nearest (in cosine).
PROBES, GAP = 12, 0.15
#: Rows a line of a region on average, the lines that an object and a query lie on, queries in a block.
LINE, OBJECT_LINES, QUERY_LINES, QUERIES = 100, 4, 8, 64
#: Collisions a query of the block on average that an object needs to be verified.
THRESHOLD = 0.15
#: The levels: half width of the windows, and the distance between unit vectors within which the k best end a query. The last holds whole arrays.
LEVELS = ((0.35, 0.8), (2.0, 8.0))
SEED = 20_240_101


def unpack(packed: pd.Series) -> np.ndarray:
    """Rows of unit vectors from their packed form."""
    raw = np.frombuffer(b"".join(packed), dtype="u1").reshape(len(packed), -1)
    scale = np.ascontiguousarray(raw[:, :4]).view("<f4")
    return np.ascontiguousarray(raw[:, 4:]).view("<i2").astype("f4") * scale


def packed_vectors(df: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """id, unit (packed), u (digest of the direction) of each row with a usable vector: not null, of ``dimensions`` numbers, not all zero.

    Packed are a scale and 16-bit whole numbers: cosines of packed vectors are within 0.00001 of the exact ones.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == dimensions))

    @F.pandas_udf("struct<unit:binary,u:binary>")
    def pack(vectors: pd.Series) -> pd.DataFrame:
        import hashlib

        m = np.array([np.asarray(v, dtype="f8") for v in vectors]).reshape(len(vectors), -1)
        norm = np.sqrt((m * m).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        m[good] /= norm[good, None]
        m = np.round(m, 6).astype("<f4") + np.float32(0)  # scaled copies become the same; no negative zeros
        scale = np.where(good, np.abs(m).max(axis=1, initial=0) / 32767, 1).astype("<f4")
        whole = np.rint(np.where(good[:, None], m, 0) / scale[:, None]).astype("<i2")
        units = [scale[i].tobytes() + whole[i].tobytes() if good[i] else None for i in range(len(m))]
        return pd.DataFrame({"unit": units, "u": [hashlib.md5(m[i].tobytes()).digest() if good[i] else None for i in range(len(m))]})

    # not to be computed a second time for the filter
    pack = pack.asNondeterministic()
    return rows.select("id", pack("v").alias("p")).select("id", "p.*").filter(F.col("unit").isNotNull())


def fit_pivots(sample: np.ndarray, pivots: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means centres of the sample."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), min(pivots, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        order = np.argsort(near, kind="stable")
        cuts = np.flatnonzero(np.diff(near[order], prepend=-1))
        sums = np.add.reduceat(sample[order], cuts, axis=0)
        centres = centres.copy()
        centres[near[order][cuts]] = sums
        norm = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = centres / np.where(norm > 0, norm, 1)
    return centres.astype("f4")


def fit_regions(pivots: np.ndarray, regions: int) -> np.ndarray:
    """The region of each pivot: pivots that are near to each other share one, so that a crowd of rows is not cut apart by chance."""
    return (pivots @ fit_pivots(pivots, regions, 15).T).argmax(axis=1).astype("i4")


def regions_of(vectors: np.ndarray, pivots: np.ndarray, region: np.ndarray) -> list[np.ndarray]:
    """The regions that each vector is in, each once."""
    out = []
    probes = min(PROBES, len(pivots))
    for part in np.array_split(vectors, max(1, len(vectors) // 1024)):
        near = part @ pivots.T
        best = np.argpartition(near, len(pivots) - probes, axis=1)[:, len(pivots) - probes :]
        value = np.take_along_axis(near, best, 1)
        # a probe that is too far counts as one more of the nearest pivot
        nearest = best[np.arange(len(part)), value.argmax(axis=1)]
        best = np.where(value >= value.max(axis=1, keepdims=True) - GAP, best, nearest[:, None])
        out += [np.unique(row) for row in region[best]]
    return out


def _lines_of(vectors: np.ndarray, lines: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The lines that each vector lies furthest along, the furthest first, and its projections on them."""
    most = min(most, len(lines))
    which, place = np.empty((len(vectors), most), dtype="i4"), np.empty((len(vectors), most), dtype="f4")
    for a in range(0, len(vectors), 4096):
        all_ = vectors[a : a + 4096] @ lines.T
        top = np.argpartition(all_, len(lines) - most, axis=1)[:, len(lines) - most :]
        value = np.take_along_axis(all_, top, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        which[a : a + 4096], place[a : a + 4096] = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
    return which, place


def _coverage(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows [low, high) lie over an array: start, end and how many windows of each stretch that some cover."""
    edges, place = np.unique(np.concatenate([low, high]), return_inverse=True)
    step = np.bincount(place[: len(low)], minlength=len(edges)) - np.bincount(place[len(low) :], minlength=len(edges))
    depth = np.cumsum(step)[:-1]
    used = depth > 0
    return edges[:-1][used], edges[1:][used], depth[used]


def collide(objects: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, object, cosine) of the best k objects of each query. ``own``: the object that a query itself is, or -1."""
    n = len(objects)
    count = max(1, n // LINE)
    rng = np.random.default_rng(SEED)
    lines = fit_pivots(objects[rng.choice(n, min(n, 16 * count), replace=False)], count, 4)
    line, place = _lines_of(objects, lines, OBJECT_LINES)
    asked, at = _lines_of(queries, lines, QUERY_LINES)
    # one sorted array a line, all in one: projections lie within -1 and 1, lines four apart
    keys = (line * 4.0 + place).ravel()
    order = np.argsort(keys, kind="stable")
    keys, members = keys[order], order // line.shape[1]
    best, which = np.full((len(queries), k), -2.0, dtype="f4"), np.full((len(queries), k), -1, dtype="i8")
    walk = np.lexsort((at[:, 0], asked[:, 0]))  # along the sorted array of each query's first line
    for start in range(0, len(walk), QUERIES):
        active = walk[start : start + QUERIES]
        need = THRESHOLD * len(active)
        collisions, verified = np.zeros(n), np.zeros(n, dtype=bool)
        middle = np.searchsorted(keys, (asked[active] * 4.0 + at[active]).ravel()).reshape(len(active), -1)
        low, high = middle, middle
        for width, radius in LEVELS:
            base, centre = asked[active] * 4.0, at[active]
            left = np.searchsorted(keys, (base + np.maximum(centre - width, -1.5)).ravel()).reshape(low.shape)
            right = np.searchsorted(keys, (base + np.minimum(centre + width, 1.5)).ravel()).reshape(low.shape)
            # only what the windows newly reach at either end is counted
            a, b, depth = _coverage(np.concatenate([left.ravel(), high.ravel()]), np.concatenate([low.ravel(), right.ravel()]))
            length = b - a
            entered = np.arange(length.sum()) + np.repeat(a - (np.cumsum(length) - length), length)
            collisions += np.bincount(members[entered], weights=np.repeat(depth, length), minlength=n)
            found = np.flatnonzero((collisions >= need) & ~verified)
            verified[found] = True
            _verify(objects, queries, active, found, own, best, which, k)
            # the k-th best lies within the radius: what was verified is near enough
            open_ = best[active, k - 1] < 1 - radius * radius / 2
            active, low, high = active[open_], left[open_], right[open_]
            if not len(active):
                break
    # a query with too few collisions is compared with all objects of the block
    short = np.flatnonzero((which >= 0).sum(axis=1) < min(k, n - 1))
    for part in np.array_split(short, max(1, len(short) // 256)) if len(short) else ():
        best[part], which[part] = -2.0, -1
        _verify(objects, queries, part, np.arange(n), own, best, which, k)
    q, nth = np.nonzero(which >= 0)
    return q, which[q, nth], best[q, nth]


def _verify(objects: np.ndarray, queries: np.ndarray, active: np.ndarray, found: np.ndarray, own: np.ndarray, best: np.ndarray, which: np.ndarray, k: int) -> None:
    """Merges the cosines of the ``found`` objects into the best k of the ``active`` queries."""
    if not len(found):
        return
    cosine = queries[active] @ objects[found].T
    cosine[found[None, :] == own[active][:, None]] = -2.0  # a query is not its own neighbour
    most = min(k, len(found))
    top = np.argpartition(cosine, len(found) - most, axis=1)[:, len(found) - most :]
    value = np.concatenate([best[active], np.take_along_axis(cosine, top, 1)], axis=1)
    object_ = np.concatenate([which[active], found[top]], axis=1)
    object_[value <= -2.0] = -1
    order = np.lexsort((object_, -value), axis=1)[:, :k]
    best[active], which[active] = np.take_along_axis(value, order, 1), np.take_along_axis(object_, order, 1)


def nearest_neighbours(df: DataFrame, key: str, vector: str, k: int = 5, dimensions: int = 96) -> DataFrame:
    """id, neighbour, cosine, rank (1 to k) of each usable vector.

    Null, empty and zero vectors and those of other lengths take no part; repeated rows of an id count
    once (of different vectors of an id the one of least digest). Of copies, and of equal cosines within the lists, the lesser id comes first.
    Copies are neighbours of each other, at cosine 1. Fewer than k other vectors: all of them. An empty table gives no rows.
    """
    spark = df.sparkSession
    packed = packed_vectors(df, key, vector, dimensions)
    # a direction is a number from here on; the checkpoint fixes it
    heads = cut(packed.groupBy("u").agg(F.first("unit").alias("unit")).select(F.monotonically_increasing_id().alias("head"), "u", "unit"))
    n = heads.count()
    id_type = packed.schema["id"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"id {id_type}, neighbour {id_type}, cosine float, rank int")
    ids = packed.groupBy("id").agg(F.min("u").alias("u"))
    # no join of rows is a broadcast through the driver: the engine takes a vector for one number, and what follows it for a ninetieth of its size
    members = cut(ids.join(heads.select("u", "head").hint("merge"), "u").select("id", "head"))
    sampled = heads.filter(F.pmod(F.xxhash64("u"), F.lit(max(1, n // SAMPLE))) == 0) if n > 2 * SAMPLE else heads
    sample = sampled.select("unit").limit(2 * SAMPLE).toPandas()
    pivots = fit_pivots(unpack(sample["unit"]), int(np.clip(n // CELL, 1, PIVOTS)))
    fitted = spark.sparkContext.broadcast((pivots, fit_regions(pivots, int(np.clip(n // REGION, 1, len(pivots))))))

    @F.pandas_udf("array<int>")
    def regions(units: pd.Series) -> pd.Series:
        return pd.Series(regions_of(unpack(units), *fitted.value))

    placed = heads.select("head", "unit", F.explode(regions("unit")).alias("region"))
    sizes = heads.select(F.explode(regions("unit")).alias("region")).groupBy("region").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("side"))
    sized = placed.join(F.broadcast(sizes), "region")  # a row a region, of which there are as many as pivots at most
    # of a grid of side x side blocks a row is a query in one line and an object in one column, in their crossing both
    sized = sized.withColumn("own", F.pmod(F.xxhash64("head", F.lit(7)), F.col("side")).cast("int"))
    as_query = F.transform(F.sequence(F.lit(0), F.col("side") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("asks"), (j == F.col("own")).alias("is_object")))
    as_object = F.transform(F.filter(F.sequence(F.lit(0), F.col("side") - 1), lambda i: i != F.col("own")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("is_object")))
    cells = sized.select("region", "head", "unit", F.inline(F.concat(as_query, as_object)))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("head", kind="stable")
        heads_, vectors = frame["head"].to_numpy(), unpack(frame["unit"])
        o, q = frame["is_object"].to_numpy(), frame["asks"].to_numpy()
        if not o.any() or not q.any():
            return pd.DataFrame({"head": [], "other": [], "cosine": []}, dtype="i8")
        own = np.where(o, np.cumsum(o) - 1, -1)[q]
        a, b, cosine = collide(vectors[o], vectors[q], k, own)
        return pd.DataFrame({"head": heads_[q][a], "other": heads_[o][b], "cosine": np.minimum(np.round(cosine, 6), 1.0)})

    found = cells.groupBy("region", "i", "j").applyInPandas(search, "head long, other long, cosine float")
    ordered = lambda c, more: F.slice(F.array_sort(F.array_distinct(c)), 1, more)
    # k rows of each block that a direction is in: a short list
    near = found.groupBy("head").agg(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "other")).alias("l")).select("head", F.inline(ordered(F.col("l"), k)))
    # of a direction's copies the k + 1 least ids can be anyone's neighbours; the limit is applied before the shuffle too
    of = W.partitionBy("head").orderBy("id")
    visible = members.withColumn("nth", F.row_number().over(of)).filter(F.col("nth") <= k + 1).groupBy("head").agg(F.collect_list("id").alias("ids"))
    shown = near.join(visible.withColumnRenamed("head", "other").hint("merge"), "other").select("head", "far", "ids")
    lists = shown.unionByName(visible.select("head", F.lit(-1.0).cast("float").alias("far"), "ids"))
    lists = lists.select("head", F.transform("ids", lambda x: F.struct(F.col("far").alias("far"), x.alias("neighbour"))).alias("l")).groupBy("head").agg(ordered(F.flatten(F.collect_list("l")), k + 1).alias("l"))
    own_list = members.join(lists.hint("merge"), "head").select("id", F.posexplode(F.slice(F.filter("l", lambda x: x["neighbour"] != F.col("id")), 1, k)).alias("n", "x"))
    return own_list.select("id", "x.neighbour", (-F.col("x.far")).alias("cosine"), (F.col("n") + 1).alias("rank"))


def mutual_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """id_a < id_b, each among the other's neighbours, with a cosine of at least ``least``."""
    close = neighbours.filter(F.col("cosine") >= least)
    # both directions of a pair are two rows of one key
    pair = close.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"))
    return pair.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("id_a", "id_b")
