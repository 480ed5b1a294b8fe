import numpy as np

from millrace.llm import neighbours
from millrace.llm.neighbours import mutual_pairs, nearest_neighbours


def table(spark, vectors, ids=None):
    ids = ids or [f"v{i:05d}" for i in range(len(vectors))]
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "x") for i, v in zip(ids, vectors)], "id string, vector array<double>, cosine string")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 96))
    v = centres[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 96)) * 1.2
    v[1::50] = v[::50] + rng.standard_normal((60, 96)) * 0.05  # near copies
    v[:300] = centres[0] + rng.standard_normal((300, 96)) * 1.2  # a crowded topic
    df = table(spark, v)
    found = nearest_neighbours(df, "id", "vector").toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    kth = np.sort(s, axis=1)[:, -5]
    hits = sum(c >= kth[int(i[1:])] - 1e-5 for i, c in zip(found["id"], found["cosine"]))
    assert len(found) == 5 * 3000 and hits / (5 * 3000) >= 0.9
    ten = np.where(s >= 0.92)
    top = np.argsort(-s, axis=1)[:, :5]
    want = {(f"v{a:05d}", f"v{b:05d}") for a, b in zip(*ten) if a < b and b in top[a] and a in top[b]}
    assert {tuple(r) for r in mutual_pairs(nearest_neighbours(df, "id", "vector"), 0.92).collect()} == want


def test_recall_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 10)  # 300 cells
    rng = np.random.default_rng(5)
    v = rng.standard_normal((10, 96))[rng.integers(0, 10, 3000)] + rng.standard_normal((3000, 96)) * 1.2
    found = nearest_neighbours(table(spark, v), "id", "vector").toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    kth = np.sort(s, axis=1)[:, -5]
    assert sum(c >= kth[int(i[1:])] - 1e-5 for i, c in zip(found["id"], found["cosine"])) / (5 * 3000) >= 0.9


def test_copies_unusable_and_repeated(spark):
    a, b = [1.0] + [0.0] * 95, [0.9, 0.4] + [0.0] * 94
    df = table(spark, [a, a, [2 * x for x in a], b, None, [], [0.0] * 96, [1.0], [float("nan")] * 96], list("abcdefghi")).unionByName(table(spark, [a], ["a"]))
    rows = nearest_neighbours(df, "id", "vector", k=2).orderBy("id", "rank").collect()
    assert [(r["id"], r["neighbour"]) for r in rows] == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b"), ("d", "a"), ("d", "b")]
    assert {r["id"] for r in rows} == set("abcd")


def test_more_copies_than_neighbours(spark):
    v = [[1.0] + [0.0] * 95] * 40
    rows = nearest_neighbours(table(spark, v), "id", "vector", k=3).orderBy("id", "rank").collect()
    assert len(rows) == 120 and [r["neighbour"] for r in rows[:3]] == ["v00001", "v00002", "v00003"] and [r["neighbour"] for r in rows[-3:]] == ["v00000", "v00001", "v00002"]


def test_empty_and_single(spark):
    assert nearest_neighbours(table(spark, [[1.0] * 96]).limit(0), "id", "vector").count() == 0
    assert nearest_neighbours(table(spark, [[1.0] * 96]), "id", "vector").count() == 0


def test_regions_and_blocks(spark, monkeypatch):
    """Many regions, each a grid of blocks, give the lists that one region gives, but for what the fit loses."""
    monkeypatch.setattr(neighbours, "CELL", 20)
    monkeypatch.setattr(neighbours, "REGION", 400)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 250)
    rng = np.random.default_rng(9)
    v = rng.standard_normal((20, 96))[rng.integers(0, 20, 2000)] + rng.standard_normal((2000, 96)) * 0.8
    found = nearest_neighbours(table(spark, v), "id", "vector").toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    kth = np.sort(s, axis=1)[:, -5]
    assert len(found) == 5 * 2000 and not found.duplicated(["id", "neighbour"]).any() and (found["id"] != found["neighbour"]).all()
    assert sum(c >= kth[int(i[1:])] - 1e-5 for i, c in zip(found["id"], found["cosine"])) / (5 * 2000) >= 0.95


def test_collisions_exclude_and_verify():
    rng = np.random.default_rng(4)
    v = rng.standard_normal((80, 96))[rng.integers(0, 80, 8000)] + rng.standard_normal((8000, 96)) * 0.7
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("f4")
    met = []
    inner = neighbours._verify

    def count(objects, queries, active, found, *rest):
        met.append(len(active) * len(found))
        inner(objects, queries, active, found, *rest)

    neighbours._verify = count
    try:
        a, b, c = neighbours.collide(v, v, 5, np.arange(len(v)))
    finally:
        neighbours._verify = inner
    assert sum(met) < 0.7 * len(v) ** 2  # the more a block holds, the smaller the share that is verified
    assert np.allclose((v[a] * v[b]).sum(axis=1), c, atol=1e-5) and (a != b).all()


def test_no_rows_are_broadcast_through_the_driver(spark, monkeypatch):
    """Joins of rows stay shuffled however small the engine takes them to be; only the regions' sizes, a row a region, are broadcast."""
    rng = np.random.default_rng(6)
    plans, inner = [], neighbours.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return inner(df)

    monkeypatch.setattr(neighbours, "cut", seen)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10_000_000
    out = nearest_neighbours(table(spark, rng.standard_normal((200, 96))), "id", "vector")
    out.collect()
    plans.append(out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 4 and [("Broadcast" in x, "region#" in x) for x in joins if "SortMergeJoin" not in x] == [(True, True)]
    assert sum(plan.count("pack(") for plan in plans) == 2  # each vector is packed once for the directions and once for the ids
