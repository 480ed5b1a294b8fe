import numpy as np
import pytest

from millrace.llm import spans as S


def brute(docs, least):
    grams = {}
    for d, t in docs:
        for p in range(len(t or "") - least + 1):
            grams.setdefault(t[p : p + least], set()).add(d)
    pairs, covered = set(), {}
    for d, t in docs:
        mark = np.zeros(len(t or ""), dtype=bool)
        for p in range(len(t or "") - least + 1):
            if len(grams[t[p : p + least]]) > 1:
                mark[p : p + least] = True
        covered[d] = covered.get(d, 0) + int(mark.sum())
    for g in grams.values():
        o = sorted(g)
        pairs |= {(a, b) for i, a in enumerate(o) for b in o[i + 1 :]}
    return pairs, covered


def corpus(seed, n=40, least=40):
    rng = np.random.default_rng(seed)
    letters = np.array(list("abc deमद字é"))
    text = lambda k: "".join(rng.choice(letters, k))
    shared = [text(least), text(least + 1), text(3 * least), text(least - 1), "ab" * least]
    docs = []
    for i in range(n):
        t = text(rng.integers(0, 120))
        for s in rng.choice(len(shared), rng.integers(0, 3), replace=False):
            t += shared[s] + text(rng.integers(0, 30))
        docs.append((i, t))
    return docs + [(n, docs[0][1]), (n + 1, ""), (n + 2, None), (n + 3, "ab" * 300)]


@pytest.mark.parametrize("contexts", [S.CONTEXTS, 2])
def test_against_brute_force(spark, monkeypatch, contexts):
    monkeypatch.setattr(S, "CONTEXTS", contexts)
    for seed in range(2):
        docs = corpus(seed)
        df = spark.createDataFrame([(d, t, "x") for d, t in docs], "id long, text string, doc string")
        occurrences = S.shared_occurrences(df, "id", least=40)
        pairs, covered = brute(docs, 40)
        assert {tuple(r) for r in S.sharing_pairs(occurrences).collect()} == pairs
        members = {}
        for r in S.passage_members(occurrences).collect():
            members.setdefault((r["passage_id"], r["documents"]), set()).add(r["doc"])
        assert all(len(m) == n > 1 for (_, n), m in members.items()) and {(a, b) for m in members.values() for a in m for b in m if a < b} == pairs
        got = {r["id"]: r["shared_chars"] for r in S.shared_share(df, occurrences, "id").collect()}
        assert got == covered


def test_shards_and_salts(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_CHARS", 200)
    monkeypatch.setattr(S, "PART_CHARS", 300)
    docs = corpus(5)
    df = spark.createDataFrame(docs, "id long, text string")
    assert {tuple(r) for r in S.sharing_pairs(S.shared_occurrences(df, "id", least=40)).collect()} == brute(docs, 40)[0]


def test_many_contexts_give_the_same_occurrences(spark, monkeypatch):
    df = spark.createDataFrame(corpus(8, n=60), "id long, text string")
    few = sorted(map(tuple, S.shared_occurrences(df, "id", least=40).collect()))
    monkeypatch.setattr(S, "CONTEXTS", 2)
    assert sorted(map(tuple, S.shared_occurrences(df, "id", least=40).collect())) == few and len(few) > 100


def test_hashes_and_anchors():
    text = "the mill and the mill and the mill race " * 10
    h = S.gram_hashes(S._codes(text), 20)
    seen = {}
    for p in range(len(text) - 19):
        assert seen.setdefault(text[p : p + 20], h[p]) == h[p]
    assert len(set(seen.values())) == len(seen)
    which, at, _ = S.anchors(["short", text, text[3:]], 40, 20)
    for t, body in ((1, text), (2, text[3:])):
        places = set(at[which == t].tolist())
        assert all(places & set(range(p, p + 21)) for p in range(len(body) - 39))
    assert not (which == 0).any()


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert S.shared_occurrences(df, "id", least=40).count() == 0
    one = spark.createDataFrame([(1, "x" * 300), (1, "x" * 300), (None, "x" * 300)], "id long, text string")
    assert S.sharing_pairs(S.shared_occurrences(one, "id", least=40)).count() == 0
