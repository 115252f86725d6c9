import numpy as np
import pytest

from quire.llm import pivot_index as P

SCHEMA = "vec_id long, embedding array<float>, label int, key string, n int"


def brute(ids, vecs):
    x = np.array([v for v in vecs], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T >= 0.9


def rows_of(spark, ids, vecs):
    return spark.createDataFrame([(i, v, 1, "k", 2) for i, v in zip(ids, vecs)], SCHEMA)


def test_recall_and_consistency_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {r["vec_id"]: r for r in P.near_vectors(df).collect()}
    data = df.select("vec_id", "embedding").collect()
    ok = brute([r[0] for r in data], [r[1] for r in data])
    want = {r[0]: int(k.sum()) - 1 for r, k in zip(data, ok)}
    assert sorted(got) == sorted(want)
    assert all(got[i]["n_links"] <= want[i] for i in want)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(want.values())
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_groups_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 7)
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(40, 16))
    vecs = [(base[i % 40] + 0.05 * rnd.normal(size=16)).tolist() for i in range(200)] + [base[0].tolist()] * 30
    ids = [int(i) for i in rnd.permutation(1000)[:230]]
    got = {r["vec_id"]: r for r in P.near_vectors(rows_of(spark, ids, vecs).repartition(4)).collect()}
    ok = brute(ids, [np.float32(v) for v in vecs])
    have, want = sum(r["n_links"] for r in got.values()), int(ok.sum()) - len(ids)
    assert 0.9 * want <= have <= want
    label = list(range(230))
    for _ in range(230):
        new = [min(label[j] for j in np.flatnonzero(ok[i])) for i in range(230)]
        if new == label:
            break
        label = new
    comp = {}
    for i, l in zip(ids, label):
        comp[l] = min(i, comp.get(l, i))
    assert np.mean([got[i]["component_id"] == comp[l] for i, l in zip(ids, label)]) > 0.95


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vecs = [None, [], [0.0, 0.0], [1.0, nan], [inf, 1.0], [1.0, None], [1.0, 2.0], [2.0, 4.0], [1.0, 2.0], [1.0, 2.0, 0.0], [1e38, 2e38], [-1.0, -2.0]]
    ids = list(range(len(vecs)))
    ids[8] = 6
    got = P.near_vectors(rows_of(spark, ids + [None], vecs + [[1.0, 2.0]])).collect()
    by = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert len(got) == 13
    assert {(i, 0, i, True) for i in (0, 1, 2, 3, 4, 5, 9, 11)} <= by and (None, 0, None, False) in by
    assert {(6, 3, 6, True), (7, 3, 6, False), (10, 3, 6, False)} <= by
    assert P.near_vectors(rows_of(spark, [], [])).count() == 0


@pytest.mark.parametrize("count", [150, 474, 1500, 4096])
def test_recall_with_the_pivots_of_large_tables(spark, monkeypatch, count):
    rnd = np.random.default_rng(count)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    pivots = unit(rnd.normal(size=(count, 64)))
    monkeypatch.setattr(P, "choose_pivots", lambda reps, n: {64: pivots})
    a, g = unit(rnd.normal(size=(1500, 64))), rnd.normal(size=(1500, 64))
    g = unit(g - (g * a).sum(axis=1, keepdims=True) * a)
    cos = rnd.uniform(0.9001, 0.92, size=(1500, 1))
    vecs = np.concatenate([a, cos * a + np.sqrt(1 - cos ** 2) * g]).astype(np.float32).tolist()
    ids = list(range(3000))
    want = int(brute(ids, vecs).sum()) - 3000
    have = sum(r["n_links"] for r in P.near_vectors(rows_of(spark, ids, vecs).repartition(4)).collect())
    assert want >= 3000 and 0.985 * want <= have <= want
