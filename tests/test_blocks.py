"""Lookups by blocks of rows: the same as in place, whatever the block size."""
import math

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from conftest import SF001
from quire.operators import blocks as B, encode as ENC, lm as LM, vocab as V


def test_blocks_of_any_size_answer_alike(spark):
    rows = [(i, [f"w{(i * j) % 7}" for j in range(i % 9)], "x") for i in range(60)] + [(None, None, "n"), (None, [], "e"), (3, [None, "w1"], "t")]
    df = spark.createDataFrame(rows, "k long, tokens array<string>, _ids string").repartition(3)
    known = spark.createDataFrame([(f"w{i}", i) for i in range(5)], "_element string, _value int")
    want = sorted([(k, n, [int(t[1:]) if t and int(t[1:]) < 5 else None for t in ts or []]) for k, ts, n in rows], key=repr)
    for size in (1, 5, 1 << 20):
        got = B.look_up(df, "tokens", lambda a: a.join(known, "_element"), "v", IntegerType(), size)
        assert got.columns == ["k", "tokens", "_ids", "v"]
        assert sorted([(r.k, r["_ids"], r.v) for r in got.collect()], key=repr) == want
    assert B.look_up(df.where("false"), "tokens", lambda a: a.join(known, "_element"), "v", IntegerType()).count() == 0
    assert B.blocked(df, "tokens", 5).groupBy("_block").agg(F.sum(F.size("tokens")).alias("n")).agg(F.max("n")).first()[0] <= 12


def test_a_vocabulary_beyond_the_limit_is_joined(spark, monkeypatch):
    d = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    d = d.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "zzzz <|S|> unseenword")], d.schema))
    vocab = V.word_vocab(d.where("doc_id >= 0"), limit=500).cache()
    rows = lambda df: sorted([tuple(r) for r in df.collect()], key=repr)
    enc = ENC.word_encode_ids(d, ["doc_id"], "text", vocab).cache()
    ids, texts = rows(enc), rows(ENC.decode_joined(enc, ["doc_id"], "ids", vocab))
    assert len(ids) == d.count() and texts[0][1] is not None
    monkeypatch.setattr(ENC, "MAX_LOOKUP", 10)
    assert rows(ENC.word_encode_ids(d, ["doc_id"], "text", vocab)) == ids
    assert rows(ENC.decode_joined(enc, ["doc_id"], "ids", vocab)) == texts


def test_cross_entropy_equals_a_plain_loop(spark):
    docs = [(1, [3, 4, 3, 4, 5]), (2, [5]), (3, []), (4, [9, 9, 9]), (4, [3, 4]), (None, [4, 3]), (None, [4, 3])]
    df = spark.createDataFrame(docs, "doc_id long, ids array<int>").repartition(2)
    counts = LM.fit_bigram(df.where("doc_id = 1"), ["doc_id"])
    c, ctx = {}, {}
    for w, nx in zip(docs[0][1], docs[0][1][1:]):
        c[w, nx], ctx[w] = c.get((w, nx), 0) + 1, ctx.get(w, 0) + 1
    want = []
    for k, ids in docs:
        loss = [-math.log((c.get(p, 0) + 1) / (ctx.get(p[0], 0) + 10)) for p in zip(ids, ids[1:])]
        want.append((k, len(loss), round(sum(loss) / len(loss), 9) if loss else None))
    got = [(r.doc_id, r.n_bigrams, r.cross_entropy and round(r.cross_entropy, 9)) for r in LM.cross_entropy(df, ["doc_id"], counts, 10).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_projection_by_blocks_equals_the_product(spark, monkeypatch):
    """Any edge, weights left out of the table, null vectors, clashing names, repeated and no rows."""
    import numpy as np
    import pytest
    from quire.operators import vectors as VEC
    rng = np.random.default_rng(3)
    x, w, b = rng.normal(size=(23, 11)), rng.normal(size=(11, 7)), rng.normal(size=7)
    w[4:8, 3:6] = 0
    rows = [(i, [float(v) for v in r], f"r{i}") for i, r in enumerate(x)] + [(0, [float(v) for v in x[0]], "r0"), (99, None, None), (None, None, "n")]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, _w string").repartition(3)
    weight = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(11) for j in range(7) if w[i, j]], "i int, j int, w double")
    bias = spark.createDataFrame([(j, float(b[j])) for j in range(7)], "j int, b double")

    def result(y):
        assert y.columns == ["vec_id", "v", "_w", "projected"]
        return sorted([(r.vec_id, r["_w"], r.projected and [round(e, 9) for e in r.projected]) for r in y.collect()], key=repr)
    for use, offset in ((bias, b), (None, 0 * b)):
        want = sorted([(k, n, v and [round(float(e), 9) for e in np.array(v) @ w + offset]) for k, v, n in rows], key=repr)
        assert result(VEC.project(df, "v", weight, use)) == want
        for edge in (3, 1024):
            assert result(VEC.linear_blocks(df, "v", weight, use, edge=edge)) == want
    monkeypatch.setattr(VEC, "BLOCK_NUMBERS", 20)
    monkeypatch.setattr(VEC, "MAX_WEIGHTS", 1)
    assert result(VEC.project(df, "v", weight)) == want
    assert VEC.project(df.where("false"), "v", weight).count() == 0
    with pytest.raises(Exception, match="11 weights a column"):
        VEC.linear_blocks(df.withColumn("v", F.slice("v", 1, 3)), "v", weight).collect()


def test_batches_are_cut_by_elements(monkeypatch):
    """An in-place lookup works on bounded slices of a batch; a longer row stands alone."""
    import pyarrow as pa
    from quire.operators import blocks as BL
    monkeypatch.setattr(BL, "CHUNK_ELEMENTS", 4)
    lists = pa.array([[1, 2], [3], None, [4, 5], [], [6] * 9, [7]])
    assert [c.to_pylist() for c in BL.list_chunks(lists)] == [[[1, 2], [3], None], [[4, 5], []], [[6] * 9], [[7]]]
    assert list(BL.pieces_of(pa.array([], pa.int32()), 4)) == []


def test_elements_are_answered_without_a_shuffle_for_distinct_ones(spark):
    from pyspark.sql import functions as F
    from pyspark.sql.types import LongType
    from quire.operators import blocks as BL
    rows = spark.createDataFrame([(k, [k % 3, 7, k % 3]) for k in range(50)], "k long, e array<long>").repartition(2)
    plans = []

    def answer(asked):
        plans.append(asked._jdf.queryExecution().executedPlan().toString())
        return asked.withColumn("_value", F.col("_element") * 10)
    got = BL.look_up(rows, "e", answer, "v", LongType(), size=20).collect()
    assert sorted((r.k, r.v) for r in got) == [(k, [k % 3 * 10, 70, k % 3 * 10]) for k in range(50)]
    assert "Exchange" not in plans[0]
