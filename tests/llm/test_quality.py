import zlib

import numpy as np
import pyarrow as pa

from quire.llm import hashing as H
from quire.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.score_documents(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.93
    good, bad = ([r["score"] for r, q in held if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_context_sums_equal_a_plain_loop(spark):
    texts = ["a b c, d a", "", None, "x", "b!! a\nc"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    index, want = quality.index_vectors().astype(int), np.zeros((quality.BUCKETS, quality.DIM), int)
    for t in texts:
        h = quality._buckets(H.words(pa.array([t or ""]), H.SHAPED)[0])
        for i in range(len(h)):
            for j in range(max(0, i - 2), min(len(h), i + 3)):
                if i != j:
                    want[h[i]] += index[h[j]]
    assert (quality.context_sums(df) == want).all()


def test_gradient_training_separates_and_calibrates():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(4000, 10))
    y = (x[:, 0] * x[:, 1] + 0.3 * rnd.normal(size=4000) > 0).astype(int)
    cal = np.arange(4000) % 3 == 0
    net = quality.train(x, y, cal)
    best = np.mean((x[cal, 0] * x[cal, 1] > 0) == y[cal])           # what the noise allows
    assert np.mean((net.score(x[cal]) > 0.5) == y[cal]) > best - 0.05
    z = net.logits(x[cal])
    assert quality._nll(z, y[cal], net.temperature) <= quality._nll(z, y[cal], 1.0) + 1e-9


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (None, "word " * 60000, "q"), (1, None, "q")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == 4 and {r["score"] for r in got} == {0.5} and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert quality.score_documents(docs.where("false"), labels).count() == 0
    assert set(quality.keep_good(docs, labels).columns) == {"doc_id", "text", "score"}


def test_short_chunks_keep_short_tables(monkeypatch):
    import pyarrow as pa

    from quire.llm import hashing as H
    monkeypatch.setattr(H, "_powers", {"n": 0})
    few = H.words(pa.array(["some words of a text"]))[0]
    assert len(H._powers["up"]) < 100                   # were 32 MB a worker whatever the chunk
    H.words(pa.array(["w " * 5000]))
    assert (H.words(pa.array(["some words of a text"]))[0] == few).all() and len(H._powers["up"]) >= 10_001
