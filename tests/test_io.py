"""Sources and sinks: round trips through temporary folders."""
import os

import numpy as np

S_, E_ = "<|S|>", "<|E|>"


def test_corpus_dir_segment_split_roundtrip(spark, scratch):
    from quire.operators import segment as SEG, split as SPL
    from quire.sources import corpus as CO
    d = os.path.join(scratch, "raw")
    os.makedirs(d)
    texts = {"a.txt": "T\n\na\nb\nc\n\nd", "b.txt": "x\r\ny\r\nz\n\nw", "c_segmented.txt": "skip",
             "notes.md": "ignored"}
    for n, t in texts.items():
        with open(os.path.join(d, n), "w", newline="") as f:
            f.write(t)
    df = CO.read_corpus_dir(spark, d)
    assert sorted(r.file_name for r in df.collect()) == ["a.txt", "b.txt"]
    marked = SEG.mark_segments(df)
    CO.write_segmented(marked, os.path.join(scratch, "seg"))
    back = {r.file_name: r.text for r in spark.read.parquet(os.path.join(scratch, "seg")).collect()}
    assert back["a_segmented.txt"] == f"{S_}\nT\n\na\nb\nc\n{E_}\n{S_}\nd\n{E_}\n"
    assert back["b_segmented.txt"] == f"{S_}\nx\ny\nz\n{E_}\n{S_}\nw\n{E_}\n"
    segs = SEG.load_segments(marked, "file_name")
    sp = SPL.exact_split(segs, ["file_name", "seg_id"])
    CO.write_splits(sp, os.path.join(scratch, "splits"))
    r = CO.read_splits(spark, os.path.join(scratch, "splits"), ["train"])
    assert r.count() == 3          # 4 segments: floor(3.2) train, floor(0.4) val, 1 test
    assert "PartitionFilters: [" in (plan := r._jdf.queryExecution().executedPlan().toString())
    assert "split" in plan.split("PartitionFilters: [")[1].split("]")[0]
    named = os.path.join(scratch, "named")
    CO.write_corpus_dir(spark.createDataFrame([(7, "a\nb"), (8, "c")], "k long, t string"), named, "k", "t")
    assert {r.file_name: r.text.strip() for r in CO.read_corpus_dir(spark, named).collect()} == {"7.txt": "a\nb", "8.txt": "c"}


def test_exact_split_sizes(spark):
    from quire.operators import split as SPL
    for n, want in [(10, (8, 1, 1)), (9, (7, 0, 2)), (1, (0, 0, 1))]:
        df = spark.range(n).withColumnRenamed("id", "k")
        got = {r.split: r.n_rows for r in SPL.split_sizes(SPL.exact_split(df, ["k"])).collect()}
        assert (got.get("train", 0), got.get("val", 0), got.get("test", 0)) == want


def test_bucketed_split_equals_global_rank(spark):
    from pyspark.sql import Window, functions as F
    from quire.operators import split as SPL
    df = spark.range(20000).withColumnRenamed("id", "k")
    got = SPL.exact_split(df, ["k"])
    h = SPL.shuffle_key(["k"])
    w = Window.orderBy(h, "k")
    n = 20000
    ref = (df.withColumn("r", F.row_number().over(w) - 1)
             .withColumn("split", F.when(F.col("r") < int(n * 0.8), "train")
                         .when(F.col("r") < int(n * 0.8) + int(n * 0.1), "val").otherwise("test")))
    a = dict((r.k, r.split) for r in got.collect())
    b = dict((r.k, r.split) for r in ref.collect())
    assert a == b


def test_token_stream_roundtrip_and_legacy_bins(spark, scratch):
    from quire.sources import tokens as TK
    docs = [("train", 0, 700), ("train", 700, 0), ("train", 700, 9300), ("val", 0, 50)]
    rows = [(s, o, [(i * 7) % 500 for i in range(o, o + n)]) for s, o, n in docs]
    stream = spark.createDataFrame(rows, "split string, offset long, ids array<int>")
    TK.write_token_stream(stream, os.path.join(scratch, "tok"), chunk=1000)
    back = TK.read_token_stream(spark, os.path.join(scratch, "tok"), "train")
    got = sorted((r.offset, list(r.ids)) for r in back.collect())
    assert got == [(p, [(i * 7) % 500 for i in range(p, p + 1000)]) for p in range(0, 10000, 1000)]
    bins = os.path.join(scratch, "bins")
    os.makedirs(bins)
    np.array([5, 6, 65535, 2], dtype=np.uint16).tofile(os.path.join(bins, "val.bin"))
    imp = TK.import_uint16_bins(spark, bins, chunk=3).collect()
    assert sorted((r.start, list(r.ids)) for r in imp) == [(0, [5, 6, 65535]), (3, [2])]


def test_legacy_files_are_read_in_ranges(spark, scratch):
    import numpy as np
    import pytest
    from quire.sources import tokens as TK
    bins = os.path.join(scratch, "bins")
    os.makedirs(bins)
    ids = {s: np.random.default_rng(k).integers(0, 65536, n).astype("<u2") for k, (s, n) in enumerate([("train", 100_003), ("val", 64), ("test", 0)])}
    for s, a in ids.items():
        a.tofile(os.path.join(bins, f"{s}.bin"))
    df = TK.import_uint16_bins(spark, bins, chunk=32, task_bytes=10_000)
    assert df.rdd.getNumPartitions() >= 20
    rows = sorted((r.split, r.start, list(r.ids)) for r in df.collect())
    for s, a in ids.items():
        mine = [(start, x) for t, start, x in rows if t == s]
        assert [start for start, _ in mine] == list(range(0, len(a), 32)) and [i for _, x in mine for i in x] == a.tolist()
    large = os.path.join(scratch, "large")
    os.makedirs(large)
    with open(os.path.join(large, "train.bin"), "wb") as f:
        f.truncate(3 << 30)                                   # sparse: 3 GB
    assert TK.import_uint16_bins(spark, large).rdd.getNumPartitions() == 48
    open(os.path.join(bins, "odd.bin"), "wb").write(b"abc")
    with pytest.raises(Exception, match="16-bit"):
        TK.import_uint16_bins(spark, bins).count()


def test_bpe_tables_roundtrip(spark, scratch):
    from quire.operators.bpe import BpeModel
    from quire.sources import tokens as TK
    m = BpeModel(["<|S|>", "<|E|>"], [b"<|S|>", b"<|E|>", b"a", b"b", b"ab"], [(2, 3, 4)])
    TK.save_bpe(m, spark, os.path.join(scratch, "bpe"))
    m2 = TK.load_bpe(spark, os.path.join(scratch, "bpe"))
    assert (m2.specials, m2.tokens, m2.merges) == (m.specials, m.tokens, m.merges)


def test_segment_stream(spark, scratch):
    from quire.streaming.corpus_stream import segment_stream
    d = os.path.join(scratch, "in")
    os.makedirs(d)
    with open(os.path.join(d, "p.txt"), "w") as f:
        f.write("a\nb\nc\n\nd")
    q = segment_stream(spark, d, os.path.join(scratch, "out"), os.path.join(scratch, "ck"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(scratch, "out")).collect()
    assert [(r.file_name, r.segmented) for r in out] == [
        ("p_segmented.txt", f"{S_}\na\nb\nc\n{E_}\n{S_}\nd\n{E_}\n")]


def _stream(spark, sizes, base=0):
    """Documents of the given sizes one after another; the id at position p is p mod 60000."""
    rows, at = [], base
    for n in sizes:
        rows.append(("train", at, [p % 60000 for p in range(at, at + n)]))
        at += n
    return spark.createDataFrame(rows, "split string, offset long, ids array<int>").repartition(3), at


def test_windows_keep_order_past_2_to_the_31(spark):
    import random
    from quire.operators import windows as WIN
    rnd = random.Random(1)
    for T_ in (4, 100, 256):
        base = (2 ** 31 // T_ - 3) * T_
        stream, end = _stream(spark, [rnd.choice([0, 1, 7, T_, 3 * T_ + 1]) for _ in range(12)] + [T_ + 3], base)
        got = WIN.packed_windows(stream, T_).collect()
        want = {}
        for p in range(base, end - 1):
            want.setdefault(p // T_, []).append(p)
        assert {r.win_id: (list(r.x), list(r.y), r.start, r.n) for r in got} == {
            w: ([p % 60000 for p in ps], [(p + 1) % 60000 for p in ps], w * T_, len(ps)) for w, ps in want.items()}
        starts = sorted({rnd.randrange(base, end - T_) for _ in range(20)} | {base, end - T_ - 1})
        st = spark.createDataFrame([("train", i, 0, s) for i, s in enumerate(starts)], "split string, win_id long, batch long, start long")
        for r in WIN.gather_windows(stream, st, T_).collect():
            assert list(r.x) == [p % 60000 for p in range(r.start, r.start + T_)]
            assert list(r.y) == [p % 60000 for p in range(r.start + 1, r.start + T_ + 1)]


def test_short_split_raises_and_tail_is_kept(spark):
    import pytest
    from quire.operators import windows as WIN
    stream, _ = _stream(spark, [6, 4])
    w = {r.win_id: (list(r.x), list(r.y)) for r in WIN.packed_windows(stream, 4).collect()}
    assert w == {0: ([0, 1, 2, 3], [1, 2, 3, 4]), 1: ([4, 5, 6, 7], [5, 6, 7, 8]), 2: ([8], [9])}
    with pytest.raises(Exception, match="no window of 16 tokens"):
        WIN.window_starts(WIN.stream_sizes(stream), 3, 16).collect()


def test_prompts(spark):
    import pytest
    from pyspark.sql import functions as F
    from quire.operators import encode as ENC
    df = spark.createDataFrame([(1, [5, 6]), (2, []), (3, list(range(10, 20))), (4, [7] * 8)], "k int, ids array<int>")
    got = {r.k: [list(w) for w in r.w] for r in df.select("k", ENC.prompt_windows(F.col("ids"), 4).alias("w")).collect()}
    assert got == {1: [[2, 2, 5, 6]], 2: [[2, 2, 2, 2]], 3: [[2, 2, 10, 11], [12, 13, 14, 15], [16, 17, 18, 19]], 4: [[7] * 4] * 2}
    one = df.where("k = 1").select(ENC.left_pad(F.col("ids"), 4).alias("p")).first().p
    assert list(one) == [2, 2, 5, 6]
    with pytest.raises(Exception, match="longer than 4"):
        df.select(ENC.left_pad(F.col("ids"), 4)).collect()


def test_language_model_keeps_every_row(spark):
    from quire.operators import lm as LM
    docs = spark.createDataFrame([(1, [4, 5, 4, 5]), (2, [4]), (3, [])], "d int, ids array<int>")
    counts = LM.fit_bigram(docs, ["d"])
    ce = {r.d: (r.n_bigrams, r.cross_entropy is None) for r in LM.cross_entropy(docs, ["d"], counts, 10).collect()}
    assert ce == {1: (3, False), 2: (0, True), 3: (0, True)}
    prompts = spark.createDataFrame([(1, 4), (2, 99), (3, 5)], "d int, last int")
    got = {r.d: r.next_id for r in LM.next_token_draw(prompts, ["d"], "last", counts).collect()}
    assert got[1] == 5 and got[2] in (4, 5) and got[3] == 4


def test_bad_target_raises_and_missing_vector_is_reported(spark):
    import pytest
    from pyspark.sql import functions as F
    from quire.operators import vectors as V
    df = spark.createDataFrame([([0.1, 0.2], 2)], "v array<double>, t int")
    with pytest.raises(Exception, match="no score for target 2"):
        df.select(V.cross_entropy_row(F.col("v"), F.col("t"))).collect()
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "k int, v array<double>")
    q = spark.createDataFrame([(1, 0), (1, 9), (9, 0)], "i int, p int")
    assert sorted((r.i, r.p, r.vec) for r in V.lookup_add(q, "i", "p", table, "k", "v").collect()) == [
        (1, 0, [3.0]), (1, 9, None), (9, 0, None)]


def test_running_best_rule(spark):
    import datetime as dt
    from quire.operators import runs as R
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, i, t0 + dt.timedelta(hours=3 * i), float(v)) for i, v in enumerate([5, 6, 4, 4])]
    df = spark.createDataFrame(rows, "run long, k long, ts timestamp_ntz, loss double")
    got = R.run_scan(df, "run", "ts", "k", "loss").orderBy("k").collect()
    assert [r.is_best for r in got] == [True, False, True, False]
    assert [r.save_checkpoint for r in got] == [False, False, True, False]
    assert [r.iter for r in got] == [0, 1, 2, 3]
    assert [r.dt_ms for r in got] == [None, 3 * 3600 * 1000.0, 3 * 3600 * 1000.0, 3 * 3600 * 1000.0]


def test_clipped_cross_entropy_case(spark):
    import math
    from pyspark.sql import functions as F
    from quire.operators import vectors as V
    df = spark.createDataFrame([([0.2, 2.0], 1)], "logits array<double>, t int")
    got = df.select(V.cross_entropy_row(F.col("logits"), F.col("t")).alias("ce")).collect()[0].ce
    want = -math.log(math.exp(0.999999) / (math.exp(0.2) + math.exp(0.999999)))
    assert abs(got - want) < 1e-12


def test_token_sink_rejects_ids_outside_uint16(spark, scratch):
    import pytest
    from quire.sources import tokens as TK
    bad = spark.createDataFrame([("train", 0, [1, 70000])], "split string, offset long, ids array<int>")
    with pytest.raises(Exception):
        TK.write_token_stream(bad, os.path.join(scratch, "bad"))


def test_chunked_run_scan_equals_plain_window(spark):
    """A hot run cut into many tiny chunks gives the same iter / best / lag as one window."""
    import datetime as dt
    import random
    from pyspark.sql import Window, functions as F
    from quire.operators import runs as R
    random.seed(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(r, k, t0 + dt.timedelta(milliseconds=random.randint(0, 20000)), float(random.randint(0, 50)))
            for k, r in enumerate([0] * 300 + [1] * 40 + [2] * 5)]
    df = spark.createDataFrame(rows, "run long, k long, ts timestamp_ntz, loss double")
    got = R.run_scan(df, "run", "ts", "k", "loss", chunk_seconds=1)
    w = Window.partitionBy("run").orderBy("ts", "k")
    ref = (df.withColumn("iter", F.row_number().over(w) - 1)
             .withColumn("bb", F.coalesce(F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(1e9)))
             .withColumn("prev", F.lag("ts").over(w)))
    a = {r.k: (r.iter, r.best_before, r.prev_ts) for r in got.collect()}
    b = {r.k: (r.iter, r.bb, r.prev) for r in ref.collect()}
    assert a == b


def test_pieces_follow_the_rows(spark):
    """One-event runs, a long even run and a burst inside a run: no piece above the limit, few pieces, same scan."""
    import datetime as dt
    import random
    from pyspark.sql import Window, functions as F
    from quire.operators import runs as R
    rnd, t0 = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(r, t0 + dt.timedelta(days=r)) for r in range(500)]                                     # one event each
    rows += [(1000, t0 + dt.timedelta(hours=k)) for k in range(900)]                                 # 37 days, evenly
    rows += [(1001, t0 + dt.timedelta(days=k)) for k in range(30)]
    rows += [(1001, t0 + dt.timedelta(days=3, microseconds=rnd.randrange(200_000))) for _ in range(1500)]   # a burst
    rows += [(1002, t0 - dt.timedelta(days=20_000, seconds=k)) for k in range(40)]                   # before 1970
    data = [(r, k, t, float(rnd.randrange(50))) for k, (r, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "run long, k long, ts timestamp_ntz, loss double").repartition(4)
    sizes = R.time_pieces(df, "run", "ts", 50).groupBy("run", "_chunk").count().collect()
    assert sum(r["count"] for r in sizes) == len(rows) and max(r["count"] for r in sizes) <= 100
    assert sum(r["run"] < 1000 for r in sizes) == 500 and sum(r["run"] == 1002 for r in sizes) == 1
    got = R.run_scan(df, "run", "ts", "k", "loss", piece_rows=50)
    w = Window.partitionBy("run").orderBy("ts", "k")
    ref = (df.withColumn("iter", F.row_number().over(w) - 1).withColumn("prev", F.lag("ts").over(w))
             .withColumn("bb", F.coalesce(F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1e9))))
    assert {r.k: (r.iter, r.best_before, r.prev_ts) for r in got.collect()} == {r.k: (r.iter, r.bb, r.prev) for r in ref.collect()}


def test_corpus_dir_names_and_layouts(spark, scratch):
    from pyspark.sql import functions as F

    from quire.sources import corpus as CO
    rows = [("a", "one"), ("a", "one"), ("b/c: 100%+é", "x\r\ny"), ("", None), ("_d", "d"), ("=e", "e"), ("null", "n"), (None, "none")]
    df = spark.createDataFrame(rows, "k string, t string").coalesce(1)
    path = os.path.join(scratch, "own")
    CO.write_corpus_dir(df, path, "k", "t")
    # a folder per text is slow to write and costs a listing each
    assert [d for d, _, _ in os.walk(path)] == [path, os.path.join(path, "writer_task=0")]
    assert os.path.exists(os.path.join(path, "writer_task=0", "a.txt"))
    got = CO.read_corpus_dir(spark, path, skip_processed=False).collect()
    want = {"a.txt": "one\none\n", "b/c: 100%+é.txt": "x\ny\n", ".txt": "\n", "_d.txt": "d\n", "=e.txt": "e\n",
            "null.txt": "n\n", None: "none\n"}
    assert len(got) == len(want) and {r.file_name: r.text for r in got} == want
    # folders by name, as Spark's writer makes them
    other = os.path.join(scratch, "spark")
    named = df.select(F.concat("k", F.lit(".txt")).alias("file_name"), "t").where("k is null or k != 'b/c: 100%+é'")
    named.write.partitionBy("file_name").text(other)
    del want["b/c: 100%+é.txt"]
    assert {r.file_name: r.text for r in CO.read_corpus_dir(spark, other, skip_processed=False).collect()} == want
    CO.write_corpus_dir(df.limit(0), empty := os.path.join(scratch, "empty"), "k", "t")
    assert CO.read_corpus_dir(spark, empty).count() == 0
