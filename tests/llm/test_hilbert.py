import itertools
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import hilbert


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (3, 1)])
def test_curve_visits_every_cell_once_by_unit_steps(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(dims)))
    got = df.withColumn("h", hilbert.hilbert_index([F.col(f"c{i}") for i in range(dims)], bits)).collect()
    path = [tuple(r[:dims]) for r in sorted(got, key=lambda r: r["h"])]
    assert sorted(r["h"] for r in got) == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


def test_shards_are_even_and_slots_gapless(spark):
    rows = [(i % 90, "x" * (i * 7 % 50) if i % 11 else None, ("en", "de", None)[i % 3], f"src{i % 5}", 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, slot int")
    got = hilbert.shard_documents(df).collect()
    n = Counter(r["shard"] for r in got)
    assert len(got) == 1000 and set(n) == set(range(24)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        mine = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(n[s]))
    last = [r["curve"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert last == sorted(last)
    texts = [r[1] or "" for r in rows]
    assert Counter((r["size"], r["text_crc32"]) for r in got) == Counter((len(t) + 8, zlib.crc32(t.encode())) for t in texts)


def test_empty_null_id_and_files(spark, scratch):
    schema = "doc_id long, text string, lang string, source string"
    assert hilbert.shard_documents(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, None, None, None), (1, "a", "en", "s"), (1, "a", "en", "s")], schema)
    assert Counter(r["shard"] for r in hilbert.shard_documents(df).collect()) == {0: 1, 8: 1, 16: 1}
    docs = spark.createDataFrame([(i, "t", "en", f"s{i % 3}") for i in range(60)], schema)
    hilbert.write_shards(docs, hilbert.shard_documents(docs, shards=4), scratch + "/out")
    assert spark.read.parquet(scratch + "/out").groupBy("shard").count().where("count = 15").count() == 4


def test_files_hold_null_and_repeated_ids_once(spark, scratch):
    schema = "doc_id long, text string, lang string, source string"
    rows = [(i % 20 if i % 3 else None, ("a", "b", None, "")[i // 7 % 4], ("en", None)[i % 2], (None, "en")[i % 2]) for i in range(300)]
    docs = spark.createDataFrame(rows, schema).repartition(5)
    hilbert.write_shards(docs, hilbert.shard_documents(docs, shards=4), scratch + "/out")
    got = spark.read.parquet(scratch + "/out").collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(75))


def test_sources_with_a_long_common_beginning_get_steps_of_their_own(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "t", "en", f"https://example.org/{i % 8}") for i in range(160)], "doc_id long, text string, lang string, source string")
    by = lambda: {(r["source"], r["curve"]) for r in docs.join(hilbert.shard_documents(docs, shards=4), "doc_id").collect()}
    assert len(by()) == 8 == len({c for _, c in by()})
    monkeypatch.setattr(hilbert, "ACCURACY", 5)
    assert len({c for _, c in by()}) >= 6
