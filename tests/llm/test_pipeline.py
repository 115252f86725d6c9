import re
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from quire.llm import packing, pii, quality
from test_ngram_join import brute as near
from test_packing import PATH
from test_substring import _removed

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in quality.score_documents(docs, labels).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    first = {d for d, _, c in near(rows) if d == c}
    rows = _removed([(d, t) for d, t in rows if d in first], 13)
    a = pii.automaton()
    rows = [(d, pii._redacted(t, pii.spans_of(t, a))) for d, t in rows]
    enc = packing.WordEncoder(open(PATH, encoding="utf-8").read())
    want = {(d, len(enc.whole.encode(t, add_special_tokens=False).ids) + 1) for d, t in rows}
    got, seqs = defaultdict(int), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] += r["length"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(got.items()) == want and 0 < len(got) < docs.count()
    for s in seqs.values():
        ends = 0
        for at, n in sorted(s):
            assert at == ends
            ends += n
        assert ends <= 2048


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    rows = [(1, "a b c d e f", None, "s", 3, "x"), (1, "a b c d e f", None, "s", 3, "x"), (2, "a b c d e f", "en", None, None, "x"),
            (3, None, None, None, None, None), (None, "a@b.co", "en", "s", 6, "x"), (4, "", "en", "s", 0, "x")]
    df = spark.createDataFrame(rows, schema)
    for data, n in ((df, 4), (df.where("false"), 0)):
        out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, data, SF)
        assert out.columns == df.columns and out.count() == n
        for name in ("substring", "pii"):
            out = dict(corpus_pipeline.STAGES)[name](spark, out, SF)
            assert out.columns == df.columns and out.count() == n
        assert out.where("text = '<EMAIL>' and n_chars = 7").count() == (n > 0)
        assert dict(corpus_pipeline.STAGES)["quality"](spark, data, SF).columns == df.columns
        assert dict(corpus_pipeline.STAGES)["packing"](spark, out, SF).count() == n


def test_stages_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substring", "pii", "packing"]
