import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import toxicity as T

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]


@pytest.fixture(scope="module")
def model(tables):
    return T.fit(*tables)


def plain_hits(folded, model):
    """Every word against every entry; words inside exception phrases do not count."""
    words = folded.split()
    free = set()
    for e in model.exceptions:
        p = e.split()
        for k in range(len(words) - len(p) + 1):
            if words[k:k + len(p)] == p:
                free.update(range(k, k + len(p)))
    out = {}
    for k, w in enumerate(words):
        if k not in free:
            best = max([v for e, v in model.entries.items() if (e == f" {w} " if e.endswith(" ") else f" {w} ".startswith(e))], default=0)
            if best:
                out[k] = best
    return out


def test_held_out(spark, tables):
    docs, labels = tables
    got = {r["doc_id"]: r for r in T.score_documents(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[r["doc_id"]], r["toxic"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([r["predicted"] == y for r, y in held]) > 0.97
    toxic, clean = ([r["score"] for r, y in held if y == k] for k in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.95 and np.mean([s >= 0.5 for s in clean]) < 0.005


def test_hits_equal_a_plain_search(tables, model):
    a = model.automaton()
    some = [r["text"] for r in tables[0].where("doc_id % 50 = 7").select("text").collect()]
    found = 0
    for t in some:
        folded = T.fold(t)
        got = {f" {folded}".count(" ", 0, at): w for at, w in T.hits(folded, a).items()}
        assert got == plain_hits(folded, model)
        found += len(got)
    assert found > 20


def test_lexicon_counts_equal_a_plain_loop(spark):
    texts = [(1, "bad word bad"), (0, "good word"), (1, "badly"), (0, None), (1, "")]
    df = spark.createDataFrame([(y, t or "") for y, t in texts], "y int, text string").repartition(3)
    got = {r["term"]: (r["toxic"], r["clean"]) for r in T._document_counts(df, lambda: T._candidates).collect()}
    want = {}
    for y, t in texts:
        for c in T._candidates(T.fold(t)) | {""}:
            want[c] = tuple(np.add(want.get(c, (0, 0)), (y, 1 - y)))
    assert got == want and got[""] == (3, 2) and got[" bad "] == (1, 0) and got[" badi"] == (1, 0)


def test_disguises_fold_to_the_word():
    plain = T.fold("idiot")
    for t in ("1D10T", "idi​ot", "ｉｄｉｏｔ", "іdіоt", "ídïöt", "id!ot".replace("!", "1"), "IDIOT!!", "𝐢𝐝𝐢𝐨𝐭", "ldlot"):
        assert T.fold(t) == plain, t
    assert T.fold("tr@sh $1 5070 lo$er") == "trash ioser" and T.fold("5cum") == "scum" and T.fold(None) == ""
    assert T.word_places("áb  1d1ot, 77 x") == [(0, 3), (5, 10), (15, 16)]


def test_exceptions_and_spans(spark):
    m = T.Model({" trash ": 5.0, " scu": 3.0}, ("trash can", "scuba"), [1.0, 1.0, 0.0, -3.0])
    df = spark.createDataFrame([("Trash, can",), ("a TR4SH can​, trash scum scuba!",), (None,), ("",)], "text string")
    got = [r["s"] for r in df.select(T.toxic_spans(F.col("text"), m).alias("s")).collect()]
    assert [[(x["start"], x["end"], x["weight"]) for x in s] for s in got] == [[], [(14, 19, 5.0), (20, 24, 3.0)], [], []]
    a = m.automaton()
    assert T.features("trash scum", a) == [math.log1p(8), math.log1p(800 / 12), math.log1p(2)]
    assert T.features("trash can", a)[0] == 0


def test_learnt_exception(spark):
    rows = [(i, "you vile fool", 1) for i in range(60)] + [(i, "the fool moon rises" if i % 2 else "plain day", 0) for i in range(60, 400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    m = T.fit(docs, labels)
    assert " viie " in m.entries
    score = {r["doc_id"]: r["score"] for r in T.score_documents(docs, labels).collect()}
    assert min(score[i] for i in range(60)) > 0.5 > max(score[i] for i in range(60, 400))


def test_odd_rows_and_no_labels(spark, model, tables):
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (None, "idiot " * 200_000, "q"), (1, None, "q"), (3, "x" * 2_000_000, "q")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (77, 1, 0)], "doc_id long, toxic int, quality int")
    got = T.score_documents(docs, labels).collect()
    assert len(got) == 5 and {r["score"] for r in got} == {0.0} and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert T.score_documents(docs.where("false"), labels).count() == 0
    s = {(r["doc_id"], len(r["text"] or "")): r["v"] for r in docs.select("doc_id", "text", T.scored(F.col("text"), model).alias("v")).collect()}
    assert s[None, 1_200_000] > 0.5 > s[3, 2_000_000] and s[1, 0] == s[2, 0] < 0.5
