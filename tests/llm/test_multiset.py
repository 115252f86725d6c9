import hashlib

from pyspark.sql import functions as F

from quire.llm import multiset

SCHEMA = "doc_id long, text string, digest string, k long"


def run(spark, texts, ids=None):
    ids = ids or range(len(texts))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], SCHEMA)
    return sorted(multiset.fingerprint_documents(df).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))


def test_edited_texts_and_likeness(spark):
    texts = [" ".join(f"w{(i * 37 + j * (i + 3)) % 9973}" for j in range(120 + 40 * i)).replace("7 ", "7\n") for i in range(9)]
    got = run(spark, texts, [3 * i for i in range(9)])
    assert [r["doc_id"] for r in got] == [3 * i for i in range(9)]
    for i, r in enumerate(got):
        t, nxt = texts[i], texts[(i + 1) % 9]
        q = len(t) // 4
        edited = t[:len(t) - q] + nxt[:q]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0.45 < r["near_edited"] < 0.97 and 0 <= r["near_next"] < 0.45
    assert len({r["fingerprint"] for r in got}) == 9


def test_homomorphism_and_order(spark):
    df = spark.createDataFrame([(1, "a b\nc d e\nf"), (2, "f\na b\nc d e"), (3, "a b\nf"), (4, "c d e")], "id long, x string")
    got = {r["id"]: r for r in multiset.fingerprints(df, ["id"], "x").collect()}
    assert got[1]["digest"] == got[2]["digest"] and got[1]["lanes"] == got[2]["lanes"] != got[3]["lanes"]
    p = spark.createDataFrame([(got[1]["digest"], got[3]["digest"], got[4]["digest"])], "a array<long>, b array<long>, c array<long>")
    r = p.select(multiset.add(F.col("b"), F.col("c")), multiset.subtract(F.col("a"), F.col("c"))).first()
    assert r[0] == got[1]["digest"] and r[1] == got[3]["digest"]


def test_null_empty_equal_long_and_repeated_rows(spark):
    long = "é😀 word\n" * 30000
    got = run(spark, [None, "", "same text here", "same text here", long, "z"], [None, 1, 2, 2, 5, 9])
    assert [r["n_chars"] for r in got] == [0, 0, 14, 14, len(long), 1]
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[2]["fingerprint"] == got[3]["fingerprint"]
    q = len(long) // 4
    assert got[4]["edited_sha256"] == hashlib.sha256((long[:-q] + "z").encode()).hexdigest()
    assert got[5]["edited_sha256"] == hashlib.sha256(b"z").hexdigest() and got[5]["near_edited"] == 1
    one = run(spark, ["abcd efgh"], [7])[0]
    assert one["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest() and one["near_next"] == 1
    assert run(spark, []) == []


def test_likeness_of_a_long_repetitive_text(spark):
    """More than 46,341 equal word pairs in one lane: the products need more than 32 bits."""
    docs = spark.createDataFrame([(1, "a " * 90_000), (2, "a " * 90_000), (3, "b c d")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in multiset.fingerprint_documents(docs).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[1]["near_next"] == 1.0 and got[2]["near_next"] < 0.2
