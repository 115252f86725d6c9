import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder(open(PATH, encoding="utf-8").read())


TEXTS = ["Hello World's  it's we'LL 123 4a5 *** ÀÉß ÿ!", "", "<|endoftext|> a <| b", "東京 ﬁ İstanbul Σας", "á b\x1c c d ²x ª",
         "x" * 5000 + " " + "é" * 300, "tab\tnew\nline\rret 'S 'd"]


def test_ids_equal_the_tokenizer(encoder):
    docs = TEXTS + [r[0] for r in __import__("duckdb").connect().execute(
        "select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    for _ in range(2):
        got = encoder.encode(docs)
        assert all(g.tolist() == encoder.whole.encode(t, add_special_tokens=False).ids for g, t in zip(got, docs))


@settings(max_examples=200, deadline=None)
@given(t=st.text(alphabet="aZé'sldr e0.,<|*\ńİß²", max_size=40))
def test_ids_equal_on_odd_texts(encoder, t):
    assert encoder.encode([t])[0].tolist() == encoder.whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed,size", [(0, 2048), (1, 2048), (2, 64), (3, 50)])
def test_plan_holds_every_piece(seed, size):
    rnd = np.random.default_rng(seed)
    lengths = np.minimum(size, 1 + (rnd.lognormal(np.log(size / 5), 1, 4000)).astype(int))
    hist = np.bincount(lengths, minlength=size + 1)
    groups = packing.plan(hist, size)
    back = np.zeros(size + 1, int)
    for c, p in groups:
        assert c > 0 and sum(p) <= size
        np.add.at(back, list(p), c)
    assert (back == hist).all()
    assert sum(c for c, _ in groups) <= 1.02 * -(-int(lengths.sum()) // size) + 2


def test_nnls_matches_conditions():
    rnd = np.random.default_rng(5)
    a, b = rnd.random((20, 60)), rnd.random(20) * 5
    x = packing.nnls(a, b)
    g = a.T @ (b - a @ x)
    assert (x >= 0).all() and g.max() < 1e-6 and abs(g[x > 0]).max() < 1e-6


def test_pack_rows(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["the", "cat", "zebra", "Ünder"]) for _ in range(rnd.choice([0, 3, 40, 300, 900]))) for _ in range(200)]
    rows = [(i, t, 5, "z") for i, t in enumerate(texts)] + [(None, None, 1, ""), (3, texts[3], 1, ""), (900, "word " * 5000, 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, rank string").repartition(4)
    got = packing.pack(df, PATH, keep_ids=True).collect()
    enc = packing.WordEncoder(open(PATH, encoding="utf-8").read())
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.array(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"] and r["start"] == 2048 * r["piece"]
        seqs[r["sequence_id"]].append(r)
        docs[r["doc_id"]].append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    for i in (0, 1, 2, 900):
        want = enc.whole.encode(rows[i][1] if i < 900 else rows[-1][1], add_special_tokens=False).ids + [0]
        assert sum((r["ids"] for r in sorted(docs[i], key=lambda r: r["piece"])), []) == want
    assert len(docs[3]) == 2 * len([r for r in docs[3] if r["piece"] == 0]) // 2 and docs[None][0]["length"] == 1
    rooms = []                          # first fit, longest first
    for n in sorted((r["length"] for r in got), reverse=True):
        i = next((i for i, room in enumerate(rooms) if room >= n), len(rooms))
        rooms[i:i + 1] = [(rooms[i] if i < len(rooms) else 2048) - n]
    assert len(seqs) <= len(rooms) + 1
    assert packing.pack(df.where("false"), PATH).count() == 0


def test_words_and_texts_share_one_vocabulary(encoder):
    from tokenizers import Tokenizer
    assert sum(isinstance(v, Tokenizer) for v in vars(encoder).values()) == 1       # two took 50 MB of each worker
    spec = Tokenizer.from_file(PATH)
    texts = ["plain words", "odd 中文 text", "new plainer words", "odd 中文 text"]
    assert [g.tolist() for g in encoder.encode(texts)] == [spec.encode(t, add_special_tokens=False).ids for t in texts]
