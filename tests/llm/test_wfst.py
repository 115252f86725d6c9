import hashlib
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import wfst

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", "  two  spaces   three", "\n\nline\n", "東京タワー 😀 ünïcödé", "<s> </s> <unk> <0x0A> x", "aaaaaaaaaaaaaaaaaaaaaa",
       "    " * 9 + "x", "tab\tand\rret   nbsp", "trailing ", "▁mark", "1234567890 3.14", "the the theatre's"]


@pytest.fixture(scope="module")
def both():
    return wfst.Transducer(wfst.read_model(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_texts_equal_the_library(both):
    t, lib = both
    texts = ODD + [r[0] for r in duckdb.connect().execute("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    for text, ids in zip(texts, t.encode(texts)):
        assert ids.tolist() == lib.encode(text), text[:60]
        assert t.decode(ids.tolist()) == lib.decode(lib.encode(text))
        assert "▁" in text or t.decode(ids.tolist()) == text


@settings(max_examples=500, deadline=None)
@given(text=st.text(alphabet="abcdeéthersin  \n.,'-_=(){}<>/0123*#▁東ß\x00", max_size=50))
def test_ids_equal_on_odd_texts(both, text):
    t, lib = both
    assert t.encode([text])[0].tolist() == lib.encode(text)


def test_unigram_weights_take_the_best_split():
    pieces = [("<unk>", 0, 2), ("▁", -3, 1), ("▁a", -2, 1), ("b", -4, 1), ("a", -4, 1), ("ab", -3.5, 1), ("▁ab", -6.5, 1)]
    t = wfst.Transducer({"pieces": [(p, float(s), k) for p, s, k in pieces], "kind": wfst.UNIGRAM, "prefix": True, "unknown": 0})
    assert [t.text[i] for i in t.encode(["ab"])[0]] == ["▁a", "b"]
    assert t.encode(["z"])[0].tolist() == [1, 0]


def test_rows(spark):
    rows = [(1, ODD[5], "x"), (None, None, "x"), (2, "", "x"), (2, "", "x"), (3, "long words " * 50000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = wfst.encode_documents(df, PATH)
    got = enc.collect()
    assert len(got) == 5
    for r in got:
        text = {1: ODD[5], 3: rows[4][1]}.get(r["doc_id"], "")
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["n_ids"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert {(r["doc_id"], r["text"]) for r in wfst.decode_documents(enc, PATH).collect()} == {(d, t or "") for d, t, _ in rows}
    assert wfst.encode_documents(df.where("false"), PATH).count() == 0


def test_arcs_end_where_no_piece_goes_on():
    """One long piece must not make every place try as many letters."""
    pieces = [("<unk>", 0.0, 2), ("b", -1.0, 1), ("a" * 5_000, -1.0, 1)]
    t = wfst.Transducer({"pieces": pieces, "kind": wfst.UNIGRAM, "prefix": False, "unknown": 0})
    t0 = time.process_time()
    assert t.encode(["b" * 20_000 + "a" * 5_000])[0].tolist() == [1] * 20_000 + [2]
    assert time.process_time() - t0 < 5
