"""Byte-level BPE against the tokenizers library (test-only oracle)."""
import json
import os

import pytest

from conftest import SF001

tokenizers = pytest.importorskip("tokenizers")


#: Marks to compose, reorder and decompose, Hangul parts, reserved tokens, odd white space.
ODD = ["e\u0301x <|S|>a\u0301\u0323b<|E|> z", "\u1112\u1161\u11ab! \u212b z", "q\u0307\u0323 w \u0344x", "\u1100\u1161\u1100\u1161o\u0302\u0301 n",
       "a\u0327\u0301\u0323z", "  e\u0301 \u0301", "x\u0000y \U0001F600 !", "", " \n\t "]


def _library(texts, vocab_size, specials, tmp):
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel as BLD
    from tokenizers.models import BPE
    from tokenizers.normalizers import NFC
    from tokenizers.pre_tokenizers import ByteLevel
    from tokenizers.trainers import BpeTrainer
    files = []
    for i, t in enumerate(texts):
        p = os.path.join(tmp, f"{i}.txt")
        with open(p, "w", encoding="utf-8", newline="") as f:
            f.write(t)
        files.append(p)
    tk = Tokenizer(BPE())
    tk.normalizer = NFC()
    tk.pre_tokenizer = ByteLevel(add_prefix_space=False)
    tk.decoder = BLD()
    tk.train(files, BpeTrainer(vocab_size=vocab_size, special_tokens=specials, show_progress=False))
    return tk


def _byte_of():
    """Character that stands for a byte -> byte: printable bytes are themselves, the others
    are numbered from 256 in ascending order."""
    from quire.operators.bpe import PRINTABLE_RANGES
    shown = {b for lo, hi in PRINTABLE_RANGES for b in range(lo, hi + 1)}
    hidden = sorted(set(range(256)) - shown)
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    from quire import config as C
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    texts += [t.replace("<|S|>", "").replace("<|E|>", "") for t in ODD]     # so that the alphabet has their bytes
    small = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from quire.operators.bpe_train import train_bpe
    model = train_bpe(small, vocab_size=350, specials=C.BPE_SPECIALS)
    lib = _library(texts, 350, C.BPE_SPECIALS, str(tmp_path_factory.mktemp("bpe")))
    return small, texts, model, lib


def test_vocab_and_merges_match_library(trained):
    _, _, model, lib = trained
    j = json.loads(lib.to_str())
    vocab = j["model"]["vocab"]
    u2b = _byte_of()
    lib_tokens = [s.encode() if i < 3 else bytes(u2b[ch] for ch in s)
                  for s, i in sorted(vocab.items(), key=lambda x: x[1])]
    assert lib_tokens == model.tokens
    lib_merges = [(vocab[a], vocab[b]) for a, b in
                  (m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"])]
    assert lib_merges == [(l, r) for l, r, _ in model.merges]


def test_encode_and_decode_match_library(spark, trained):
    from quire.operators import bpe as B
    small, texts, model, lib = trained
    extra = ["Im März fließt der Bach schneller, grün und kühl.", "<|S|>\nFÄHRMANN.\nDas Boot liegt schräg.\n<|E|>",
             "x.<|S|>y  ab !", "été Å"]
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(extra)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in B.bpe_encode(df, ["doc_id"], "text", model).collect()}
    for k, t in rows:
        assert got[k] == lib.encode(t).ids, t[:60]
    ids = spark.createDataFrame([(k, v) for k, v in got.items()], "doc_id long, ids array<int>")
    dec = {r.doc_id: r.text for r in B.bpe_decode(ids, ["doc_id"], "ids", model).collect()}
    for k, _ in rows:
        assert dec[k] == lib.decode(got[k]), k


def test_spans_match_library(spark, trained):
    """Ids and places in the text before NFC, reserved tokens and cut characters included.  (Bytes that
    the alphabet lacks have no token; the library then moves the places behind them, bpe_spans does not.)"""
    from quire.operators import bpe as B
    small, texts, model, lib = trained
    rows = list(enumerate(texts + ODD)) + [(999, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in B.bpe_spans(df, ["doc_id"], "text", model).collect()}
    for k, t in rows:
        want = lib.encode(t or "")
        assert got[k] == [(i, *o) for i, o in zip(want.ids, want.offsets)], (t or "")[:60]


def test_null_text_and_long_words(spark, trained):
    import time
    from quire.operators import bpe as B
    _, _, model, lib = trained
    df = spark.createDataFrame([(1, None), (2, " \n ")], "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in B.bpe_encode(df, ["doc_id"], "text", model).collect()}
    assert got == {1: [], 2: lib.encode(" \n ").ids}
    byte_ids = {t[0]: i for i, t in enumerate(model.tokens) if i >= 3 and len(t) == 1}
    ranks = {(l, r): (k, o) for k, (l, r, o) in enumerate(model.merges)}
    t0 = time.time()
    word = "theren" * 10000
    assert B._encode_word(word, byte_ids, ranks) == lib.encode(word).ids and time.time() - t0 < 5


def test_saved_model_is_the_model(spark, trained):
    from quire.sources import tokens as TK
    _, _, model, _ = trained
    m = TK.model_from_table(TK.model_table(model, spark))
    assert (m.specials, m.tokens, m.merges) == (model.specials, model.tokens, model.merges)


def _library_merges(lib):
    j = json.loads(lib.to_str())["model"]
    return [(j["vocab"][a], j["vocab"][b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in j["merges"])]


@pytest.mark.parametrize("size,specials", [(4096, 2), (8192, 3)])
def test_full_size_models_match_library(spark, tmp_path, size, specials):
    from quire import config as C
    from quire.operators.bpe_train import train_bpe
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("text").where("length(text) < 3000").coalesce(1)
    model = train_bpe(docs, vocab_size=size, specials=C.BPE_SPECIALS[:specials])
    lib = _library([r.text for r in docs.collect()], size, C.BPE_SPECIALS[:specials], str(tmp_path))
    assert _library_merges(lib) == [(l, r) for l, r, _ in model.merges]
    assert len(model.counts) == len(model.merges) > 1000 and model.rounds < len(model.merges) / 4
    assert model.counts == sorted(model.counts, reverse=True)


def test_few_kept_pairs_and_small_plans_change_nothing(spark, trained, monkeypatch):
    from quire import config as C
    from quire.operators import bpe_train as TR
    small, _, model, _ = trained
    monkeypatch.setattr(TR, "PLAN", (1, 3))
    monkeypatch.setattr(TR, "REBASE", 4)
    monkeypatch.setattr(TR, "WORDS_PER_TASK", 300)
    first = TR.Trainer.__post_init__

    def few(self):
        first(self)
        self.pairs_kept = 40
    monkeypatch.setattr(TR.Trainer, "__post_init__", few)
    got = TR.train_bpe(small, vocab_size=200, specials=C.BPE_SPECIALS)
    assert got.merges == model.merges[:len(got.merges)] and len(got.tokens) == 200


def test_training_goes_on_where_it_ended(spark, trained, scratch, monkeypatch):
    from quire import config as C
    from quire.operators import bpe_train as TR
    small, _, model, _ = trained
    monkeypatch.setattr(TR, "REBASE", 3)
    monkeypatch.setattr(TR, "PLAN", (4, 8))
    ended = TR.train_bpe(small, vocab_size=350, specials=C.BPE_SPECIALS, state=f"{scratch}/bpe", stop_after=10)
    assert 0 < len(ended.merges) < len(model.merges)
    states = TR._states(spark, f"{scratch}/bpe")
    os.remove(f"{states[-1].removeprefix('file:')}/model/_SUCCESS")         # ended while it was being written
    rounds = []
    on = TR.train_bpe(small.limit(0), vocab_size=350, specials=C.BPE_SPECIALS, state=f"{scratch}/bpe", log=lambda r, *_: rounds.append(r))
    assert rounds[0] == 7 and (on.tokens, on.merges, on.counts) == (model.tokens, model.merges, model.counts)


@pytest.mark.parametrize("words", [{"aaaaa": 3, "aaa": 1, "baab": 2}, {"abab": 5, "ababab": 1, "ba": 7}, {"abc": 4, "bc": 4, "ab": 1, "aabcc": 2}])
def test_linked_merges_equal_rewritten_words(words):
    from collections import Counter

    import numpy as np
    import pyarrow as pa
    from quire.operators import bpe_train as TR
    block = list(TR._first_blocks({97: 1, 98: 2, 99: 3})(iter([pa.RecordBatch.from_pydict(
        {"word": list(words), "count": list(words.values())})])))
    plan = [(1, 2, 4), (1, 1, 5), (4, 4, 6), (2, 3, 7), (5, 1, 8), (4, 3, 9)]
    step = [dict() for _ in plan]
    for r in TR._try([], plan)(iter(block)):
        for k, code, d in zip(*(c.to_pylist() for c in r.columns)):
            step[k][code >> 32, code & 0xFFFFFFFF] = d
    state = [([ord(c) - 96 for c in w], n) for w, n in words.items()]

    def pairs():
        out = Counter()
        for w, n in state:
            for p in zip(w, w[1:]):
                out[p] += n
        return out
    for k, (l, r, x) in enumerate(plan):
        before = pairs()
        for i, (w, n) in enumerate(state):
            new, j = [], 0
            while j < len(w):
                if w[j:j + 2] == [l, r]:
                    new.append(x)
                    j += 2
                else:
                    new.append(w[j])
                    j += 1
            state[i] = (new, n)
        after = pairs()
        assert step[k] == {p: after[p] - before[p] for p in before | after if after[p] != before[p]}
    done = [np.frombuffer(s.as_py(), "<u2").tolist() for b in TR._apply(plan)(iter(block)) for s in b.column(0)]
    assert done == ([[x for w, _ in state if len(w) > 1 for x in (TR.SEP, *w)]] if any(len(w) > 1 for w, _ in state) else [])


def test_a_round_links_only_the_words_of_its_merges(monkeypatch):
    """Few merges in many words, which come in many batches: one list of the words that hold them."""
    import pyarrow as pa
    from quire.operators import bpe_train as TR
    words = ["cacaca"] * 500 + ["cab"] * 3
    first = list(TR._first_blocks({97: 1, 98: 2, 99: 3})(pa.RecordBatch.from_pydict({"word": [w], "count": [2]}) for w in words))
    linked = []

    class Counted(TR._Words):
        def __init__(self, symbols, *rest):
            linked.append(len(symbols))
            super().__init__(symbols, *rest)
    monkeypatch.setattr(TR, "_Words", Counted)
    got = [r for b in TR._try([], [(1, 2, 4), (3, 4, 5)])(iter(first)) for r in b.to_pylist()]
    assert linked == [12]
    change = {(r["step"], r["code"] >> 32, r["code"] & 0xFFFFFFFF): r["delta"] for r in got}
    assert change == {(0, 1, 2): -6, (0, 3, 1): -6, (0, 3, 4): 6, (1, 3, 4): -6}
    done = [b for x in TR._apply([(1, 2, 4)])(iter(first)) for b in x.to_pylist()]
    assert len(done) == 1 and len(done[0]["counts"]) == 8 * 503 and linked == [12, 12]


def test_segment_encode_template_and_roundtrip(spark, trained):
    """ENC9 (per-segment encode: split on S, drop E), ENC10 (S ... E template), and
    decode(encode(x)) == NFC(x) when every byte is in the alphabet."""
    import unicodedata
    from quire.operators import bpe as B, segment as SEG
    small, texts, model, lib = trained
    marked = SEG.mark_segments(small.limit(5))
    plain = B.segment_encode(marked, "doc_id", "segmented", model, template=False).collect()
    wrapped = B.segment_encode(marked, "doc_id", "segmented", model)
    want = {r.doc_id: [b for p in r.segmented.split("<|S|>") if (b := p.replace("<|E|>", "").strip())] for r in marked.collect()}
    assert {(r.doc_id, r.seg_id) for r in plain} == {(d, i) for d, b in want.items() for i in range(len(b))}
    for r in plain:
        assert list(r.ids) == lib.encode(want[r.doc_id][r.seg_id]).ids
    assert sorted([0, *r.ids, 1] for r in plain) == sorted(list(r.ids) for r in wrapped.collect())
    for r in B.bpe_decode(wrapped, ["doc_id", "seg_id"], "ids", model).collect():
        assert r.text == unicodedata.normalize("NFC", want[r.doc_id][r.seg_id])


def test_words_are_worked_on_in_bounded_pieces(monkeypatch):
    """One batch of many rows is cut by bytes, and what is remembered of its words is bounded."""
    import numpy as np
    import pyarrow as pa
    from quire.functions.memory import WordMemory
    from quire.operators import bpe as B
    monkeypatch.setattr(B, "CHUNK_BYTES", 10)
    lists = pa.array([["zz"], ["abcd", "ab"], None, [], ["abcd"], ["abcd" * 9, "c"], ["ab"]]).slice(1)
    memory = WordMemory(lambda words: (np.array([ord(c) for w in words for c in w], np.uint32), np.array([len(w) for w in words])), 400)
    got = []
    for words, rows in B._word_chunks(lists):
        flat, ends = B._remembered(memory, words)
        assert len(rows) == 2 or sum(map(len, words.to_pylist())) <= 10
        assert memory.bytes <= 500
        got += ["".join(map(chr, flat[ends[a]:ends[b]])) for a, b in zip(rows[:-1], rows[1:])]
    assert got == ["abcdab", "", "", "abcd", "abcd" * 9 + "c", "ab"]
