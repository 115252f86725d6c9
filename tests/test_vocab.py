"""Word- and character-level vocabularies and encoders against the tokenizers library."""
import os

import pytest

from conftest import SF001

tokenizers = pytest.importorskip("tokenizers")

SAMPLE = "Größe und Maß: der Bäcker grüßt höflich, x.<|S|>y ab qq"


def _files(texts, tmp):
    out = []
    for i, t in enumerate(texts):
        p = os.path.join(tmp, f"{i}.txt")
        with open(p, "w", encoding="utf-8", newline="") as f:
            f.write(t)
        out.append(p)
    return out


@pytest.fixture(scope="module")
def texts(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").limit(40).collect()
    return [r.text for r in d] + ["<|S|>\nMÜLLER.\nAm Flußufer stehen süße Äpfel.\n<|E|>"]


def test_word_level(spark, texts, tmp_path):
    from tokenizers import Regex, Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Sequence, Split, Whitespace
    from tokenizers.trainers import WordLevelTrainer
    from quire.operators import encode as ENC, vocab as V
    tk = Tokenizer(WordLevel(unk_token="<|UNK|>"))
    tk.pre_tokenizer = Sequence([Whitespace(), Split(Regex(r"(<\|S\|>|<\|E\|>)"), behavior="isolated")])
    tk.train(_files(texts, str(tmp_path)), WordLevelTrainer(vocab_size=500,
                                                            special_tokens=["<|S|>", "<|E|>", "<|UNK|>"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocab = V.word_vocab(df, limit=500)
    mine = {r.token: r.id for r in vocab.collect()}
    assert mine == tk.get_vocab()
    probe = spark.createDataFrame([(0, SAMPLE)], "doc_id long, text string")
    enc = ENC.word_encode_ids(probe, ["doc_id"], "text", vocab)
    assert list(enc.first().ids) == tk.encode(SAMPLE).ids
    dec = ENC.decode_joined(enc, ["doc_id"], "ids", vocab).first().text
    assert dec == tk.decode(tk.encode(SAMPLE).ids)


def test_char_level(spark, texts, tmp_path):
    from tokenizers import Regex, Tokenizer
    from tokenizers.models import WordPiece
    from tokenizers.pre_tokenizers import Sequence, Split
    from tokenizers.trainers import WordPieceTrainer
    from quire.operators import encode as ENC, vocab as V
    tk = Tokenizer(WordPiece(unk_token="<|UNK|>", max_input_chars_per_word=1))
    tk.pre_tokenizer = Sequence([Split(Regex(r"(<\|S\|>|<\|E\|>)"), behavior="isolated"),
                                 Split("", behavior="isolated")])
    tk.train(_files(texts, str(tmp_path)), WordPieceTrainer(special_tokens=["<|S|>", "<|E|>", "<|UNK|>"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocab = V.char_vocab(df)
    assert {r.token: r.id for r in vocab.collect()} == tk.get_vocab()
    probe = spark.createDataFrame([(0, SAMPLE)], "doc_id long, text string")
    enc = ENC.char_encode_ids(probe, ["doc_id"], "text", vocab)
    assert list(enc.first().ids) == tk.encode(SAMPLE).ids
    dec = ENC.decode_joined(enc, ["doc_id"], "ids", vocab).first().text
    assert dec == tk.decode(tk.encode(SAMPLE).ids)
    known = {r.token: r.id for r in vocab.collect()}
    odd = "😀 <|E|>x" + chr(0x100003)
    got = ENC.char_encode_ids(spark.createDataFrame([(odd,)], "text string"), [], "text", vocab).first().ids
    assert list(got) == [2, known[" "], 1, known["x"], 2]


def test_alphabet_limit_equals_the_library(spark, tmp_path):
    """The most frequent characters stay (no two here are equally frequent); the others are unknown."""
    from tokenizers import Tokenizer
    from tokenizers.models import WordPiece
    from tokenizers.pre_tokenizers import Split
    from tokenizers.trainers import WordPieceTrainer
    from quire.operators import encode as ENC, vocab as V
    kinds = "zäa\u4e2d😀 \nqß.Xe"
    texts = ["".join(c * (k + 1) for k, c in enumerate(kinds)), "", kinds]
    df = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string").repartition(2)
    assert {r.token: r["count"] for r in V.char_counts(df).collect()} == {c: k + 2 for k, c in enumerate(kinds)}
    for limit in (1, 5, len(kinds), 100):
        tk = Tokenizer(WordPiece(unk_token="<|UNK|>", max_input_chars_per_word=1))
        tk.pre_tokenizer = Split("", behavior="isolated")
        tk.train_from_iterator(texts, WordPieceTrainer(special_tokens=["<|S|>", "<|E|>", "<|UNK|>"], limit_alphabet=limit))
        vocab = V.char_vocab(df, alphabet_limit=limit)
        assert {r.token: r.id for r in vocab.collect()} == tk.get_vocab()
        got = ENC.char_encode_ids(df.where("doc_id = 2"), ["doc_id"], "text", vocab).first().ids
        assert list(got) == tk.encode(kinds).ids
    assert V.char_vocab(df, alphabet_limit=100).orderBy("id").collect() == V.char_vocab(df).orderBy("id").collect()
    tied = spark.createDataFrame([("ba",), ("cab",), ("c",)], "text string")
    assert [r.token for r in V.char_vocab(tied, alphabet_limit=2).orderBy("id").collect()][3:] == ["a", "b"]
    assert V.char_vocab(tied.where("false"), alphabet_limit=2).count() == 3


def test_no_row_is_lost(spark):
    """Empty, blank, marker-only and null texts come back from encode, decode and spans."""
    from quire.operators import encode as ENC, vocab as V
    rows = [(1, "a b a"), (2, ""), (3, " \n "), (4, "<|S|>"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = V.word_vocab(df)
    enc = ENC.word_encode_ids(df, ["doc_id"], "text", vocab)
    known = {r.token: r.id for r in vocab.collect()}
    ab = [known["a"], known["b"], known["a"]]
    assert {r.doc_id: list(r.ids) for r in enc.collect()} == {1: ab, 2: [], 3: [], 4: [0], 5: []}
    dec = {r.doc_id: r.text for r in ENC.decode_joined(enc, ["doc_id"], "ids", vocab).collect()}
    assert dec == {1: "a b a", 2: "", 3: "", 4: "", 5: ""}
    chars = {r.doc_id: len(r.ids) for r in ENC.char_encode_ids(df, ["doc_id"], "text", V.char_vocab(df)).collect()}
    assert chars == {1: 5, 2: 0, 3: 3, 4: 1, 5: 0}
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in ENC.word_spans(df, ["doc_id"]).collect()}
    assert spans[1] == [(0, 1), (2, 3), (4, 5)] and spans[2] == spans[3] == spans[5] == []


def test_nfc_only_where_needed(spark):
    import unicodedata
    from quire.functions import text as T
    rows = [(0, "plain ascii"), (1, "été"), (2, "Å ohm Ω"), (3, "ßüé"), (4, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.text for r in T.nfc_normalize(df, "text").collect()}
    for i, t in rows:
        assert got[i] == (None if t is None else unicodedata.normalize("NFC", t))


def test_line_pattern_equals_per_line_split(spark):
    """Byte-level pre-tokens of each line (newline kept) == the one-pass line pattern."""
    import random
    from pyspark.sql import functions as F
    from quire.functions import text as T
    random.seed(7)
    alpha = ["a", "b", " ", "  ", "\n", "\t", "\r", "1", "!", "'s", "\x0b", "\xa0", "x y", "\n\n", " \n "]
    texts = ["".join(random.choice(alpha) for _ in range(random.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lines = T.split_keep_newline(F.col("text"))
    per = F.flatten(F.transform(lines, lambda l: T.extract_all(l, T.BYTE_LEVEL_PATTERN)))
    got = df.select("id", per.alias("a"), T.extract_all(F.col("text"), T.BYTE_LEVEL_LINES_PATTERN)
                    .alias("b")).collect()
    assert all(list(r.a) == list(r.b) for r in got)
