"""Registered queries: each is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables.

Each query is a composition of library operators; column names match the
DuckDB oracle strings in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..operators import segment as SEG
from ..operators import split as SPL
from ..session import artefact, scratch_path
from ..sources.tables import table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- corpus
def _segmented_scripts(spark, sf_dir):
    scripts = SEG.conversation_scripts(table(spark, sf_dir, "conversations"))
    return SEG.mark_segments(scripts)


@register("corpus_segments")
def corpus_segments(spark, sf_dir):
    """PRJ2-3, WIN1-2, AGG3: scripts derived from conversations, marked into segments."""
    m = _segmented_scripts(spark, sf_dir)
    n_seg = F.size(F.split(F.col("segmented"), T.quote_regex(C.START_MARKER), -1)) - 1
    return m.select("conv_id", n_seg.cast("long").alias("n_segments"),
                    F.length("segmented").cast("long").alias("n_chars"), "segmented")


@register("segment_reload")
def segment_reload(spark, sf_dir):
    """PRJ4, SET1: segments of every marked script as rows."""
    return SEG.load_segments(_segmented_scripts(spark, sf_dir), "conv_id")


def _split_segments(spark, sf_dir):
    segs = SEG.load_segments(_segmented_scripts(spark, sf_dir), "conv_id")
    return SPL.exact_split(segs, ["conv_id", "seg_id"])


@register("split_summary")
def split_summary(spark, sf_dir):
    """Flagship: segment -> load -> exact split -> segments, chars, words per split."""
    s = _split_segments(spark, sf_dir)
    words = F.size(T.extract_all(F.col("body"), T.WORD_PATTERN))
    return (s.groupBy("split")
             .agg(F.count(F.lit(1)).alias("n_segments"),
                  F.sum(F.length("body")).cast("long").alias("n_chars"),
                  F.sum(words).cast("long").alias("n_words")))


@register("exact_split")
def exact_split(spark, sf_dir):
    """SRT1-2: reproducible shuffle and exact 0.8/0.1/rest split of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return SPL.exact_split(docs, ["doc_id"])


@register("skip_processed")
def skip_processed(spark, sf_dir):
    """PRJ1 + SNK1 naming: documents named by source; names with 'segmented' are skipped."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.col("source"), F.when(F.col("doc_id") % 7 == 0, "_segmented")
                           .otherwise(""), F.lit(".txt")).alias("file_name"))
    return SEG.skip_processed(d).select("doc_id", "file_name",
                                        SEG.segmented_name(F.col("file_name")).alias("out_name"))


# ---------------------------------------------------------------- vocabularies and encoding
from ..operators import encode as ENC   # noqa: E402
from ..operators import vocab as VOC    # noqa: E402


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _word_vocab(spark, sf_dir):
    """The word vocabulary of all documents, trained once and read from its table (SNK4, SRC4)."""
    return artefact(spark, (sf_dir, "word-vocab"), lambda: VOC.word_vocab(_docs(spark, sf_dir)))


@register("word_vocab")
def word_vocab(spark, sf_dir):
    """TXT4, AGG1, SRT4, VOC1: word-level vocabulary of the documents."""
    return VOC.word_vocab(_docs(spark, sf_dir))


@register("char_vocab")
def char_vocab(spark, sf_dir):
    """TXT6, SET2, VOC2: character vocabulary of the documents."""
    return VOC.char_vocab(_docs(spark, sf_dir))


#: Characters that ``char_vocab_limited`` keeps: below the number of kinds in the documents, so that some are unknown.
ALPHABET_LIMIT = 40


@register("char_vocab_limited")
def char_vocab_limited(spark, sf_dir):
    """VOC2 with the trainer's alphabet limit: the characters that occur most often in the documents."""
    return VOC.char_vocab(_docs(spark, sf_dir), alphabet_limit=ALPHABET_LIMIT)


def _digest(ids, *keys):
    return ids.select(*keys, F.size("ids").cast("long").alias("n_tokens"),
                      F.size(F.filter("ids", lambda i: i == C.UNK_ID)).cast("long").alias("n_unk"),
                      ENC.ids_digest(F.col("ids")).alias("ids_md5"))


@register("word_encode")
def word_encode(spark, sf_dir):
    """ENC1, JN2: word-level encode of every document, digest per document."""
    return _digest(ENC.word_encode_ids(_docs(spark, sf_dir), ["doc_id"], "text", _word_vocab(spark, sf_dir)), "doc_id")


@register("marked_encode")
def marked_encode(spark, sf_dir):
    """TXT5, TXT7: scripts with segment markers, word-level encoded; the markers keep their reserved ids."""
    marked = _segmented_scripts(spark, sf_dir)
    return _digest(ENC.word_encode_ids(marked, ["conv_id"], "segmented", _word_vocab(spark, sf_dir)), "conv_id")


@register("char_encode")
def char_encode(spark, sf_dir):
    """ENC2: character-level encode with the character vocabulary."""
    docs = _docs(spark, sf_dir)
    return _digest(ENC.char_encode_ids(docs, ["doc_id"], "text", VOC.char_vocab(docs)), "doc_id")


@register("decode_roundtrip")
def decode_roundtrip(spark, sf_dir):
    """ENC5: word-level decode (reserved skipped, space-joined) of the encoded documents."""
    dec = ENC.decode_joined(_doc_word_ids(spark, sf_dir), ["doc_id"], "ids", _word_vocab(spark, sf_dir))
    return dec.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                      F.md5("text").alias("text_md5"))


def _turn_ids(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return ENC.word_encode_ids(conv, ["conv_id", "turn"], "text", _word_vocab(spark, sf_dir))


@register("left_pad")
def left_pad(spark, sf_dir):
    """ENC7: every turn as a prompt, left-padded with id 2 to windows of the context length;
    longer prompts give several windows and lose no id."""
    ids = _turn_ids(spark, sf_dir).withColumn("w", ENC.prompt_windows(F.col("ids"), C.CONTEXT_LENGTH))
    w = ids.select("conv_id", "turn", F.size("ids").cast("long").alias("n_ids"), F.posexplode("w").alias("win", "padded"))
    return w.select("conv_id", "turn", F.col("win").cast("long").alias("win"), "n_ids",
                    F.size("padded").cast("long").alias("n_padded"), ENC.ids_digest(F.col("padded")).alias("padded_md5"))


@register("batch_pad")
def batch_pad(spark, sf_dir):
    """ENC6: turns batched per conversation, right-padded with id 2 to the batch maximum."""
    p = ENC.batch_right_pad(_turn_ids(spark, sf_dir), "conv_id", "ids")
    return p.select("conv_id", "turn", F.size("padded").cast("long").alias("n_padded"),
                    ENC.ids_digest(F.col("padded")).alias("padded_md5"))


# ---------------------------------------------------------------- byte-level BPE
from ..operators import bpe as BPE   # noqa: E402
from ..operators import bpe_train as TRAIN   # noqa: E402

BPE_QUERY_MERGES = 8


@register("byte_pretoken_counts")
def byte_pretoken_counts(spark, sf_dir):
    """TXT1, TXT2, AGG1: NFC, byte-level pre-tokens per line (newline kept), counted."""
    return BPE.byte_level_words(_docs(spark, sf_dir))


@register("byte_alphabet")
def byte_alphabet(spark, sf_dir):
    """TXT3, SET2: seen bytes in alphabet order, ids after the three reserved tokens."""
    a = BPE.alphabet_ids(BPE.byte_level_words(_docs(spark, sf_dir)), len(C.BPE_SPECIALS))
    return a.select("id", F.col("byte").cast("int").alias("byte"))


@register("bpe_pair_counts")
def bpe_pair_counts(spark, sf_dir):
    """AGG2: weighted adjacent-pair counts of the alphabet ids over all pre-tokens."""
    words = BPE.byte_level_words(_docs(spark, sf_dir))
    return BPE.pair_counts(words, len(C.BPE_SPECIALS))


@register(f"bpe_merges_{BPE_QUERY_MERGES}")
def bpe_merges(spark, sf_dir):
    """VOC5, SRT3: the first merges of the byte-level trainer over all documents."""
    model = TRAIN.train_bpe(_docs(spark, sf_dir), max_merges=BPE_QUERY_MERGES)
    return model.merges_df(spark)


@register("bpe_vocab_4096")
def bpe_vocab_4096(spark, sf_dir):
    """VOC3: the example byte-level vocabulary (4096 entries, reserved S and E)."""
    model = _bpe_model(spark, sf_dir, C.BPE_VOCAB_EXAMPLE, C.BPE_SPECIALS_EXAMPLE)
    return model.vocab_df(spark).select("id", F.hex("token").alias("token_hex"), "special")


@register("bpe_vocab_8192")
def bpe_vocab_8192(spark, sf_dir):
    """VOC4: the production byte-level vocabulary (8192 entries, reserved S, E and PAD)."""
    model = _bpe_model(spark, sf_dir, C.BPE_VOCAB, C.BPE_SPECIALS)
    return model.vocab_df(spark).select("id", F.hex("token").alias("token_hex"), "special")


@register("bpe_merges")
def bpe_merge_list(spark, sf_dir):
    """SRT3, VOC5: every merge of the 4096-entry model in order, with the count of its pair when it ranked first."""
    model = _bpe_model(spark, sf_dir, C.BPE_VOCAB_EXAMPLE, C.BPE_SPECIALS_EXAMPLE)
    rows = [(k, l, r, o, n) for k, ((l, r, o), n) in enumerate(zip(model.merges, model.counts))]
    return spark.createDataFrame(rows, "rank int, left int, right int, out int, count long")


def _bpe_model(spark, sf_dir, size, specials):
    """A model trained on all documents once per session, saved and loaded (SNK4, SRC4)."""
    def train():
        model = TRAIN.train_bpe(_docs(spark, sf_dir), vocab_size=size, specials=specials)
        return TOK.model_table(model, spark)
    return TOK.model_from_table(artefact(spark, (sf_dir, f"bpe-{size}-{len(specials)}"), train))


def _bpe_ids(spark, sf_dir):
    """Documents with their split and BPE ids, encoded once per session."""
    def build():
        model = _bpe_model(spark, sf_dir, C.BPE_VOCAB_EXAMPLE, C.BPE_SPECIALS_EXAMPLE)
        docs = _docs(spark, sf_dir)
        return BPE.bpe_encode(docs, ["doc_id"], "text", model).join(SPL.exact_split(docs.select("doc_id"), ["doc_id"]), "doc_id")
    return artefact(spark, (sf_dir, "bpe-ids"), build)


@register("bpe_encode")
def bpe_encode(spark, sf_dir):
    """ENC3: every document encoded with the 4096-entry model: number and digest of its ids, and the
    NFC text they decode to."""
    model = _bpe_model(spark, sf_dir, C.BPE_VOCAB_EXAMPLE, C.BPE_SPECIALS_EXAMPLE)
    text = BPE.bpe_decode(_bpe_ids(spark, sf_dir), ["doc_id", "ids"], "ids", model)
    return text.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ENC.ids_digest(F.col("ids")).alias("ids_md5"),
                       F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("bpe_decode")
def bpe_decode(spark, sf_dir):
    """ENC5: the encoded documents decoded: the NFC form of each document."""
    model = _bpe_model(spark, sf_dir, C.BPE_VOCAB_EXAMPLE, C.BPE_SPECIALS_EXAMPLE)
    text = BPE.bpe_decode(_bpe_ids(spark, sf_dir), ["doc_id"], "ids", model)
    return text.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("segment_ids")
def segment_ids(spark, sf_dir):
    """ENC9, ENC10: the ids of every segment of the marked scripts, in the S ... E template."""
    model = _bpe_model(spark, sf_dir, C.BPE_VOCAB_EXAMPLE, C.BPE_SPECIALS_EXAMPLE)
    enc = BPE.segment_encode(_segmented_scripts(spark, sf_dir), "conv_id", "segmented", model)
    return enc.select("conv_id", F.col("seg_id").cast("long").alias("seg_id"), F.size("ids").cast("long").alias("n_tokens"),
                      ENC.ids_digest(F.col("ids")).alias("ids_md5"))


@register("segment_encode")
def segment_encode(spark, sf_dir):
    """ENC9, ENC10: every segment of the marked scripts encoded by itself in the S ... E template."""
    model = _bpe_model(spark, sf_dir, C.BPE_VOCAB_EXAMPLE, C.BPE_SPECIALS_EXAMPLE)
    enc = BPE.segment_encode(_segmented_scripts(spark, sf_dir), "conv_id", "segmented", model)
    dec = BPE.bpe_decode(enc.select("conv_id", "seg_id", "ids"), ["conv_id", "seg_id", "ids"], "ids", model)
    return dec.select("conv_id", F.col("seg_id").cast("long").alias("seg_id"),
                      F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"),
                      F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------- token streams and windows
from ..operators import windows as WIN   # noqa: E402
from ..sources import corpus as COR   # noqa: E402
from ..sources import tokens as TOK   # noqa: E402

CONTEXT = C.CONTEXT_LENGTH
SAMPLE_WINDOWS = C.EVAL_ITERS * C.BATCH_SIZE


def _doc_word_ids(spark, sf_dir):
    """Documents split 0.8/0.1/rest, word-level encoded; written once per session.  The
    encoded corpus is the hand-off between tokenising, streams, windows and the LM."""
    def build():
        docs = _docs(spark, sf_dir)
        ids = ENC.word_encode_ids(docs, ["doc_id"], "text", _word_vocab(spark, sf_dir))
        return ids.join(SPL.exact_split(docs.select("doc_id"), ["doc_id"]), "doc_id")
    return artefact(spark, (sf_dir, "word-ids"), build)


def _word_stream(spark, sf_dir):
    return artefact(spark, (sf_dir, "word-stream"), lambda: WIN.token_stream(_doc_word_ids(spark, sf_dir)))


@register("token_stream")
def token_stream(spark, sf_dir):
    """ENC4: the whole stream, one row per document: split, position of its first id, ids."""
    return _word_stream(spark, sf_dir).select(
        "split", "doc_id", "offset", F.size("ids").cast("long").alias("n_tokens"), ENC.ids_digest(F.col("ids")).alias("ids_md5"))


@register("stream_head")
def stream_head(spark, sf_dir):
    """SRT5: stream length and the first 100 ids of every split (a preview)."""
    s = _word_stream(spark, sf_dir)
    head = (WIN.stream_tokens(s.where(F.col("offset") < 100)).where(F.col("pos") < 100).groupBy("split")
               .agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_h")))
    return (WIN.stream_sizes(s).join(head, "split")
               .select("split", "n_tokens", ENC.ids_digest(F.transform("_h", lambda e: e["id"])).alias("head_md5")))


@register("bpe_stream_windows")
def bpe_stream_windows(spark, sf_dir):
    """ENC3 -> ENC4 -> WIN6: windows over the BPE stream; their sizes and starts."""
    w = WIN.packed_windows(WIN.token_stream(_bpe_ids(spark, sf_dir)), CONTEXT)
    return w.select("split", "win_id", "start", F.col("n").cast("long").alias("n"), *_arr_digests(w, "x", "y"))


@register("token_sink")
def token_sink(spark, sf_dir):
    """SNK3, SRC3: the word stream written in chunks of 4096 per split and scanned back."""
    path = scratch_path(spark, "token-sink")
    TOK.write_token_stream(_word_stream(spark, sf_dir), path)
    r = TOK.read_token_stream(spark, path)
    return r.select("split", F.col("offset").alias("start"), F.size("ids").cast("long").alias("n"),
                    ENC.ids_digest(F.col("ids")).alias("ids_md5"))


@register("corpus_files")
def corpus_files(spark, sf_dir):
    """SRC1, PRJ1, SNK1, SRC2, SNK2: scripts as text files, scanned, segmented, written, loaded,
    split, written per split; the train and val splits scanned back."""
    raw, seg, out = (scratch_path(spark, n) for n in ("raw-files", "segmented", "splits"))
    scripts = SEG.conversation_scripts(table(spark, sf_dir, "conversations"))
    COR.write_corpus_dir(scripts, raw, "conv_id", "text")
    COR.write_segmented(SEG.mark_segments(COR.read_corpus_dir(spark, raw)), seg)
    segs = SEG.load_segments(spark.read.parquet(seg).withColumnRenamed("text", "segmented"), "file_name")
    segs = segs.withColumn("conv_id", F.regexp_extract("file_name", r"^(\d+)", 1).cast("long"))
    COR.write_splits(SPL.exact_split(segs.select("conv_id", "seg_id", "body"), ["conv_id", "seg_id"]), out)
    return COR.read_splits(spark, out, ["train", "val"]).select("split", "conv_id", "seg_id", "body")


def _arr_digests(df, *cols):
    return [ENC.ids_digest(F.col(c)).alias(f"{c}_md5") for c in cols]


@register("packed_windows")
def packed_windows(spark, sf_dir):
    """WIN6 + WIN3: non-overlapping context windows with next-token targets, the short tail included."""
    w = WIN.packed_windows(_word_stream(spark, sf_dir), CONTEXT)
    return w.select("split", "win_id", "start", F.col("n").cast("long").alias("n"), *_arr_digests(w, "x", "y"))


def _sampled_windows(spark, sf_dir):
    s = _word_stream(spark, sf_dir)
    return WIN.gather_windows(s, WIN.window_starts(WIN.stream_sizes(s), SAMPLE_WINDOWS, CONTEXT), CONTEXT)


@register("random_windows")
def random_windows(spark, sf_dir):
    """SMP1 + SMP2 + JN3: 200 batches of 16 hash-seeded random windows per split."""
    w = _sampled_windows(spark, sf_dir)
    return w.select("split", "win_id", "batch", "start", *_arr_digests(w, "x", "y"))


@register("eval_batches")
def eval_batches(spark, sf_dir):
    """SMP2 + AGG5: mean loss per split over 200 batches of 16 windows under the train bigram model."""
    _, counts, v = _lm_inputs(spark, sf_dir)
    pairs = F.zip_with("x", "y", lambda a, b: F.struct(a.alias("w"), b.alias("nx")))
    w = _sampled_windows(spark, sf_dir).select("split", "batch", F.explode(pairs).alias("p"))
    w = w.groupBy("split", "batch", "p.w", "p.nx").agg(F.count(F.lit(1)).alias("times"))
    per = LM.pair_loss(w, counts, v).groupBy("split", "batch").agg(
        (F.sum(F.col("times") * F.col("loss")) / F.sum("times")).alias("loss"), F.sum("times").alias("n"))
    return per.groupBy("split").agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n").cast("long").alias("n_targets"),
                                    F.round(F.avg("loss"), 9).alias("mean_loss"))


# ---------------------------------------------------------------- vector jobs
from ..operators import vectors as VEC   # noqa: E402

PROJ_OUT = 16


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _r(c, d=9):
    return F.round(c, d)


@register("cross_entropy")
def cross_entropy(spark, sf_dir):
    """AGG6 + JN4: embeddings as logits, label as target; clipped (reference) and
    standard loss, averaged per label and overall (label -1).  One scan."""
    e = _emb(spark, sf_dir).select(
        "label", VEC.cross_entropy_row(F.col("embedding"), F.col("label")).alias("ce_clip"),
        VEC.cross_entropy_row(F.col("embedding"), F.col("label"), clipped=False).alias("ce"))
    u = e.rollup("label").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("ce_clip")).alias("ce_clip"),
                              _r(F.avg("ce")).alias("ce"))
    return u.select(F.coalesce("label", F.lit(-1)).cast("int").alias("label"), F.col("n").cast("long").alias("n"),
                    "ce_clip", "ce")


@register("softmax_scores")
def softmax_scores(spark, sf_dir):
    """VEC1: softmax of every vector (max-shifted and unshifted), long form."""
    e = _emb(spark, sf_dir).select("vec_id", F.arrays_zip(
        VEC.softmax(F.col("embedding")).alias("p"),
        VEC.softmax(F.col("embedding"), shifted=False).alias("q")).alias("z"))
    ex = e.select("vec_id", F.posexplode("z").alias("dim", "s"))
    return ex.select("vec_id", F.col("dim").cast("int").alias("dim"),
                     _r(F.col("s.p")).alias("prob"), _r(F.col("s.q")).alias("prob_unshifted"))


def _gamma(i):
    return F.lit(1.0) + (i % 5).cast("double") / F.lit(10.0)


def _beta(i):
    return ((i % 3) - 1).cast("double") / F.lit(10.0)


@register("layer_norm")
def layer_norm(spark, sf_dir):
    """VEC3 + AGG8: per-vector standardisation, scale and shift (rule-derived weights)."""
    e = _emb(spark, sf_dir).select("vec_id", VEC.layer_norm(F.col("embedding"), _gamma, _beta)
                                   .alias("y"))
    ex = e.select("vec_id", F.posexplode("y").alias("dim", "v"))
    return ex.select("vec_id", F.col("dim").cast("int").alias("dim"), _r(F.col("v")).alias("value"))


@register("one_hot_counts")
def one_hot_counts(spark, sf_dir):
    """VEC2: one-hot targets summed per predicted class (argmax): a confusion table over
    the classes of the data, one row per pair that occurs."""
    e = _emb(spark, sf_dir).select(VEC.argmax(F.col("embedding")).alias("pred"), "label")
    return e.groupBy("pred", F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("residual_by_class")
def residual_by_class(spark, sf_dir):
    """AGG9: mean (prediction - one_hot(target)) per class and dimension."""
    e = _emb(spark, sf_dir).select("label", VEC.residual(F.col("embedding"), F.col("label"))
                                   .alias("r"))
    m = VEC.elementwise_mean(e, ["label"], "r")
    return m.select(F.col("label").cast("int").alias("label"), F.col("dim").cast("int").alias("dim"),
                    _r(F.col("mean")).alias("mean_residual"))


@register("label_centroids")
def label_centroids(spark, sf_dir):
    """AGG7: elementwise mean vector per label."""
    m = VEC.elementwise_mean(_emb(spark, sf_dir), ["label"], "embedding")
    return m.select(F.col("label").cast("int").alias("label"), F.col("dim").cast("int").alias("dim"),
                    _r(F.col("mean")).alias("mean"))


def projection_weights(spark, in_dim=64, out_dim=PROJ_OUT):
    """A rule-derived weight table (i, j, w) and bias (j, b) for VEC4."""
    w = (spark.range(in_dim * out_dim)
              .select(F.expr(f"id div {out_dim}").cast("int").alias("i"),
                      (F.col("id") % out_dim).cast("int").alias("j"))
              .withColumn("w", (((F.col("i") * 7 + F.col("j") * 13) % 17) - 8).cast("double") / 8.0))
    b = spark.range(out_dim).select(F.col("id").cast("int").alias("j"),
                                    (F.col("id") % 4).cast("double") / 4.0)
    return w, b.toDF("j", "b")


@register("linear_projection")
def linear_projection(spark, sf_dir):
    """VEC4: every vector times a 64 x 16 weight plus bias, long form."""
    y = VEC.project(_emb(spark, sf_dir), "embedding", *projection_weights(spark))
    out = y.select("vec_id", F.posexplode("projected").alias("j", "value"))
    return out.select("vec_id", F.col("j").cast("int").alias("j"), _r(F.col("value")).alias("value"))


@register("centroid_scores")
def centroid_scores(spark, sf_dir):
    """AGG7 -> VEC4 by blocks: every vector times the table of the labels' mean vectors, long form."""
    emb = _emb(spark, sf_dir)
    weight = (VEC.elementwise_mean(emb.where("label is not null"), ["label"], "embedding")
              .select(F.col("dim").alias("i"), F.col("label").alias("j"), F.col("mean").alias("w")))
    y = VEC.linear_blocks(emb, "embedding", weight, out="scores").select("vec_id", F.posexplode("scores").alias("label", "score"))
    return y.select("vec_id", F.col("label").cast("int").alias("label"), _r(F.col("score"), 6).alias("score"))


@register("embedding_lookup")
def embedding_lookup(spark, sf_dir):
    """PRJ6 + JN1: last event of every user (run) -> vector of the user id plus the
    vector of the last position, long form."""
    ev = table(spark, sf_dir, "events")
    last = VEC.last_per_sequence(ev, ["user_id"], ["ts", "event_id"], ["value"])
    last = last.withColumn("last_pos", F.col("length") - 1)
    j = VEC.lookup_add(last, "user_id", "last_pos", _emb(spark, sf_dir), "vec_id", "embedding")
    # a run without a vector keeps one row with a null dimension
    ex = j.select("user_id", "event_id", F.posexplode_outer("vec").alias("dim", "v"))
    return ex.select("user_id", "event_id", F.col("dim").cast("int").alias("dim"),
                     _r(F.col("v").cast("double"), 6).alias("value"))


# ---------------------------------------------------------------- run metrics
from ..operators import runs as RUNS   # noqa: E402

EVERY_N = 10


def _run_metrics(spark, sf_dir):
    """events as run metrics: run = user_id, split = event_type, loss = value."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return RUNS.run_scan(ev, "user_id", "ts", "event_id", "value")


@register("running_best")
def running_best(spark, sf_dir):
    """WIN4: iteration number, strict best-so-far flag and checkpoint rule per run."""
    m = _run_metrics(spark, sf_dir)
    return m.select("user_id", "event_id", "iter", "is_best", "save_checkpoint")


@register("step_duration")
def step_duration(spark, sf_dir):
    """WIN5: time since the previous step of the same run, in milliseconds."""
    m = _run_metrics(spark, sf_dir)
    return m.select("user_id", "event_id", F.round("dt_ms", 3).alias("dt_ms"))


@register("mean_loss")
def mean_loss(spark, sf_dir):
    """AGG5: mean loss per run and split."""
    ev = table(spark, sf_dir, "events")
    m = RUNS.mean_loss(ev, ["user_id", "event_type"], "value")
    return m.select("user_id", "event_type", F.round("mean_loss", 9).alias("mean_loss"),
                    F.col("n").cast("long").alias("n"))


@register("every_n")
def every_n(spark, sf_dir):
    """PRJ5: every 10th iteration of every run."""
    m = RUNS.every_n(_run_metrics(spark, sf_dir), "iter", EVERY_N)
    return m.select("user_id", "iter", "event_id", "value")


# ---------------------------------------------------------------- sampling
from ..operators import sampling as SMP   # noqa: E402

P_DROP = 0.1


@register("weighted_sample")
def weighted_sample(spark, sf_dir):
    """SMP4: hash-Bernoulli row sample of orders with inverse-probability weights."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return SMP.bernoulli_keep(o, ["o_orderkey"], P_DROP).select("o_orderkey", "o_orderstatus",
                                                                "weight")


@register("sample_estimate")
def sample_estimate(spark, sf_dir):
    """SMP4: weighted totals from the sample next to the true totals, per status."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    keep, weight = SMP.kept(["o_orderkey"], P_DROP)
    return o.groupBy("o_orderstatus").agg(
        F.count(F.when(keep, 1)).alias("n_kept"), F.count(F.lit(1)).alias("n_all"),
        F.round(F.sum(F.when(keep, weight * F.col("o_totalprice"))), 2).alias("est_total"),
        F.round(F.sum("o_totalprice"), 2).alias("true_total"))


@register("weighted_draw")
def weighted_draw(spark, sf_dir):
    """SMP3: one order per customer, drawn with probability proportional to its price."""
    o = table(spark, sf_dir, "orders")
    return SMP.weighted_draw(o, ["o_custkey"], "o_orderkey", "o_totalprice", out="o_orderkey")


# ---------------------------------------------------------------- bigram language model
from ..operators import lm as LM   # noqa: E402


def _lm_inputs(spark, sf_dir):
    """The encoded corpus, the train bigram counts (both written once) and the vocabulary's size."""
    ids = _doc_word_ids(spark, sf_dir)
    counts = artefact(spark, (sf_dir, "bigrams"), lambda: LM.fit_bigram(ids.where(F.col("split") == "train"), ["doc_id"]))
    return ids, counts, _word_vocab(spark, sf_dir).count()


@register("bigram_model")
def bigram_model(spark, sf_dir):
    """LM1: bigram counts on the train split with add-one probabilities."""
    _, counts, v = _lm_inputs(spark, sf_dir)
    m = LM.smoothed(counts, v)
    return m.select("w", "nx", F.col("count").cast("long").alias("count"),
                    F.round("prob", 12).alias("prob"))


@register("bigram_cross_entropy")
def bigram_cross_entropy(spark, sf_dir):
    """LM2: per-document mean cross-entropy (perplexity = exp) under the train model."""
    ids, counts, v = _lm_inputs(spark, sf_dir)
    ce = LM.cross_entropy(ids, ["doc_id", "split"], counts, v)
    return ce.select("doc_id", "split", F.col("n_bigrams").cast("long").alias("n_bigrams"),
                     F.round("cross_entropy", 9).alias("cross_entropy"))


@register("next_token_draw")
def next_token_draw(spark, sf_dir):
    """LM3 + SMP3: for every conversation turn as a prompt, draw the next token after its
    last word from the train bigram counts; an empty prompt ends with padding."""
    _, counts, _ = _lm_inputs(spark, sf_dir)
    prompts = _turn_ids(spark, sf_dir).select(
        "conv_id", "turn", F.coalesce(F.try_element_at("ids", F.lit(-1)), F.lit(C.PAD_ID)).alias("last_id"))
    d = LM.next_token_draw(prompts, ["conv_id", "turn"], "last_id", counts)
    return d.select("conv_id", "turn", F.col("last_id").cast("int").alias("last_id"),
                    F.col("next_id").cast("int").alias("next_id"))


@register("token_spans")
def token_spans(spark, sf_dir):
    """ENC8: character spans of word-level tokens, digested per document."""
    sp = ENC.word_spans(_docs(spark, sf_dir), ["doc_id"])
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return sp.select("doc_id", F.size("spans").cast("long").alias("n_tokens"),
                     F.coalesce(F.try_element_at("spans", F.lit(-1))["end"], F.lit(0)).cast("long").alias("last_end"),
                     F.md5(text).alias("spans_md5"))


@register("bpe_spans")
def bpe_spans(spark, sf_dir):
    """ENC8 for the 4096-entry model: ids with their places in the text as it is, digested per document."""
    model = _bpe_model(spark, sf_dir, C.BPE_VOCAB_EXAMPLE, C.BPE_SPECIALS_EXAMPLE)
    sp = BPE.bpe_spans(_docs(spark, sf_dir), ["doc_id"], "text", model)
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["id"], x["start"], x["end"])), ",")
    return sp.select("doc_id", F.size("spans").cast("long").alias("n_tokens"),
                     F.coalesce(F.try_element_at("spans", F.lit(-1))["end"], F.lit(0)).cast("long").alias("last_end"),
                     F.md5(text).alias("spans_md5"))


@register("nfc_text")
def nfc_text(spark, sf_dir):
    """TXT1: NFC of every document (JVM check first; only candidate rows carry text to Python)."""
    d = T.nfc_normalize(_docs(spark, sf_dir), "text")
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                    F.md5("text").alias("text_md5"))


@register("vector_stats")
def vector_stats(spark, sf_dir):
    """AGG8: mean and population variance of every vector."""
    e = _emb(spark, sf_dir).select("vec_id", VEC.mean_var(F.col("embedding")).alias("mv"))
    return e.select("vec_id", _r(F.col("mv.mean")).alias("mean"), _r(F.col("mv.var")).alias("var"))
