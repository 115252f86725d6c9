"""Encoding texts to id tables and decoding them back (ENC1, ENC2, ENC4-ENC8, ENC10, JN2).

Encoded text is one id array per input row, made in place: pre-tokens are cut
by built-in expressions and looked up in Arrow batches against a vocabulary
whose size is checked.  No token is exploded or shuffled, and every input row
comes back, with an empty array if its text is empty or null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from .. import config as C
from ..functions import text as T
from . import vocab as V
from .blocks import list_chunks, look_up, pieces_of, with_offsets


def has_special(text: Column, specials: list[str]) -> Column:
    cond = F.lit(False)
    for s in specials:
        cond = cond | text.contains(s)
    return cond


def _pieces(text: Column, specials: list[str], pretok) -> Column:
    """TXT7: reserved tokens are cut out first and kept whole; the rest is pre-tokenised.
    The (costlier) isolation only runs on rows that contain a reserved token."""
    parts = T.isolate_specials(text, specials)
    isolated = F.flatten(F.transform(parts, lambda p: F.when(p.isin(specials), F.array(p))
                                     .otherwise(pretok(p))))
    return F.when(has_special(text, specials), isolated).otherwise(pretok(text))


#: Entries of a vocabulary that an in-place lookup carries to the tasks, at most; larger ones are joined.
MAX_LOOKUP = 2_000_000


def vocab_rows(vocab: DataFrame) -> list | None:
    """The rows (id, token, special) of a vocabulary on the driver, or None if there are more than ``MAX_LOOKUP``."""
    rows = vocab.select("id", "token", "special").limit(MAX_LOOKUP + 1).collect()
    return rows if len(rows) <= MAX_LOOKUP else None


def lookup_ids(df: DataFrame, tokens_col: str, vocab: DataFrame, out: str = "ids", unk_id: int = C.UNK_ID) -> DataFrame:
    """JN2: ``out``, the ids of an array of tokens, misses as UNK.

    Up to ``MAX_LOOKUP`` entries in place: nothing is exploded or shuffled.  A larger
    vocabulary is joined with the distinct tokens of each block of rows."""
    rows = vocab_rows(vocab)
    if rows is None:
        known = vocab.select(F.col("token").alias("_element"), F.col("id").cast("int").alias("_value"))
        found = look_up(df, tokens_col, lambda asked: asked.join(known, "_element"), "_ids", IntegerType())
        return (found.withColumn(out, F.transform("_ids", lambda i: F.coalesce(i, F.lit(unk_id))))
                     .select(*df.columns, out))
    shared = vocab.sparkSession.sparkContext.broadcast((pa.array([r.token for r in rows], pa.string()),
                                                        pa.array([r.id for r in rows], pa.int32())))

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, ids = shared.value
        for whole in batches:
            for lists in list_chunks(whole):
                kinds = lists.flatten().dictionary_encode()
                found = pc.fill_null(ids.take(pc.index_in(kinds.dictionary, value_set=known)), unk_id)
                yield with_offsets(lists, pc.fill_null(found.take(kinds.indices), unk_id))
    return df.withColumn(out, run(F.col(tokens_col)))


def word_encode_ids(df: DataFrame, keys: list[str], text_col: str, vocab: DataFrame,
                    specials: list[str] = C.WORD_SPECIALS) -> DataFrame:
    """ENC1 + TXT7: (keys, ids), one row per input row; null text counts as empty."""
    pieces = _pieces(F.coalesce(F.col(text_col), F.lit("")), specials, V.word_pretokens)
    return lookup_ids(df.select(*keys, pieces.alias("_tokens")), "_tokens", vocab).drop("_tokens")


def ids_digest(ids: Column) -> Column:
    return F.md5(F.array_join(ids, ","))


def decode_joined(df: DataFrame, keys: list[str], ids_col: str, vocab: DataFrame) -> DataFrame:
    """ENC5 for word/char vocabularies: reserved tokens skipped, the rest joined by one
    space.  One row per input row; ids outside the vocabulary are skipped.  Beyond
    ``MAX_LOOKUP`` entries the tokens are joined by blocks of rows."""
    rows = vocab_rows(vocab)
    if rows is None:
        known = vocab.where("not special").select(F.col("id").cast("int").alias("_element"), F.col("token").alias("_value"))
        ids = df.select(*keys, F.col(ids_col).cast("array<int>").alias("_ids"))
        found = look_up(ids, "_ids", lambda asked: asked.join(known, "_element"), "_tokens", StringType())
        return found.select(*keys, F.array_join("_tokens", " ").alias("text"))
    table = pa.array([r.id for r in rows if not r.special], pa.int32()), pa.array([r.token for r in rows if not r.special], pa.string())
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids, tokens = shared.value
        for whole in batches:
            for lists in list_chunks(whole):
                yield with_offsets(lists, tokens.take(pc.index_in(lists.flatten().cast(pa.int32()), value_set=ids)))
    return df.select(*keys, F.array_join(run(F.col(ids_col)), " ").alias("text"))


def left_pad(ids: Column, length: int, pad_id: int = C.PAD_ID) -> Column:
    """ENC7: left-pad to ``length`` with the pad id; longer input raises."""
    n = F.size(ids)
    fitted = F.when(n <= length, ids).otherwise(F.raise_error(F.lit(f"input longer than {length} tokens")))
    return F.concat(F.array_repeat(F.lit(pad_id), F.greatest(F.lit(length) - n, F.lit(0))), fitted)


def prompt_windows(ids: Column, length: int, pad_id: int = C.PAD_ID) -> Column:
    """ENC7 for prompts of any length: the ids cut into windows of ``length`` that end with the
    last id, the first one left-padded.  No id is lost; a prompt that fits is one window."""
    n = F.size(ids)
    count = F.greatest(F.lit(1), F.ceil(n / F.lit(length)).cast("int"))
    full = F.concat(F.array_repeat(F.lit(pad_id), (count * length - n).cast("int")), ids)
    return T.bind(full, lambda x: F.transform(F.sequence(F.lit(0), count - 1),
                                              lambda k: F.slice(x, k * length + 1, F.lit(length))))


def batch_right_pad(df: DataFrame, batch_col: str, ids_col: str, pad_id: int = C.PAD_ID,
                    out: str = "padded") -> DataFrame:
    """ENC6: pad every row on the right to the longest row of its batch.

    The batch maximum is an aggregate joined back (a batch is a bounded set of
    rows chosen by the caller), not a window over the batch."""
    mx = df.groupBy(batch_col).agg(F.max(F.size(ids_col)).alias("_L"))
    return (df.join(mx, batch_col)
              .withColumn(out, F.concat(F.col(ids_col),
                                        F.array_repeat(F.lit(pad_id), F.col("_L") - F.size(ids_col))))
              .drop("_L"))


def wrap_template(ids: Column, start_id: int = 0, end_id: int = 1) -> Column:
    """ENC10: <|S|> $A <|E|> around an id sequence."""
    return F.concat(F.array(F.lit(start_id)), ids, F.array(F.lit(end_id)))


SPAN_PATTERN = r"(?U)\s*(?:\w+|[^\w\s]+)"


def word_spans(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """ENC8: (keys, spans) with the character offsets of word-level tokens, in order.

    Each token is extracted together with the white space before it, so the
    running sum of piece lengths gives a token's end and its own length the
    start.  Lengths are built-in expressions; the running sum is one Arrow step."""
    pieces = T.extract_all(F.coalesce(F.col(text_col), F.lit("")), SPAN_PATTERN)
    whole = F.transform(pieces, F.length)
    token = F.transform(pieces, lambda p: F.length(F.regexp_replace(p, r"^(?U)\s+", "")))

    @F.arrow_udf("array<struct<start: long, end: long>>")
    def run(whole: pa.Array, token: pa.Array) -> pa.Array:
        n = np.concatenate([[0], np.cumsum(whole.value_lengths().to_numpy(zero_copy_only=False))])
        end = np.concatenate([[0], np.cumsum(whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64))])
        end = end[1:] - np.repeat(end[n[:-1]], np.diff(n))
        start = end - token.flatten().to_numpy(zero_copy_only=False)
        return with_offsets(whole, pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]))
    return df.select(*keys, run(whole, token).alias("spans"))


#: Bytes of text that the character encoder works on at once, about.
CHAR_BYTES = 4 << 20


def char_encode_ids(df: DataFrame, keys: list[str], text_col: str, vocab: DataFrame,
                    specials: list[str] = C.CHAR_SPECIALS, unk_id: int = C.UNK_ID,
                    out: str = "ids") -> DataFrame:
    """ENC2 without exploding characters: each document becomes its id array in place.

    An Arrow UDF turns texts into code points (``np.frombuffer`` on UTF-32), about
    ``CHAR_BYTES`` of text at once, and looks them up with ``np.searchsorted`` in the sorted
    alphabet; misses become UNK, reserved tokens are matched whole first.  The alphabet
    (the vocabulary's characters) travels in the closure and is bounded by the
    vocabulary.  No row explosion, no shuffle."""
    rows = sorted((ord(r.token), r.id) for r in vocab.select("id", "token", "special").where("char_length(token) = 1").collect() if not r.special and len(r.token) == 1)
    cps = np.array([c for c, _ in rows], dtype=np.uint32)
    ids = np.array([i for _, i in rows], dtype=np.int32)
    spec = {s: i for i, s in enumerate(specials)}
    splitter = re.compile("(" + "|".join(re.escape(s) for s in specials) + ")")

    def encode_plain(t: str) -> np.ndarray:
        cp = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
        if len(cps) == 0:
            return np.full(len(cp), unk_id, dtype=np.int32)
        pos = np.minimum(np.searchsorted(cps, cp), len(cps) - 1)
        return np.where(cps[pos] == cp, ids[pos], unk_id).astype(np.int32)

    def encode(t):
        if t is None:
            return np.zeros(0, dtype=np.int32)
        if not any(s in t for s in specials):
            return encode_plain(t)
        parts = [np.array([spec[p]], dtype=np.int32) if p in spec else encode_plain(p)
                 for p in splitter.split(t) if p]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)

    @F.arrow_udf("array<int>")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for first, last in pieces_of(pc.binary_length(texts), CHAR_BYTES):
                out = [encode(t.as_py()) for t in texts[first:last]]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in out])])
                yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(out)))

    return df.select(*keys, udf(F.col(text_col)).alias(out))
