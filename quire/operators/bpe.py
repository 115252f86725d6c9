"""Byte-level BPE: the model, its pre-tokens and pairs (TXT1-3, AGG2), encoding, decoding
and spans (ENC3, ENC5, ENC8-10).

Training is in ``bpe_train``.  Vocabulary and merge list live on the driver; both are
bounded by the vocabulary size.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..functions.memory import WordMemory
from .blocks import pieces_of

# ---- fixed values: byte alphabet order of the byte-level model ----
# Printable bytes (33-126, 161-172, 174-255) stand for themselves and sort
# first; all other bytes sort after them, each group ascending.
PRINTABLE_RANGES = ((33, 126), (161, 172), (174, 255))


def _printable(b: int) -> bool:
    return any(lo <= b <= hi for lo, hi in PRINTABLE_RANGES)


def alphabet_key(b: int) -> int:
    return b if _printable(b) else 256 + b


def byte_level_words(df: DataFrame, text_col: str = "text", per_line: bool = True) -> DataFrame:
    """TXT1 + TXT2 + AGG1: NFC, then byte-level pre-tokens (per line, newline kept,
    as a trainer reading files sees them), counted."""
    t = T.nfc_normalize(df.select(text_col), text_col)
    pieces = T.extract_all(F.col(text_col), T.BYTE_LEVEL_LINES_PATTERN if per_line
                           else T.BYTE_LEVEL_PATTERN)
    return (t.select(F.explode(pieces).alias("word"))
             .groupBy("word").agg(F.count(F.lit(1)).alias("count")))


def byte_alphabet(words: DataFrame) -> DataFrame:
    """TXT3 + SET2: distinct bytes seen, in alphabet order, as (rank, byte)."""
    b = (words.select(F.explode(T.byte_hex_symbols(F.col("word"))).alias("h"))
              .distinct()
              .select(F.conv("h", 16, 10).cast("int").alias("byte")))
    key = F.when(_printable_col(F.col("byte")), F.col("byte")).otherwise(F.col("byte") + 256)
    return b.select("byte", key.alias("akey"))


def _printable_col(c):
    cond = F.lit(False)
    for lo, hi in PRINTABLE_RANGES:
        cond = cond | c.between(lo, hi)
    return cond


@dataclass
class BpeModel:
    specials: list[str]
    tokens: list[bytes] = field(default_factory=list)          # id -> token bytes
    merges: list[tuple[int, int, int]] = field(default_factory=list)  # (left, right, out)
    rounds: int = 0
    counts: list[int] = field(default_factory=list)            # count of each merged pair, when it was merged

    def token_index(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens) if i >= len(self.specials)}

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, bytes(t), i < len(self.specials)) for i, t in enumerate(self.tokens)]
        return spark.createDataFrame(rows, "id int, token binary, special boolean")

    def merges_df(self, spark: SparkSession) -> DataFrame:
        rows = [(k, l, r, o) for k, (l, r, o) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left int, right int, out int")

    @classmethod
    def from_tables(cls, vocab: DataFrame, merges: DataFrame) -> "BpeModel":
        """SRC4: load from the vocab and merges tables (bounded by the vocab size)."""
        v = sorted((r.id, bytes(r.token), r.special) for r in vocab.collect())
        m = sorted((r.rank, r.left, r.right, r.out) for r in merges.collect())
        specials = [t.decode("utf-8") for _, t, s in v if s]
        return cls(specials, [t for _, t, _ in v], [(l, r, o) for _, l, r, o in m])


# ---------------------------------------------------------------- encoding
def _encode_word(word: str, byte_ids: dict[int, int], ranks: dict[tuple[int, int], tuple[int, int]]):
    """Lowest-rank pair first, leftmost first; bytes outside the alphabet are dropped.

    The symbols form a linked list and the mergeable pairs a heap of (rank, place);
    an entry whose pair has changed meanwhile is skipped.  n log n in the word's length.
    """
    syms = [byte_ids[b] for b in word.encode("utf-8") if b in byte_ids]
    n = len(syms)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m[0], i) for i in range(n - 1) if (m := ranks.get((syms[i], syms[i + 1])))]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if syms[i] >= 0 else n
        m = ranks.get((syms[i], syms[j])) if j < n else None
        if m is None or m[0] != rank:
            continue
        syms[i], syms[j] = m[1], -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and (m := ranks.get((syms[a], syms[after[a]]))):
                heapq.heappush(heap, (m[0], a))
    return [s for s in syms if s >= 0]


def _pieces(text: Column, specials: list[str]) -> Column:
    """Reserved tokens whole, byte-level pre-tokens between them, in order; they make up the text."""
    parts = T.isolate_specials(text, specials)
    isolated = F.flatten(F.transform(parts, lambda p: F.when(p.isin(specials), F.array(p))
                                     .otherwise(T.extract_all(p, T.BYTE_LEVEL_PATTERN))))
    has_special = F.lit(False)
    for sp in specials:
        has_special = has_special | text.contains(sp)
    return F.when(has_special, isolated).otherwise(T.extract_all(text, T.BYTE_LEVEL_PATTERN))


#: Bytes of pre-tokens (or ids) that a task works on at once, about; bytes of words it remembers.
CHUNK_BYTES, REMEMBERED_BYTES = 4 << 20, 64 << 20


def _word_chunks(lists: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(words, row ends from 0) of slices of an array of word lists, of about ``CHUNK_BYTES`` each or one row."""
    rows = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    words = lists.flatten()
    size = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)])[rows]
    for at, to in pieces_of(pa.array(np.diff(size)), CHUNK_BYTES):
        yield words.slice(rows[at], rows[to] - rows[at]), rows[at:to + 1] - rows[at]


def _remembered(memory: WordMemory, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What ``memory`` knows of all words in a row, and running ends per word with a leading 0."""
    coded = words.dictionary_encode()
    known, end = memory.ids(coded.dictionary.to_pylist())
    k = coded.indices.to_numpy(zero_copy_only=False)
    size = np.diff(end)[k]
    ends = np.concatenate([[0], np.cumsum(size)])
    return known[np.repeat(end[k] - ends[:-1], size) + np.arange(ends[-1])], ends


def bpe_encode(df: DataFrame, keys: list[str], text_col: str, model: BpeModel) -> DataFrame:
    """ENC3 + TXT7: NFC, reserved tokens matched whole, byte-level pre-tokens encoded in
    place: (keys, ids array<int>), one row per input row; null text counts as empty.

    A task encodes each distinct pre-token once and remembers it, up to ``REMEMBERED_BYTES``; nothing is
    exploded or shuffled.  The model's size is bounded by its vocabulary."""
    specials = model.specials
    byte_ids = {t[0]: i for i, t in enumerate(model.tokens) if i >= len(specials) and len(t) == 1}
    ranks = {(l, r): (k, o) for k, (l, r, o) in reversed(list(enumerate(model.merges)))}
    shared = df.sparkSession.sparkContext.broadcast((byte_ids, ranks, {s: [i] for i, s in enumerate(specials)}))
    t = T.nfc_normalize(df.select(*keys, F.coalesce(text_col, F.lit("")).alias(text_col)), text_col)
    pieces = _pieces(F.col(text_col), specials)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        byte_ids, ranks, known = shared.value

        def encode(words):
            ids = [known.get(w) or _encode_word(w, byte_ids, ranks) for w in words]
            return np.array([x for i in ids for x in i], np.uint32), np.array([len(i) for i in ids], np.int64)
        memory = WordMemory(encode, REMEMBERED_BYTES)
        for lists in batches:
            for words, rows in _word_chunks(lists):
                ids, ends = _remembered(memory, words)
                yield pa.ListArray.from_arrays(pa.array(ends[rows].astype(np.int32)), pa.array(ids.astype(np.int32)))
    return t.select(*keys, run(pieces).alias("ids"))


def nfc_alignment(text: str) -> list[int] | None:
    """For each character of the NFC form, the character of ``text`` it comes from; None if the text is NFC.

    Inside a run of a character and its marks the first character comes from the first one and the last
    ones pair up: what was composed counts as its first character; what was decomposed is the last one."""
    if unicodedata.is_normalized("NFC", text):
        return None
    out, at = [], 0
    while at < len(text):
        end, run = at + 1, text[at]
        while end < len(text) and (unicodedata.combining(text[end]) or _joins(run, text[end])):
            run += text[end]
            end += 1
        n, m = len(run), len(unicodedata.normalize("NFC", run))
        out += [at + (min(k, n - 1) if m > n else k + n - m if k else 0) for k in range(m)]
        at = end
    return out


def _joins(run: str, c: str) -> bool:
    """A character without combining class that still composes with what is before it (Hangul)."""
    return ord(c) > 0x2FF and unicodedata.normalize("NFC", run + c) != unicodedata.normalize("NFC", run) + unicodedata.normalize("NFC", c)


def bpe_spans(df: DataFrame, keys: list[str], text_col: str, model: BpeModel) -> DataFrame:
    """ENC8: the ids of ``bpe_encode`` with their places: (keys, spans array of (id, start, end)).

    Places are code points of the text as it is (before NFC), end exclusive.  A token of some bytes of a
    character has that character's place; reserved tokens have theirs.  Null text counts as empty."""
    specials = model.specials
    byte_ids = {t[0]: i for i, t in enumerate(model.tokens) if i >= len(specials) and len(t) == 1}
    ranks = {(l, r): (k, o) for k, (l, r, o) in reversed(list(enumerate(model.merges)))}
    shared = df.sparkSession.sparkContext.broadcast((byte_ids, ranks, [len(t) for t in model.tokens], {s: i for i, s in enumerate(specials)}))
    t = T.nfc_normalize(df.select(*keys, F.coalesce(text_col, F.lit("")).alias(text_col), F.coalesce(text_col, F.lit("")).alias("_text")), text_col)

    @F.arrow_udf("array<struct<id: int, start: int, end: int>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        byte_ids, ranks, size, reserved = shared.value
        size = np.array(size, np.int64)
        all_known = len(byte_ids) == 256

        def place(words):
            """(id, first byte, end) of each token in its pre-token; bytes outside the alphabet have no token."""
            found = []
            for w in words:
                data = w.encode("utf-8")
                if w in reserved:
                    found.append(np.array([[reserved[w], 0, len(data)]]))
                    continue
                ids = np.array(_encode_word(w, byte_ids, ranks), np.int64)
                end = np.cumsum(size[ids])
                first = end - size[ids]
                if not all_known and len(ids) and end[-1] < len(data):
                    kept = np.array([k for k, b in enumerate(data) if b in byte_ids], np.int64)
                    first, end = kept[first], kept[end - 1] + 1
                found.append(np.stack([ids, first, end], axis=1))
            n = np.array([len(f) for f in found], np.int64)
            return np.concatenate(found).astype(np.uint32).ravel() if found else np.zeros(0, np.uint32), 3 * n
        memory = WordMemory(place, REMEMBERED_BYTES)
        for texts, lists in batches:
            at = 0
            for words, rows in _word_chunks(lists):
                flat, ends = _remembered(memory, words)
                ids, first, end = flat.astype(np.int64).reshape(-1, 3).T
                ends = ends // 3
                begin = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
                data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[begin[0]:begin[-1]]
                begin -= begin[0]
                base = np.repeat(begin[:-1], np.diff(ends))
                char = np.cumsum((data & 0xC0) != 0x80)                   # characters up to each byte
                before = np.concatenate([[0], char])[begin[rows]]         # characters before each row
                tokens = ends[rows]
                own = np.repeat(before[:-1], np.diff(tokens))
                first, last = char[first + base] - 1 - own, char[end + base - 1] - 1 - own
                for k in np.flatnonzero(np.diff(rows)):
                    aligned = nfc_alignment(texts[at + int(k)].as_py())
                    if aligned is not None:
                        mine = slice(tokens[k], tokens[k + 1])
                        aligned = np.array(aligned)
                        first[mine], last[mine] = aligned[first[mine]], aligned[last[mine]]
                at += len(rows) - 1
                columns = [pa.array(c.astype(np.int32)) for c in (ids, first, last + 1)]
                yield pa.ListArray.from_arrays(pa.array(tokens.astype(np.int32)), pa.StructArray.from_arrays(columns, ["id", "start", "end"]))
    return t.select(*keys, run(F.col("_text"), _pieces(F.col(text_col), specials)).alias("spans"))


def segment_encode(scripts: DataFrame, key: str, text_col: str, model: BpeModel,
                   template: bool = True) -> DataFrame:
    """ENC9 + ENC10: marked texts split at the start marker, the end marker dropped, each
    segment encoded by itself and wrapped as start, ids, end when ``template``.

    (key, seg_id, ids); blank segments are dropped, as the loader drops them."""
    start, end = C.START_MARKER, C.END_MARKER
    bodies = F.filter(F.transform(F.split(F.col(text_col), T.quote_regex(start), -1),
                                  lambda p: T.py_strip(F.replace(p, F.lit(end), F.lit("")))), lambda p: F.length(p) > 0)
    seg = scripts.select(key, F.posexplode(bodies).alias("seg_id", "_body"))
    enc = bpe_encode(seg, [key, "seg_id"], "_body", model)
    if not template:
        return enc
    s, e = model.specials.index(start), model.specials.index(end)
    return enc.withColumn("ids", F.concat(F.array(F.lit(s)), "ids", F.array(F.lit(e))))


def bpe_decode(ids_df: DataFrame, keys: list[str], ids_col: str, model: BpeModel) -> DataFrame:
    """ENC5 (byte-level): reserved ids skipped, token bytes concatenated, UTF-8 decoded;
    invalid byte runs (a token cut inside a character) become U+FFFD.  In place, one row
    per input row; null ids decode to an empty text."""
    tokens = [b"" if i < len(model.specials) else bytes(t) for i, t in enumerate(model.tokens)]
    shared = ids_df.sparkSession.sparkContext.broadcast(tokens)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token, none = pa.array([*shared.value, b""], pa.large_binary()), len(shared.value)
        for lists in batches:
            rows = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            for at, to in pieces_of(lists.value_lengths(), CHUNK_BYTES // 4):
                mine = ids[rows[at]:rows[to]]
                parts = token.take(pa.array(np.where((mine >= 0) & (mine < none), mine, none)))
                off = np.frombuffer(parts.buffers()[1], np.int64)[:len(parts) + 1] if len(parts) else np.zeros(1, np.int64)
                data, end = parts.buffers()[2].to_pybytes() if len(parts) and off[-1] else b"", off[rows[at:to + 1] - rows[at]]
                yield pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(end[:-1], end[1:])], pa.string())
    return ids_df.select(*keys, run(F.col(ids_col)).alias("text"))


def alphabet_ids(words: DataFrame, n_specials: int) -> DataFrame:
    """(byte, id): the seen bytes numbered after the reserved tokens (<= 256 rows)."""
    w = Window.orderBy("akey")
    return byte_alphabet(words).select("byte", (F.row_number().over(w) + n_specials - 1)
                                       .cast("int").alias("id"))


def pair_counts(words: DataFrame, n_specials: int) -> DataFrame:
    """AGG2 as a table: (left, right, count) of adjacent bytes over all pre-tokens,
    in alphabet ids.  Bytes are paired first; the 256-row alphabet is joined last."""
    hx = T.byte_hex_symbols(F.col("word"))
    n = F.size(hx)
    pairs = F.zip_with(F.slice(hx, 1, F.greatest(n - 1, F.lit(0))),
                       F.slice(hx, 2, F.greatest(n - 1, F.lit(0))),
                       lambda a, b: F.struct(F.conv(a, 16, 10).cast("int").alias("l"),
                                             F.conv(b, 16, 10).cast("int").alias("r")))
    c = (words.select(F.explode(pairs).alias("p"), "count")
              .groupBy("p.l", "p.r").agg(F.sum("count").alias("count")))
    a = alphabet_ids(words, n_specials)                       # at most 256 rows
    return (c.join(a.toDF("l", "left"), "l").join(a.toDF("r", "right"), "r")
             .select("left", "right", F.col("count").cast("long").alias("count")))
