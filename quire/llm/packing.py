"""Pattern packing of documents into sequences by non-negative least squares (free style).

1. **Pieces.**  Texts are encoded whole, closed with id 0 and cut into pieces of
   at most ``size`` tokens; only longer documents have several.  The table of
   pieces (no ids, no texts) is written once.
2. **Plan.**  The histogram of piece lengths (``size`` numbers at most, whatever the
   corpus) goes to the driver.  Patterns of up to ``PARTS`` pieces that fill a
   sequence are enumerated over lengths rounded up to a ``UNITS``-th of a sequence; their repeat
   counts are fitted to the histogram by non-negative least squares, rounded and
   limited to the pieces that exist.  The residual pieces are packed best-fit,
   longest first, into the slack of the patterns and into new sequences.  All of it
   works on counts of equal lengths.
3. **Assignment.**  A piece's rank among the pieces of its length decides its place:
   the plan maps intervals of ranks to sequences.  Ranks come from hash buckets
   with offsets, so a very frequent length is ranked by many tasks.

Defined cases: null text counts as empty, an empty text is the one token 0;
rows with null or equal doc_ids are packed like any others; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .hashing import text_chunks
from ..functions.memory import WordMemory, give_back

SIZE = 2048
END_ID = 0
UNITS = 128
PARTS = 4
#: Bytes of words that a task remembers, about.
REMEMBERED_BYTES = 48 << 20

# ---- encoding ------------------------------------------------------------------------------

_ODD = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]|<\|")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class WordEncoder:
    """Ids of a lower-casing word-end BPE tokenizer, word by word through a memory of words.

    Texts of ASCII and Latin-1 letters are split here by the tokenizer's own rule
    and each distinct word is encoded once by the tokenizer; any other text goes
    through the tokenizer as a whole.  Results are the tokenizer's.
    """

    def __init__(self, spec: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers
        self.whole = Tokenizer.from_str(spec)            # one for texts and words: its vocabulary is large
        self.splitter = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex("\n"), "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memory = WordMemory(self._encode_words, REMEMBERED_BYTES)

    def _encode_words(self, words: list[str]):
        t = self.whole
        steps = t.normalizer, t.pre_tokenizer
        t.normalizer, t.pre_tokenizer = None, self.splitter
        try:
            enc = t.encode("\n".join(words), add_special_tokens=False)
        finally:
            t.normalizer, t.pre_tokenizer = steps
        return np.array(enc.ids, np.uint32), np.bincount(np.array(enc.word_ids, np.int64), minlength=len(words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as uint32 arrays."""
        out: list = [None] * len(texts)
        plain, words, ends = [], [], []
        for i, t in enumerate(texts):
            if _ODD.search(t):
                out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                words += _SPLIT.findall(t.lower())
                plain.append(i)
                ends.append(len(words))
        ids, end = self.memory.ids(words)
        start = 0
        for i, e in zip(plain, ends):
            out[i] = ids[end[start]:end[e]]
            start = e
        return out


_encoders: dict[int, WordEncoder] = {}


def _encoder(spec: str) -> WordEncoder:
    key = zlib.crc32(spec.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(spec)
    return _encoders[key]


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of whole texts."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())      # a vocabulary file: fixed size

    def build(batches):
        enc = _encoder(spec.value)
        for b in batches:
            for first, col in text_chunks(b.column(1)):
                rows, piece, start, length, crc, kept = [], [], [], [], [], []
                for r, ids in enumerate(enc.encode(col.to_pylist())):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for k in range(0, len(ids), size):
                        part = ids[k:k + size]
                        rows.append(first + r)
                        piece.append(k // size)
                        start.append(k)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if keep_ids:
                            kept.append(part.astype(np.int32))
                out = {"doc_id": b.column(0).take(pa.array(rows, pa.int64())), "piece": pa.array(piece, pa.int32()),
                       "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                       "ids_crc32": pa.array(crc, pa.int64())}
                if keep_ids:
                    out["ids"] = pa.array(kept, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)
        enc.memory.forget()         # workers are used again by other stages
        give_back()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(build, schema)


# ---- plan ----------------------------------------------------------------------------------

def patterns(units: int, parts: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of up to ``parts`` positive numbers that add up to ``units``."""
    def grow(rest, most, left):
        if rest == 0:
            yield ()
        elif left:
            for u in range(min(rest, most), (rest + left - 1) // left - 1, -1):
                for tail in grow(rest - u, u, left - 1):
                    yield (u, *tail)
    return list(grow(units, units, parts))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with x >= 0, by Lawson and Hanson's active sets."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    scale = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * a.shape[0] + 10):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(w.argmax())
        if w[j] <= scale:
            break
        passive[j] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            low = passive & (z <= 1e-12)
            if not low.any():
                x = z
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
    return x


def plan(hist: np.ndarray, size: int = SIZE, parts: int = PARTS) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) groups of equal sequences that hold every piece; ``hist[n]`` pieces have length n."""
    left = {n: int(c) for n, c in enumerate(hist) if c}
    done: list[tuple[int, tuple[int, ...]]] = []
    if left.get(size):
        done.append((left.pop(size), (size,)))
    step = max(1, size // UNITS)
    units = size // step               # a sum of rounded lengths up to here fits
    pools: dict[int, list[list[int]]] = defaultdict(list)      # unit -> [length, count], ascending
    for n in sorted(left):
        pools[-(-n // step)].append([n, left[n]])
    have = {u: sum(c for _, c in p) for u, p in pools.items()}
    able = [p for p in patterns(units, parts) if all(u in have for u in p)]
    slack: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)

    def take(u: int, n: int, longest: bool):
        """n pieces of a unit's pool as runs [(length, count)]."""
        runs, pool = [], pools[u]
        while n:
            i = -1 if longest else 0
            c = min(n, pool[i][1])
            runs.append((pool[i][0], c))
            pool[i][1] -= c
            n -= c
            if not pool[i][1]:
                pool.pop(i)
        return runs

    def place(groups):
        for c, lengths in groups:
            rest = size - sum(lengths)
            (slack[rest] if rest else done).append((c, lengths))

    if able:
        rows = sorted(have)
        at = {u: i for i, u in enumerate(rows)}
        a = np.zeros((len(rows), len(able)))
        for j, p in enumerate(able):
            for u in p:
                a[at[u], j] += 1
        weight = np.array(rows, float)                         # long pieces are hardest to place later
        x = nnls(a * weight[:, None], np.array([have[u] for u in rows]) * weight)
        for j in np.argsort(-x, kind="stable"):
            p = able[j]
            n = min([int(x[j] + 0.5)] + [have[u] // p.count(u) for u in set(p)])
            if n <= 0:
                continue
            slots = []
            for k, u in enumerate(p):
                have[u] -= n
                slots.append(take(u, n, longest=k == 0))
            place(_zip_runs(slots))
    rest = sorted(((n, c) for p in pools.values() for n, c in p), reverse=True)
    rooms = sorted(slack)
    for n, c in rest:
        while c:
            i = bisect.bisect_left(rooms, n)
            if i == len(rooms):
                each = size // n
                if c >= each:
                    place_in, k = (c // each, (n,) * each), c // each * each
                else:
                    place_in, k = (1, (n,) * c), c
                c -= k
                left_over = size - sum(place_in[1])
            else:
                room = rooms[i]
                count, lengths = slack[room].pop()
                k = min(c, count)
                if k < count:
                    slack[room].append((count - k, lengths))
                elif not slack[room]:
                    rooms.pop(i)
                place_in, left_over = (k, lengths + (n,)), room - n
                c -= k
            if left_over:
                if not slack[left_over]:
                    bisect.insort(rooms, left_over)
                slack[left_over].append(place_in)
            else:
                done.append(place_in)
    return done + [g for r in rooms for g in slack[r]]


def _zip_runs(slots: list[list[tuple[int, int]]]) -> list[tuple[int, tuple[int, ...]]]:
    """Runs of equal lengths per slot, cut into groups that are equal in all slots."""
    out, at = [], [[0, s[0][1]] for s in slots]
    while True:
        n = min(a[1] for a in at)
        out.append((n, tuple(s[a[0]][0] for s, a in zip(slots, at))))
        for s, a in zip(slots, at):
            a[1] -= n
            if not a[1]:
                a[0] += 1
                if a[0] == len(s):
                    return out
                a[1] = s[a[0]][1]


def places(groups: list[tuple[int, tuple[int, ...]]]):
    """Sorted (length, first rank) keys with sequence numbers and offsets, and the number of sequences."""
    used: dict[int, int] = defaultdict(int)
    rows, seq = [], 0
    for count, lengths in groups:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], seq, offset))
            used[n] += count
            offset += n
        seq += count
    rows.sort()
    t = np.array(rows, np.int64).reshape(-1, 4)
    return (t[:, 0] << 44) + t[:, 1], t[:, 1], t[:, 2], t[:, 3], seq


# ---- assignment ----------------------------------------------------------------------------

def ranked(rows: DataFrame, group: str, order: list[str], sub_bits: int = 8) -> DataFrame:
    """``rows`` with ``rank`` from 0 inside each group; a frequent group is ranked by ``2**sub_bits`` tasks."""
    d = rows.withColumn("sub", F.pmod(F.xxhash64(*order), F.lit(1 << sub_bits)))
    inside = Window.partitionBy(group).orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy(group, "sub").agg(F.count("*").alias("n")).select(
        group, "sub", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("first"))
    w = Window.partitionBy(group, "sub").orderBy(*order)
    return (d.withColumn("k", F.row_number().over(w)).join(starts, [group, "sub"])
             .withColumn("rank", F.col("first") + F.col("k") - 1).drop("sub", "k", "first"))


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """Pieces with their sequence and offset: (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])."""
    table = written(pieces(docs, tokenizer_path, size, keep_ids), "pieces")
    hist = np.zeros(size + 1, np.int64)
    for r in table.groupBy("length").count().collect():        # at most `size` rows
        hist[r["length"]] = r["count"]
    starts, first, seq, offset, _ = places(plan(hist, size))
    where = docs.sparkSession.sparkContext.broadcast((starts, first, seq, offset))   # bounded by the histogram

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def find(length: pa.Array, rank: pa.Array) -> pa.Array:
        s, f, q, o = where.value
        k = rank.to_numpy(zero_copy_only=False)
        i = np.searchsorted(s, (length.to_numpy(zero_copy_only=False) << 44) + k, "right") - 1
        return pa.StructArray.from_arrays([pa.array(q[i] + k - f[i]), pa.array(o[i])], ["sequence_id", "offset"])
    placed = ranked(table, "length", ["doc_id", "piece", "ids_crc32"]).withColumn("at", find("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset",
                         *(["ids"] if keep_ids else []))
