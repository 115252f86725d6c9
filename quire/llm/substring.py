"""Substring dedup: words covered by a window that an earlier document also holds (free style).

A window is ``window`` consecutive words of one document.  Three steps:

1. **Count-min prefilter.**  Every partition sketches its windows; the merged
   sketch over-estimates how many documents hold a window.  All windows that
   share their smallest ``GRAM``-word gram count under that gram (a function of
   the window's words, so a window's estimate can only be too high); a run of
   neighbouring windows therefore costs one cell instead of nine.
2. **Exact grouping.**  Only windows estimated to lie in two or more documents
   are shuffled, by their hash, for the smallest doc_id that holds them; windows
   of that hash in later documents are marked.  Windows hash to 64 bits per
   ``HASHES``; the aggregate combines before the shuffle and the join splits hot
   hashes (adaptive skew join), so a passage in a third of all documents is fine.
3. **Removal.**  Marked positions are gathered per document and its words taken out.

Windows are compared by 64-bit hashes, equal for two different ones with a chance of
2**-64.  No window is lost: the sketch never under-estimates, whatever its size; a sketch
that is small for the corpus only lets more windows through to step 2.

Defined cases: null text counts as empty; documents under ``window`` words lose
nothing; rows with a null doc_id are returned unchanged and hold back nothing
from others; rows with equal doc_id do not remove from one another; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.memory import give_back
from ..session import written
from . import hashing as H
from .sketch import BLOCK_SCHEMA, RepeatSketch

WINDOW = 13
GRAM = 5
#: Cells of each of the sketch's rows: 2**26; three rows make a bitmap of 24 MB.
SKETCH_BITS = 26

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _windows(col: pa.Array, window: int):
    """(hash, anchor, first word, row) of every window of a chunk."""
    h, bounds, _, _ = H.word_keys(col)
    w, at, row = H.shingles(h, bounds, window)
    if not len(w):
        return w, w, at, row
    g, g_at, _ = H.shingles(h, bounds, min(GRAM, window))
    gram = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
    gram[g_at] = g
    least, have, need = gram, 1, window - min(GRAM, window) + 1
    while have < need:                       # smallest gram of the next `need` positions
        step = min(have, need - have)
        least = np.minimum(least[:len(least) - step], least[step:])
        have += step
    return w, least[at], at - bounds[row], row


def window_sketch(docs: DataFrame, window: int, sketch: RepeatSketch) -> np.ndarray:
    """Bitmap of the cells whose windows may lie in two documents."""
    def build(batches):
        kept, size = [], 0
        for b in batches:
            for _, col in H.text_chunks(b.column(0)):
                _, anchor, _, row = _windows(col, window)
                if len(anchor):
                    order = np.lexsort((anchor, row))
                    a, r = anchor[order], row[order]
                    new = np.ones(len(a), bool)
                    new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
                    kept.append(a[new])
                    size += int(new.sum())
            if size > 1 << 22:               # a very large partition hands out several sketches
                yield sketch.partition_rows(kept)
                kept, size = [], 0
        yield sketch.partition_rows(kept)
        kept.clear()
        give_back()
    return sketch.merge(docs.where("doc_id is not null").select("text").mapInArrow(build, BLOCK_SCHEMA))


def repeated_windows(docs: DataFrame, window: int, sketch: RepeatSketch, bitmap) -> DataFrame:
    """(w, doc_id, tkey, pos): windows that the sketch estimates in two documents or more."""
    def build(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            keys = b.column(1).to_numpy(zero_copy_only=False)
            for first, col in H.text_chunks(b.column(2)):
                w, anchor, pos, row = _windows(col, window)
                if not len(w):
                    continue
                hit = sketch.repeated(bitmap.value, anchor)
                r = row[hit] + first
                yield pa.RecordBatch.from_pydict({"w": pa.array(w[hit].view(np.int64)), "doc_id": pa.array(ids[r]),
                                                  "tkey": pa.array(keys[r]), "pos": pa.array(pos[hit].astype(np.int32))})
        give_back()
    return (docs.where("doc_id is not null").select("doc_id", "tkey", "text")
                .mapInArrow(build, "w long, doc_id long, tkey long, pos int"))


def _keep(text: str, starts: list[int], window: int):
    """(number of words, covered flags, word matches) of one text."""
    spans = [m.span() for m in _WORD.finditer(text)]
    edge = np.zeros(len(spans) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.asarray(starts, np.int64) + window, -1)
    return spans, np.cumsum(edge[:-1]) > 0


def covered(docs: DataFrame, window: int = WINDOW, sketch: RepeatSketch | None = None) -> DataFrame:
    """(doc_id, tkey, starts): first words of the windows that an earlier document holds."""
    spark = docs.sparkSession
    sketch = sketch or RepeatSketch(SKETCH_BITS)
    bitmap = spark.sparkContext.broadcast(window_sketch(docs, window, sketch))
    found = repeated_windows(docs, window, sketch, bitmap)
    least = written(found.groupBy("w").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                         .where("least < most").select("w", "least"), "windows")
    later = found.join(least, "w").where("doc_id > least")
    return later.groupBy("doc_id", "tkey").agg(F.collect_set("pos").alias("starts"))


def _with_covered(docs: DataFrame, window: int, sketch: RepeatSketch | None, *more) -> DataFrame:
    d = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"), *more)
    return d.join(covered(d, window, sketch), ["doc_id", "tkey"], "left")


def removal_report(docs: DataFrame, window: int = WINDOW, sketch: RepeatSketch | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by spaces)."""
    d = _with_covered(docs, window, sketch).select("doc_id", "text", "starts")

    def report(batches):
        for b in batches:
            n, cut, sha = [], [], []
            for t, starts in zip(b.column(1), b.column(2)):
                t = t.as_py() or ""
                if starts.is_valid:
                    spans, gone = _keep(t, starts.values.to_numpy(), window)
                    kept = [t[s:e] for (s, e), g in zip(spans, gone.tolist()) if not g]
                    n.append(len(spans))
                    cut.append(len(spans) - len(kept))
                else:
                    kept = _WORD.findall(t)
                    n.append(len(kept))
                    cut.append(0)
                sha.append(hashlib.sha256(" ".join(kept).encode()).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_words": pa.array(n, pa.int64()),
                                              "n_removed": pa.array(cut, pa.int64()), "kept_sha256": pa.array(sha)})
    return d.mapInArrow(report, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, sketch: RepeatSketch | None = None) -> DataFrame:
    """The documents with the covered words cut out of ``text``; all columns are kept.

    Where words go, the white space behind them goes too; texts without
    covered words stay as they are, byte for byte.
    """
    d = _with_covered(docs, window, sketch, F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))

    @F.arrow_udf("string")
    def cut(text: pa.Array, starts: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(text, starts):
            t = t.as_py()
            if t is not None and s.is_valid:
                spans, gone = _keep(t, s.values.to_numpy(), window)
                ends = [s for s, _ in spans[1:]] + [len(t)]
                t = t[:spans[0][0]] + "".join(t[s:e] for (s, _), e, g in zip(spans, ends, gone.tolist()) if not g)
            out.append(t)
        return pa.array(out, pa.string())
    return d.select(*[cut(F.col("text"), F.col("starts")).alias("text") if c == "text" else F.col("row")[c].alias(c)
                      for c in docs.columns])
