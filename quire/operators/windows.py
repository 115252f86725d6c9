"""Token streams and training windows (ENC4, WIN3, WIN6, SMP1, SMP2, JN3).

A split's token stream is the concatenation of its documents in shuffle
order.  Global positions come from a prefix sum over *per-document* token
counts (never over tokens).

A stream stays one row per document.  Windows are built from slices of the
documents' arrays cut at window edges, so no token is a row of its own, and
positions inside a window are relative to its start: streams of any length
keep their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from . import scan, split as SPL


def stream_offsets(doc_counts: DataFrame, split_col: str = "split", key_cols=("doc_id",),
                   n_col: str = "n", seed: int = C.DEFAULT_SEED) -> DataFrame:
    """ENC4: per document, where its tokens start in its split's stream.

    Documents are ordered like the split shuffle: md5(seed:key), then key.
    The chunk is the first 16 bits of that hash (65,536 chunks at most)."""
    h = SPL.shuffle_key(list(key_cols), seed)
    d = (doc_counts.withColumn("_h", h)
                   .withColumn("_b", F.substr("_h", F.lit(1), F.lit(SPL.BUCKET_HEX))))
    return scan.prefix_offsets(d, [split_col], "_b", ["_h", *key_cols], n_col, "offset").drop("_h", "_b")


def token_stream(doc_ids: DataFrame, split_col: str = "split", key_cols=("doc_id",),
                 ids_col: str = "ids") -> DataFrame:
    """ENC4: (split, doc keys, offset, ids): one row per document with the global
    position of its first id in the split's stream."""
    counts = doc_ids.select(split_col, *key_cols, F.size(ids_col).cast("long").alias("n"))
    offs = stream_offsets(counts, split_col, key_cols).select(*key_cols, "offset")
    return (doc_ids.join(offs, list(key_cols))
                   .select(split_col, *key_cols, "offset", F.col(ids_col).alias("ids")))


def stream_tokens(stream: DataFrame, split_col: str = "split") -> DataFrame:
    """The stream in long form: (split, pos, id)."""
    return (stream.select(split_col, "offset", F.posexplode("ids").alias("_p", "id"))
                  .select(split_col, (F.col("offset") + F.col("_p")).alias("pos"), "id"))


def stream_sizes(stream: DataFrame, split_col: str = "split") -> DataFrame:
    return stream.groupBy(split_col).agg(F.sum(F.size("ids")).cast("long").alias("n_tokens"))


def _pieces(stream: DataFrame, T_: int, split_col: str, overlap: int) -> DataFrame:
    """(split, win, at, part): each document cut at window edges.

    Window ``win`` holds the positions [win T, win T + T + overlap); ``at`` is where the
    part starts inside it.  One row per document and window, never per token.
    Positions inside a window stay below T + overlap however long the stream is.
    """
    s = stream.where(F.size("ids") > 0).withColumn("_last", F.col("offset") + F.size("ids") - 1)
    s = s.withColumn("win", F.explode(F.sequence(
        F.expr(f"greatest(0L, (offset - {overlap}) div {T_})"), F.expr(f"_last div {T_}"))))
    s = s.withColumn("_from", F.greatest(F.col("offset"), F.col("win") * T_))
    s = s.withColumn("_to", F.least(F.col("_last"), F.col("win") * T_ + (T_ + overlap - 1)))
    return s.where("_from <= _to").select(
        split_col, "win", (F.col("_from") - F.col("win") * T_).cast("int").alias("at"),
        F.slice("ids", (F.col("_from") - F.col("offset") + 1).cast("int"),
                (F.col("_to") - F.col("_from") + 1).cast("int")).alias("part"))


def _joined(parts) -> F.Column:
    """Parts (at, part) in order, as one array."""
    return F.flatten(F.transform(F.array_sort(F.collect_list(parts)), lambda p: p["part"]))


def chunks(stream: DataFrame, size: int, split_col: str = "split") -> DataFrame:
    """The stream cut at every ``size`` ids: (split, start, ids)."""
    g = (_pieces(stream, size, split_col, 0).groupBy(split_col, "win")
         .agg(_joined(F.struct("at", "part")).alias("ids")))
    return g.select(split_col, (F.col("win") * size).alias("start"), "ids")


def packed_windows(stream: DataFrame, T_: int, split_col: str = "split") -> DataFrame:
    """WIN6 + WIN3: non-overlapping windows x = [cT, cT+T), y = x shifted by one.

    The last window of a split is short: it holds the ids that have a successor, so
    every id of the stream but its first is a target once.  ``n`` is the number of
    targets of a window."""
    w = (_pieces(stream, T_, split_col, 1).groupBy(split_col, F.col("win").alias("win_id"))
         .agg(_joined(F.struct("at", "part")).alias("_e")))
    n = F.least(F.size("_e") - 1, F.lit(T_))
    return (w.where(F.size("_e") > 1)
             .select(split_col, "win_id", (F.col("win_id") * T_).alias("start"), n.alias("n"),
                     F.slice("_e", F.lit(1), n).alias("x"), F.slice("_e", F.lit(2), n).alias("y")))


def window_starts(sizes: DataFrame, n_windows: int, T_: int, seed: int = C.DEFAULT_SEED,
                  batch_size: int = C.BATCH_SIZE, split_col: str = "split") -> DataFrame:
    """SMP1 + SMP2: ``n_windows`` starts per split, uniform in [0, N - T), hash-seeded;
    ``batch = i div batch_size``.  One job for all splits and batches, no loop.  A split
    that is too short for a window raises."""
    room = F.when(F.col("n_tokens") > T_, F.col("n_tokens") - T_).otherwise(
        F.raise_error(F.concat(F.lit(f"no window of {T_} tokens in split "), F.col(split_col))))
    s = sizes.select(split_col, room.cast("long").alias("_room"),
                     F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_windows - 1).cast("long"))).alias("i"))
    key = F.concat_ws(":", F.lit(str(seed)), F.col(split_col), F.col("i"))
    return s.select(split_col, F.col("i").alias("win_id"), F.expr(f"i div {batch_size}").alias("batch"),
                    F.pmod(T.hash_int(key), F.col("_room")).alias("start"))


def gather_windows(stream: DataFrame, starts: DataFrame, T_: int,
                   split_col: str = "split") -> DataFrame:
    """JN3: x = tokens [start, start+T), y = tokens [start+1, start+T], by bucket equi join.

    A window of T+1 positions touches at most two buckets of T; the stream side has
    one row per document and bucket."""
    w = starts.select(split_col, "win_id", "batch", "start", F.expr(f"start div {T_}").alias("_b"),
                      F.explode(F.array(F.expr(f"start div {T_}"), F.expr(f"start div {T_} + 1"))).alias("win"))
    j = _pieces(stream, T_, split_col, 0).join(w, [split_col, "win"])
    at = (F.col("at") + (F.col("win") - F.col("_b")) * T_).cast("int")
    g = (j.select(split_col, "win_id", "batch", "start", at.alias("at"), "part")
          .groupBy(split_col, "win_id", "batch", "start").agg(_joined(F.struct("at", "part")).alias("_e")))
    first = F.expr(f"CAST(start % {T_} AS INT)")
    return g.select(split_col, "win_id", "batch", "start", F.slice("_e", first + 1, F.lit(T_)).alias("x"),
                    F.slice("_e", first + 2, F.lit(T_)).alias("y"))
