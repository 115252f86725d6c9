"""Reproducible shuffle and exact-ratio split (SRT1, SRT2, AGG4).

Order: md5(seed:key), then key.  Sizes: train = floor(n * train_ratio),
val = floor(n * val_ratio), test = the rest (the test ratio is accepted and
ignored, as in the reference).

No global sort: rows are bucketed by the first 16 bits of the hash.  The
bucket table (<= 65,536 rows by construction) gets a prefix sum; a bucket that
falls wholly inside one split is assigned directly, and only the rows of the
(at most two) buckets that straddle a split boundary are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T

BUCKET_HEX = 4   # 65,536 buckets: the broadcast bucket table is bounded by this


def shuffle_key(key_cols: list[str], seed: int = C.DEFAULT_SEED):
    return T.md5_key(F.lit(str(seed)), *key_cols)


def exact_split(df: DataFrame, key_cols: list[str], seed: int = C.DEFAULT_SEED,
                train_ratio: float = C.TRAIN_RATIO, val_ratio: float = C.VAL_RATIO,
                test_ratio: float = C.TEST_RATIO) -> DataFrame:
    """Add ``split`` to every row of ``df``; ``test_ratio`` is accepted and unused."""
    h = df.withColumn("_h", shuffle_key(key_cols, seed))
    h = h.withColumn("_b", F.conv(F.substr("_h", F.lit(1), F.lit(BUCKET_HEX)), 16, 10).cast("int"))

    # Bucket sizes (partial aggregation map-side), then offsets on the small table.
    w_all = Window.partitionBy(F.lit(0))
    w_run = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (h.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
                .withColumn("_lo", F.coalesce(F.sum("_c").over(w_run), F.lit(0)).cast("long"))
                .withColumn("_n", F.sum("_c").over(w_all).cast("long")))
    train_end = F.floor(F.col("_n").cast("double") * F.lit(float(train_ratio))).cast("long")
    val_end = train_end + F.floor(F.col("_n").cast("double") * F.lit(float(val_ratio))).cast("long")
    buckets = (buckets.withColumn("_te", train_end).withColumn("_ve", val_end)
               .withColumn("_hi", F.col("_lo") + F.col("_c")))

    def label(rank):
        return (F.when(rank < F.col("_te"), "train")
                 .when(rank < F.col("_ve"), "val").otherwise("test"))

    whole = ((F.col("_hi") <= F.col("_te"))
             | ((F.col("_lo") >= F.col("_te")) & (F.col("_hi") <= F.col("_ve")))
             | (F.col("_lo") >= F.col("_ve")))
    j = h.join(F.broadcast(buckets), "_b")

    inner = j.where(whole).withColumn("split", label(F.col("_lo")))
    w_b = Window.partitionBy("_b").orderBy("_h", *key_cols)
    edge = (j.where(~whole)
             .withColumn("_r", F.col("_lo") + F.row_number().over(w_b) - 1)
             .withColumn("split", label(F.col("_r"))))
    cols = df.columns + ["split"]
    return inner.select(*cols).unionByName(edge.select(*cols))


def split_sizes(split_df: DataFrame) -> DataFrame:
    """AGG4: rows per split."""
    return split_df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
