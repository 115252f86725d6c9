"""Bigram language model over token-id arrays (LM1, LM2, LM3).

Bigrams are taken inside each document's id array (``zip_with`` of the array
and its shift), so fitting needs no window and no self-join of the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import config as C
from ..functions import text as T
from .blocks import look_up


def bigrams(doc_ids: DataFrame, keys: list[str], ids_col: str = "ids") -> DataFrame:
    """WIN3 in array form: (keys, w, nx) for every adjacent pair."""
    n = F.size(ids_col)
    pairs = F.zip_with(F.slice(ids_col, 1, F.greatest(n - 1, F.lit(0))),
                       F.slice(ids_col, 2, F.greatest(n - 1, F.lit(0))),
                       lambda a, b: F.struct(a.alias("w"), b.alias("nx")))
    return (doc_ids.where(n >= 2).select(*keys, F.explode(pairs).alias("_p"))
                   .select(*keys, "_p.w", "_p.nx"))


def fit_bigram(doc_ids: DataFrame, keys: list[str], ids_col: str = "ids") -> DataFrame:
    """LM1: bigram counts (w, nx, count) and context totals (w, ctx)."""
    return (bigrams(doc_ids, keys, ids_col).groupBy("w", "nx")
              .agg(F.count(F.lit(1)).alias("count")))


def context_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("w").agg(F.sum("count").alias("ctx"), F.count(F.lit(1)).alias("n_next"))


def smoothed(counts: DataFrame, vocab_size: int, k: float = 1.0) -> DataFrame:
    """LM1: add-k conditional probabilities for the observed bigrams."""
    ctx = context_totals(counts)
    return (counts.join(ctx, "w")
                  .withColumn("prob", (F.col("count") + F.lit(k))
                              / (F.col("ctx") + F.lit(k * vocab_size))))


def pair_loss(pairs: DataFrame, counts: DataFrame, vocab_size: int, k: float = 1.0) -> DataFrame:
    """``pairs`` (.., w, nx) with ``loss`` = -ln p(nx | w) under add-k smoothing (unseen
    pairs and contexts get k / (ctx + kV)).  Shuffle joins on the pair and the
    context; AQE splits hot keys and broadcasts small tables."""
    ctx = context_totals(counts).select("w", "ctx")
    j = pairs.join(counts, ["w", "nx"], "left").join(ctx, "w", "left")
    p = ((F.coalesce("count", F.lit(0)) + F.lit(k))
         / (F.coalesce("ctx", F.lit(0)) + F.lit(k * vocab_size)))
    return j.withColumn("loss", -F.log(p)).drop("count", "ctx")


def cross_entropy(doc_ids: DataFrame, keys: list[str], counts: DataFrame, vocab_size: int,
                  k: float = 1.0, ids_col: str = "ids") -> DataFrame:
    """LM2: per row, number of bigrams and mean -ln p(nx | w); a row of fewer than two
    ids has 0 bigrams and a null mean.  Pairs stay in their row: each block of rows asks
    for the loss of its distinct pairs once (``blocks.look_up``)."""
    n = F.size(ids_col)
    pair = F.zip_with(F.slice(ids_col, 1, F.greatest(n - 1, F.lit(0))), F.slice(ids_col, 2, F.greatest(n - 1, F.lit(0))),
                      lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long")))
    pairs = doc_ids.select(*keys, F.coalesce(pair, F.array().cast("array<long>")).alias("_pairs"))

    def losses(asked: DataFrame) -> DataFrame:
        asked = asked.select("_block", "_element", F.shiftright("_element", 32).cast("int").alias("w"),
                             F.col("_element").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("nx"))
        return pair_loss(asked, counts, vocab_size, k).withColumnRenamed("loss", "_value")
    found = look_up(pairs, "_pairs", losses, "_losses", DoubleType())
    size = F.size("_losses")
    return found.select(*keys, size.cast("long").alias("n_bigrams"), F.when(size > 0, F.aggregate(
        "_losses", F.lit(0.0), lambda acc, x: acc + x) / size).alias("cross_entropy"))


#: Context under which the counts of all contexts are summed, for prompts never seen in training.
ANY_CONTEXT = -1


def next_token_draw(prompts: DataFrame, keys: list[str], last_col: str, counts: DataFrame,
                    seed: int = C.DEFAULT_SEED) -> DataFrame:
    """LM3 + SMP3: one next-token draw per prompt from the observed bigram counts; a prompt
    whose last token was never a context draws from the counts of all contexts.

    Inverse CDF on integers: r = hash(seed:keys) mod ctx(w); the drawn token is the
    successor whose cumulative interval [lo, hi) (successors in id order) holds r.
    Intervals are replicated into at most n_next(w) buckets of the range, and a
    prompt joins only its bucket, so a common last token neither pairs every
    prompt with every successor nor lands in one task."""
    known = counts.select("w").distinct().withColumn("_known", F.lit(True))
    counts = counts.union(counts.groupBy("nx").agg(F.sum("count").alias("count"))
                                .select(F.lit(ANY_CONTEXT).alias("w"), "nx", "count"))
    ctx = context_totals(counts)
    w_cum = Window.partitionBy("w").orderBy("nx").rowsBetween(Window.unboundedPreceding, -1)
    iv = (counts.withColumn("lo", F.coalesce(F.sum("count").over(w_cum), F.lit(0)))
                .withColumn("hi", F.col("lo") + F.col("count"))
                .join(ctx, "w"))
    bucket = lambda v: F.expr(f"({v}) * n_next div ctx")
    iv = iv.select("w", "nx", "lo", "hi",
                   F.explode(F.sequence(bucket("lo"), bucket("hi - 1"))).alias("bk"))
    r = F.pmod(T.hash_int(F.concat_ws(":", F.lit(str(seed)), *[F.col(c) for c in keys])),
               F.col("ctx"))
    prompts = prompts.join(known, prompts[last_col] == known["w"], "left").drop("w")
    prompts = prompts.withColumn("w", F.when(F.col("_known"), F.col(last_col)).otherwise(F.lit(ANY_CONTEXT)))
    p = (prompts.join(ctx, "w")
                .withColumn("r", r).withColumn("bk", bucket("r"))
                .select(*keys, F.col(last_col), "w", "r", "bk"))
    j = p.join(iv, ["w", "bk"]).where((F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
    return j.select(*keys, last_col, F.col("nx").alias("next_id"))
