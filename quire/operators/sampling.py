"""Sampling with deterministic hash randomness (SMP3, SMP4).

Uniforms come from md5 of (seed, key), so a sample is reproducible, identical
on every executor and after a retried task, and independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T


def kept(key_cols: list[str], p_drop: float, seed: int = C.DEFAULT_SEED):
    """SMP4: (whether a row is kept, with probability 1 - p_drop; its weight 1 / (1 - p_drop))."""
    u = T.hash_uniform(F.concat_ws(":", F.lit(str(seed)), *[F.col(c) for c in key_cols]))
    return u >= F.lit(p_drop), F.lit(1.0 / (1.0 - p_drop))


def bernoulli_keep(df: DataFrame, key_cols: list[str], p_drop: float,
                   seed: int = C.DEFAULT_SEED, weight_col: str = "weight") -> DataFrame:
    """SMP4 (dropout as row sampling): the kept rows with their weight, so weighted sums
    stay unbiased."""
    keep, weight = kept(key_cols, p_drop, seed)
    return df.where(keep).withColumn(weight_col, weight)


def weighted_draw(df: DataFrame, group_cols: list[str], item_col: str, weight_col: str,
                  seed: int = C.DEFAULT_SEED, out: str = "drawn") -> DataFrame:
    """SMP3: one draw per group with P(item) proportional to its weight.

    Exponential race: the item with the smallest -ln(u)/w wins.  This is a
    min_by aggregate, so it combines map-side and a hot group is never held
    whole by one task."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.col(c) for c in group_cols], F.col(item_col))
    race = -F.log(T.hash_uniform(key)) / F.col(weight_col).cast("double")
    return (df.where(F.col(weight_col) > 0)
              .groupBy(*group_cols).agg(F.min_by(item_col, race).alias(out)))
