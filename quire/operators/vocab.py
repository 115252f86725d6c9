"""Pre-token counting and vocabulary training (AGG1, SET2, SRT4, VOC1, VOC2).

A vocabulary is a DataFrame ``(id int, token string, special boolean)``.
Counting is a partial + final hash aggregation; ranking takes the top rows
with TakeOrderedAndProject and numbers only that bounded result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T


def specials_frame(spark: SparkSession, specials: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, s, True) for i, s in enumerate(specials)],
                                 "id int, token string, special boolean")


def word_pretokens(text) -> "F.Column":
    """TXT4: runs of word characters or runs of other non-space characters."""
    return T.extract_all(text, T.WORD_PATTERN)


def char_pretokens(text) -> "F.Column":
    """TXT6: one piece per code point."""
    return F.filter(F.split(text, "", -1), lambda s: F.length(s) > 0)


def token_counts(df: DataFrame, pieces) -> DataFrame:
    """AGG1: occurrences of every piece."""
    return (df.select(F.explode(pieces).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("count")))


def word_vocab(df: DataFrame, text_col: str = "text", limit: int = C.WORD_VOCAB_LIMIT,
               specials: list[str] = C.WORD_SPECIALS) -> DataFrame:
    """VOC1: reserved tokens first, then words by count desc, token asc, up to ``limit``
    entries in total."""
    spark = df.sparkSession
    counts = token_counts(df, word_pretokens(F.col(text_col))).where(~F.col("token").isin(specials))
    top = counts.orderBy(F.desc("count"), F.asc("token")).limit(max(limit - len(specials), 0))
    w = Window.orderBy(F.desc("count"), F.asc("token"))   # bounded: at most `limit` rows
    ranked = top.select((F.row_number().over(w) + len(specials) - 1).cast("int").alias("id"),
                        "token", F.lit(False).alias("special"))
    return specials_frame(spark, specials).unionByName(ranked)


def char_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """TXT6 + AGG1: (token, count) of every character; added up in the task, which shuffles one
    row per kind of character."""
    def count(batches):
        total = np.zeros(0x110000, np.int64)
        for b in batches:
            for t in b.column(0):
                text = t.as_py() or ""
                for at in range(0, len(text), 1 << 20):
                    kinds, n = np.unique(np.frombuffer(text[at:at + (1 << 20)].encode("utf-32-le"), np.uint32), return_counts=True)
                    total[kinds] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([chr(k) for k in seen], pa.string()), pa.array(total[seen])], ["token", "count"])
    return df.select(text_col).mapInArrow(count, "token string, count long").groupBy("token").agg(F.sum("count").alias("count"))


def char_vocab(df: DataFrame, text_col: str = "text", specials: list[str] = C.CHAR_SPECIALS,
               alphabet_limit: int | None = None) -> DataFrame:
    """VOC2: reserved tokens, then distinct characters ascending by code point (SET2).

    ``alphabet_limit`` keeps the characters that occur most often, the lower code point
    where counts are equal; characters beyond it are unknown to the encoder."""
    spark = df.sparkSession
    if alphabet_limit is None:
        # distinct within each row first: one row per character kind, not per character
        chars = (df.select(F.explode(F.array_distinct(char_pretokens(F.col(text_col)))).alias("token"))
                   .distinct().where(~F.col("token").isin(specials)))
    else:
        chars = (char_counts(df, text_col).where(~F.col("token").isin(specials))
                 .orderBy(F.desc("count"), F.asc("token")).limit(alphabet_limit).select("token"))
    w = Window.orderBy("token")   # the alphabet: a few thousand rows at most for real text
    ranked = chars.select((F.row_number().over(w) + len(specials) - 1).cast("int").alias("id"),
                          "token", F.lit(False).alias("special"))
    return specials_frame(spark, specials).unionByName(ranked)


def vocab_size(vocab: DataFrame) -> DataFrame:
    """AGG4: number of entries."""
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size"))
