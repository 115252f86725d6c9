"""Two-level prefix scans: running totals without one global (or one hot-group) window.

Rows are cut into chunks by a coarse ordering key that agrees with the row
order (a hash prefix, a time bucket).  Chunk totals form a small table whose
prefix is computed per group; each chunk then scans only its own rows and adds
the carry-in.  No task ever holds more than one chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_offsets(df: DataFrame, group_cols: list[str], chunk_col: str, order_cols: list[str],
                   size_col: str, out: str = "offset") -> DataFrame:
    """Exclusive running sum of ``size_col`` within each group, in (chunk, order) order."""
    g = list(group_cols)
    totals = df.groupBy(*g, chunk_col).agg(F.sum(size_col).alias("_t"))
    w_chunks = Window.partitionBy(*g).orderBy(chunk_col).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*g, chunk_col,
                          F.coalesce(F.sum("_t").over(w_chunks), F.lit(0)).alias("_carry"))
    w_in = (Window.partitionBy(*g, chunk_col).orderBy(*order_cols)
                  .rowsBetween(Window.unboundedPreceding, -1))
    inner = df.withColumn("_in", F.coalesce(F.sum(size_col).over(w_in), F.lit(0)))
    return (inner.join(carry, g + [chunk_col])
                 .withColumn(out, (F.col("_carry") + F.col("_in")).cast("long"))
                 .drop("_carry", "_in"))
