"""Run-metric analytics (AGG5, WIN4, WIN5, PRJ5) over ``(run, ts, tie, loss)`` rows.

Ordered scans per run (iteration number, best-so-far, step duration) are
two-level: rows are cut into (run, time) pieces, a small per-piece table
carries counts, minima and last timestamps forward, and each piece scans only
its own rows.  Pieces follow the rows (``time_pieces``), so a run holding a
third of all rows is spread over pieces of ``PIECE_ROWS`` rows at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..session import written

EPOCH_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))"


def _micros(col: str):
    return F.expr(EPOCH_US.format(c=col))


#: Rows of a piece, at most (unless they all have one timestamp).
PIECE_ROWS = 100_000
#: Lengths of time cells, as bits of a microsecond count: 12.7 days, 18 minutes, 1 second, 1 millisecond, 1 microsecond.
CELL_BITS = (40, 30, 20, 10, 0)


def time_pieces(df: DataFrame, run_col: str, ts_col: str, rows: int = PIECE_ROWS) -> DataFrame:
    """Adds ``_chunk``: runs of up to ``rows`` rows are one piece; longer ones are cut into time cells, and
    cells that hold more into the next finer cells.  So pieces follow the rows and not the clock: neither
    runs of one event nor a burst inside a run makes others small or itself large.

    One small aggregate over run and time per level that is needed; heavy runs and cells are at most one in
    ``rows`` rows, light cells at most 1024 for each heavy one."""
    t = _micros(ts_col)
    found = df.groupBy(run_col).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    heavy = written(found.select(run_col), "heavy-runs")
    if heavy.isEmpty():
        return df.withColumn("_chunk", F.lit(0).cast("long"))
    cell = lambda bits: F.shiftright(t, bits)       # noqa: E731
    start = lambda bits: F.shiftleft(cell(bits), bits)      # noqa: E731
    rest = df.select(run_col, ts_col).join(heavy, run_col, "left_semi")
    out = df.join(heavy.withColumn("_heavy", F.lit(True)), run_col, "left")
    out = out.withColumn("_chunk", F.when(F.col("_heavy"), start(CELL_BITS[0])).otherwise(F.lit(0).cast("long"))).drop("_heavy")
    for bits, finer in zip(CELL_BITS, CELL_BITS[1:]):
        cells = rest.withColumn("_cell", cell(bits))
        found = cells.groupBy(run_col, "_cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
        heavy = written(found.select(run_col, "_cell"), "heavy-cells")
        if heavy.isEmpty():
            break
        rest = cells.join(heavy, [run_col, "_cell"], "left_semi").drop("_cell")
        out = out.withColumn("_cell", cell(bits)).join(heavy.withColumn("_heavy", F.lit(True)), [run_col, "_cell"], "left")
        out = out.withColumn("_chunk", F.when(F.col("_heavy"), start(finer)).otherwise(F.col("_chunk"))).drop("_heavy", "_cell")
    return out


def run_scan(df: DataFrame, run_col: str, ts_col: str, tie_col: str, loss_col: str,
             chunk_seconds: float | None = None, best_init: float = C.BEST_LOSS_INIT, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Adds ``iter`` (0-based), ``best_before`` (running minimum of earlier losses,
    ``best_init`` when none), ``is_best`` (strictly below it), ``save_checkpoint``
    (best and iter > 0), ``prev_ts`` and ``dt_ms`` (WIN4, WIN5)."""
    d = (time_pieces(df, run_col, ts_col, piece_rows) if chunk_seconds is None
         else df.withColumn("_chunk", F.floor(_micros(ts_col) / F.lit(int(chunk_seconds * 1_000_000)))))
    chunks = d.groupBy(run_col, "_chunk").agg(F.count(F.lit(1)).alias("_n"),
                                              F.min(loss_col).alias("_min"),
                                              F.max(ts_col).alias("_last"))
    wc = Window.partitionBy(run_col).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(run_col, "_chunk",
                          F.coalesce(F.sum("_n").over(wc), F.lit(0)).alias("_off"),
                          F.min("_min").over(wc).alias("_cmin"),
                          F.max("_last").over(wc).alias("_clast"))
    wi = Window.partitionBy(run_col, "_chunk").orderBy(ts_col, tie_col)
    wp = wi.rowsBetween(Window.unboundedPreceding, -1)
    inner = (d.withColumn("_rn", F.row_number().over(wi) - 1)
              .withColumn("_imin", F.min(loss_col).over(wp))
              .withColumn("_ilag", F.lag(ts_col).over(wi)))
    j = inner.join(carry, [run_col, "_chunk"])
    best_before = F.coalesce(F.least("_cmin", "_imin"), F.lit(best_init))
    prev_ts = F.coalesce("_ilag", "_clast")
    out = (j.withColumn("iter", (F.col("_off") + F.col("_rn")).cast("long"))
            .withColumn("best_before", best_before.cast("double"))
            .withColumn("is_best", F.col(loss_col) < F.col("best_before"))
            .withColumn("save_checkpoint", F.col("is_best") & (F.col("iter") > 0))
            .withColumn("prev_ts", prev_ts)
            .withColumn("dt_ms", F.expr(f"timestampdiff(MICROSECOND, prev_ts, {ts_col})") / 1000.0))
    return out.drop("_chunk", "_rn", "_imin", "_ilag", "_off", "_cmin", "_clast")


def mean_loss(df: DataFrame, group_cols: list[str], loss_col: str) -> DataFrame:
    """AGG5: mean loss per (run, split) -- or any grouping."""
    return df.groupBy(*group_cols).agg(F.avg(loss_col).alias("mean_loss"),
                                       F.count(F.lit(1)).alias("n"))


def every_n(df: DataFrame, iter_col: str, n: int) -> DataFrame:
    """PRJ5: keep every n-th iteration."""
    return df.where(F.col(iter_col) % n == 0)
