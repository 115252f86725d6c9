"""Vector-column jobs over ``array<float|double>`` columns (VEC1-VEC4, JN1, JN4, AGG6-AGG9, PRJ6).

Per-vector work uses array higher-order functions (JVM side, no Python).
Reductions across rows go through ``posexplode`` + ``groupBy(key, dim)`` so
that partial aggregation runs map-side and no group is collected whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..session import written


def _d(c: Column) -> Column:
    return c.cast("double")


def vsum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + _d(x))


_bind = T.bind


def softmax(arr: Column, shifted: bool = True) -> Column:
    """VEC1: softmax of a score vector; max-shifted unless ``shifted=False``."""
    if shifted:
        e = _bind(_d(F.array_max(arr)), lambda m: F.transform(arr, lambda x: F.exp(_d(x) - m)))
    else:
        e = F.transform(arr, lambda x: F.exp(_d(x)))
    return _bind(e, lambda ev: _bind(vsum(ev), lambda s: F.transform(ev, lambda x: x / s)))


def clip(x: Column, eps: float = C.CLIP_EPS) -> Column:
    return F.least(F.greatest(_d(x), F.lit(eps)), F.lit(1.0 - eps))


def cross_entropy_row(logits: Column, target: Column, clipped: bool = True) -> Column:
    """AGG6 per row (JN4: the target is an element access, no one-hot table).  A target
    outside the vector raises.

    ``clipped`` keeps the reference rule (logits clipped to [eps, 1-eps] before
    the softmax); otherwise the standard max-shifted log-softmax loss."""
    target = F.when((target >= 0) & (target < F.size(logits)), target).otherwise(
        F.raise_error(F.concat(F.lit("no score for target "), F.coalesce(target.cast("string"), F.lit("null")))))
    if clipped:
        return _bind(F.transform(logits, lambda x: clip(x)),
                     lambda y: F.log(vsum(F.transform(y, lambda v: F.exp(v)))) - F.get(y, target))
    return _bind(_d(F.array_max(logits)), lambda m: F.log(
        vsum(F.transform(logits, lambda v: F.exp(_d(v) - m)))) + m - _d(F.get(logits, target)))


def mean_var(arr: Column) -> Column:
    """AGG8: struct(mean, var) of one vector (population variance)."""
    n = F.size(arr).cast("double")
    return _bind(vsum(arr) / n, lambda mean: F.struct(
        mean.alias("mean"),
        (F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (_d(x) - mean) * (_d(x) - mean)) / n)
        .alias("var")))


def layer_norm(arr: Column, gamma, beta, eps: float = C.LAYER_NORM_EPS) -> Column:
    """VEC3: standardise each vector, then scale and shift per dimension.

    ``gamma``/``beta`` are functions of the 0-based dimension index returning a
    Column (a rule), or array Columns."""
    def at(p, i):
        return p(i) if callable(p) else F.get(p, i)

    return _bind(mean_var(arr), lambda mv: F.transform(
        arr, lambda x, i: (_d(x) - mv["mean"]) / F.sqrt(mv["var"] + F.lit(eps)) * at(gamma, i)
        + at(beta, i)))


def argmax(arr: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def one_hot(index: Column, n: int) -> Column:
    """VEC2: class indicator vector of length n (never a dense n x n table)."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == index, 1).otherwise(0))


def residual(logits: Column, target: Column) -> Column:
    """AGG9: prediction minus one-hot target (raw scores, as the reference does)."""
    return F.transform(logits, lambda x, i: _d(x) - F.when(i == target, 1.0).otherwise(0.0))


def elementwise_mean(df: DataFrame, keys: list[str], vec_col: str) -> DataFrame:
    """AGG7: mean vector per key, long form (keys, dim, mean)."""
    ex = df.select(*keys, F.posexplode(vec_col).alias("dim", "_x"))
    return ex.groupBy(*keys, "dim").agg(F.avg(_d(F.col("_x"))).alias("mean"))


#: Weights (numbers) that a projection carries to the tasks, at most: 256 MB of doubles.
MAX_WEIGHTS = 1 << 25


def project(df: DataFrame, vec_col: str, weight: DataFrame, bias: DataFrame | None = None, out: str = "projected") -> DataFrame:
    """VEC4: ``df`` with an array ``out`` = x W + b for the weight table (i, j, w) and bias (j, b).

    Up to ``MAX_WEIGHTS`` weights are carried to the tasks, more are met by blocks.  A
    null vector gives null; one of another length than the weights raises."""
    if weight.count() > MAX_WEIGHTS:
        return linear_blocks(df, vec_col, weight, bias, out)
    return df.withColumn(out, linear(F.col(vec_col), *weight_matrix(weight, bias)))


def weight_matrix(weight: DataFrame, bias: DataFrame | None = None):
    """The weight table (i, j, w) and bias (j, b) as arrays, their size checked."""
    n = weight.count()
    if n > MAX_WEIGHTS:
        raise ValueError(f"{n} weights; an in-place projection carries {MAX_WEIGHTS} at most")
    t = weight.select("i", "j", "w").toPandas()
    m = np.zeros((int(t["i"].max()) + 1, int(t["j"].max()) + 1))
    m[t["i"].to_numpy(), t["j"].to_numpy()] = t["w"].to_numpy()
    b = np.zeros(m.shape[1])
    for r in (bias.collect() if bias is not None else []):
        b[r["j"]] = r["b"]
    return m, b


def _vectors(y: np.ndarray, valid: np.ndarray) -> pa.Array:
    """The rows of ``y`` as lists at the valid places, null elsewhere."""
    ends = np.concatenate([[0], np.cumsum(valid)]).astype(np.int32) * np.int32(y.shape[1])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(y.ravel()), mask=None if valid.all() else pa.array(~valid))


def linear(vec: Column, weight: np.ndarray, bias: np.ndarray) -> Column:
    """VEC4: y = x W + b for every vector, as one matrix product per Arrow batch; no
    shuffle and no row per weight.  The weights' size is fixed by the model."""
    @F.arrow_udf("array<double>")
    def run(lists: pa.Array) -> pa.Array:
        if bad := set(lists.value_lengths().drop_null().unique().to_pylist()) - {len(weight)}:
            raise ValueError(f"{len(weight)} weights a column, vectors of {sorted(bad)}")
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(weight))
        return _vectors(x @ weight + bias, lists.is_valid().to_numpy(zero_copy_only=False))
    return run(vec)


#: Edge of a weight block; numbers in the vectors of a row block; numbers of the pieces that meet a weight block in one task.
BLOCK_EDGE, BLOCK_NUMBERS, PIECE_NUMBERS = 1 << 10, 1 << 20, 1 << 22


def linear_blocks(df: DataFrame, vec_col: str, weight: DataFrame, bias: DataFrame | None = None,
                  out: str = "projected", edge: int = BLOCK_EDGE) -> DataFrame:
    """VEC4 for weights of any size, the same rows as in place.

    Vectors are cut into pieces of ``edge`` numbers, the weight table into blocks of
    ``edge`` x ``edge``.  A group of row blocks meets one weight block in a task, the
    products are summed per row block and output block, and each row block is put
    together at the end.  So a task holds one weight block with a few million numbers
    of vectors, or the products of one row block, whatever the sizes of table and
    weights.  The bias is one more weight row, for a last vector element of 1.
    """
    n_in, n_out = [int(x) for x in weight.agg(F.max("i") + 1, F.max("j") + 1).first()]
    weight = weight.select(F.col("i").cast("long"), F.col("j").cast("long"), _d(F.col("w")).alias("w"))
    if bias is not None:
        weight = weight.unionByName(bias.select(F.lit(n_in).cast("long").alias("i"), F.col("j").cast("long"), _d(F.col("b")).alias("w")))
    high = n_in + 1
    per = max(1, BLOCK_NUMBERS // max(high, n_out))
    together = max(1, PIECE_NUMBERS // (edge * per))
    last_in, last_out = (high - 1) // edge, (n_out - 1) // edge
    names, keys, found = df.columns, ["_group", "_in", "_out"], "_row long, _block long, _out int, _y array<double>"
    parts = pa.schema([("_row", pa.int64()), ("_block", pa.int64()), ("_out", pa.int32()), ("_y", pa.list_(pa.float64()))])

    def every(last: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(last)))

    def matrix(lists: pa.ChunkedArray) -> np.ndarray:
        return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)

    def rows_of(m: np.ndarray) -> pa.Array:
        return _vectors(m, np.ones(len(m), bool))

    def dense(key: tuple, t: pa.Table) -> pa.Table:
        a, b = key[0].as_py(), key[1].as_py()
        m = np.zeros((min(edge, high - a * edge), min(edge, n_out - b * edge)))
        m[t["i"].to_numpy() - a * edge, t["j"].to_numpy() - b * edge] = t["w"].to_numpy()
        return pa.table({"_in": pa.array([a], pa.int32()), "_out": pa.array([b], pa.int32()), "_w": rows_of(m.reshape(1, -1))})

    def product(x: pa.Table, w: pa.Table) -> pa.Table:
        if not x.num_rows or not w.num_rows:            # no vector, or a block without weights
            return parts.empty_table()
        pieces = matrix(x["_x"])
        return pa.table([x["_row"], x["_block"], x["_out"], rows_of(pieces @ matrix(w["_w"]).reshape(pieces.shape[1], -1))], schema=parts)

    def summed(key: tuple, t: pa.Table) -> pa.Table:
        row = t["_row"].to_numpy()
        order = np.argsort(row, kind="stable")
        ids, starts = np.unique(row[order], return_index=True)
        y = np.add.reduceat(matrix(t["_y"])[order], starts, axis=0)
        same = [pa.array(np.full(len(ids), k.as_py()), f.type) for k, f in zip(key, list(parts)[1:])]
        return pa.table([pa.array(ids), *same, rows_of(y)], schema=parts)

    def put_together(mine: pa.Table, got: pa.Table) -> pa.Table:
        place = {r: k for k, r in enumerate(mine["_row"].to_pylist())}
        y = np.zeros((len(place), n_out))
        for r, o, part in zip(got["_row"].to_pylist(), got["_out"].to_pylist(), got["_y"]):
            y[place[r], o * edge:o * edge + len(part)] = part.values.to_numpy()
        valid = mine[vec_col].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        return mine.select(names).append_column(out, _vectors(y[valid], valid))

    rows = (written(df.withColumn("_row", F.monotonically_increasing_id()), "vectors").withColumn("_block", F.expr(f"_row div {per}")))
    group = F.expr(f"_block div {together}").alias("_group")
    v = F.col(vec_col).cast("array<double>")
    v = F.when(F.size(v) == n_in, F.concat(v, F.array(F.lit(1.0)))).otherwise(F.raise_error(F.concat(
        F.lit(f"{n_in} weights a column, a vector of "), F.size(v).cast("string"))))
    pieces = (rows.where(F.col(vec_col).isNotNull()).select("_row", "_block", group, v.alias("_v"))
              .select("_row", "_block", "_group", "_v", every(last_in).alias("_in"))
              .select("_row", "_block", "_group", "_in", F.slice("_v", F.col("_in") * edge + 1, edge).alias("_x"))
              .select("*", every(last_out).alias("_out")))
    blocks = written(weight.groupBy(*[F.expr(f"{c} div {edge}").cast("int").alias(n) for c, n in (("i", "_in"), ("j", "_out"))])
                     .applyInArrow(dense, "_in int, _out int, _w array<double>"), "weights")
    asked = (rows.select(group).distinct().select("_group", every(last_in).alias("_in"))
             .select("_group", "_in", every(last_out).alias("_out")))
    products = (pieces.groupBy(*keys).cogroup(asked.join(blocks, ["_in", "_out"]).groupBy(*keys)).applyInArrow(product, found)
                .groupBy("_block", "_out").applyInArrow(summed, found))
    # the table's own columns keep their types
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` array<double>"
    return rows.groupBy("_block").cogroup(products.groupBy("_block")).applyInArrow(put_together, schema)


def last_per_sequence(df: DataFrame, seq_cols: list[str], order_cols: list[str],
                      value_cols: list[str]) -> DataFrame:
    """PRJ6: the last row of every sequence (max_by over the order key); a partial
    aggregate, so a long sequence never sits in one task."""
    order = F.struct(*order_cols)
    payload = F.struct(*order_cols, *value_cols)
    return (df.groupBy(*seq_cols).agg(F.max_by(payload, order).alias("_last"),
                                      F.count(F.lit(1)).alias("length"))
              .select(*seq_cols, "length", *[F.col(f"_last.{c}").alias(c)
                                            for c in order_cols + value_cols]))


def lookup_add(df: DataFrame, id_col: str, pos_col: str, table: DataFrame,
               key_col: str, vec_col: str, out: str = "vec") -> DataFrame:
    """JN1: token vector + position vector, elementwise.  Rows whose id or position has
    no vector stay, with a null ``out``."""
    tok = table.select(F.col(key_col).alias("_tk"), F.col(vec_col).alias("_tv"))
    pos = table.select(F.col(key_col).alias("_pk"), F.col(vec_col).alias("_pv"))
    j = (df.join(tok, df[id_col] == tok["_tk"], "left").join(pos, F.col(pos_col) == pos["_pk"], "left"))
    return (j.withColumn(out, F.zip_with("_tv", "_pv", lambda a, b: a + b))
             .drop("_tk", "_tv", "_pk", "_pv"))
