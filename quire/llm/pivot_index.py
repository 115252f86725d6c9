"""Embedding near-dedup with a pivot-permutation index (free style: numpy blocks in Arrow tasks).

1. **Representatives.**  Equal vectors are one from the start.
2. **Permutation.**  Reference points ("pivots") are vectors of the table, the first
   in hash order; their number grows with the square root of the table, so lists
   and pivots stay in balance.  A vector is described by its nearest pivots
   from near to far: ``NEAREST``, and one more for each doubling of the pivots
   beyond ``NEAREST_UP_TO``, as two close vectors share fewer of them the more there are.
3. **Inverted lists.**  A vector is entered in the list of each of its nearest pivots.
   Inside a list, vectors that share at least ``SHARED`` of those pivots are
   candidates (one small matrix product counts them), and candidates are verified
   by their cosine in double precision.  A pair that meets in several lists counts in the
   list of its smallest shared pivot only.  Lists longer than ``BLOCK`` rows are cut
   into pieces and each pair of pieces is a task of its own, so a crowded pivot
   costs more tasks, not a longer one, and no row is left out.
4. **Links.**  Numbers of links are added up with the copies that each
   representative stands for; a task hands a spanning forest of its links to the
   component search, never all pairs of a group.

Defined cases: null, zero, or non-finite vectors, and vectors with null components,
link with nothing and keep themselves; vectors of different lengths never link;
rows with a null vec_id are returned without links and a null component; equal
vec_ids count as rows of their own that share an id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .components import components

COSINE = 0.9
NEAREST, NEAREST_UP_TO = 8, 128
SHARED = 2
#: Pivots are ``PIVOT_RATE * sqrt(rows)``, between the two bounds (4,096 x 64 doubles are 2 MB).
PIVOT_RATE, PIVOTS_LEAST, PIVOTS_MOST = 1.5, 16, 4096
BLOCK = 2000


def usable(docs: DataFrame) -> DataFrame:
    """(vec_id, v, key): v is null for vectors that link with nothing."""
    v = F.col("embedding").cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    d = docs.select("vec_id", F.when(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull(), v).alias("v"))
    return d.withColumn("key", F.sha2(F.array_join("v", ",").cast("binary"), 256))


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)          # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def choose_pivots(reps: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Unit pivots by vector length; a bounded sample of the representatives in hash order."""
    n = int(min(PIVOTS_MOST, max(PIVOTS_LEAST, PIVOT_RATE * count ** 0.5)))
    got: dict[int, list] = {}
    for r in reps.select("key", "v").orderBy("key").limit(n).collect():
        got.setdefault(len(r["v"]), []).append(r["v"])
    return {d: _unit(np.array(v, float).ravel(), len(v)) for d, v in got.items()}


def nearest(pivots: int) -> int:
    """How many nearest pivots describe a vector."""
    return NEAREST + max(0, math.ceil(math.log2(pivots / NEAREST_UP_TO)))


def _entries(pivots):
    """Rows (rep, n, v) into rows (pivot, rep, n, near, v): one for each of a vector's nearest pivots."""
    def build(batches):
        for b in batches:
            size = np.diff(b.column(2).offsets.to_numpy())
            for d in np.unique(size):
                part = b.filter(pa.array(size == d))
                p = pivots.value.get(int(d), np.eye(1, int(d)))
                unit = _unit(_matrix(part.column(2)), part.num_rows)
                near = np.argsort(-(unit @ p.T), axis=1, kind="stable")[:, :nearest(len(p))].astype(np.int32)
                m = near.shape[1]
                row = pa.array(np.repeat(np.arange(part.num_rows), m))
                yield pa.RecordBatch.from_pydict({
                    "pivot": pa.array(near.ravel().astype(np.int64) + (int(d) << 32)), "rep": part.column(0).take(row),
                    "n": part.column(1).take(row), "near": pa.array(list(near), pa.list_(pa.int32())).take(row),
                    "v": part.column(2).take(row)})
    return build


def _pairs(x, near_x, y, near_y, pivot: int, same: bool) -> np.ndarray:
    """Boolean matrix of the linked pairs whose smallest shared pivot is ``pivot``."""
    most = int(max(near_x.max(), near_y.max())) + 1
    a, b = np.zeros((len(x), most), np.float32), np.zeros((len(y), most), np.float32)
    np.put_along_axis(a, near_x, 1, axis=1)
    np.put_along_axis(b, near_y, 1, axis=1)
    ok = a @ b.T >= min(SHARED, near_x.shape[1])
    ok &= a[:, :pivot] @ b[:, :pivot].T == 0
    # Single precision rules out what is clearly below; the rest is verified in double precision.
    ok &= x.astype(np.float32) @ y.astype(np.float32).T >= COSINE - 1e-4
    if same:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    for k in range(0, len(i), 1 << 16):
        s = slice(k, k + (1 << 16))
        ok[i[s], j[s]] = np.einsum("ij,ij->i", x[i[s]], y[j[s]]) >= COSINE
    return ok


def _search(batches):
    """Rows sorted by (pivot, left, right, side): link counts per vector (to itself) and spanning edges (no count)."""
    key, rows, out = None, [], {"id": [], "links": [], "to": []}

    def close():
        if not rows:
            return
        same = key[1] == key[2]
        one = [r for r in rows if r[0] == 0]
        two = one if same else [r for r in rows if r[0] == 1]
        if not one or not two:
            return
        mats = [(np.array([r[1] for r in part]), np.array([r[2] for r in part]), np.array([r[3] for r in part]),
                 _unit(np.concatenate([r[4] for r in part]), len(part))) for part in ((one,) if same else (one, two))]
        (ra, na, pa_, xa), (rb, nb, pb, xb) = mats[0], mats[-1]
        ok = _pairs(xa, pa_, xb, pb, int(key[0] & 0xFFFFFFFF), same)
        left, right = ok @ nb, na @ ok
        for ids, links in ((ra, left), (rb, right)):
            for i in np.flatnonzero(links):
                out["id"].append(int(ids[i]))
                out["links"].append(int(links[i]))
                out["to"].append(int(ids[i]))
        for a, b in _spanning(ok, ra, rb):
            out["id"].append(a)
            out["links"].append(0)
            out["to"].append(b)

    for b in batches:
        head = [b.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5)]
        near, v = b.column(6), b.column(7)
        no, vo = near.offsets.to_numpy(), v.offsets.to_numpy()
        nv, vv = near.values.to_numpy(zero_copy_only=False), v.values.to_numpy(zero_copy_only=False)
        for k, (p, l, r, side, rep, n) in enumerate(zip(*head)):
            if (p, l, r) != key:
                close()
                key, rows = (p, l, r), []
            rows.append((side, rep, n, nv[no[k]:no[k + 1]].astype(np.int64), vv[vo[k]:vo[k + 1]].copy()))
        if len(out["id"]) > 50_000:
            yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in out.items()})
            out = {"id": [], "links": [], "to": []}
    close()
    yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in out.items()})


def _spanning(ok: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Edges of a spanning forest of a block's links, by label propagation over the matrix."""
    names, back = np.unique(np.concatenate([left, right]), return_inverse=True)
    i, j = np.nonzero(ok)
    a, b = back[:len(left)][i], back[len(left):][j]
    label = np.arange(len(names))
    while len(a):
        lo, hi = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = lo < hi
        if not open_.any():
            return
        a, b, lo, hi = a[open_], b[open_], lo[open_], hi[open_]
        _, first = np.unique(hi, return_index=True)
        for k in first:
            yield int(names[lo[k]]), int(names[hi[k]])
        up = np.arange(len(names))
        up[hi[first]] = lo[first]
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def near_vectors(docs: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = docs.sparkSession
    rows = written(usable(docs), "vectors")
    fine = rows.where("v is not null")
    reps = written(fine.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "representatives")
    pivots = spark.sparkContext.broadcast(choose_pivots(reps, reps.count()))     # bounded by PIVOTS_MOST
    # rid: a number of its own for each representative, as vec_ids may repeat
    named = reps.select(F.xxhash64("key").alias("rid"), "n", "v")
    entries = written(named.mapInArrow(_entries(pivots), "pivot long, rep long, n long, near array<int>, v array<double>"), "entries")
    sizes = entries.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pieces"))
    e = entries.join(sizes, "pivot").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int"))
    # Each pair of a list's pieces once: a row goes to (own, j) for j >= own as left, (i, own) for i < own as right.
    e = e.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    e = e.select("pivot", F.least("own", "other").alias("l"), F.greatest("own", "other").alias("r"),
                 (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "n", "near", "v")
    found = written(e.repartition("pivot", "l", "r").sortWithinPartitions("pivot", "l", "r", "side", "rep")
                     .mapInArrow(_search, "id long, links long, to long"), "links")
    links = found.groupBy(F.col("id").alias("rid")).agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("id", "rid")
    ids = reps.select("key", F.xxhash64("key").alias("rid"), "rep", "n").join(links, "rid", "left").join(label, "rid", "left")
    ids = written(ids.withColumn("c", F.coalesce("component", "rid")), "classes")
    least = ids.groupBy("c").agg(F.min("rep").alias("component_id"))
    per = written(ids.join(least, "c").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "per-key")
    out = fine.select("vec_id", "key").join(per, "key").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
