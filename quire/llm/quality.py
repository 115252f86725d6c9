"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network (free style).

1. **Word vectors.**  Every word bucket has a fixed sparse ternary index vector; a
   word's vector is the sum of the index vectors of its neighbours (two on either
   side) over the texts of *all* documents.  Partitions add up integers, so the
   result does not depend on the order of rows; the table has ``BUCKETS * DIM`` cells
   whatever the vocabulary.
2. **Pooling.**  A document is the mean of its words' vectors, the mean over its
   distinct words, the mean of its words' index vectors, the shares of
   words that stand again one to three places on, and three pool sizes.
3. **Network.**  One hidden layer, trained by Adam on a bounded sample of labelled
   documents (``SAMPLE`` rows, those with the least hash of doc_id), then a
   temperature fitted on labelled documents that were kept out of training.

Learning reads labels of documents whose crc32(doc_id as text) mod 4 is not 2
(0 and 1 train, 3 calibrates).  Scores depend on the text alone.

Defined cases: null text counts as empty; an empty text has a zero mean vector
and is scored like any other; a null doc_id is scored and not held out; labels that
are null or without a document teach nothing; without usable labels of both classes
the score is the mean label (0.5 if none); equal texts have equal scores; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.memory import give_back
from . import hashing as H
from .sketch import BLOCK_SCHEMA, dense_blocks, merge_dense

BUCKETS = 1 << 14
DIM = 64
NONZERO = 8
REACH = 2
HIDDEN = 32
#: Labelled documents used for fitting (training and calibration together), at most.
SAMPLE = 12_000
THRESHOLD = 0.7
_POOL_BYTES = 1 << 19
LAGS = (1, 2, 3)
FEATURES = 3 * DIM + len(LAGS) + 3


def index_vectors() -> np.ndarray:
    """(BUCKETS, DIM) of -1, 0, 1 with ``NONZERO`` non-zeros a row; fixed by its seed."""
    rnd = np.random.default_rng(71)
    out = np.zeros((BUCKETS, DIM), np.int8)
    at = np.argsort(rnd.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rnd.choice(np.array([-1, 1], np.int8), (BUCKETS, NONZERO)), axis=1)
    return out


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def context_sums(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM) sums of the neighbours' index vectors over all texts."""
    def build(batches):
        index = index_vectors()
        total = np.zeros((BUCKETS, DIM), np.int64)
        for batch in batches:
            for _, col in H.text_chunks(batch.column(0), _POOL_BYTES):
                h, bounds, _, _ = H.words(col, H.SHAPED)
                if not len(h):
                    continue
                b, row = _buckets(h), H.row_of(bounds)
                v = index[b]
                around = np.zeros((len(b), DIM), np.int8)
                for j in range(1, REACH + 1):
                    around[:-j] += v[j:]
                    around[j:] += v[:-j]
                    over = np.flatnonzero(row[j:] != row[:-j])      # neighbours in another text
                    around[over] -= v[over + j]
                    around[over + j] -= v[over]
                order = np.argsort(b, kind="stable")
                u, first = np.unique(b[order], return_index=True)
                total[u] += np.add.reduceat(around[order], first, axis=0, dtype=np.int32)
        yield dense_blocks(total, 64)
        del index, total
        give_back()
    return merge_dense(docs.select("text").mapInArrow(build, BLOCK_SCHEMA), "int64", (BUCKETS, DIM))


def word_table(sums: np.ndarray) -> np.ndarray:
    """(BUCKETS, 2 DIM): unit context vector beside unit index vector."""
    s = sums.astype(np.float32)
    s /= np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-9)
    return np.hstack([s, index_vectors().astype(np.float32) / np.sqrt(NONZERO)])


def pooled(col: pa.Array, table: np.ndarray) -> np.ndarray:
    """(rows, FEATURES) of a text column."""
    out = [np.zeros((0, FEATURES), np.float32)]
    for _, part in H.text_chunks(col, _POOL_BYTES):
        h, bounds, _, _ = H.words(part, H.SHAPED)
        n = np.diff(bounds)
        f = np.zeros((len(n), FEATURES), np.float32)
        some = np.flatnonzero(n)
        if len(some):
            row = H.row_of(bounds)
            order = np.lexsort((h, row))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(h))).astype(np.float32)
            kinds = np.bincount(row[order[at]], minlength=len(n))
            first = np.concatenate([[0], np.cumsum(kinds)])[some]
            v = table[_buckets(h[order[at]])]                       # one row per distinct word of a text
            f[some, 2 * DIM:3 * DIM] = np.add.reduceat(v[:, :DIM], first, axis=0) / kinds[some, None]
            v *= times[:, None]
            f[some, :2 * DIM] = np.add.reduceat(v, first, axis=0) / n[some, None]
            for j, lag in enumerate(LAGS):
                near = row[lag:] == row[:-lag]
                again = np.bincount(row[lag:], near & (h[lag:] == h[:-lag]), len(n))
                f[:, 3 * DIM + j] = again / np.maximum(np.bincount(row[lag:], near, len(n)), 1)
            f[some, -3] = np.log1p(n[some])
            f[some, -2] = np.log1p(kinds[some])
            f[some, -1] = kinds[some] / n[some]
        out.append(f)
    return np.vstack(out)


@dataclass
class Network:
    """Standardisation, two layers and a temperature; ``constant`` replaces them when nothing could be learnt."""
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        return z @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -60, 60)))


def _nll(z, y, t):
    return float(np.mean(np.logaddexp(0, z / t) - y * z / t))


def train(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3) -> Network:
    """Fit on the rows where ``calibrate`` is False; the temperature on the others."""
    fit = ~calibrate if calibrate.any() and not calibrate.all() else np.ones(len(y), bool)
    if len(set(y[fit].tolist())) < 2:
        return Network(constant=float(y.mean()) if len(y) else 0.5)
    x, y = x.astype(np.float64), y.astype(np.float64)
    rnd = np.random.default_rng(5)
    net = Network(x[fit].mean(0), x[fit].std(0) + 1e-3, rnd.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)),
                  np.zeros(HIDDEN), rnd.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), 0.0)
    s, t = (x[fit] - net.mean) / net.scale, y[fit]
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        order = rnd.permutation(len(t))
        for i in range(0, len(t), 256):
            k = order[i:i + 256]
            z = s[k] @ weights[0] + weights[1]
            a = np.maximum(z, 0)
            d = 1 / (1 + np.exp(-np.clip(a @ weights[2] + weights[3], -60, 60))) - t[k]
            back = np.outer(d, weights[2]) * (z > 0)
            n = len(k)
            grads = [s[k].T @ back / n + decay * weights[0], back.mean(0), a.T @ d / n + decay * weights[2], d.mean(keepdims=True)]
            step += 1
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                weights[j] -= rate * (m[j] / (1 - 0.9 ** step)) / (np.sqrt(v[j] / (1 - 0.999 ** step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    z, t = net.logits(x[~fit] if (~fit).any() else x[fit]), y[~fit] if (~fit).any() else y[fit]
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 241))
    net.temperature = float(grid[int(np.argmin([_nll(z, t, g) for g in grid]))])
    return net


def _remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(word table, network) from all texts and a bounded sample of labels."""
    table = word_table(context_sums(docs))
    lab = (labels.where("doc_id is not null and quality in (0, 1)").where(_remainder(F.col("doc_id")) != 2)
                 .select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
                 .orderBy(F.xxhash64("id"), "id", "y").limit(sample))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    # The sample has at most `sample` rows of 12 bytes.
    rows = docs.select("doc_id", "text").join(F.broadcast(lab), F.col("doc_id") == F.col("id")).select("id", "y", "text")

    def features(batches):
        for b in batches:
            x = pooled(b.column(2), shared.value)
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "y": b.column(1),
                                              "x": pa.array([r.tobytes() for r in x], pa.binary())})
        give_back()
    got = sorted((r["id"], r["y"], bytes(r["x"])) for r in rows.mapInArrow(features, "id long, y int, x binary").collect())
    x = np.array([np.frombuffer(b, np.float32) for _, _, b in got], np.float32).reshape(-1, FEATURES)
    y = np.array([q for _, q, _ in got], int)
    calibrate = np.array([zlib.crc32(str(i).encode()) % 4 == 3 for i, _, _ in got], bool)
    return shared, train(x, y, calibrate)


def scored(text: Column, model) -> Column:
    """Score of a text column: probability of a good label, 0 to 1."""
    shared, net = model

    @F.arrow_udf("double")
    def run(col: pa.Array) -> pa.Array:
        out = pa.array(np.concatenate([net.score(pooled(col.slice(i, 2000), shared.value)) for i in range(0, len(col), 2000)]
                                      or [np.zeros(0)]))
        give_back()
        return out
    return run(text)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels, sample)
    d = docs.select("doc_id", scored(F.col("text"), model).alias("score"))
    return d.select("doc_id", F.coalesce(_remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    model = fit(docs, labels, sample)
    rows = docs.select(F.struct(*docs.columns).alias("row"), scored(F.col("text"), model).alias("score"))
    return rows.where(F.col("score") >= THRESHOLD).select("row.*")
