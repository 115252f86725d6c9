"""Count sketches built per partition and merged over the cluster.

A partition adds its counts into a fixed-size array and hands out its blocks;
Spark sums equal blocks in two steps (by block and a salt of the partition,
then by block), streaming over the copies: a task holds one block, however many
partitions there are.  Only the merged array reaches the driver; its size is a
parameter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partitions merged in one task of the first step.
FAN_IN = 64

BLOCK_SCHEMA = "block int, part long, data binary"


def dense_blocks(counts: np.ndarray, n_blocks: int):
    """An array as block rows; ``counts`` is cut along its first axis."""
    part = TaskContext.get().partitionId()
    pieces = np.array_split(counts, n_blocks)
    return pa.RecordBatch.from_pydict({
        "block": pa.array(range(n_blocks), pa.int32()),
        "part": pa.array([part] * n_blocks, pa.int64()),
        "data": pa.array([zlib.compress(np.ascontiguousarray(p).tobytes(), 1) for p in pieces], pa.binary())})


def _block(key: tuple, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int64()),
                                       "data": pa.array([data], pa.binary())})


def _summed(dtype: str):
    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column("data"):
                x = np.frombuffer(zlib.decompress(v.as_buffer()), dtype)
                total = x.copy() if total is None else total + x
        yield _block(key, zlib.compress(total.tobytes(), 1))
    return add


def merge_dense(rows: DataFrame, dtype: str, shape: tuple) -> np.ndarray:
    """Sum the block rows of all partitions into one array on the driver (its size is fixed)."""
    add = _summed(dtype)
    first = (rows.groupBy("block", F.expr(f"part div {FAN_IN}").alias("salt"))
                 .applyInArrow(add, BLOCK_SCHEMA))
    merged = first.groupBy("block").applyInArrow(add, BLOCK_SCHEMA)
    got = sorted((r["block"], bytes(r["data"])) for r in merged.select("block", "data").collect())
    if not got:
        return np.zeros(shape, dtype)
    return np.concatenate([np.frombuffer(zlib.decompress(d), dtype) for _, d in got]).reshape(shape)


# ---- count-min sketch in sparse form -------------------------------------------------------

class RepeatSketch:
    """Which hashes may occur in two or more rows: a count-min sketch of ``depth`` rows.

    A partition writes only the cells it touched (sorted, as differences), with
    one bit for cells it counted twice.  Merging adds the counts up; what is
    kept of them is whether a cell reached two.  An estimate is the least of a
    hash's cells, so it is never below the true count.
    """

    def __init__(self, bits: int = 26, depth: int = 3, shards: int = 32):
        """``shards``: blocks of each of the ``depth`` rows, a power of two."""
        self.bits, self.depth, self.shards = bits, depth, shards
        self.width = (1 << bits) // shards

    def cells(self, h: np.ndarray) -> np.ndarray:
        """(depth, n) cell numbers; each depth has its own 2**bits cells."""
        low = h & np.uint64((1 << 32) - 1)
        high = h >> np.uint64(32)
        out = np.empty((self.depth, len(h)), np.int64)
        for d in range(self.depth):
            x = (low * np.uint64(2 * d + 1) + high * np.uint64(2 * d * d + 3 * d + 7)) & np.uint64((1 << 32) - 1)
            x = (x * np.uint64(0x9E3779B1)) & np.uint64((1 << 32) - 1)
            out[d] = (x >> np.uint64(32 - self.bits)).astype(np.int64) + (d << self.bits)
        return out

    def partition_rows(self, hashes: list[np.ndarray]):
        """The sketch of one partition; each array holds the hashes of whole rows, distinct within a row."""
        h, c = np.unique(np.concatenate(hashes), return_counts=True) if hashes else (np.zeros(0, np.uint64), np.zeros(0, int))
        cells = self.cells(h)
        part = TaskContext.get().partitionId()
        width = self.width
        blocks, data = [], []
        for d in range(self.depth):
            x = cells[d]
            order = np.argsort(x, kind="stable")
            x, n = x[order], c[order]
            u, first = np.unique(x, return_index=True)
            many = np.add.reduceat(n, first) > 1 if len(u) else np.zeros(0, bool)
            for b in range(d * self.shards, (d + 1) * self.shards):
                lo, hi = np.searchsorted(u, (b * width, (b + 1) * width))
                if lo < hi:
                    blocks.append(b)
                    data.append(_pack(u[lo:hi] - b * width, many[lo:hi]))
        return pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int32()),
                                           "part": pa.array([part] * len(blocks), pa.int64()),
                                           "data": pa.array(data, pa.binary())})

    def merge(self, rows: DataFrame) -> np.ndarray:
        """Bitmap of the cells that reached a count of two (fixed size: depth * 2**bits / 8 bytes)."""
        width = self.width

        def joined(batches):
            seen, twice = np.zeros(width, bool), np.zeros(width, bool)
            for b in batches:
                for v in b.column("data"):
                    x, many = _unpack(v.as_py())
                    twice[x] |= seen[x] | many
                    seen[x] = True
            return seen, twice

        def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, twice = joined(batches)
            x = np.flatnonzero(seen)
            yield _block(key, _pack(x, twice[x]))

        def last(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = np.flatnonzero(joined(batches)[1])
            yield _block(key, _pack(x, np.ones(len(x), bool)))

        first = (rows.groupBy("block", F.expr(f"part div {FAN_IN}").alias("salt"))
                     .applyInArrow(join, BLOCK_SCHEMA))
        merged = first.groupBy("block").applyInArrow(last, BLOCK_SCHEMA)
        bits = np.zeros((self.depth << self.bits) // 8, np.uint8)
        for r in merged.select("block", "data").toLocalIterator():
            x, _ = _unpack(bytes(r["data"]))
            x = x + r["block"] * width
            np.bitwise_or.at(bits, x >> 3, (1 << (x & 7)).astype(np.uint8))
        return bits

    def repeated(self, bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
        """True where the estimate is two or more."""
        out = np.ones(len(h), bool)
        cells = self.cells(h)
        for d in range(self.depth):
            x = cells[d]
            out &= (bitmap[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _pack(x: np.ndarray, flag: np.ndarray) -> bytes:
    """Sorted numbers as byte-split differences, then one flag bit each."""
    d = np.diff(x, prepend=0).astype("<u4")
    raw = d.view(np.uint8).reshape(-1, 4).T.tobytes() + np.packbits(flag).tobytes()
    return len(x).to_bytes(4, "little") + zlib.compress(raw, 1)


def _unpack(b: bytes):
    n = int.from_bytes(b[:4], "little")
    raw = np.frombuffer(zlib.decompress(b[4:]), np.uint8)
    d = np.ascontiguousarray(raw[:4 * n].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(d.astype(np.int64)), np.unpackbits(raw[4 * n:], count=n).astype(bool)
