"""Token-stream sinks and scans (SNK3, SRC3) and tokenizer tables (SNK4, SRC4).

The stream is stored as chunk rows ``(split, start, ids array<int>)``:
partitioned by split, ids range-checked against uint16 at write time, and
min/max statistics on ``start`` let a reader prune row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as WIN
from ..operators.bpe import BpeModel

CHUNK = 4096
UINT16_LIMIT = 65536


def to_chunks(stream: DataFrame, chunk: int = CHUNK, split_col: str = "split") -> DataFrame:
    """A stream of document rows (split, offset, ids) as fixed-size chunk rows (split, start, ids)."""
    # the check is part of the ids expression itself, so column pruning keeps it
    fits = F.forall("ids", lambda i: (i >= 0) & (i < UINT16_LIMIT))
    checked = stream.withColumn("ids", F.when(fits, F.col("ids")).otherwise(
        F.raise_error(F.lit("token id outside uint16")).cast("array<int>")))
    return WIN.chunks(checked, chunk, split_col)


def write_token_stream(stream: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """SNK3: chunked token stream, one directory per split."""
    (to_chunks(stream, chunk).sortWithinPartitions("split", "start")
        .write.mode("overwrite").partitionBy("split").parquet(path))


def read_token_stream(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """SRC3: the chunks (split, offset, ids) of one split (partition pruned) or all; a stream
    that the window operators read as it is."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df.select("split", F.col("start").alias("offset"), "ids")


#: Bytes of a legacy file that one task reads, about; bytes read at once.
TASK_BYTES, READ_BYTES = 64 << 20, 4 << 20


def _uint16_source():
    """A Python data source for headerless files of 16-bit ids: byte ranges of the files are the tasks.

    Defined in a function, so that it travels to the workers by value."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    def opened(path: str):
        import re

        from pyarrow import fs
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if "://" in path or path.startswith("file:") else "file://" + path)

    class Uint16Reader(DataSourceReader):
        def __init__(self, options):
            self.path, self.chunk, self.task = options["path"], int(options["chunk"]), int(options["task"])

        def partitions(self):
            from pyarrow import fs
            system, root = opened(self.path)
            files = [f for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and f.path.endswith(".bin")]
            odd = [f.path for f in files if f.size % 2]
            if odd:
                raise ValueError(f"not a whole number of 16-bit ids: {odd[0]}")
            step = max(1, self.task // (2 * self.chunk)) * 2 * self.chunk       # whole chunks
            return [InputPartition((f.path, at, min(step, f.size - at))) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, step)]

        def read(self, partition):
            import numpy as np
            import pyarrow as pa
            path, at, length = partition.value
            split, end = path.rsplit("/", 1)[-1][:-4], at + length
            most = max(1, READ_BYTES // (2 * self.chunk)) * 2 * self.chunk
            with opened(self.path)[0].open_input_file(path) as f:
                f.seek(at)
                while at < end:
                    ids = np.frombuffer(f.read(min(most, end - at)), "<u2").astype(np.int32)
                    first = np.append(np.arange(0, len(ids), self.chunk), len(ids))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([split] * (len(first) - 1)), pa.array(at // 2 + first[:-1]), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))],
                        ["split", "start", "ids"])
                    at += 2 * len(ids)

    class Uint16Source(DataSource):
        @classmethod
        def name(cls):
            return "uint16_tokens"

        def schema(self):
            return "split string, start long, ids array<int>"

        def reader(self, schema):
            return Uint16Reader(self.options)
    return Uint16Source


def import_uint16_bins(spark: SparkSession, path: str, chunk: int = CHUNK, task_bytes: int = TASK_BYTES) -> DataFrame:
    """SRC3 for legacy headerless little-endian uint16 ``*.bin`` files (one per split, named
    ``<split>.bin``), as chunk rows (split, start, ids).  Files of any size are read in ranges of whole chunks, one
    per task; an empty file has no rows."""
    spark.dataSource.register(_uint16_source())
    return spark.read.format("uint16_tokens").option("chunk", chunk).option("task", task_bytes).load(path)


def save_bpe(model: BpeModel, spark: SparkSession, path: str) -> None:
    """SNK4: vocabulary and merge tables."""
    model.vocab_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
    model.merges_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")


def load_bpe(spark: SparkSession, path: str) -> BpeModel:
    """SRC4: a model back from its tables (bounded by the vocabulary size)."""
    return BpeModel.from_tables(spark.read.parquet(f"{path}/vocab"),
                                spark.read.parquet(f"{path}/merges"))


def model_table(model: BpeModel, spark: SparkSession) -> DataFrame:
    """SNK4 as one table: vocabulary entries with the rank, parts and pair count of the
    merges that made them."""
    made = {}
    for k, (l, r, o) in enumerate(model.merges):
        made.setdefault(o, []).append((k, l, r, model.counts[k] if k < len(model.counts) else 0))
    rows = [(i, bytes(t), i < len(model.specials), [list(m) for m in made.get(i, [])]) for i, t in enumerate(model.tokens)]
    return spark.createDataFrame(rows, "id int, token binary, special boolean, merges array<array<long>>")


def model_from_table(table: DataFrame) -> BpeModel:
    """SRC4 from ``model_table`` (bounded by the vocabulary size)."""
    rows = sorted(table.collect(), key=lambda r: r.id)
    merges = sorted((k, l, r, row.id, n) for row in rows for k, l, r, n in row.merges)
    return BpeModel([bytes(r.token).decode("utf-8") for r in rows if r.special], [bytes(r.token) for r in rows],
                    [(l, r, o) for _, l, r, o, _ in merges], counts=[m[4] for m in merges])
