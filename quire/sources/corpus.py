"""Corpus scans and sinks (SRC1, SRC2, SNK1, SNK2).

Corpora are folders of ``*.txt`` files, one text per file; every later stage
reads and writes Parquet.
"""

from __future__ import annotations

import os
import re
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segment as SEG


#: Folder column of the files that ``write_corpus_dir`` writes by itself.
TASK = "writer_task"

_PLAIN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._~-]*")


def _file_name(name: str | None) -> str:
    """A file's name for a text's: plain names stay, others are escaped behind an equals sign.

    Escapes begin with that sign too, as ``_metadata.file_name`` would escape a percent sign once more."""
    if name is None:
        return "=null.txt"
    return f"{name}.txt" if _PLAIN.fullmatch(name) else f"={quote(name, safe='').replace('%', '=')}.txt"


def _text_name(file_name: Column) -> Column:
    escaped = F.replace(F.substr(file_name, F.lit(2)), F.lit("="), F.lit("%"))
    return F.when(file_name == "=null.txt", F.lit(None)).when(file_name.startswith("="), F.url_decode(escaped)).otherwise(file_name)


def _write_files(df: DataFrame, folder: str) -> None:
    """Rows (name, text) as ``writer_task=<task>/<name>.txt`` below ``folder``, which all machines see.

    As with Spark's writer, rows of one task with equal names are lines of one file.  A file gets
    its name when it is whole, and a repeated task writes the same files again.
    """
    def write(batches):
        task, rows = TaskContext.get(), 0
        to = f"{folder}/{TASK}={task.partitionId()}"
        part, name, out = f"{to}/.{task.taskAttemptId()}", None, None
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if out is None or k != name:
                    if out is None:
                        os.makedirs(to, exist_ok=True)
                    else:
                        out.close()
                        os.replace(part, f"{to}/{_file_name(name)}")
                    name, out = k, open(part, "wb")
                out.write(f"{text or ''}\n".encode())
            rows += b.num_rows
        if out is not None:
            out.close()
            os.replace(part, f"{to}/{_file_name(name)}")
        yield pa.RecordBatch.from_pydict({"n": pa.array([rows], pa.int64())})
    df.sortWithinPartitions(df.columns[0]).mapInArrow(write, "n long").agg(F.sum("n")).collect()    # one row


def write_corpus_dir(df: DataFrame, path: str, name_col: str, text_col: str) -> None:
    """A folder of text files, one per name, for ``read_corpus_dir``.

    In a mounted folder (file:) the tasks write ``writer_task=<task>/<name>.txt`` themselves: Spark's writer
    makes a folder per text, which is slow to write there, and each is listed by a task of its own.
    Elsewhere Spark writes ``file_name=<name>.txt/part-*.txt``.
    """
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        if fs.exists(at):
            raise FileExistsError(path)
        fs.mkdirs(at)
        _write_files(df.select(F.col(name_col).cast("string").alias("name"), text_col), fs.makeQualified(at).toUri().getPath())
        return
    (df.select(F.concat(F.col(name_col).cast("string"), F.lit(".txt")).alias("file_name"), text_col)
       .write.partitionBy("file_name").text(path))


def read_corpus_dir(spark: SparkSession, path: str, skip_processed: bool = True) -> DataFrame:
    """SRC1 (+PRJ1): every ``*.txt`` file under ``path`` as one row (file_name, text); names
    come from ``file_name=...`` folders where there are any.

    Python reads text files with universal newlines, so CR LF and CR become LF."""
    # wholetext goes to text() itself: its default would override an .option()
    df = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    name = F.col("file_name") if "file_name" in df.columns else F.col("_metadata.file_name")
    if TASK in df.columns:
        name = _text_name(name)
    df = df.select(name.cast("string").alias("file_name"),
                   F.regexp_replace("value", r"\r\n?", "\n").alias("text"))
    return SEG.skip_processed(df) if skip_processed else df


def write_segmented(df: DataFrame, path: str, name_col: str = "file_name",
                    text_col: str = "segmented") -> None:
    """SNK1: one row per input, named X_segmented.txt after X.txt."""
    (df.select(SEG.segmented_name(F.col(name_col)).alias("file_name"),
               F.col(text_col).alias("text"))
       .write.mode("overwrite").parquet(path))


def write_splits(df: DataFrame, path: str) -> None:
    """SNK2: one row per segment, partitioned by split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, splits=("test", "train", "val")) -> DataFrame:
    """SRC2: the named splits (partition pruning on ``split``)."""
    return spark.read.parquet(path).where(F.col("split").isin(list(splits)))


def split_text_lines(df: DataFrame, body_col: str = "body") -> DataFrame:
    """The text a split file would hold, as rows: segments joined by a newline means
    every segment but the last of a file ends with one; tokenizer training sees
    each line with its newline (SRC2)."""
    return df.select(F.concat(F.col(body_col), F.lit("\n")).alias("text"))
