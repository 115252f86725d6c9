"""Looking up array elements in a table that is too large to be carried to the tasks.

Rows are numbered into blocks of about ``BLOCK_ELEMENTS`` elements and written once.
Each block asks for its distinct elements only, the answers are joined once per block
and element, and a block's rows meet its answers in one task.  Neither a row's
elements nor its pairs are shuffled one by one, and no group is larger than a block
(or than one row).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StructField, StructType

from ..session import written

#: Elements of one block, about.
BLOCK_ELEMENTS = 1 << 21
_BLOCK, _ELEMENT, _VALUE = "_block", "_element", "_value"


def _lengths(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def with_offsets(lists: pa.Array, values: pa.Array) -> pa.Array:
    """``values`` cut into lists as long as those of ``lists``; a null list becomes an empty one."""
    n = np.concatenate([[0], np.cumsum(_lengths(lists))])
    return pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), values)


#: Elements that an in-place lookup works on at once, about.
CHUNK_ELEMENTS = 1 << 20


def pieces_of(sizes: pa.Array, most: int):
    """(first, end) of runs of rows whose sizes add up to ``most``, about; a run has one row at least."""
    total = np.concatenate([[0], np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at, n = 0, len(sizes)
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1))
        yield at, to
        at = to


def list_chunks(lists: pa.Array):
    """Slices of about ``CHUNK_ELEMENTS`` elements, or of one row: a batch has many long rows at times."""
    for first, end in pieces_of(lists.value_lengths(), CHUNK_ELEMENTS):
        yield lists.slice(first, end - first)


def blocked(df: DataFrame, list_col: str, size: int = BLOCK_ELEMENTS) -> DataFrame:
    """The rows with a block number, written: neighbours of a partition share a block of about ``size`` elements."""
    schema = StructType([*df.schema.fields, StructField(_BLOCK, LongType())])
    at = df.columns.index(list_col)

    def number(batches):
        before = 0
        for b in batches:
            ends = before + np.cumsum(_lengths(b.column(at)) + 1)       # an empty row counts as well
            block = (TaskContext.get().partitionId() << 33) + np.concatenate([[before], ends[:-1]]) // size
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block[:b.num_rows], pa.int64())], [*b.schema.names, _BLOCK])
    return written(df.mapInArrow(number, schema), "blocks")


def look_up(df: DataFrame, list_col: str, answer: Callable[[DataFrame], DataFrame], out: str, out_type: DataType,
            size: int = BLOCK_ELEMENTS) -> DataFrame:
    """``df`` with an array ``out`` of the values of the elements of ``list_col``, null where there is none.

    ``answer`` gets the elements asked for, (_block, _element), some of them twice, and returns (_block,
    _element, _value), equal values for equal elements.  Null arrays give empty ones; every row comes back.
    """
    rows = blocked(df, list_col, size)
    element = df.schema[list_col].dataType.elementType

    def ask(batches):
        for b in batches:
            lists = b.column(1)
            t = pa.table({_BLOCK: b.column(0).take(pa.array(np.repeat(np.arange(len(lists)), _lengths(lists)))), _ELEMENT: lists.flatten()})
            yield from t.group_by([_BLOCK, _ELEMENT]).aggregate([]).select([_BLOCK, _ELEMENT]).to_batches()
    asked = rows.select(_BLOCK, list_col).mapInArrow(ask, StructType([StructField(_BLOCK, LongType()), StructField(_ELEMENT, element)]))
    # asked twice only where a batch ends inside a block: not worth a shuffle, and equal answers do no harm
    found = answer(asked).select(_BLOCK, _ELEMENT, _VALUE)

    def send_back(mine: pa.Table, answers: pa.Table) -> pa.Table:
        lists = mine.column(list_col).combine_chunks()
        values = answers.column(_VALUE).combine_chunks().take(
            pc.index_in(lists.flatten(), value_set=answers.column(_ELEMENT).combine_chunks()))
        return mine.drop_columns([_BLOCK]).append_column(out, with_offsets(lists, values))
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(out_type))])
    return rows.groupBy(_BLOCK).cogroup(found.groupBy(_BLOCK)).applyInArrow(send_back, schema)
