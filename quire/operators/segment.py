"""Segmentation of texts into marked segments, and the segment loader.

Rule (a line state machine in the reference, reduced to a local test): after
stripping the text and cutting it into lines, a whitespace-only line whose
three preceding lines are all non-blank "closes" a paragraph of three or more
lines.  A closer is replaced by END + START; every other line is kept
verbatim.  The whole text is wrapped in START ... END.

The rule only looks three lines back, so it is computed with array
higher-order functions inside one row: no explode, no window, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T


def mark_segments_col(text: Column, start: str = C.START_MARKER,
                      end: str = C.END_MARKER) -> Column:
    def mark(stripped):
        def per_lines(lines):
            def per_flags(blank):
                def closer(i):
                    return (F.get(blank, i) & (i >= 3) & ~F.get(blank, i - 1)
                            & ~F.get(blank, i - 2) & ~F.get(blank, i - 3))
                return F.transform(lines, lambda l, i: F.when(closer(i), F.lit(f"{end}\n{start}"))
                                   .otherwise(l))
            return T.bind(F.transform(lines, lambda l: T.is_blank(l)), per_flags)

        marked = T.bind(T.split_lines(stripped), per_lines)
        return (F.when(stripped == "", F.lit(f"{start}\n{end}\n"))
                .otherwise(F.concat(F.lit(f"{start}\n"), F.array_join(marked, "\n"),
                                    F.lit(f"\n{end}\n"))))

    return T.bind(T.py_strip(text), mark)


def mark_segments(df: DataFrame, text_col: str = "text", out_col: str = "segmented",
                  start: str = C.START_MARKER, end: str = C.END_MARKER) -> DataFrame:
    """WIN1/WIN2/PRJ2/PRJ3/AGG3: add the marked text of each document."""
    return df.withColumn(out_col, mark_segments_col(F.col(text_col), start, end))


def load_segments(df: DataFrame, key_col: str, text_col: str = "segmented",
                  start: str = C.START_MARKER) -> DataFrame:
    """PRJ4: split marked texts on START, drop blank pieces, strip, re-prefix START.

    The END marker is not removed (a START/END-only segment is kept), and text
    before the first START becomes a segment of its own.
    """
    pieces = F.split(F.col(text_col), T.quote_regex(start), -1)
    kept = F.filter(pieces, lambda p: ~T.is_blank(p))
    return (df.select(key_col, F.posexplode(kept).alias("seg_id", "piece"))
              .select(key_col, F.col("seg_id").cast("long").alias("seg_id"),
                      F.concat(F.lit(start + "\n"), T.py_strip(F.col("piece"))).alias("body")))


def skip_processed(df: DataFrame, name_col: str = "file_name") -> DataFrame:
    """PRJ1: inputs whose name contains 'segmented' were already processed."""
    return df.where(~F.col(name_col).contains("segmented"))


def segmented_name(name: Column) -> Column:
    """SNK1 naming: X.txt -> X_segmented.txt (every occurrence, like str.replace)."""
    return F.replace(name, F.lit(".txt"), F.lit("_segmented.txt"))


def conversation_scripts(conversations: DataFrame) -> DataFrame:
    """Derive a play script per conversation: ``ROLE.\\n`` + text, turns joined by a
    blank line in turn order (AGG3: ordered concatenation, never bare collect_list)."""
    piece = F.concat(F.upper("role"), F.lit(".\n"), F.col("text"))
    return (conversations
            .groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("turn"), piece.alias("p"))))
                 .alias("turns"))
            .select("conv_id", F.array_join(F.transform("turns", lambda t: t["p"]), "\n\n")
                    .alias("text")))
