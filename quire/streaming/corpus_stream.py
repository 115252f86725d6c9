"""Incremental corpus segmentation with Structured Streaming.

The reference has no streaming.  Segmentation is per document with no state,
so new ``*.txt`` files dropped into a folder can be marked as they arrive:
file source -> marked text -> Parquet sink, exactly once via the checkpoint.
(The windowed operators need row windows that a stream rejects; they run on
the written table instead.)
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import segment as SEG


def segment_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                   available_now: bool = True):
    src = (spark.readStream.format("text").option("wholetext", True)
                .option("pathGlobFilter", "*.txt").load(in_dir)
                .select(F.col("_metadata.file_name").alias("file_name"),
                        F.regexp_replace("value", r"\r\n?", "\n").alias("text")))
    marked = SEG.mark_segments(SEG.skip_processed(src))
    out = marked.select(SEG.segmented_name(F.col("file_name")).alias("file_name"), "segmented")
    w = (out.writeStream.format("parquet").option("path", out_dir)
            .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
