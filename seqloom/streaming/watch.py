"""Sequences that grow: files as a stream, and row-local steps on them.

wait-for-update is a streaming read of a folder: each new file is a document,
once. Steps that look at one document only run on every batch as they do on a
table; steps that need the order or the number of all documents are refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.functions.errors import PipelineError

#: Steps of operators.sequence that need the whole sequence.
WHOLE = frozenset({"count", "count_each", "split_sequence", "wrap_sequence", "pack", "compare", "concat", "iterate", "flatten", "adjacent_runs", "with_position"})


def watch(spark: SparkSession, folder: str, pattern: str = "*.xml", max_files: int = 1000) -> DataFrame:
    """New files of a folder as a stream of documents; pos is a hash of the path, for files come in no order."""
    stream = spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).format("text").load(folder)
    return stream.select(F.lit(0).cast("bigint").alias("iter"), F.xxhash64(F.col("_metadata.file_path")).alias("pos"), F.col("_metadata.file_path").alias("base_uri"), F.col("value").alias("doc"))


def refuse_whole(step: Callable) -> None:
    """Raise for a step that cannot run on an unbounded sequence."""
    if getattr(step, "__name__", "") in WHOLE:
        raise PipelineError("XD0012", f"{step.__name__} needs the whole sequence and cannot run on a stream")


def run(stream: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], out: str, checkpoint: str, once: bool = False, interval: str = "1 second") -> StreamingQuery:
    """Run row-local steps on every batch and append the documents to Parquet files.

    A batch that is run again after a failure writes to its own folder again,
    so each document is in the output once.
    """
    for step in steps:
        refuse_whole(step)

    def batch(rows: DataFrame, number: int) -> None:
        for step in steps:
            rows = step(rows)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def counts(stream: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of a stream by key and time window, with rows later than `late` dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
