"""File-stream helpers: staging a table as an ordered series of files, and exactly-once batch sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def stage_files(df: DataFrame, path: str, chunk: Column, chunks: list, fmt: str = "parquet") -> str:
    """Write ``df`` into ``path`` one chunk at a time, in the given order.

    A file stream source picks files up oldest first, so the chunks arrive as
    successive micro-batches in this order (e.g. days of an event table).
    """
    for c in chunks:
        part = df.where(chunk == c)
        part.write.mode("append").format(fmt).save(path)
    return path


def idempotent_batch_writer(path: str, partition_cols: list[str], fmt: str = "parquet"):
    """foreachBatch writer: each epoch lands in its own ``batch_id`` partitions and a replayed
    epoch overwrites exactly those (dynamic partition overwrite), so retries never duplicate rows."""
    from pyspark.sql import functions as F

    def write(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():              # no-data batches (timeouts, watermarks) write nothing
            return
        (batch.withColumn("batch_id", F.lit(epoch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*partition_cols, "batch_id").format(fmt).save(path))

    return write
