"""Add vectors to the IVF lists as they arrive (and S7: metric samples appended by a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quiver.operators.ivf import IVFIndex, ivf_add
from quiver.streaming.sources import idempotent_batch_writer


def ivf_ingest_stream(index: IVFIndex, stream: DataFrame, lists_path: str, checkpoint: str,
                      id_col: str = "vec_id", vec_col: str = "embedding", available_now: bool = True,
                      keep_cols: list[str] | None = None) -> StreamingQuery:
    """Each micro-batch is assigned to lists by the index metric and appended under
    ``lists/cluster_id=*/batch_id=*``; replays overwrite their own batch.  ``keep_cols``
    (e.g. the metadata map) are stored with the vectors."""
    write = idempotent_batch_writer(lists_path, ["cluster_id"])

    def handle(batch: DataFrame, epoch_id: int) -> None:
        write(ivf_add(index, batch, id_col=id_col, vec_col=vec_col, keep_cols=keep_cols), epoch_id)

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def metrics_append_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """S7 as a stream: the file sink commits each batch once through its log."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)
