"""Starting streams: drain what is there, write tables, score, tee."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from flowloom.operators.learn import score
from flowloom.operators.report import detection_report
from flowloom.operators.packets import MAX_TS_MS
from flowloom.schemas import PACKET_SCHEMA
from flowloom.session import ROCKSDB_PROVIDER
from flowloom.sources.sinks import Sink, tee

END_CAPTURE = "__end__"


def packet_stream(
    spark: SparkSession, path: str, like: DataFrame, files_per_batch: int | None = None
) -> DataFrame:
    """Files landing in a folder as a stream, with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def with_end_marks(packets: DataFrame, folder: str) -> DataFrame:
    """A packet stream joined by the end marks of a folder (see :func:`finish`)."""
    spark = packets.sparkSession
    spark.createDataFrame([], PACKET_SCHEMA).write.mode("append").parquet(folder)
    return packets.unionByName(spark.readStream.schema(PACKET_SCHEMA).parquet(folder))


def mark_end(spark: SparkSession, folder: str) -> None:
    """Put a packet with the last valid time into the folder.

    It moves the watermark past all flows; its own conversation stays open and
    is never written. Packets that come later are late.
    """
    row = (END_CAPTURE, 0, MAX_TS_MS, "0.0.0.0", "0.0.0.0", 0, 0, "UDP", 0, 0, None)
    spark.createDataFrame([row], PACKET_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def finish(spark: SparkSession, start: Callable[[], StreamingQuery], folder: str) -> None:
    """Drain, mark the end and drain again: flows that are still open are written, once.

    ``start`` starts an available-now query whose packets come from
    :func:`with_end_marks` with this folder. Safe to call again after a failure.
    """
    drain(start())
    mark_end(spark, folder)
    drain(start())


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def write_stream(
    flows: DataFrame, path: str, checkpoint: str, kind: str = "parquet", once: bool = True
) -> StreamingQuery:
    """Append closed flows to a folder. The checkpoint makes a restart resume.

    ``once`` processes what is there and stops; flows still open stay in the
    state until a later packet or :func:`finish` moves the watermark.
    """
    writer = flows.writeStream.outputMode("append").format(kind)
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    if kind == "csv":
        writer = writer.option("header", True)
    return (writer.trigger(availableNow=True) if once else writer).start()


def drain(query: StreamingQuery, seconds: int | None = None) -> None:
    """Wait for an available-now stream; safe to call again."""
    query.awaitTermination(seconds)


def write_both(
    flows: DataFrame,
    checkpoint: str,
    write_main: Sink,
    write_extra: Callable[[DataFrame, int], object],
    once: bool = True,
) -> StreamingQuery:
    """Each micro-batch to two sinks; the second is best effort.

    A batch may be replayed: the main sink must replace it (``sinks.folder_sink``).
    """
    writer = flows.writeStream.foreachBatch(tee(write_main, write_extra))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def score_stream(model: PipelineModel, flows: DataFrame, time_text: str = "stream") -> DataFrame:
    """Detection report of streamed flows; a stream has no overall time range."""
    scored = score(model, flows).withColumnRenamed("prediction", "model_class")
    return detection_report(scored, prediction="model_class", time_text=time_text)
