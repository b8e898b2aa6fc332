"""Late packets: counted, kept apart, and worked into the flows they belong to.

A first stream deals each micro-batch to two tables of the shared folder before
any state is touched: packets whose session may have closed, by the times of the
batches before, are late; all others are on time. The flow stream reads the
on-time table. Its watermark never passes that of the split, since it reads the
same packets in the same order and no later ones first, so it drops nothing, and
the late table holds every packet that a plain stream would have dropped.

Late packets belong to conversations whose flows are written already. The repair
builds the flows of just those conversations again, from all their packets, and
puts them in the place of the old ones.

Packets that are no part of any flow (time or protocol) are neither late nor on
time; they move no watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.operators.packets import FLOW_KEY, valid_packets, with_flow_key
from flowloom.operators.sessions import IDLE_TIMEOUT_MS
from flowloom.schemas import PACKET_SCHEMA
from flowloom.streaming.sessions import session_flows

LATE_DDL = "batch bigint, watermark_ms bigint, behind_ms bigint"


def _folder(base: str, table: str, batch_id: int) -> str:
    return f"{base}/{table}/batch-{batch_id:012d}"


def split_late(
    packets: DataFrame,
    base: str,
    delay_ms: int = 600_000,
    timeout_ms: int = IDLE_TIMEOUT_MS,
    once: bool = True,
) -> StreamingQuery:
    """Deal a packet stream to ``base/on_time`` and ``base/late``, a folder per micro-batch.

    The watermark of a batch is the latest packet of all batches before, less the
    delay. A batch that is replayed after a failure replaces its folders, so let the
    flow stream read them when this one has drained.
    """

    def deal(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = valid_packets(batch).persist()
        latest = None
        if batch_id:
            latest = spark.read.parquet(_folder(base, "latest", batch_id - 1)).first()["latest_ms"]
        watermark = F.lit(None if latest is None else latest - delay_ms).cast("bigint")
        behind = watermark - F.col("ts_ms") - timeout_ms
        is_late = F.coalesce(behind >= 0, F.lit(False))
        named = [F.col(c) for c in PACKET_SCHEMA.fieldNames()]
        rows.filter(~is_late).select(*named).write.mode("overwrite").parquet(_folder(base, "on_time", batch_id))
        rows.filter(is_late).select(
            *named, F.lit(batch_id).cast("bigint").alias("batch"), watermark.alias("watermark_ms"), behind.alias("behind_ms")
        ).write.mode("overwrite").parquet(_folder(base, "late", batch_id))
        so_far = F.greatest(F.max("ts_ms"), F.lit(latest).cast("bigint")).alias("latest_ms")
        rows.agg(so_far).write.mode("overwrite").parquet(_folder(base, "latest", batch_id))
        rows.unpersist()

    writer = packets.writeStream.foreachBatch(deal).option("checkpointLocation", f"{base}/offsets")
    return (writer.trigger(availableNow=True) if once else writer).start()


def on_time_stream(spark: SparkSession, base: str) -> DataFrame:
    """The packets that came in time, as a stream for :mod:`flowloom.streaming.sessions`."""
    return spark.readStream.schema(PACKET_SCHEMA).parquet(f"{base}/on_time/*")


def on_time_packets(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(PACKET_SCHEMA).parquet(f"{base}/on_time/*")


def late_packets(spark: SparkSession, base: str) -> DataFrame:
    """Late packets with the batch, its watermark and how far behind it their session had closed."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PACKET_SCHEMA.fields)
    return spark.read.schema(f"{columns}, {LATE_DDL}").parquet(f"{base}/late/*")


def late_counts(late: DataFrame) -> DataFrame:
    """Per capture: late packets, their conversations, and the furthest one behind."""
    return (
        with_flow_key(late)
        .groupBy("capture_id")
        .agg(
            F.count(F.lit(1)).alias("late_packets"),
            F.count_distinct(F.struct(*FLOW_KEY)).alias("conversations"),
            F.max("behind_ms").alias("most_behind_ms"),
        )
    )


def repaired(
    flows: DataFrame,
    on_time: DataFrame,
    late: DataFrame,
    build: Callable[[DataFrame], DataFrame] = session_flows,
) -> DataFrame:
    """The flows of all packets: those of conversations with late packets are built again.

    ``build`` makes the flows of a table of packets, with the columns of ``flows``.
    """
    names = PACKET_SCHEMA.fieldNames()
    touched = with_flow_key(late).select(*FLOW_KEY).distinct()
    everything = on_time.select(*names).unionByName(late.select(*names))
    again = with_flow_key(everything).join(touched, FLOW_KEY, "left_semi").select(*names)
    kept = with_flow_key(flows).join(touched, FLOW_KEY, "left_anti").select(*flows.columns)
    return kept.unionByName(build(again).select(*flows.columns))
