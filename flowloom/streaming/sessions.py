"""Flows from a packet stream with event-time session windows.

A session closes when the watermark passes its last packet by the idle timeout.
Sessions follow event time, so a packet that arrives late joins the session its
time belongs to. Packets later than the watermark delay are dropped by Spark; to
count them and to work them in, split them off before (:mod:`flowloom.streaming.late`).
All features here are independent of the arrival order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.columns import or_zero, or_zero_double
from flowloom.operators.flow_features import derive_dns, derive_rates
from flowloom.operators.packets import FLOW_KEY, packet_facts, valid_packets
from flowloom.operators.sessions import IDLE_TIMEOUT_MS
from flowloom.schemas import FLOW_TYPES

DEFAULT_DELAY = "10 minutes"

# Flow columns that need the arrival order.
ORDER_DEPENDENT = [
    "flow_iat_std",
    "flow_iat_min",
    "flow_iat_max",
    "fwd_iat_mean",
    "bwd_iat_mean",
    "response_time_variance",
]


def with_event_time(packets: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    return packets.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)


def timed_facts(packets: DataFrame, delay: str, questions: str = "all") -> DataFrame:
    """Packet facts with the event time; filters come first so that packets with
    an invalid time cannot move the watermark."""
    facts = packet_facts(valid_packets(packets), questions)
    return with_event_time(facts, delay)


def session_flows(
    packets: DataFrame,
    delay: str = DEFAULT_DELAY,
    timeout_ms: int = IDLE_TIMEOUT_MS,
    questions: str = "all",
) -> DataFrame:
    """Closed flows of a stream (or all flows of a table).

    Session windows that touch are one session, so a gap of exactly the timeout
    stays in the flow, as in the batch rule. Without late packets ``flow_iat_mean`` equals the mean gap.
    """
    facts = timed_facts(packets, delay, questions)
    window = F.session_window("ts", f"{timeout_ms} milliseconds")
    forward = ~F.col("rev")
    query, response = ~F.col("is_response"), F.col("is_response")

    def bytes_if(cond):
        return or_zero(F.sum(F.when(cond, F.col("len"))))

    raw = facts.groupBy(window, *FLOW_KEY).agg(
        F.min_by("rev", "seq").alias("flow_rev"),
        F.min("ts_ms").alias("start_ms"),
        F.max("ts_ms").alias("end_ms"),
        F.count_if(forward).alias("lo_packets"),
        F.count_if(F.col("rev")).alias("hi_packets"),
        bytes_if(forward).alias("lo_bytes"),
        bytes_if(F.col("rev")).alias("hi_bytes"),
        F.min("len").cast("double").alias("flow_length_min"),
        F.max("len").cast("double").alias("flow_length_max"),
        F.avg("len").alias("average_packet_size"),
        or_zero_double(F.stddev_samp("len")).alias("packet_size_std"),
        F.count("dns_id").alias("dns_packets"),
        F.count_if(query).alias("dns_total_queries"),
        F.count_if(response).alias("dns_total_responses"),
        bytes_if(query).alias("dns_query_bytes"),
        bytes_if(response).alias("dns_response_bytes"),
        or_zero(F.sum("ancount")).alias("answer_total"),
        or_zero(F.sum("any_questions")).alias("any_total"),
        or_zero(F.sum("txt_questions")).alias("txt_total"),
    )

    def oriented(lo: str, hi: str, flip: bool):
        first, second = (hi, lo) if not flip else (lo, hi)
        return F.when(F.col("flow_rev"), F.col(first)).otherwise(F.col(second))

    src, dst = oriented("ep_lo", "ep_hi", False), oriented("ep_lo", "ep_hi", True)
    flows = raw.withColumns(
        {
            "src_ip": src["ip"],
            "dst_ip": dst["ip"],
            "src_port": src["port"],
            "dst_port": dst["port"],
            "total_fwd_packets": oriented("lo_packets", "hi_packets", False),
            "total_bwd_packets": oriented("lo_packets", "hi_packets", True),
            "fwd_bytes": oriented("lo_bytes", "hi_bytes", False),
            "bwd_bytes": oriented("lo_bytes", "hi_bytes", True),
            "response_pairs": F.lit(0),
            "response_var": F.lit(0.0),
        }
    )
    flows = derive_dns(derive_rates(flows))
    packets_seen = F.col("total_fwd_packets") + F.col("total_bwd_packets")
    mean_gap = F.when(packets_seen > 1, F.col("flow_duration") / (packets_seen - 1))

    def mean(total: str, count: str):
        return F.when(F.col(count) > 0, F.col(total) / F.col(count)).otherwise(F.lit(0.0))

    flows = flows.withColumns(
        {
            "flow_iat_mean": F.coalesce(mean_gap, F.lit(0.0)),
            "fwd_packet_length_mean": mean("fwd_bytes", "total_fwd_packets"),
            "bwd_packet_length_mean": mean("bwd_bytes", "total_bwd_packets"),
        }
    )
    columns = [c for c in FLOW_TYPES if c not in ORDER_DEPENDENT]
    return flows.select("capture_id", "start_ms", *columns)
