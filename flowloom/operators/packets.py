"""Packet filters and the bidirectional flow key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.columns import endpoint, occurrences

# Accepted capture times (2017-01-01 to 2030-01-01, both included)
# and transport protocols; the DNS port; the query types that are counted.
MIN_TS_MS = 1483228800000
MAX_TS_MS = 1893456000000
PROTOCOLS = ["TCP", "UDP"]
DNS_PORT = 53
QTYPE_ANY = 255
QTYPE_TXT = 16

# Columns every window and aggregation of a flow starts with: hash-partitioning
# by them once serves all later steps. The hash adds nothing to the identity; it
# comes first because sorts compare the first column as a machine word.
FLOW_KEY = ["key_hash", "capture_id", "ep_lo", "ep_hi", "protocol"]


def sane_time(ts_ms: Column) -> Column:
    return ts_ms.between(MIN_TS_MS, MAX_TS_MS)


def is_transport() -> Column:
    return (
        F.col("protocol").isin(PROTOCOLS)
        & F.col("src_ip").isNotNull()
        & F.col("dst_ip").isNotNull()
    )


def on_dns_port() -> Column:
    return (F.col("src_port") == DNS_PORT) | (F.col("dst_port") == DNS_PORT)


def valid_packets(packets: DataFrame) -> DataFrame:
    """Packets with a plausible time that belong to a TCP or UDP conversation."""
    return packets.filter(sane_time(F.col("ts_ms")) & is_transport())


def dns_packets(packets: DataFrame) -> DataFrame:
    """Packets on port 53 whose payload was decoded as DNS."""
    return packets.filter(on_dns_port() & F.col("dns").isNotNull())


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Add the direction-free key; ``rev`` is true for packets from ``ep_hi`` to ``ep_lo``."""
    src, dst = endpoint("src_ip", "src_port"), endpoint("dst_ip", "dst_port")
    keyed = packets.withColumns(
        {"ep_lo": F.least(src, dst), "ep_hi": F.greatest(src, dst), "rev": src > dst}
    )
    return keyed.withColumn("key_hash", F.xxhash64("capture_id", "ep_lo", "ep_hi", "protocol"))


def packet_facts(packets: DataFrame, questions: str = "all", extra: Sequence[str] = ()) -> DataFrame:
    """The narrow per-packet columns the flow features need.

    Arrays are reduced to numbers before the shuffle. ``questions="all"`` counts
    question types in queries and in the responses that echo them;
    ``"queries"`` counts them in queries only. ``extra`` names more fields of ``dns``
    that come along.
    """
    if questions not in ("all", "queries"):
        raise ValueError("questions must be 'all' or 'queries'")
    # One struct, null without DNS, is tested once. A test per column makes the generated method
    # longer than the JVM compiles, so that it is interpreted for every packet.
    keyed = with_flow_key(packets).withColumn("_dns", F.when(on_dns_port(), F.col("dns")))
    counted = F.col("_dns").isNotNull() if questions == "all" else ~F.col("_dns.qr")
    fields = ("qr", "is_response"), ("opcode", "opcode"), ("qdcount", "qdcount"), ("ancount", "ancount")
    return keyed.select(
        *FLOW_KEY,
        "rev",
        "seq",
        "ts_ms",
        F.col("len").cast("long").alias("len"),
        "ip_ttl",
        F.col("_dns.id").alias("dns_id"),
        *[F.col(f"_dns.{field}").alias(name) for field, name in fields],
        F.when(counted, occurrences(F.col("_dns.qtypes"), QTYPE_ANY)).alias("any_questions"),
        F.when(counted, occurrences(F.col("_dns.qtypes"), QTYPE_TXT)).alias("txt_questions"),
        F.try_element_at(F.col("_dns.qtypes"), F.lit(-1)).alias("last_qtype"),
        F.array_max("_dns.opt_sizes").alias("opt_size"),
        F.col("_dns.qtypes").alias("qtypes"),
        *[F.col(f"_dns.{name}").alias(name) for name in extra],
    )


def tuple_filter(src_ip: str, src_port: int, dst_ip: str, dst_port: int, protocol: str) -> Column:
    """Predicate for one conversation in both directions."""
    forward = (
        (F.col("src_ip") == src_ip)
        & (F.col("src_port") == src_port)
        & (F.col("dst_ip") == dst_ip)
        & (F.col("dst_port") == dst_port)
    )
    backward = (
        (F.col("src_ip") == dst_ip)
        & (F.col("src_port") == dst_port)
        & (F.col("dst_ip") == src_ip)
        & (F.col("dst_port") == src_port)
    )
    return (forward | backward) & (F.col("protocol") == protocol)
