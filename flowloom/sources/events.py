"""Packets derived from the ``events`` table.

The data folder has no capture, so the packet table the other operators read is
computed from ``events``: every event is one packet of a client talking to one
of four servers. Time is compressed so that the idle timeout both joins and
splits, and late packets, invalid times and a foreign protocol are mixed in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FLAT = """
select event_id as seq, concat('cap', u % 2) as capture_id,
 case when event_id % 211 = 0 then 0
      else 1704067200000 + (ems - 1704067200000) div 300
           - case when event_id % 17 = 0 then 90000 else 0 end end as ts_ms,
 case when r then srv else cli end as src_ip,
 case when r then cli else srv end as dst_ip,
 cast(case when r then sp else cp end as int) as src_port,
 cast(case when r then cp else sp end as int) as dst_port,
 case when event_id % 97 = 0 then 'ICMP' when u % 5 <> 0 then 'UDP' else 'TCP' end as protocol,
 cast(60 + floor(value) as int) as len,
 cast(case k % 4 when 0 then 64 when 1 then 128 when 2 then 255 else 42 end as int) as ip_ttl,
 (sp = 53 and event_type <> 'error') as is_dns,
 cast(k % 2 as int) as dns_id, r as dns_qr,
 cast(case when k = 99 then 5 else 0 end as int) as dns_opcode, 1 as dns_qdcount,
 cast(case when r then k % 6 else 0 end as int) as dns_ancount,
 cast(case k % 5 when 0 then 1 when 1 then 28 when 2 then 255 when 3 then 16 else 15 end as int)
   as dns_qtype,
 cast(case when k % 7 = 0 then 512 * (1 + k % 8) else 0 end as int) as dns_opt_size,
 cast(case when r and k % 5 = 0 then 3 else 0 end as int) as dns_rcode, 60 * (1 + k % 4) as dns_ttl,
 concat(case when k % 3 = 0 then 'www.' else '' end, 'd', event_id % 41, '.example.com') as dns_name
from (select event_id, event_type, value, user_id as u,
        timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as ems,
        cast(get_json_object(props, '$.k') as bigint) as k,
        event_type in ('view', 'purchase') as r,
        concat('10.0.', user_id div 256, '.', user_id % 256) as cli,
        concat('192.0.2.', user_id % 4) as srv,
        40000 + user_id % 1000 as cp,
        case when user_id % 3 <> 0 then 53 else 443 end as sp
      from {events})
"""


def flat_packets(events: DataFrame) -> DataFrame:
    """One flat row per packet (one question and one OPT size at most)."""
    return events.sparkSession.sql(_FLAT, events=events)


def packets_from_events(events: DataFrame) -> DataFrame:
    """The packet table of :data:`flowloom.schemas.PACKET_SCHEMA`."""
    dns = F.struct(
        F.col("dns_id").alias("id"),
        F.col("dns_qr").alias("qr"),
        F.col("dns_opcode").alias("opcode"),
        F.col("dns_qdcount").alias("qdcount"),
        F.col("dns_ancount").alias("ancount"),
        F.array("dns_qtype").alias("qtypes"),
        F.when(F.col("dns_opt_size") > 0, F.array("dns_opt_size"))
        .otherwise(F.array().cast("array<int>"))
        .alias("opt_sizes"),
        F.col("dns_rcode").alias("rcode"),
        F.array_repeat("dns_ttl", F.col("dns_ancount")).alias("answer_ttls"),
        F.array("dns_name").alias("qnames"),
    )
    return flat_packets(events).select(
        "capture_id",
        "seq",
        "ts_ms",
        "src_ip",
        "dst_ip",
        "src_port",
        "dst_port",
        "protocol",
        "len",
        "ip_ttl",
        F.when(F.col("is_dns"), dns).alias("dns"),
    )


def load_packets(spark: SparkSession, folder: str) -> DataFrame:
    return packets_from_events(spark.read.parquet(f"{folder}/events.parquet"))
