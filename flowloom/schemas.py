"""Column layouts of the packet, flow and prediction tables."""

from __future__ import annotations

from pyspark.sql import types as T

DNS_TYPE = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("qr", T.BooleanType()),
        T.StructField("opcode", T.IntegerType()),
        T.StructField("qdcount", T.IntegerType()),
        T.StructField("ancount", T.IntegerType()),
        T.StructField("qtypes", T.ArrayType(T.IntegerType())),
        T.StructField("opt_sizes", T.ArrayType(T.IntegerType())),
        T.StructField("rcode", T.IntegerType()),
        T.StructField("answer_ttls", T.ArrayType(T.LongType())),
        T.StructField("qnames", T.ArrayType(T.StringType())),
    ]
)

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("len", T.IntegerType()),
        T.StructField("ip_ttl", T.IntegerType()),
        T.StructField("dns", DNS_TYPE),
    ]
)

# Names, order and types of the flow table.
FLOW_FIELDS = [
    ("src_ip", "string"),
    ("dst_ip", "string"),
    ("src_port", "int"),
    ("dst_port", "int"),
    ("protocol", "string"),
    ("dns_amplification_factor", "double"),
    ("query_response_ratio", "double"),
    ("dns_any_query_ratio", "double"),
    ("dns_txt_query_ratio", "double"),
    ("dns_server_fanout", "bigint"),
    ("dns_response_inconsistency", "bigint"),
    ("ttl_violation_rate", "bigint"),
    ("dns_queries_per_second", "double"),
    ("dns_mean_answers_per_query", "double"),
    ("port_53_traffic_ratio", "double"),
    ("flow_bytes_per_sec", "double"),
    ("flow_packets_per_sec", "double"),
    ("fwd_packets_per_sec", "double"),
    ("bwd_packets_per_sec", "double"),
    ("flow_duration", "bigint"),
    ("total_fwd_packets", "bigint"),
    ("total_bwd_packets", "bigint"),
    ("total_fwd_bytes", "double"),
    ("total_bwd_bytes", "double"),
    ("dns_total_queries", "bigint"),
    ("dns_total_responses", "bigint"),
    ("dns_response_bytes", "bigint"),
    ("flow_iat_mean", "double"),
    ("flow_iat_std", "double"),
    ("flow_iat_min", "double"),
    ("flow_iat_max", "double"),
    ("fwd_iat_mean", "double"),
    ("bwd_iat_mean", "double"),
    ("fwd_packet_length_mean", "double"),
    ("bwd_packet_length_mean", "double"),
    ("packet_size_std", "double"),
    ("flow_length_min", "double"),
    ("flow_length_max", "double"),
    ("response_time_variance", "double"),
    ("average_packet_size", "double"),
]

FLOW_COLUMNS = [name for name, _ in FLOW_FIELDS]
FLOW_TYPES = dict(FLOW_FIELDS)
FLOW_DDL = ", ".join(f"{name} {kind}" for name, kind in FLOW_FIELDS)
LABELLED_FLOW_DDL = FLOW_DDL + ", label string"

# The identity columns that never reach a model.
IDENTITY_COLUMNS = ["src_ip", "dst_ip", "src_port", "dst_port"]
FEATURE_COLUMNS = [name for name in FLOW_COLUMNS if name not in IDENTITY_COLUMNS]
NUMERIC_FEATURES = [name for name in FEATURE_COLUMNS if name != "protocol"]

# Columns that are always zero and are hidden from reports.
HIDDEN_IN_REPORTS = ["ttl_violation_rate", "dns_server_fanout"]
