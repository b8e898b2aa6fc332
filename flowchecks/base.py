"""Registry of checked queries, shared inputs and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.columns import rounded
from flowloom.operators.flow_features import flow_features
from flowloom.operators.sessions import assign_flows
from flowloom.plans.flow_tables import stored
from flowloom.schemas import FLOW_COLUMNS, FLOW_FIELDS
from flowloom.sources.events import load_packets

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 4


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its double columns are rounded as the SQL rounds them."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), DIGITS)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_packets(spark, sf_dir)


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_flows(packets(spark, sf_dir))


def client_number(src: str = "src_ip", dst: str = "dst_ip"):
    """The user number of the client address."""
    client = F.when(F.col(src).startswith("10."), F.col(src)).otherwise(F.col(dst))
    parts = F.split(client, r"\.")
    return parts[2].cast("bigint") * 256 + parts[3].cast("bigint")


KEPT = ("capture_id", "flow_no", "start_ms", "end_ms", "first_seq")


def with_labels(flows: DataFrame) -> DataFrame:
    """Deterministic label and score, so that metrics can be compared exactly."""
    flows = flows.withColumn("u", client_number())
    return flows.withColumns(
        {
            "label": F.when(F.col("u") % 4 == 0, "ATTACK").otherwise("BENIGN"),
            "y": F.when(F.col("u") % 4 == 0, 1).otherwise(0),
            "score": ((F.col("u") * 37 + F.col("flow_no") * 11) % 1000) / F.lit(1000.0),
        }
    )


_STORED: dict[tuple[str, str], DataFrame] = {}


def flow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow table of a data folder: built once per application and stored."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        flows = with_labels(flow_features(packets(spark, sf_dir), keep=KEPT))
        _STORED[key] = stored(flows, "flows")
    return _STORED[key]


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow table with the label as 0/1 and a class from the score."""
    flows = flow_table(spark, sf_dir).withColumn("label", F.col("y"))
    return flows.withColumn("prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def r4(expression: str, name: str | None = None) -> str:
    return f"round({expression}, {DIGITS}) as {name or expression}"


_PACKETS = """
pk as (
 select event_id as seq, 'cap' || (u % 2) as capture_id, u,
  case when event_id % 211 = 0 then 0
       else 1704067200000 + (ems - 1704067200000) // 300
            - case when event_id % 17 = 0 then 90000 else 0 end end as ts_ms,
  case when r then srv else cli end as src_ip, case when r then cli else srv end as dst_ip,
  cast(case when r then sp else cp end as int) as src_port,
  cast(case when r then cp else sp end as int) as dst_port,
  case when event_id % 97 = 0 then 'ICMP' when u % 5 <> 0 then 'UDP' else 'TCP' end as protocol,
  cast(60 + floor(value) as int) as len,
  cast(case k % 4 when 0 then 64 when 1 then 128 when 2 then 255 else 42 end as int) as ip_ttl,
  (sp = 53 and event_type <> 'error') as is_dns, cast(k % 2 as int) as dns_id, r as dns_qr,
  cast(case when k = 99 then 5 else 0 end as int) as dns_opcode, 1 as dns_qdcount,
  cast(case when r then k % 6 else 0 end as int) as dns_ancount,
  cast(case k % 5 when 0 then 1 when 1 then 28 when 2 then 255 when 3 then 16 else 15 end as int)
    as dns_qtype,
  cast(case when k % 7 = 0 then 512 * (1 + k % 8) else 0 end as int) as dns_opt_size,
  cast(case when r and k % 5 = 0 then 3 else 0 end as int) as dns_rcode, 60 * (1 + k % 4) as dns_ttl,
  case when k % 3 = 0 then 'www.' else '' end || 'd' || (event_id % 41) || '.example.com' as dns_name
 from (select event_id, event_type, value, user_id as u, epoch_us(ts) // 1000 as ems,
         cast(json_extract_string(props, '$.k') as bigint) as k,
         event_type in ('view', 'purchase') as r,
         '10.0.' || (user_id // 256) || '.' || (user_id % 256) as cli,
         '192.0.2.' || (user_id % 4) as srv,
         40000 + user_id % 1000 as cp,
         case when user_id % 3 <> 0 then 53 else 443 end as sp
       from events)
)"""

_VALID = (
    _PACKETS
    + """,
vp as (
 select *, src_ip || ':' || src_port as s, dst_ip || ':' || dst_port as d,
  least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) as lo,
  greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) as hi
 from pk
 where ts_ms between 1483228800000 and 1893456000000 and protocol in ('TCP', 'UDP')
)"""
)

_ASSIGNED = (
    _VALID
    + """,
p1 as (select *, max(ts_ms) over (partition by capture_id, lo, hi, protocol order by seq
   rows between unbounded preceding and 1 preceding) as pm from vp),
p2 as (select *, (pm is null or ts_ms - pm > 120000) as is_new from p1),
p3 as (select *, cast(sum(case when is_new then 1 else 0 end) over (
   partition by capture_id, lo, hi, protocol order by seq
   rows between unbounded preceding and current row) as bigint) as flow_no from p2),
p4 as (select *, s = first_value(s) over (partition by capture_id, lo, hi, protocol, flow_no
   order by seq rows between unbounded preceding and current row) as is_fwd from p3),
p5 as (select *,
   case when not is_new and ts_ms >= pm then ts_ms - pm end as flow_iat,
   ts_ms - lag(ts_ms) over (partition by capture_id, lo, hi, protocol, flow_no, is_fwd
     order by seq) as dir_gap,
   lag(dns_qr) over (partition by capture_id, lo, hi, protocol, flow_no, is_dns, dns_id
     order by seq) as before_qr,
   lag(ts_ms) over (partition by capture_id, lo, hi, protocol, flow_no, is_dns, dns_id
     order by seq) as before_ts
   from p4),
pa as (select *, case when dir_gap >= 0 then dir_gap end as dir_iat,
   case when is_dns and dns_qr and not before_qr then ts_ms - before_ts end as response_ms
   from p5)"""
)

_FLOWS = (
    _ASSIGNED
    + """,
fa as (
 select capture_id, lo, hi, protocol, flow_no,
  max(case when is_new then src_ip end) as src_ip, max(case when is_new then dst_ip end) as dst_ip,
  max(case when is_new then src_port end) as src_port,
  max(case when is_new then dst_port end) as dst_port,
  max(u) as u, min(seq) as first_seq,
  max(case when is_new then ts_ms end) as start_ms, max(ts_ms) as end_ms,
  count(*) filter (where is_fwd) as total_fwd_packets,
  count(*) filter (where not is_fwd) as total_bwd_packets,
  cast(coalesce(sum(len) filter (where is_fwd), 0) as double) as total_fwd_bytes,
  cast(coalesce(sum(len) filter (where not is_fwd), 0) as double) as total_bwd_bytes,
  count(*) filter (where is_dns) as dns_packets,
  count(*) filter (where is_dns and not dns_qr) as dns_total_queries,
  count(*) filter (where is_dns and dns_qr) as dns_total_responses,
  cast(coalesce(sum(len) filter (where is_dns and not dns_qr), 0) as bigint) as dns_query_bytes,
  cast(coalesce(sum(len) filter (where is_dns and dns_qr), 0) as bigint) as dns_response_bytes,
  cast(coalesce(sum(dns_ancount) filter (where is_dns), 0) as bigint) as answer_total,
  count(*) filter (where is_dns and dns_qtype = 255) as any_total,
  count(*) filter (where is_dns and dns_qtype = 16) as txt_total,
  count(response_ms) as response_pairs, var_pop(response_ms) as response_var,
  coalesce(avg(flow_iat), 0) as flow_iat_mean, coalesce(stddev_samp(flow_iat), 0) as flow_iat_std,
  cast(coalesce(min(flow_iat), 0) as double) as flow_iat_min,
  cast(coalesce(max(flow_iat), 0) as double) as flow_iat_max,
  coalesce(avg(dir_iat) filter (where is_fwd), 0) as fwd_iat_mean,
  coalesce(avg(dir_iat) filter (where not is_fwd), 0) as bwd_iat_mean,
  coalesce(avg(len) filter (where is_fwd), 0) as fwd_packet_length_mean,
  coalesce(avg(len) filter (where not is_fwd), 0) as bwd_packet_length_mean,
  coalesce(stddev_samp(len), 0) as packet_size_std, cast(min(len) as double) as flow_length_min,
  cast(max(len) as double) as flow_length_max, avg(len) as average_packet_size
 from pa group by capture_id, lo, hi, protocol, flow_no),
fb as (select *, end_ms - start_ms as flow_duration,
  case when end_ms - start_ms <= 0 then 1.0 else (end_ms - start_ms) / 1000.0 end as secs,
  total_fwd_bytes + total_bwd_bytes as total_bytes from fa),
fc as (select *,
  case when dns_packets = 0 then 0.0 when dns_query_bytes > 0
    then cast(dns_response_bytes as double) / dns_query_bytes
    when dns_response_bytes > 0 then 999.0 else 0.0 end as dns_amplification_factor,
  case when dns_packets = 0 then 0.0 when dns_total_responses = 0
    then cast(dns_total_queries as double)
    else dns_total_queries / cast(dns_total_responses as double) end as query_response_ratio,
  case when dns_total_queries = 0 then 0.0
    else any_total / cast(dns_total_queries as double) end as dns_any_query_ratio,
  case when dns_total_queries = 0 then 0.0
    else txt_total / cast(dns_total_queries as double) end as dns_txt_query_ratio,
  cast(0 as bigint) as dns_server_fanout,
  abs(dns_total_queries - dns_total_responses) as dns_response_inconsistency,
  cast(0 as bigint) as ttl_violation_rate,
  dns_total_queries / cast(secs as double) as dns_queries_per_second,
  case when dns_total_responses = 0 then 0.0
    else answer_total / cast(dns_total_responses as double) end as dns_mean_answers_per_query,
  case when total_bytes > 0 then (dns_query_bytes + dns_response_bytes) / total_bytes
    else 0.0 end as port_53_traffic_ratio,
  total_bytes / cast(secs as double) as flow_bytes_per_sec,
  (total_fwd_packets + total_bwd_packets) / cast(secs as double) as flow_packets_per_sec,
  total_fwd_packets / cast(secs as double) as fwd_packets_per_sec,
  total_bwd_packets / cast(secs as double) as bwd_packets_per_sec,
  case when response_pairs > 1 then greatest(response_var, 0.0) else 0.0 end
    as response_time_variance
 from fb),
fl as (select *, case when u % 4 = 0 then 'ATTACK' else 'BENIGN' end as label,
  case when u % 4 = 0 then 1 else 0 end as y,
  cast((u * 37 + flow_no * 11) % 1000 as double) / 1000.0 as score from fc),
fx as (select *, case when score >= 0.5 then 1 else 0 end as prediction from fl)"""
)

WITH_PACKETS = "with " + _PACKETS
WITH_VALID = "with " + _VALID
WITH_ASSIGNED = "with " + _ASSIGNED
WITH_FLOWS = "with " + _FLOWS

FLOW_HANDLE = ["capture_id", "first_seq"]


def sql_columns(names, prefix: str = "") -> str:
    """Flow columns as the comparison wants them: doubles rounded."""
    kinds = dict(FLOW_FIELDS) | {"score": "double"}
    parts = []
    for name in names:
        source = f"{prefix}{name}"
        parts.append(r4(source, name) if kinds.get(name) == "double" else f"{source} as {name}")
    return ", ".join(parts)


def flow_sql(names, extra: str = "", tail: str = "") -> str:
    """Selected flow columns of all flows."""
    return f"{WITH_FLOWS} select {sql_columns([*FLOW_HANDLE, *names])}{extra} from fl {tail}"


ALL_FLOW_COLUMNS = FLOW_COLUMNS


def unpivot_sql(source: str, features, value: str, more: str = "") -> str:
    """One SELECT per feature, united; ``{c}`` in the text stands for the column."""
    return " union all ".join(
        f"select '{c}' as feature, {value.replace('{c}', c)} from {source}{more}" for c in features
    )
