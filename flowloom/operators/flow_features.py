"""One row per flow: the 40 flow columns and optional further feature groups.

All groups are aggregations over the packets of :mod:`flowloom.operators.sessions`
and go into a single ``agg``; groups a query does not select are pruned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.columns import (
    or_zero,
    or_zero_double,
    ratio_or_zero,
    seconds_floor,
)
from flowloom.operators.packets import FLOW_KEY
from flowloom.operators.sessions import (
    DEFAULT_POLICY,
    IDLE_TIMEOUT_MS,
    HotKeyPolicy,
    flow_parts,
)
from flowloom.schemas import FLOW_FIELDS
from flowloom.tables import stored

# Factor reported for responses without any query, and the usual
# initial IP TTLs.
RESPONSES_ONLY_FACTOR = 999.0
COMMON_TTLS = [64, 128, 255]


def _fwd() -> Column:
    return F.col("is_fwd")


def _bwd() -> Column:
    return ~F.col("is_fwd")


def _query() -> Column:
    return ~F.col("is_response")


def _response() -> Column:
    return F.col("is_response")


def _sum_if(cond: Column, value: str) -> Column:
    return or_zero(F.sum(F.when(cond, F.col(value))))


def volume_group() -> list[Column]:
    return [
        F.max(F.when(F.col("is_new"), F.col("ts_ms"))).alias("start_ms"),
        F.max("ts_ms").alias("end_ms"),
        F.max(F.when(F.col("is_new"), F.col("seq"))).alias("first_seq"),
        F.count_if(_fwd()).alias("total_fwd_packets"),
        F.count_if(_bwd()).alias("total_bwd_packets"),
        _sum_if(_fwd(), "len").alias("fwd_bytes"),
        _sum_if(_bwd(), "len").alias("bwd_bytes"),
    ]


def size_group() -> list[Column]:
    return [
        F.min("len").cast("double").alias("flow_length_min"),
        F.max("len").cast("double").alias("flow_length_max"),
        F.avg("len").alias("average_packet_size"),
        or_zero_double(F.stddev_samp("len")).alias("packet_size_std"),
        or_zero_double(F.avg(F.when(_fwd(), F.col("len")))).alias("fwd_packet_length_mean"),
        or_zero_double(F.avg(F.when(_bwd(), F.col("len")))).alias("bwd_packet_length_mean"),
    ]


def timing_group() -> list[Column]:
    return [
        or_zero_double(F.avg("flow_iat")).alias("flow_iat_mean"),
        or_zero_double(F.stddev_samp("flow_iat")).alias("flow_iat_std"),
        or_zero_double(F.min("flow_iat")).alias("flow_iat_min"),
        or_zero_double(F.max("flow_iat")).alias("flow_iat_max"),
        or_zero_double(F.avg(F.when(_fwd(), F.col("dir_iat")))).alias("fwd_iat_mean"),
        or_zero_double(F.avg(F.when(_bwd(), F.col("dir_iat")))).alias("bwd_iat_mean"),
    ]


def dns_group() -> list[Column]:
    return [
        F.count("dns_id").alias("dns_packets"),
        F.count_if(_query()).alias("dns_total_queries"),
        F.count_if(_response()).alias("dns_total_responses"),
        _sum_if(_query(), "len").alias("dns_query_bytes"),
        _sum_if(_response(), "len").alias("dns_response_bytes"),
        or_zero(F.sum("ancount")).alias("answer_total"),
        or_zero(F.sum("any_questions")).alias("any_total"),
        or_zero(F.sum("txt_questions")).alias("txt_total"),
        F.count("response_ms").alias("response_pairs"),
        or_zero_double(F.var_pop("response_ms")).alias("response_var"),
    ]


def dns_detail_group() -> list[Column]:
    """Header details that the flow export leaves out."""
    seen = F.col("dns_id").isNotNull()
    asked = F.col("last_qtype").isNotNull()
    return [
        F.coalesce(F.max(_response().cast("int")), F.lit(0)).alias("dns_qr"),
        F.coalesce(F.max_by("opcode", F.when(seen, F.col("seq"))), F.lit(0)).alias("dns_opcode"),
        or_zero(F.sum("qdcount")).alias("dns_qdcount"),
        F.coalesce(F.max_by("last_qtype", F.when(asked, F.col("seq"))), F.lit(0)).alias(
            "dns_query_type"
        ),
        or_zero(F.sum("ancount")).alias("dns_answer_count"),
        F.max(F.when(F.col("opt_size").isNotNull(), 1).otherwise(0)).alias("dns_edns_present"),
        F.coalesce(F.max("opt_size"), F.lit(0)).alias("dns_edns_udp_size"),
        or_zero_double(F.stddev_samp(F.when(seen, F.col("len")))).alias("dns_packet_size_std"),
    ]


def ttl_group() -> list[Column]:
    """Packets whose IP TTL is not a usual initial value."""
    return [F.count_if(~F.col("ip_ttl").isin(COMMON_TTLS)).alias("ttl_violations")]


FEATURE_GROUPS: dict[str, Callable[[], list[Column]]] = {
    "volume": volume_group,
    "size": size_group,
    "timing": timing_group,
    "dns": dns_group,
    "dns_detail": dns_detail_group,
    "ttl": ttl_group,
}
CORE_GROUPS = ("volume", "size", "timing", "dns")


def aggregate_flows(assigned: DataFrame, groups: tuple[str, ...] = CORE_GROUPS) -> DataFrame:
    """One row per flow with the raw aggregates of the chosen groups."""
    columns = [c for g in groups for c in FEATURE_GROUPS[g]()]
    flows = assigned.groupBy(*FLOW_KEY, "flow_no", "flow_rev").agg(*columns)
    src = F.when(F.col("flow_rev"), F.col("ep_hi")).otherwise(F.col("ep_lo"))
    dst = F.when(F.col("flow_rev"), F.col("ep_lo")).otherwise(F.col("ep_hi"))
    return flows.withColumns(
        {
            "src_ip": src["ip"],
            "dst_ip": dst["ip"],
            "src_port": src["port"],
            "dst_port": dst["port"],
        }
    )


def amplification_factor(query_bytes: Column, response_bytes: Column) -> Column:
    """Response bytes per query byte; a fixed factor when only responses occur."""
    return (
        F.when(query_bytes > 0, response_bytes.cast("double") / query_bytes)
        .when(response_bytes > 0, F.lit(RESPONSES_ONLY_FACTOR))
        .otherwise(F.lit(0.0))
    )


def query_response_ratio(queries: Column, responses: Column) -> Column:
    return F.when(responses > 0, queries.cast("double") / responses).otherwise(
        queries.cast("double")
    )


def derive_rates(flows: DataFrame) -> DataFrame:
    """Duration, byte totals and per-second rates from the volume group."""
    duration = F.col("end_ms") - F.col("start_ms")
    seconds = seconds_floor(duration)
    packets = F.col("total_fwd_packets") + F.col("total_bwd_packets")
    return flows.withColumns(
        {
            "flow_duration": duration,
            "total_fwd_bytes": F.col("fwd_bytes").cast("double"),
            "total_bwd_bytes": F.col("bwd_bytes").cast("double"),
            "flow_bytes_per_sec": (F.col("fwd_bytes") + F.col("bwd_bytes")) / seconds,
            "flow_packets_per_sec": packets / seconds,
            "fwd_packets_per_sec": F.col("total_fwd_packets") / seconds,
            "bwd_packets_per_sec": F.col("total_bwd_packets") / seconds,
        }
    )


def derive_dns(flows: DataFrame) -> DataFrame:
    """DNS ratios; all of them are 0 for flows without a decoded DNS packet."""
    gate = F.col("dns_packets") > 0
    queries, responses = F.col("dns_total_queries"), F.col("dns_total_responses")
    q_bytes, r_bytes = F.col("dns_query_bytes"), F.col("dns_response_bytes")
    seconds = seconds_floor(F.col("end_ms") - F.col("start_ms"))

    def gated(value: Column) -> Column:
        return F.when(gate, value).otherwise(F.lit(0.0))

    return flows.withColumns(
        {
            "dns_amplification_factor": gated(amplification_factor(q_bytes, r_bytes)),
            "query_response_ratio": gated(query_response_ratio(queries, responses)),
            "dns_any_query_ratio": gated(ratio_or_zero(F.col("any_total"), queries)),
            "dns_txt_query_ratio": gated(ratio_or_zero(F.col("txt_total"), queries)),
            # The flow table carries zeros here; server_fanout()
            # and the ttl group hold the real measures.
            "dns_server_fanout": F.lit(0).cast("bigint"),
            "ttl_violation_rate": F.lit(0).cast("bigint"),
            "dns_response_inconsistency": F.abs(queries - responses),
            "dns_queries_per_second": gated(queries / seconds),
            "dns_mean_answers_per_query": gated(ratio_or_zero(F.col("answer_total"), responses)),
            "port_53_traffic_ratio": gated(
                ratio_or_zero(q_bytes + r_bytes, F.col("fwd_bytes") + F.col("bwd_bytes"))
            ),
            "response_time_variance": F.when(
                F.col("response_pairs") > 1, F.greatest(F.col("response_var"), F.lit(0.0))
            ).otherwise(F.lit(0.0)),
        }
    )


def flow_features(
    packets: DataFrame,
    label: str | None = None,
    keep: tuple[str, ...] = (),
    groups: tuple[str, ...] = (),
    timeout_ms: int = IDLE_TIMEOUT_MS,
    policy: HotKeyPolicy | None = DEFAULT_POLICY,
    questions: str = "all",
) -> DataFrame:
    """Packets to the 40-column flow table.

    ``label`` adds a constant label column. ``groups`` adds feature groups and
    ``keep`` further columns (``capture_id``, ``flow_no``, ``start_ms``, ...).
    Each route is aggregated before the routes are united, so ordinary flows
    need no second shuffle.
    """
    columns = [F.col(n).cast(t).alias(n) for n, t in FLOW_FIELDS]
    columns += [F.col(c) for c in keep]
    if label is not None:
        columns.append(F.lit(label).alias("label"))
    tables = []
    for part in flow_parts(packets, timeout_ms, policy, questions):
        flows = aggregate_flows(part, CORE_GROUPS + tuple(groups))
        tables.append(derive_dns(derive_rates(flows)).select(*columns))
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result


def query_type_profile(assigned: DataFrame) -> DataFrame:
    """Per flow: number of question types and the most common one (smallest on ties)."""
    per_type = (
        assigned.filter(F.col("qtypes").isNotNull())
        .select(*FLOW_KEY, "flow_no", F.explode("qtypes").alias("qtype"))
        .groupBy(*FLOW_KEY, "flow_no", "qtype")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_type.groupBy(*FLOW_KEY, "flow_no").agg(
        F.count("qtype").alias("query_type_diversity"),
        F.max_by("qtype", F.struct(F.col("n"), -F.col("qtype"))).alias("most_common_query_type"),
    )


def query_type_histogram(assigned: DataFrame) -> DataFrame:
    """Question counts per flow and type, as rows rather than a map."""
    return (
        assigned.filter(F.col("qtypes").isNotNull())
        .select(*FLOW_KEY, "flow_no", F.explode("qtypes").alias("qtype"))
        .groupBy(*FLOW_KEY, "flow_no", "qtype")
        .agg(F.count(F.lit(1)).alias("questions"))
    )


def server_fanout(flows: DataFrame) -> DataFrame:
    """Distinct DNS servers per client.

    The pairs are made distinct first, so that a client with very many flows is
    spread over its servers instead of being one group.
    """
    return (
        flows.filter((F.col("dst_port") == 53) & (F.col("dns_total_queries") > 0))
        .select("src_ip", "dst_ip")
        .distinct()
        .groupBy("src_ip")
        .agg(F.count(F.lit(1)).alias("server_fanout"))
    )


#: Clients up to which the fan-out table is broadcast (some 10 MB), and salts of a client beyond it.
FANOUT_BROADCAST, FANOUT_SALTS = 200_000, 32


def with_server_fanout(flows: DataFrame, most_broadcast: int = FANOUT_BROADCAST) -> DataFrame:
    """Flows with the real fan-out in ``dns_server_fanout``.

    One client may hold most of the flows. A table of few clients is broadcast, so
    flows stay where they are; otherwise a client's flows are dealt to several
    join keys and its fan-out is given to each.
    """
    fanout = stored(server_fanout(flows), "fanout")
    if fanout.limit(most_broadcast + 1).count() <= most_broadcast:
        joined = flows.join(F.broadcast(fanout), "src_ip", "left")
    else:
        salt = F.pmod(F.xxhash64("dst_ip", "src_port", "dst_port"), F.lit(FANOUT_SALTS)).cast("int")
        dealt = fanout.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(FANOUT_SALTS - 1))))
        joined = flows.withColumn("_salt", salt).join(dealt, ["src_ip", "_salt"], "left")
    value = or_zero(F.col("server_fanout")).cast("bigint")
    return joined.withColumn("dns_server_fanout", value).select(*flows.columns)
