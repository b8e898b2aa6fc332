"""Checked queries from packets to flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowchecks.base import (
    ALL_FLOW_COLUMNS,
    FLOW_HANDLE,
    KEPT,
    WITH_ASSIGNED,
    WITH_FLOWS,
    WITH_PACKETS,
    WITH_VALID,
    assigned,
    check,
    flow_sql,
    flow_table,
    packets,
    r4,
)
from flowchecks.frames import FILE_SPAN, frames_from_packets, write_captures
from flowloom.functions.columns import (
    confidence_band,
    dns_flag,
    endpoint_text,
    epoch_ms_to_timestamp,
    fixed4,
    min_max_scaled,
    renamed_output,
    risk_level,
)
from flowloom.operators.flow_features import (
    aggregate_flows,
    flow_features,
    query_type_histogram,
    query_type_profile,
    server_fanout,
    with_server_fanout,
)
from flowloom.operators import name_features
from flowloom.operators.packets import (
    FLOW_KEY,
    dns_packets,
    is_transport,
    on_dns_port,
    sane_time,
    tuple_filter,
    valid_packets,
    with_flow_key,
)
from flowloom.operators.sessions import HotKeyPolicy, assign_flows
from flowloom.plans.flow_tables import FLOW_ID
from flowloom.sources import capture
from flowloom.sources.decode import decode_frames, skipped_summary
from flowloom.tables import scratch_folder

_BASE = ["capture_id", "seq", "ts_ms", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "len"]

_FRAME_LEN = """greatest(len, case protocol
   when 'TCP' then 54 when 'UDP' then 42 + case when is_dns
     then 18 + length(dns_name) + 16 * dns_ancount + case when dns_opt_size > 0 then 11 else 0 end else 14 end
   else 42 end)"""


@check(
    "s01_frame_decode",
    f"""{WITH_PACKETS}, q as (select *, protocol = 'UDP' and is_dns as shown,
      protocol in ('UDP', 'TCP') as known from pk)
    select capture_id, seq, ts_ms, src_ip, dst_ip,
     case when known then src_port end as src_port, case when known then dst_port end as dst_port,
     case when known then protocol end as protocol, cast({_FRAME_LEN} as int) as len, ip_ttl,
     case when known then 'ok' else 'other' end as status,
     case when shown then dns_id end as dns_id, case when shown then dns_qr end as dns_qr,
     case when shown then dns_opcode end as dns_opcode,
     case when shown then cast(1 as int) end as dns_qdcount,
     case when shown then dns_ancount end as dns_ancount,
     case when shown then dns_qtype end as dns_qtype,
     case when shown and dns_opt_size > 0 then dns_opt_size end as dns_opt_size,
     case when shown then dns_rcode end as dns_rcode, case when shown then dns_name end as dns_name,
     case when shown and dns_ancount > 0 then dns_ttl end as dns_ttl from q""",
)
def frame_decode(spark, sf_dir):
    decoded = decode_frames(frames_from_packets(packets(spark, sf_dir)))
    return decoded.select(
        *_BASE,
        "ip_ttl",
        "status",
        F.col("dns.id").alias("dns_id"),
        F.col("dns.qr").alias("dns_qr"),
        F.col("dns.opcode").alias("dns_opcode"),
        F.col("dns.qdcount").alias("dns_qdcount"),
        F.col("dns.ancount").alias("dns_ancount"),
        F.get("dns.qtypes", F.lit(0)).alias("dns_qtype"),
        F.get("dns.opt_sizes", F.lit(0)).alias("dns_opt_size"),
        F.col("dns.rcode").alias("dns_rcode"),
        F.get("dns.qnames", F.lit(0)).alias("dns_name"),
        F.get("dns.answer_ttls", F.lit(0)).alias("dns_ttl"),
    )


@check(
    "s01_skipped_frames",
    f"""{WITH_PACKETS}, q as (select case when protocol in ('UDP', 'TCP') then 'ok' else 'other' end
      as status from pk)
    select status, count(*) as n, round(count(*) * 100.0 / (select count(*) from q), 4) as percent
    from q group by status""",
)
def skipped_frames(spark, sf_dir):
    return skipped_summary(decode_frames(frames_from_packets(packets(spark, sf_dir))))


def _frames(spark, sf_dir, **damages):
    """The packets as capture files, read back in ranges of 64 KiB."""
    folder = f"{scratch_folder(spark, 'captures')}/in"
    write_captures(frames_from_packets(packets(spark, sf_dir)), folder, "cap1", **damages)
    capture.register(spark)
    return spark.read.format("capture").option("splitBytes", "65536").load(folder)


def _captured(spark, sf_dir, **damages):
    frames = _frames(spark, sf_dir, **damages or {"damaged": "cap0-0"})
    # The name alone is looked at: a search from each place of a long path takes longer than decoding.
    file, name = F.substring_index("capture_id", "/", -1), "([^/-]+)-([0-9]+)[.]pcap$"
    number = F.regexp_extract(file, name, 2).cast("bigint")
    return decode_frames(frames).withColumns(
        {
            "capture_id": F.regexp_extract(file, name, 1),
            "seq": number * F.lit(1 << 32) + F.col("seq"),
        }
    )


_AS_CAPTURED = """q as (select *, protocol in ('UDP', 'TCP') as known, case protocol
   when 'TCP' then 54 when 'UDP' then 42 + case when is_dns
     then 18 + length(dns_name) + 16 * dns_ancount + case when dns_opt_size > 0 then 11 else 0 end else 14 end
   else 42 end as least_len from pk)"""


@check(
    "s01_capture_files",
    f"""{WITH_PACKETS}, {_AS_CAPTURED} select capture_id, ts_ms, src_ip, dst_ip,
     case when known then src_port end as src_port, case when known then dst_port end as dst_port,
     case when known then protocol end as protocol, cast(greatest(len, least_len) as int) as len,
     case when known then 'ok' else 'other' end as status,
     case when protocol = 'UDP' and is_dns then dns_id end as dns_id from q
    union all select 'cap0', null, null, null, null, null, null, null, 'malformed', null""",
)
def capture_files(spark, sf_dir):
    rows = _captured(spark, sf_dir)
    return rows.select(*[c for c in _BASE if c != "seq"], "status", F.col("dns.id").alias("dns_id"))


#: Whether a packet is the twentieth of its capture file, or the fortieth and so on.
_TWENTIETH = f"row_number() over (partition by capture_id, seq // {FILE_SPAN} order by seq) % 20 = 0"


@check(
    "s01_damaged_captures",
    f"""{WITH_PACKETS}, {_AS_CAPTURED}, d as (select *, {_TWENTIETH} as is_bad from q)
    select capture_id, ts_ms, src_ip, dst_ip, cast(greatest(len, least_len) as int) as len from d where not is_bad""",
)
def damaged_captures(spark, sf_dir):
    """The header of one record in twenty has a length that cannot be right; all others are read."""
    rows = _captured(spark, sf_dir, every=20).filter(F.col("status").isin("ok", "other"))
    return rows.select("capture_id", "ts_ms", "src_ip", "dst_ip", "len")


@check(
    "s01_damage_report",
    f"""{WITH_PACKETS}, {_AS_CAPTURED}, d as (select *, {_TWENTIETH} as is_bad, 16 + greatest(len, least_len) as size from q)
    select capture_id, count(*) filter (not is_bad) as records, count(*) filter (is_bad) as damages,
     cast(coalesce(sum(size) filter (is_bad), 0) as bigint) as damaged_bytes, cast(0 as bigint) as cut_off from d group by capture_id""",
)
def damage_report(spark, sf_dir):
    frames = _frames(spark, sf_dir, every=20)
    return capture.damage(frames.withColumn("capture_id", F.regexp_extract("capture_id", "([^/-]+)-[0-9]+[.]pcap$", 1)))


@check(
    "s01_capture_flows",
    f"""{WITH_FLOWS} select capture_id, cast(sum(total_fwd_packets) as bigint) as fwd_packets,
     cast(sum(total_bwd_packets) as bigint) as bwd_packets, count(*) as flows
    from fl group by capture_id""",
)
def capture_flows(spark, sf_dir):
    """Capture files to flows; offsets of records recur in the files."""
    flows = flow_features(_captured(spark, sf_dir), keep=FLOW_ID)
    return flows.groupBy("capture_id").agg(
        F.sum("total_fwd_packets").alias("fwd_packets"),
        F.sum("total_bwd_packets").alias("bwd_packets"),
        F.count(F.lit(1)).alias("flows"),
    )


@check(
    "f01_sane_time",
    f"{WITH_PACKETS} select {', '.join(_BASE)} from pk where ts_ms between 1483228800000 and 1893456000000",
)
def sane_time_rows(spark, sf_dir):
    return packets(spark, sf_dir).filter(sane_time(F.col("ts_ms"))).select(*_BASE)


@check(
    "f02_transport_only",
    f"{WITH_PACKETS} select {', '.join(_BASE)} from pk where protocol in ('TCP', 'UDP')",
)
def transport_only(spark, sf_dir):
    return packets(spark, sf_dir).filter(is_transport()).select(*_BASE)


@check(
    "f03_dns_candidates",
    f"""{WITH_VALID} select capture_id, seq, src_port = 53 or dst_port = 53 as on_dns_port,
    is_dns as is_decoded from vp where src_port = 53 or dst_port = 53""",
)
def dns_candidates(spark, sf_dir):
    rows = valid_packets(packets(spark, sf_dir)).filter(on_dns_port())
    return rows.select(
        "capture_id", "seq", on_dns_port().alias("on_dns_port"), F.col("dns").isNotNull().alias("is_decoded")
    )


@check(
    "f03_decoded_dns",
    f"{WITH_VALID} select {', '.join(_BASE)} from vp where is_dns",
)
def decoded_dns(spark, sf_dir):
    return dns_packets(valid_packets(packets(spark, sf_dir))).select(*_BASE)


@check(
    "f06_conversation",
    f"""{WITH_VALID} select {', '.join(_BASE)} from vp
    where least(s, d) = '10.0.0.7:40007' and greatest(s, d) = '192.0.2.3:53' and protocol = 'UDP'""",
)
def conversation(spark, sf_dir):
    wanted = tuple_filter("10.0.0.7", 40007, "192.0.2.3", 53, "UDP")
    return valid_packets(packets(spark, sf_dir)).filter(wanted).select(*_BASE)


@check(
    "k01_flow_key",
    f"""{WITH_VALID} select capture_id, seq, lo || ' ' || hi as conversation from vp""",
)
def flow_key(spark, sf_dir):
    keyed = with_flow_key(valid_packets(packets(spark, sf_dir)))
    lo, hi = endpoint_text("ep_lo"), endpoint_text("ep_hi")
    both = F.concat_ws(" ", F.least(lo, hi), F.greatest(lo, hi))
    return keyed.select("capture_id", "seq", both.alias("conversation"))


@check("k02_flow_numbers", f"{WITH_ASSIGNED} select capture_id, seq, flow_no, is_new from pa")
def flow_numbers(spark, sf_dir):
    return assigned(spark, sf_dir).select("capture_id", "seq", "flow_no", "is_new")


@check("k02_flow_numbers_split", f"{WITH_ASSIGNED} select capture_id, seq, flow_no, is_new, is_fwd from pa")
def flow_numbers_split(spark, sf_dir):
    """Conversations of three packets or more are cut into chunks of the arrival order."""
    policy = HotKeyPolicy(min_rows=3, one_in=1, chunk_span=4096)
    rows = assign_flows(packets(spark, sf_dir), policy=policy)
    return rows.select("capture_id", "seq", "flow_no", "is_new", "is_fwd")


@check("k03_orientation", f"{WITH_ASSIGNED} select capture_id, seq, is_fwd from pa")
def orientation(spark, sf_dir):
    return assigned(spark, sf_dir).select("capture_id", "seq", "is_fwd")


@check(
    "k04_flow_times",
    f"{WITH_FLOWS} select capture_id, first_seq, start_ms, end_ms, flow_duration from fl",
)
def flow_times(spark, sf_dir):
    flows = flow_features(packets(spark, sf_dir), keep=KEPT)
    return flows.select(*FLOW_HANDLE, "start_ms", "end_ms", "flow_duration")


@check(
    "k05_label_stamp",
    f"{WITH_FLOWS} select capture_id, first_seq, 'ATTACK' as label from fl",
)
def label_stamp(spark, sf_dir):
    flows = flow_features(packets(spark, sf_dir), label="ATTACK", keep=KEPT)
    return flows.select(*FLOW_HANDLE, "label")


@check(
    "j02_response_pairs",
    f"{WITH_ASSIGNED} select capture_id, seq, response_ms from pa where response_ms is not null",
)
def response_pairs(spark, sf_dir):
    rows = assigned(spark, sf_dir).filter(F.col("response_ms").isNotNull())
    return rows.select("capture_id", "seq", "response_ms")


@check(
    "w01_flow_gaps",
    f"{WITH_ASSIGNED} select capture_id, seq, flow_iat from pa where flow_iat is not null",
)
def flow_gaps(spark, sf_dir):
    rows = assigned(spark, sf_dir).filter(F.col("flow_iat").isNotNull())
    return rows.select("capture_id", "seq", "flow_iat")


@check(
    "w02_flows_per_conversation",
    f"{WITH_ASSIGNED} select capture_id, lo || ' ' || hi as conversation, protocol, max(flow_no) as flows from pa group by all",
)
def flows_per_conversation(spark, sf_dir):
    rows = assigned(spark, sf_dir)
    lo, hi = endpoint_text("ep_lo"), endpoint_text("ep_hi")
    text = F.concat_ws(" ", F.least(lo, hi), F.greatest(lo, hi)).alias("conversation")
    return rows.groupBy("capture_id", text, "protocol").agg(F.max("flow_no").alias("flows"))


@check(
    "w03_first_packets",
    f"{WITH_ASSIGNED} select capture_id, seq, flow_no, ts_ms from pa where is_new",
)
def first_packets(spark, sf_dir):
    return assigned(spark, sf_dir).filter("is_new").select("capture_id", "seq", "flow_no", "ts_ms")


@check(
    "w04_directional_gaps",
    f"{WITH_ASSIGNED} select capture_id, seq, is_fwd, dir_iat from pa where dir_iat is not null",
)
def directional_gaps(spark, sf_dir):
    rows = assigned(spark, sf_dir).filter(F.col("dir_iat").isNotNull())
    return rows.select("capture_id", "seq", "is_fwd", "dir_iat")


# Flow columns per inventory line; each query builds its flows from the packets
# and selects only these, so that unused feature groups are pruned.
_COLUMN_QUERIES = {
    "a01_packet_counts": ["total_fwd_packets", "total_bwd_packets"],
    "a02_byte_totals": ["total_fwd_bytes", "total_bwd_bytes"],
    "a03_duration": ["flow_duration"],
    "a04_rates": [
        "flow_bytes_per_sec",
        "flow_packets_per_sec",
        "fwd_packets_per_sec",
        "bwd_packets_per_sec",
    ],
    "a05_packet_sizes": [
        "flow_length_min",
        "flow_length_max",
        "average_packet_size",
        "packet_size_std",
    ],
    "a06_directional_sizes": ["fwd_packet_length_mean", "bwd_packet_length_mean"],
    "a07_flow_gap_statistics": ["flow_iat_mean", "flow_iat_std", "flow_iat_min", "flow_iat_max"],
    "a08_directional_gap_means": ["fwd_iat_mean", "bwd_iat_mean"],
    "a09_dns_counts": ["dns_total_queries", "dns_total_responses"],
    "a10_dns_response_bytes": ["dns_response_bytes"],
    "a11_amplification": ["dns_amplification_factor"],
    "a12_query_response_ratio": ["query_response_ratio"],
    "a13_query_type_ratios": ["dns_any_query_ratio", "dns_txt_query_ratio"],
    "a14_response_inconsistency": ["dns_response_inconsistency"],
    "a15_queries_per_second": ["dns_queries_per_second"],
    "a16_mean_answers": ["dns_mean_answers_per_query"],
    "a17_dns_traffic_share": ["port_53_traffic_ratio"],
    "a18_fanout_placeholder": ["dns_server_fanout"],
    "a19_ttl_placeholder": ["ttl_violation_rate"],
    "a20_response_time_variance": ["response_time_variance"],
}


def _column_query(columns):
    def run(spark, sf_dir):
        return flow_features(packets(spark, sf_dir), keep=KEPT).select(*FLOW_HANDLE, *columns)

    return run


for _name, _columns in _COLUMN_QUERIES.items():
    check(_name, flow_sql(_columns))(_column_query(_columns))


@check("flow_table", flow_sql(ALL_FLOW_COLUMNS))
def whole_flow_table(spark, sf_dir):
    return flow_features(packets(spark, sf_dir), keep=KEPT).select(*FLOW_HANDLE, *ALL_FLOW_COLUMNS)


@check(
    "a13_questions_in_queries_only",
    f"""{WITH_ASSIGNED}, g as (select capture_id, lo, hi, protocol, flow_no, min(seq) as first_seq,
      count(*) filter (where is_dns and not dns_qr) as q,
      count(*) filter (where is_dns and not dns_qr and dns_qtype = 255) as a,
      count(*) filter (where is_dns and not dns_qr and dns_qtype = 16) as t from pa group by all)
    select capture_id, first_seq, round(case when q > 0 then a / cast(q as double) else 0 end, 4)
      as dns_any_query_ratio,
     round(case when q > 0 then t / cast(q as double) else 0 end, 4) as dns_txt_query_ratio from g""",
)
def questions_in_queries_only(spark, sf_dir):
    flows = flow_features(packets(spark, sf_dir), keep=KEPT, questions="queries")
    return flows.select(*FLOW_HANDLE, "dns_any_query_ratio", "dns_txt_query_ratio")


@check(
    "a18_server_fanout",
    f"""{WITH_FLOWS} select src_ip, count(distinct dst_ip) as server_fanout from fl
    where dst_port = 53 and dns_total_queries > 0 group by src_ip""",
)
def fanout(spark, sf_dir):
    return server_fanout(flow_table(spark, sf_dir))


@check(
    "a18_flows_with_fanout",
    f"""{WITH_FLOWS}, n as (select src_ip, count(distinct dst_ip) as c from fl
      where dst_port = 53 and dns_total_queries > 0 group by src_ip)
    select capture_id, first_seq, coalesce(c, 0) as dns_server_fanout
    from fl left join n using (src_ip)""",
)
def flows_with_fanout(spark, sf_dir):
    return with_server_fanout(flow_table(spark, sf_dir)).select(*FLOW_HANDLE, "dns_server_fanout")


@check(
    "a19_ttl_violations",
    f"""{WITH_ASSIGNED} select capture_id, min(seq) as first_seq,
      count(*) filter (where ip_ttl not in (64, 128, 255)) as ttl_violations
    from pa group by capture_id, lo, hi, protocol, flow_no""",
)
def ttl_violations(spark, sf_dir):
    flows = flow_features(packets(spark, sf_dir), keep=(*KEPT, "ttl_violations"), groups=("ttl",))
    return flows.select(*FLOW_HANDLE, "ttl_violations")


@check(
    "a21_dns_gate",
    f"{WITH_FLOWS} select capture_id, first_seq, dns_packets > 0 as is_dns_flow from fl",
)
def dns_gate(spark, sf_dir):
    flows = aggregate_flows(assigned(spark, sf_dir), ("volume", "dns"))
    return flows.select(*FLOW_HANDLE, (F.col("dns_packets") > 0).alias("is_dns_flow"))


@check(
    "a22_dns_details",
    f"""{WITH_ASSIGNED} select capture_id, min(seq) as first_seq,
     cast(max(case when is_dns and dns_qr then 1 else 0 end) as int) as dns_qr,
     coalesce(arg_max(dns_opcode, seq) filter (where is_dns), 0) as dns_opcode,
     cast(coalesce(sum(dns_qdcount) filter (where is_dns), 0) as bigint) as dns_qdcount,
     coalesce(arg_max(dns_qtype, seq) filter (where is_dns), 0) as dns_query_type,
     cast(coalesce(sum(dns_ancount) filter (where is_dns), 0) as bigint) as dns_answer_count,
     cast(max(case when is_dns and dns_opt_size > 0 then 1 else 0 end) as int) as dns_edns_present,
     cast(max(case when is_dns then dns_opt_size else 0 end) as int) as dns_edns_udp_size,
     round(coalesce(stddev_samp(len) filter (where is_dns), 0), 4) as dns_packet_size_std
    from pa group by capture_id, lo, hi, protocol, flow_no""",
)
def dns_details(spark, sf_dir):
    names = [
        "dns_qr",
        "dns_opcode",
        "dns_qdcount",
        "dns_query_type",
        "dns_answer_count",
        "dns_edns_present",
        "dns_edns_udp_size",
        "dns_packet_size_std",
    ]
    flows = flow_features(packets(spark, sf_dir), keep=(*KEPT, *names), groups=("dns_detail",))
    return flows.select(*FLOW_HANDLE, *names)


_TYPES = f"""{WITH_ASSIGNED}, h as (select capture_id, lo, hi, protocol, flow_no, dns_qtype as qtype,
  count(*) as questions from pa where is_dns group by all)"""


@check(
    "a23_query_type_profile",
    f"""{_TYPES} select capture_id, least(lo, hi) || ' ' || greatest(lo, hi) as conversation, protocol,
     flow_no, count(*) as query_type_diversity,
     arg_max(qtype, questions * 100000 - qtype) as most_common_query_type
    from h group by all""",
)
def type_profile(spark, sf_dir):
    return _by_conversation(query_type_profile(assigned(spark, sf_dir)))


@check(
    "a23_query_type_histogram",
    f"""{_TYPES} select capture_id, least(lo, hi) || ' ' || greatest(lo, hi) as conversation, protocol,
     flow_no, qtype, questions from h""",
)
def type_histogram(spark, sf_dir):
    return _by_conversation(query_type_histogram(assigned(spark, sf_dir)))


def _by_conversation(df):
    lo, hi = endpoint_text("ep_lo"), endpoint_text("ep_hi")
    text = F.concat_ws(" ", F.least(lo, hi), F.greatest(lo, hi))
    return df.withColumn("conversation", text).drop("ep_lo", "ep_hi", "key_hash")


@check(
    "c01_guarded_arithmetic",
    f"""{WITH_FLOWS} select capture_id, first_seq,
     abs(total_fwd_packets - total_bwd_packets) as imbalance,
     {r4("case when total_bwd_bytes > 0 then total_fwd_bytes / total_bwd_bytes else 0 end", "byte_ratio")},
     {r4("greatest(score, 1 - score)", "confidence")} from fl""",
)
def guarded_arithmetic(spark, sf_dir):
    from flowloom.functions.columns import ratio_or_zero

    return flow_table(spark, sf_dir).select(
        *FLOW_HANDLE,
        F.abs(F.col("total_fwd_packets") - F.col("total_bwd_packets")).alias("imbalance"),
        ratio_or_zero(F.col("total_fwd_bytes"), F.col("total_bwd_bytes")).alias("byte_ratio"),
        F.greatest(F.col("score"), 1 - F.col("score")).alias("confidence"),
    )


@check(
    "c02_four_decimals",
    f"""{WITH_FLOWS} select capture_id, first_seq,
     printf('%.4f', round(flow_bytes_per_sec, 4)) as rate_text,
     printf('%.4f', round(packet_size_std, 4)) as std_text from fl""",
)
def four_decimals(spark, sf_dir):
    return flow_table(spark, sf_dir).select(
        *FLOW_HANDLE,
        fixed4(F.col("flow_bytes_per_sec")).alias("rate_text"),
        fixed4(F.col("packet_size_std")).alias("std_text"),
    )


@check(
    "c03_text_functions",
    f"""{WITH_FLOWS} select capture_id, first_seq,
     cast(split_part(src_ip, '.', 4) as int) as last_byte,
     regexp_matches(src_ip, '^10\\.') as is_client,
     capture_id || '_balanced.csv' as output_name from fl""",
)
def text_functions(spark, sf_dir):
    source = F.concat(F.col("capture_id"), F.lit("_fixed.csv"))
    return flow_table(spark, sf_dir).select(
        *FLOW_HANDLE,
        F.split("src_ip", r"\.")[3].cast("int").alias("last_byte"),
        F.col("src_ip").rlike(r"^10\.").alias("is_client"),
        renamed_output(source, "_fixed.csv", "_balanced.csv").alias("output_name"),
    )


@check(
    "c04_array_functions",
    f"""{WITH_VALID} select capture_id, seq, cast(case when dns_qtype = 255 then 1 else 0 end as int)
      as any_questions, case when dns_opt_size > 0 then dns_opt_size end as opt_size
    from vp where is_dns""",
)
def array_functions(spark, sf_dir):
    from flowloom.operators.packets import packet_facts

    rows = packet_facts(valid_packets(packets(spark, sf_dir))).filter(F.col("dns_id").isNotNull())
    return rows.select("capture_id", "seq", "any_questions", "opt_size")


@check(
    "c05_time_functions",
    f"""{WITH_FLOWS} select capture_id, first_seq,
     strftime(make_timestamp(start_ms * 1000), '%Y-%m-%d %H:%M:%S') as start_text,
     start_ms as parsed_ms from fl""",
)
def time_functions(spark, sf_dir):
    start = epoch_ms_to_timestamp(F.col("start_ms"))
    return flow_table(spark, sf_dir).select(
        *FLOW_HANDLE,
        F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("start_text"),
        F.timestamp_diff(
            "MILLISECOND",
            F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
            start.cast("string").try_cast("timestamp_ntz"),
        ).alias("parsed_ms"),
    )


@check(
    "c06_risk_level",
    f"""{WITH_FLOWS}, c as (select *, greatest(score, 1 - score) as m from fl)
    select capture_id, first_seq,
     case when m >= 0.9 then 'CRITICAL' when m >= 0.8 then 'HIGH' when m >= 0.6 then 'MEDIUM'
       else 'LOW' end as risk_level,
     case when score >= 0.9 then 'CRITICAL' when score >= 0.8 then 'HIGH'
       when score >= 0.6 then 'MEDIUM' else 'LOW' end as attack_risk_level from c""",
)
def risk_levels(spark, sf_dir):
    return flow_table(spark, sf_dir).select(
        *FLOW_HANDLE,
        risk_level(F.greatest(F.col("score"), 1 - F.col("score"))).alias("risk_level"),
        risk_level(F.col("score")).alias("attack_risk_level"),
    )


@check(
    "c07_confidence_band",
    f"""{WITH_FLOWS}, c as (select *, greatest(score, 1 - score) as m from fl)
    select capture_id, first_seq, case when m > 0.9 then 'high' when m >= 0.7 then 'medium'
      else 'low' end as band from c""",
)
def confidence_bands(spark, sf_dir):
    confidence = F.greatest(F.col("score"), 1 - F.col("score"))
    return flow_table(spark, sf_dir).select(*FLOW_HANDLE, confidence_band(confidence).alias("band"))


@check(
    "c08_min_max_scaling",
    f"""{WITH_FLOWS}, b as (select min(average_packet_size) as lo_v, max(average_packet_size) as hi_v from fl)
    select capture_id, first_seq, {r4("(average_packet_size - lo_v) / (hi_v - lo_v)", "scaled")} from fl, b""",
)
def min_max_scaling(spark, sf_dir):
    flows = flow_table(spark, sf_dir)
    low = flows.agg(F.min("average_packet_size")).scalar()
    high = flows.agg(F.max("average_packet_size")).scalar()
    return flows.select(
        *FLOW_HANDLE, min_max_scaled(F.col("average_packet_size"), low, high).alias("scaled")
    )


@check(
    "c09_dns_flag_text",
    f"""{WITH_VALID} select capture_id, seq, dns_qr as flag from vp where is_dns""",
)
def dns_flag_text(spark, sf_dir):
    forms = F.array(
        F.when(F.col("dns.qr"), "1").otherwise("0"),
        F.when(F.col("dns.qr"), "True").otherwise("False"),
        F.when(F.col("dns.qr"), "0x1").otherwise("0x0"),
    )
    rows = dns_packets(valid_packets(packets(spark, sf_dir)))
    text = F.get(forms, (F.col("seq") % 3).cast("int"))
    return rows.select("capture_id", "seq", dns_flag(text).alias("flag"))


# --- names, response codes and answer times ----------------------------------

_NAMED = f"""{WITH_FLOWS}, nm as (select *, is_dns and not dns_qr as asks, is_dns and dns_qr as answers from pa),
 chars as (select capture_id, lo, hi, protocol, flow_no, c, count(*) as n from (select *, unnest(string_split(dns_name, '')) as c
   from nm where asks) group by all),
 ent as (select capture_id, lo, hi, protocol, flow_no, -sum(n / t * log2(n / t)) as entropy from (select *,
   cast(sum(n) over (partition by capture_id, lo, hi, protocol, flow_no) as double) as t from chars) group by all),
 nf as (select capture_id, lo, hi, protocol, flow_no, min(seq) as first_seq,
   coalesce(avg(length(dns_name)) filter (asks), 0) as name_length_mean,
   cast(coalesce(max(length(dns_name)) filter (asks), 0) as int) as name_length_max,
   coalesce(avg(case when dns_rcode = 3 then 1.0 else 0.0 end) filter (answers), 0) as nxdomain_rate,
   coalesce(cast(sum(dns_ttl * dns_ancount) filter (answers) as double) / nullif(sum(dns_ancount) filter (answers), 0), 0) as answer_ttl_mean,
   count(distinct dns_name) filter (asks) as unique_domains
  from nm group by all)"""


def _named_flows(spark, sf_dir):
    rows = packets(spark, sf_dir)
    return assign_flows(rows, extra=name_features.NAME_FIELDS)


@check(
    "x01_name_features",
    f"""{_NAMED} select capture_id, first_seq, {r4("name_length_mean")}, name_length_max, {r4("coalesce(entropy, 0)", "name_entropy")}
    from nf left join ent using (capture_id, lo, hi, protocol, flow_no)""",
)
def names_of_flows(spark, sf_dir):
    found = name_features.name_features(_named_flows(spark, sf_dir))
    return found.select("capture_id", "first_seq", "name_length_mean", "name_length_max", "name_entropy")


@check("x02_response_codes", f"""{_NAMED} select capture_id, first_seq, {r4("nxdomain_rate")} from nf""")
def response_codes(spark, sf_dir):
    return name_features.name_features(_named_flows(spark, sf_dir)).select("capture_id", "first_seq", "nxdomain_rate")


@check(
    "x03_unique_domains",
    f"""{_NAMED} select src_ip as client, count(distinct dns_name) as unique_domains, true as within_bound from nm
    where asks group by 1""",
)
def unique_domains(spark, sf_dir):
    """Exact names per client, and whether the merged sketches of its flows come near."""
    sketches = name_features.name_sketches(name_features.names_asked(_named_flows(spark, sf_dir)))
    estimated = name_features.clients_of_sketches(sketches)
    found = name_features.names_of_clients(packets(spark, sf_dir)).join(estimated, "client", "left")
    # Three standard errors of 2^12 registers.
    near = F.abs(F.col("estimated_domains") - F.col("unique_domains")) <= F.greatest(F.lit(0.5), F.col("unique_domains") * 0.05)
    return found.select("client", "unique_domains", near.alias("within_bound"))


@check(
    "x03_unique_domains_of_flows",
    f"{_NAMED} select capture_id, first_seq, unique_domains from nf where unique_domains > 0",
)
def unique_domains_of_flows(spark, sf_dir):
    assigned = _named_flows(spark, sf_dir)
    by = [*FLOW_KEY, "flow_no"]
    names = name_features.unique_names(name_features.names_asked(assigned), by)
    first = assigned.groupBy(*by).agg(F.min("seq").alias("first_seq"))
    return first.join(names, by).select("capture_id", "first_seq", "unique_domains")


@check("x04_answer_times", f"""{_NAMED} select capture_id, first_seq, {r4("answer_ttl_mean")} from nf""")
def answer_times(spark, sf_dir):
    return name_features.name_features(_named_flows(spark, sf_dir)).select("capture_id", "first_seq", "answer_ttl_mean")


@check(
    "x05_attack_types",
    f"""{_NAMED}, af as (select capture_id, first_seq, nxdomain_rate, unique_domains,
       coalesce(errors, 0) as errors from nf left join (select capture_id, lo, hi, protocol, flow_no,
       count(*) filter (answers and dns_rcode > 0) as errors from nm group by all) using (capture_id, lo, hi, protocol, flow_no))
    select fl.capture_id, fl.first_seq, case
      when protocol = 'TCP' and dst_port = 53 and total_bwd_packets = 0 and flow_packets_per_sec > 0.5 then 'handshake flood'
      when nxdomain_rate >= 0.5 and unique_domains >= 2 then 'water torture'
      when dns_total_queries = 0 and dns_total_responses > 0 then 'spoofing'
      when dns_amplification_factor > 2 then 'amplification'
      when dns_mean_answers_per_query > 2 and errors = 0 then 'reflection'
      when dns_queries_per_second > 0.5 and dns_total_responses * 2 < dns_total_queries then 'query flood' end as attack_type
    from fl join af using (capture_id, first_seq)""",
)
def attack_types(spark, sf_dir):
    """The six rules with bounds that the traffic of the tables reaches."""
    assigned = _named_flows(spark, sf_dir)
    features = name_features.name_features(assigned)
    names = name_features.unique_names(name_features.names_asked(assigned), [*FLOW_KEY, "flow_no"])
    key = ["capture_id", "first_seq"]
    of_flows = features.join(names, [*FLOW_KEY, "flow_no"], "left").select(*key, "unique_domains")
    bounds = {"amplification": 2.0, "answers": 2.0, "per_second": 0.5, "name_errors": 0.5, "many_names": 2}
    rated = features.select(*key, "nxdomain_rate", "error_rate")
    found = name_features.with_attack_type(flow_table(spark, sf_dir), rated, of_flows, key, **bounds)
    return found.select(*key, "attack_type")


@check(
    "x06_floods",
    f"""{WITH_FLOWS} select capture_id, first_seq from fl where dns_queries_per_second > 0.5 or dns_amplification_factor > 10""",
)
def floods(spark, sf_dir):
    return name_features.floods(flow_table(spark, sf_dir), per_second=0.5).select(*FLOW_HANDLE)
