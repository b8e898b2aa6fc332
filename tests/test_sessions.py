"""Flow building against the packet-by-packet model, on both routes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from flowloom.operators.flow_features import flow_features
from flowloom.operators import ordered, sessions
from flowloom.operators.packets import packet_facts, valid_packets
from flowloom.operators.sessions import HotKeyPolicy, assign_flows, flow_parts, hot_keys
from flowloom.schemas import FLOW_COLUMNS, PACKET_SCHEMA
from flowloom.sources.events import load_packets
from tests import model
from tests.model import packet

T0 = 1704067200000
# Every key is hot and chunks are tiny: flows cross many chunk borders.
FORCED = HotKeyPolicy(min_rows=1, one_in=1, chunk_span=3)


def table(spark, rows):
    return spark.createDataFrame(rows, PACKET_SCHEMA)


def flows(spark, rows, **options):
    made = flow_features(table(spark, rows), keep=("capture_id", "start_ms"), **options)
    return [r.asDict() for r in made.collect()]


def compare(spark, rows, policy):
    expected = model.run(rows)
    found = flows(spark, rows, policy=policy)
    order = lambda r: (r["capture_id"], r["src_ip"], r["src_port"], r["dst_ip"], r["dst_port"], r["protocol"], r["start_ms"], r["total_fwd_packets"])
    assert len(found) == len(expected)
    for have, want in zip(sorted(found, key=order), sorted(expected, key=order)):
        for name, value in want.items():
            same = value if isinstance(value, str) else pytest.approx(value, rel=1e-9, abs=1e-9)
            assert have[name] == same, name


def random_rows(seed, n=400):
    rng = random.Random(seed)
    rows, now = [], T0
    for seq in range(n):
        now += rng.choice([0, 1, 500, 20000, 119999, 120000, 120001, 180000])
        late = rng.choice([0, 0, 0, 0, 1000, 90000, 200000])
        client, port = f"10.0.0.{rng.randrange(3)}", 40000 + rng.randrange(2)
        service = rng.choice([53, 53, 443])
        dns = None
        response = rng.random() < 0.5
        if service == 53 and rng.random() < 0.8:
            dns = (rng.randrange(3), response, rng.randrange(4) if response else 0, [rng.choice([1, 16, 255])])
        ends = [(client, port), ("192.0.2.1", service)]
        (src, sp), (dst, dp) = ends[::-1] if response else ends
        if rng.random() < 0.02:
            src, sp, dst, dp = client, port, client, port
            dns = None
        rows.append(
            packet(
                seq,
                now - late,
                src,
                sp,
                dst,
                dp,
                rng.randrange(60, 1500),
                rng.choice(["a", "b"]),
                rng.choice(["UDP", "UDP", "TCP", "ICMP"]),
                dns=dns,
            )
        )
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ordinary_route_matches_model(spark, seed):
    compare(spark, random_rows(seed), None)


@pytest.mark.parametrize("seed", [3, 4])
def test_chunked_route_matches_model(spark, seed):
    compare(spark, random_rows(seed), FORCED)


def test_mixed_routes_match_model(spark):
    rows = random_rows(5)
    rows += [packet(1000 + i, T0 + i * 700, length=70 + i % 9) for i in range(300)]
    policy = HotKeyPolicy(min_rows=100, one_in=1, chunk_span=32)
    assert len(flow_parts(table(spark, rows), policy=policy)) == 2
    compare(spark, rows, policy)


def test_carries_over_blocks_of_chunks_match_model(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNKS_PER_BLOCK", 5)
    compare(spark, random_rows(7), FORCED)


def test_every_hot_key_is_listed(spark):
    rows = [packet(i, T0 + i, sp=40000 + (0 if i < 60 else i % 3)) for i in range(120)]
    found = hot_keys(table(spark, rows), HotKeyPolicy(min_rows=10, one_in=1))
    assert sorted(r.ep_lo.port for r in found.collect()) == [40000, 40001, 40002]


def test_hot_route_reads_stored_rows_only(spark):
    rows = [packet(i, T0 + i * 10) for i in range(300)]
    policy = HotKeyPolicy(min_rows=10, one_in=1, chunk_span=64)
    hot = flow_parts(table(spark, rows), policy=policy)[1]
    text = plan_of(hot)
    # None of the scans is the source; the open transactions are chunk summaries.
    assert "Scan ExistingRDD" not in text and "LocalTableScan" not in text
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffles = [line for line in plan_of(flow_parts(table(spark, rows), policy=policy)[1]).splitlines() if "Exchange hashpartitioning" in line]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Two of hot rows (gaps, transactions), six of chunk summaries; numbering is stored before.
    assert len(shuffles) <= 8


def test_no_hot_keys_means_one_part(spark):
    assert len(flow_parts(table(spark, random_rows(6, 50)))) == 1


def test_golden_totals(spark, data_dir):
    made = flow_features(load_packets(spark, data_dir))
    total = made.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("flow_duration").alias("duration"),
        F.round(F.sum("dns_amplification_factor"), 4).alias("amplification"),
        F.round(F.sum("flow_iat_std"), 4).alias("iat_std"),
        F.round(F.sum("response_time_variance"), 4).alias("variance"),
        F.round(F.sum("packet_size_std"), 4).alias("size_std"),
    ).first()
    assert total.n == 403
    assert total.duration == 29035707
    assert total.amplification == 77048.5751
    assert total.iat_std == 4233361.7031
    assert total.variance == 2398883569.4722
    assert total.size_std == 9474.8811


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flow_table_needs_one_exchange(spark, data_dir):
    text = plan_of(flow_features(load_packets(spark, data_dir)))
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("Exchange") == 1


def test_unused_feature_groups_are_pruned(spark, data_dir):
    text = plan_of(flow_features(load_packets(spark, data_dir)).select("total_fwd_packets"))
    assert "stddev_samp" not in text
    assert "ip_ttl" not in text.split("FileScan")[0] or "is_response" not in text


def test_chunks_bound_every_window_group(spark):
    rows = [packet(i, T0 + i * 10) for i in range(1000)]
    policy = HotKeyPolicy(min_rows=10, one_in=1, chunk_span=64)
    made = flow_features(table(spark, rows), policy=policy)
    text = plan_of(made)
    hot_windows = [line for line in text.splitlines() if " Window [" in line and "seq" in line]
    assert any("chunk" in line for line in hot_windows)
    assert made.count() == 1


# --- single rules ------------------------------------------------------------


def test_single_packet(spark):
    (flow,) = flows(spark, [packet(1, T0, length=90)])
    assert flow["flow_duration"] == 0
    assert flow["flow_bytes_per_sec"] == 90.0
    assert flow["packet_size_std"] == 0.0
    assert flow["flow_iat_max"] == 0.0


@pytest.mark.parametrize(("gap", "count"), [(120000, 1), (120001, 2)])
def test_idle_timeout_is_inclusive(spark, gap, count):
    assert len(flows(spark, [packet(1, T0), packet(2, T0 + gap)])) == count


def test_late_packet_keeps_the_clock(spark):
    rows = [packet(1, T0), packet(2, T0 + 5000), packet(3, T0 + 4000), packet(4, T0 + 125000)]
    (flow,) = flows(spark, rows)
    assert flow["flow_duration"] == 125000
    assert flow["flow_iat_mean"] == pytest.approx((5000 + 120000) / 2)
    # In the same direction the gap starts at the late packet.
    assert flow["fwd_iat_mean"] == pytest.approx((5000 + 121000) / 2)


def test_very_late_packet_stays(spark):
    rows = [packet(1, T0 + 400000), packet(2, T0 + 200000)]
    (flow,) = flows(spark, rows)
    assert flow["total_fwd_packets"] == 2
    assert flow["flow_duration"] == 0


def test_reverse_packet_opens_next_flow(spark):
    reverse = packet(2, T0 + 200000, "192.0.2.1", 53, "10.0.0.1", 40000)
    found = flows(spark, [packet(1, T0), reverse])
    assert {f["src_ip"] for f in found} == {"10.0.0.1", "192.0.2.1"}
    assert all(f["total_bwd_packets"] == 0 for f in found)


def test_self_loop_is_forward(spark):
    rows = [packet(i, T0 + i, "10.0.0.1", 53, "10.0.0.1", 53) for i in (1, 2)]
    (flow,) = flows(spark, rows)
    assert (flow["total_fwd_packets"], flow["total_bwd_packets"]) == (2, 0)


def answer(seq, ts, ident=1, count=1, types=(1,), length=200):
    return packet(seq, ts, "192.0.2.1", 53, "10.0.0.1", 40000, length, dns=(ident, True, count, list(types)))


def query(seq, ts, ident=1, types=(1,), length=100):
    return packet(seq, ts, length=length, dns=(ident, False, 0, list(types)))


def test_id_reuse_makes_one_pair(spark):
    rows = [query(1, T0), query(2, T0 + 10), answer(3, T0 + 30), answer(4, T0 + 50)]
    pairs = assign_flows(table(spark, rows)).filter("response_ms is not null").collect()
    assert [r.response_ms for r in pairs] == [20]


def test_negative_response_times_are_kept(spark):
    rows = [query(1, T0 + 500), answer(2, T0 + 100), query(3, T0 + 600, 2), answer(4, T0 + 700, 2)]
    (flow,) = flows(spark, rows)
    assert flow["response_time_variance"] == pytest.approx(62500.0)


def test_response_without_query(spark):
    (flow,) = flows(spark, [answer(1, T0)])
    assert flow["dns_amplification_factor"] == 999.0
    assert flow["query_response_ratio"] == 0.0


def test_queries_only(spark):
    (flow,) = flows(spark, [query(1, T0), query(2, T0 + 1000, 2)])
    assert flow["dns_amplification_factor"] == 0.0
    assert flow["query_response_ratio"] == 2.0


def test_any_echoed_in_response(spark):
    rows = [query(1, T0, types=(255,)), answer(2, T0 + 5, types=(255,))]
    (flow,) = flows(spark, rows)
    assert flow["dns_any_query_ratio"] == 2.0
    (flow,) = flows(spark, rows, questions="queries")
    assert flow["dns_any_query_ratio"] == 1.0


def test_undecoded_dns_port(spark):
    (flow,) = flows(spark, [packet(1, T0)])
    assert flow["port_53_traffic_ratio"] == 0.0
    assert flow["dns_total_queries"] == 0


def test_time_bounds_are_inclusive(spark):
    rows = [packet(1, 1483228800000), packet(2, 1893456000000), packet(3, 1483228799999), packet(4, 1893456000001)]
    assert len(flows(spark, rows)) == 2


def test_captures_are_separate(spark):
    rows = [packet(1, T0, capture="a"), packet(2, T0 + 1, capture="b")]
    assert len(flows(spark, rows)) == 2


def test_three_packet_capture(spark):
    client, server = ("1.2.3.4", 12345), ("8.8.8.8", 53)
    rows = [
        packet(1, T0, *client, *server, 71, dns=(0x1111, False, 0, [1])),
        packet(2, T0 + 10, *server, *client, 71, dns=(0x1111, True, 0, [1])),
        packet(3, T0 + 20, *client, *server, 79, dns=(0x2222, False, 0, [1])),
    ]
    rows[2] = rows[2][:10] + ((0x2222, False, 0, 1, 0, [1], [4096], 0, [], []),)
    made = flow_features(
        table(spark, rows), groups=("dns_detail",), keep=("dns_edns_present", "dns_edns_udp_size")
    )
    (flow,) = made.collect()
    assert (flow.total_fwd_packets, flow.total_bwd_packets) == (2, 1)
    assert (flow.dns_total_queries, flow.dns_total_responses) == (2, 1)
    assert flow.query_response_ratio == 2.0
    assert (flow.dns_edns_present, flow.dns_edns_udp_size) == (1, 4096)


def test_flow_table_has_forty_columns(spark):
    made = flow_features(table(spark, [packet(1, T0)]), label="BENIGN")
    assert made.columns == [*FLOW_COLUMNS, "label"]
    assert len(FLOW_COLUMNS) == 40


def test_facts_are_short_enough_to_be_compiled(spark, data_dir, capsys):
    facts = packet_facts(valid_packets(load_packets(spark, data_dir)))
    facts.explain("codegen")
    sizes = [int(s) for s in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


def test_question_counts_with_missing_parts(spark):
    types = [[255, None, 16, 255], [], None]
    rows = [
        packet(i, T0 + i)[:10] + ((i, i == 2, 0, 1, 0, asked, [], 0, [], []),) for i, asked in enumerate(types)
    ]
    rows.append(packet(3, T0 + 3, "1.2.3.4", 1000, "8.8.8.8", 2000, 71, dns=(9, False, 0, [255])))
    for questions, last in (("all", 0), ("queries", None)):
        made = packet_facts(table(spark, rows), questions).orderBy("seq")
        found = made.select("any_questions", "txt_questions").collect()
        assert [tuple(r) for r in found] == [(2, 1), (0, 0), (last, last), (None, None)]


def test_partitions_follow_the_packets(spark, monkeypatch):
    monkeypatch.setattr(sessions, "TASK_ROWS", 4)
    policy = HotKeyPolicy(one_in=1)
    rows = [packet(i, T0 + i, "1.2.3.4", 1000 + i) for i in range(80)]
    (part,) = flow_parts(table(spark, rows), policy=policy)
    assert part.rdd.getNumPartitions() == 20
    compare(spark, rows, policy)
