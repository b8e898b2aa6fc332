"""Streams over several micro-batches against the batch result."""

import cProfile
import pstats
import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators.flow_features import flow_features
from flowloom.schemas import FLOW_COLUMNS, FLOW_TYPES, PACKET_SCHEMA
from flowloom.streaming import late as late_rows
from flowloom.streaming import run, stateful
from flowloom.streaming.sessions import session_flows
from flowloom.streaming.stateful import arrival_order_flows
from tests.model import packet

T0 = 1704067200000
END = T0 + 10_000_000


def traffic(seed, late, n=600):
    """Packets of a few clients, then one packet much later that closes all flows."""
    rng = random.Random(seed)
    rows, now = [], T0
    for seq in range(n):
        now += rng.choice([0, 10, 3000, 20000])
        client = f"10.0.0.{rng.randrange(6)}"
        response = rng.random() < 0.5
        dns = (rng.randrange(4), response, rng.randrange(3) if response else 0, [rng.choice([1, 16, 255])])
        ends = [(client, 40000), ("192.0.2.1", rng.choice([53, 53, 443]))]
        (src, sp), (dst, dp) = ends[::-1] if response else ends
        shift = rng.choice([0, 0, 0, 40000]) if late else 0
        rows.append(packet(seq, now - shift, src, sp, dst, dp, rng.randrange(60, 900), dns=dns))
    assert now < END - 1_000_000
    return rows + [packet(n, END, "10.9.9.9", 1, "192.0.2.9", 2)]


def land(spark, rows, folder, files):
    """The packets as several files in arrival order."""
    size = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], PACKET_SCHEMA)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.read.parquet(f"{folder}/in")


def rounded(df):
    return df.select(
        [F.round(c, 3).alias(c) if FLOW_TYPES.get(c) == "double" else F.col(c) for c in df.columns]
    )


def drained(spark, folder, make, table):
    stream = run.packet_stream(spark, f"{folder}/in", table, files_per_batch=1)
    query = run.write_stream(make(stream), f"{folder}/out", f"{folder}/offsets")
    run.drain(query, 300)
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("late", [False, True])
def test_stateful_stream_equals_batch(spark, folder, late):
    run.use_rocksdb(spark)
    rows = traffic(11, late)
    table = land(spark, rows, folder, 4)
    found = drained(spark, folder, arrival_order_flows, table)
    wanted = flow_features(table, keep=("capture_id", "start_ms")).filter("src_ip <> '10.9.9.9'")
    found = rounded(found.select("start_ms", *FLOW_COLUMNS))
    wanted = rounded(wanted.select("start_ms", *FLOW_COLUMNS))
    assert found.count() == wanted.count() > 6
    assert found.exceptAll(wanted).count() == 0


def test_session_stream_equals_batch_in_order(spark, folder):
    rows = traffic(12, late=False)
    table = land(spark, rows, folder, 3)
    found = drained(spark, folder, session_flows, table)
    names = [c for c in found.columns if c != "capture_id"]
    wanted = flow_features(table, keep=("capture_id", "start_ms")).filter("src_ip <> '10.9.9.9'")
    found, wanted = rounded(found.select(names)), rounded(wanted.select(names))
    assert found.count() == wanted.count() > 6
    assert found.exceptAll(wanted).count() == 0


def test_session_gap_is_inclusive(spark):
    def sessions(gap):
        rows = [packet(1, T0), packet(2, T0 + gap)]
        return session_flows(spark.createDataFrame(rows, PACKET_SCHEMA)).count()

    assert sessions(120000) == 1
    assert sessions(120001) == 2


def test_invalid_time_does_not_move_the_watermark(spark, folder):
    rows = [packet(1, T0), packet(2, 1999999999999), packet(3, T0 + 1000), packet(4, END, "10.9.9.9")]
    table = land(spark, rows, folder, 4)
    found = drained(spark, folder, session_flows, table).collect()
    assert [r.total_fwd_packets for r in found] == [2]


@pytest.mark.parametrize("make", [session_flows, arrival_order_flows])
def test_open_flows_are_written_once_at_the_end(spark, folder, make):
    run.use_rocksdb(spark)
    rows = traffic(13, late=False)[:-1]
    table = land(spark, rows, folder, 3)

    def start():
        packets = run.packet_stream(spark, f"{folder}/in", table, files_per_batch=1)
        marked = run.with_end_marks(packets, f"{folder}/marks")
        return run.write_stream(make(marked), f"{folder}/out", f"{folder}/offsets")

    run.drain(start())
    before = spark.read.parquet(f"{folder}/out").count()
    run.finish(spark, start, f"{folder}/marks")
    run.finish(spark, start, f"{folder}/marks")
    found = spark.read.parquet(f"{folder}/out")
    names = [c for c in found.columns if c != "capture_id"]
    wanted = rounded(flow_features(table, keep=("capture_id", "start_ms")).select(names))
    assert before < found.count() == wanted.count()
    assert rounded(found.select(names)).exceptAll(wanted).count() == 0


def test_late_packets_are_counted_and_worked_in(spark, folder):
    """Several batches: the split's watermark follows the batches, nothing is lost or taken twice."""
    ordered = traffic(14, late=False)[:-1]
    rng = random.Random(2)
    held = [r for r in ordered if rng.random() < 0.2]
    rows = [r for r in ordered if r not in held]
    arrivals = [rows[:200], rows[200:], held[:40], held[40:], []]
    base = f"{folder}/split"
    sent, watermark, wanted = [], None, []
    for part in arrivals:
        table = spark.createDataFrame(part, PACKET_SCHEMA)
        table.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = run.packet_stream(spark, f"{folder}/in", table, files_per_batch=1)
        run.drain(late_rows.split_late(stream, base), 300)
        if watermark is not None:
            wanted += [r[1] for r in part if r[2] + 120_000 <= watermark]
        sent += part
        watermark = max(r[2] for r in sent) - 600_000
    late = late_rows.late_packets(spark, base)
    assert sorted(r.seq for r in late.collect()) == sorted(wanted) and wanted
    on_time = late_rows.on_time_packets(spark, base)
    assert sorted(r.seq for r in on_time.collect()) == sorted(r[1] for r in sent if r[1] not in wanted)
    assert sum(r.late_packets for r in late_rows.late_counts(late).collect()) == len(wanted)

    def start():
        marked = run.with_end_marks(late_rows.on_time_stream(spark, base), f"{folder}/marks")
        return run.write_stream(session_flows(marked), f"{folder}/out", f"{folder}/flow_offsets")

    run.finish(spark, start, f"{folder}/marks")
    flows = spark.read.parquet(f"{folder}/out")
    found = rounded(late_rows.repaired(flows, on_time, late))
    everything = rounded(session_flows(spark.createDataFrame(sent, PACKET_SCHEMA)))
    assert found.count() == everything.count() and found.exceptAll(everything).count() == 0
    assert rounded(flows).exceptAll(everything).count() > 0
    nothing = late_rows.repaired(flows, on_time, late.limit(0))
    assert nothing.exceptAll(flows).count() == 0 and nothing.count() == flows.count()


def test_emitting_a_flow_takes_few_calls():
    """Typing each column of a small frame took most of a conversation's time."""
    flow = dict.fromkeys(stateful._OUT_FIELDS, 3) | {"iat_min": None, "start_ms": 2**60 + 1}
    key = ("c", "10.0.0.1", 1, "10.0.0.2", 53, "UDP")
    profile = cProfile.Profile()
    frame = profile.runcall(stateful.FlowProcessor._emit, key, [flow, flow])
    assert list(frame.columns) == stateful._KEY_FIELDS + stateful._OUT_FIELDS and len(frame) == 2
    assert frame["start_ms"][1] == 2**60 + 1 and frame["iat_min"][0] is None and frame["lo_port"][0] == 1
    assert pstats.Stats(profile).total_calls < 3000
