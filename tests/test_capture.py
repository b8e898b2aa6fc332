"""Capture files: framing, splits, decoding."""

import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowloom.operators.flow_features import flow_features
from flowloom.plans.flow_tables import flows_from_captures
from flowloom.sources import capture
from flowloom.sources.decode import decode_frames, skipped_summary

T0 = int(datetime(2024, 1, 1).timestamp())


def udp(src, sp, dst, dp, payload, v6=False, vlan=False):
    body = struct.pack(">4H", sp, dp, 8 + len(payload), 0) + payload
    if v6:
        ip = struct.pack(">IHBB", 6 << 28, len(body), 17, 64) + src + dst
        kind = 0x86DD
    else:
        ip = struct.pack(">BBHIBBH", 0x45, 0, 20 + len(body), 0, 64, 17, 0) + bytes(src) + bytes(dst)
        kind = 0x0800
    tag = struct.pack(">HH", 0x8100, 5) if vlan else b""
    return bytes(12) + tag + struct.pack(">H", kind) + ip + body


def question(name, qtype=1):
    labels = b"".join(bytes([len(p)]) + p.encode() for p in name.split("."))
    return labels + b"\0" + struct.pack(">HH", qtype, 1)


def message(ident, flags, name, opt=None, answers=0, qtype=1):
    extra = b"\0" + struct.pack(">HHIH", 41, opt, 0, 0) if opt else b""
    rr = b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + bytes(4)
    head = struct.pack(">6H", ident, flags, 1, answers, 0, 1 if opt else 0)
    return head + question(name, qtype) + rr * answers + extra


def write(path, frames, order="<", magic=0xA1B2C3D4, scale=1000, snap=65535):
    with open(path, "wb") as out:
        out.write(struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, snap, 1))
        for ms, frame in frames:
            out.write(struct.pack(order + "4I", T0 + ms // 1000, ms % 1000 * scale, len(frame), len(frame)))
            out.write(frame)


CLIENT, SERVER = (1, 2, 3, 4), (8, 8, 8, 8)


def three_packets():
    return [
        (0, udp(CLIENT, 12345, SERVER, 53, message(0x1111, 0, "example.com"))),
        (10, udp(SERVER, 53, CLIENT, 12345, message(0x1111, 0x8183, "example.com"))),
        (20, udp(CLIENT, 12345, SERVER, 53, message(0x2222, 0, "test.com", opt=4096))),
    ]


def load(spark, path, **options):
    capture.register(spark)
    return spark.read.format("capture").options(**options).load(str(path))


@pytest.mark.parametrize(
    ("order", "magic", "scale"),
    [("<", 0xA1B2C3D4, 1000), (">", 0xA1B2C3D4, 1000), ("<", 0xA1B23C4D, 1000000)],
)
def test_three_packets(spark, folder, order, magic, scale):
    write(f"{folder}/a.pcap", three_packets(), order, magic, scale)
    rows = decode_frames(load(spark, folder)).orderBy("seq").collect()
    assert [r.len for r in rows] == [71, 71, 79]
    assert [r.ts_ms - T0 * 1000 for r in rows] == [0, 10, 20]
    assert [r.dns.id for r in rows] == [0x1111, 0x1111, 0x2222]
    assert [r.dns.qr for r in rows] == [False, True, False]
    assert rows[2].dns.opt_sizes == [4096]
    (flow,) = flows_from_captures(spark, folder, label="BENIGN").collect()
    assert (flow.src_ip, flow.src_port, flow.dst_ip) == ("1.2.3.4", 12345, "8.8.8.8")
    assert (flow.total_fwd_packets, flow.total_bwd_packets) == (2, 1)
    assert (flow.query_response_ratio, flow.label) == (2.0, "BENIGN")


def many(n, seed=0):
    frames = []
    for i in range(n):
        name = "x" * (1 + (i * 7 + seed) % 60)
        host = (10, 0, i // 250 % 250, i % 250)
        frames.append((i * 3, udp(host, 40000 + i % 100, SERVER, 53, message(i % 65536, 0, name))))
    return frames


@pytest.mark.parametrize("split", [4096, 10_000_000])
def test_splits_read_every_frame_once(spark, folder, split):
    write(f"{folder}/a.pcap", many(1500), snap=200)
    rows = load(spark, folder, splitBytes=str(split))
    whole = load(spark, folder)
    assert rows.count() == 1500
    assert rows.select("seq").distinct().count() == 1500
    assert rows.exceptAll(whole).count() == 0
    if split < 5000:
        assert rows.groupBy(F.spark_partition_id()).count().count() > 10


def test_capture_inside_a_frame_is_payload(spark, folder):
    write(f"{folder}/inner.pcap", many(12))
    with open(f"{folder}/inner.pcap", "rb") as inner:
        payload = inner.read()
    frames = [(i, udp(CLIENT, 1000, SERVER, 2000, payload)) for i in range(300)]
    import os

    os.makedirs(f"{folder}/outer")
    write(f"{folder}/outer/a.pcap", frames, snap=len(frames[0][1]))
    rows = load(spark, f"{folder}/outer", splitBytes="30000")
    assert rows.count() == 300
    assert rows.groupBy(F.spark_partition_id()).count().count() > 5


def test_odd_records_at_a_split_are_not_lost(spark, folder):
    frames = many(1500)
    frames = [(-T0 * 1000 + 5 if i % 40 < 3 else ms, f) for i, (ms, f) in enumerate(frames)]
    frames[0] = (0, frames[0][1])
    write(f"{folder}/a.pcap", frames, snap=200)
    rows = load(spark, folder, splitBytes="7777")
    assert rows.count() == 1500
    assert rows.groupBy(F.spark_partition_id()).count().count() > 5
    assert rows.select("seq").distinct().count() == 1500


def test_truncated_and_foreign_files(spark, folder):
    write(f"{folder}/a.pcap", many(10))
    with open(f"{folder}/a.pcap", "rb+") as file:
        file.truncate(900)
    with open(f"{folder}/b.txt", "w") as file:
        file.write("this is not a capture file at all, just some text")
    counts = {r.status: r.n for r in skipped_summary(decode_frames(load(spark, folder))).collect()}
    assert counts["truncated"] == 1
    assert counts["not a capture"] == 1
    assert counts["ok"] >= 7


def test_ipv6_vlan_and_malformed_dns(spark, folder):
    a, b = bytes.fromhex("20010db8" + "00" * 11 + "01"), bytes.fromhex("20010db8" + "00" * 11 + "02")
    frames = [
        (0, udp(a, 5000, b, 53, message(7, 0x8000, "a.b", answers=2, qtype=255), v6=True)),
        (1, udp(CLIENT, 5000, SERVER, 53, message(8, 0, "a.b"), vlan=True)),
        (2, udp(CLIENT, 5000, SERVER, 53, b"\xff" * 20)),
        (3, bytes(12) + b"\x08\x06" + bytes(28)),
    ]
    write(f"{folder}/a.pcap", frames)
    rows = decode_frames(load(spark, folder)).orderBy("seq").collect()
    assert rows[0].src_ip == "2001:db8:0:0:0:0:0:1"
    assert (rows[0].dns.ancount, rows[0].dns.qtypes, rows[0].ip_ttl) == (2, [255], 64)
    assert (rows[1].src_ip, rows[1].dns.id) == ("1.2.3.4", 8)
    assert rows[2].dns is None and rows[2].protocol == "UDP"
    assert (rows[3].protocol, rows[3].status) == (None, "other")
    flows = flow_features(decode_frames(load(spark, folder)))
    assert flows.agg(F.sum("total_fwd_packets")).first()[0] == 3


def test_long_chain_of_ipv6_headers(spark):
    from pyspark.sql import functions as F

    from flowloom.sources.decode import _transport_of_ipv6

    chain = 12
    fixed = bytes([0x60, 0, 0, 0, 0, 0, 0, 64]) + bytes(32)
    headers = b"".join(bytes([60 if i < chain - 1 else 17, 0, 1, 4, 0, 0, 0, 0]) for i in range(chain))
    data = bytearray(fixed + headers + bytes(8))
    data[6] = 60
    frame = spark.createDataFrame([(bytes(data),)], "data binary")
    row = frame.select(_transport_of_ipv6(F.col("data"), F.lit(0)).alias("x")).first()["x"]
    assert (row["kind"], row["at"]) == (17, 40 + 8 * chain)


def test_records_behind_a_bad_one_are_read_for_every_split(spark, folder):
    import struct

    from flowloom.sources import capture

    path = f"{folder}/bad.pcap"
    with open(path, "wb") as out:
        out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 2000, 1))
        for i in range(600):
            out.write(struct.pack("<4I", 1_700_000_000 + i, 0, 500_000 if i == 200 else 400, 400))
            out.write(bytes([i % 7]) * 400)
    capture.register(spark)
    found = []
    for split in ("100000000", "60000", "33333"):
        rows = spark.read.format("capture").option("splitBytes", split).load(path)
        found.append(sorted((r["seq"], r["status"]) for r in rows.select("seq", "status").collect()))
    assert found[0] == found[1] == found[2]
    assert sum(s == "ok" for _, s in found[0]) == 599
    assert sum(s == "malformed" for _, s in found[0]) == 1


def read_for_every_split(spark, path):
    found = set()
    for split in (100_000_000, 90_001, 60_000, 50_000, 33_333, 21_000, 15_000, 12_345, 9_999, 8_000):
        rows = load(spark, path, splitBytes=str(split)).select("seq", "ts_ms", "orig_len", "status")
        found.add(tuple(sorted(tuple(r) for r in rows.collect())))
    (same,) = found
    return same


@pytest.mark.parametrize("wrong", ["first", "all", "some", "start", "end"])
def test_wrong_clock_and_wrong_lengths_for_every_split(spark, folder, wrong):
    path = f"{folder}/a.pcap"
    with open(path, "wb") as out:
        out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 2000, 1))
        for i in range(400):
            off = {"all": True, "first": i == 0, "some": i % 5 == 2, "start": i % 5 == 2}.get(wrong, False)
            sec = i if off else T0 + i
            size = 250_000 if (wrong, i) in (("end", 300), ("start", 0)) else 400
            out.write(struct.pack("<4I", sec, i * 7, size, max(size, 400)))
            out.write(bytes([i % 7]) * 400)
    rows = read_for_every_split(spark, path)
    bad = wrong in ("start", "end")
    assert sum(r[3] == "ok" for r in rows) == 400 - bad
    assert sum(r[3] == "malformed" for r in rows) == bad
    if not bad:
        assert [r[0] for r in rows] == [24 + 416 * i for i in range(400)]


@pytest.mark.parametrize("kind", ["length", "both lengths", "zeros", "noise"])
@pytest.mark.parametrize("bad", ["97", "5", "2", "three at once", "first"])
def test_good_records_between_damages_are_all_read(kind, bad):
    """In process: any rate and kind of damage, any split size."""
    import io
    import random

    draw = random.Random(1)
    is_bad = {
        "97": lambda i: i % 97 == 5,
        "5": lambda i: i % 5 == 1,
        "2": lambda i: i % 2 == 1,
        "three at once": lambda i: i % 50 in (3, 4, 5),
        "first": lambda i: i == 0 or i % 7 == 3,
    }[bad]
    data, good, gaps, was_bad = bytearray(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262_144, 1)), [], [], False
    for i in range(1200):
        size = draw.randint(60, 1500)
        head = [1_700_000_000 + i, 0, size, size]
        if is_bad(i):
            if not was_bad:
                gaps.append([len(data), 0])
            gaps[-1][1] += 16 + size
            head = {
                "length": [*head[:2], 1 << 30, size],
                "both lengths": [*head[:2], *[draw.choice([1 << 30, 300_000])] * 2],
                "zeros": [0] * 4,
                "noise": [draw.getrandbits(32) | 1 << 31 for _ in range(4)],
            }[kind]
        else:
            good.append(len(data))
        was_bad = is_bad(i)
        data += struct.pack("<4I", *head) + draw.randbytes(size)
    for split in (10**9, 90_001, 300_000) if bad == "97" else (10**9, 300_000):
        source, rows = io.BytesIO(data), []
        reader = capture.CaptureReader({"path": "x", "splitbytes": str(split)})
        for part in range(-(-(len(data) - 24) // split)):
            read = reader._frames(source, capture.ByteRange("x", part, split, len(data)), bytes(data[:24]), "<", 1_000_000)
            rows += [r for batch in read for r in batch.to_pylist()]
        assert sorted(r["seq"] for r in rows if r["status"] == "ok") == good
        assert sorted([r["seq"], r["skipped"]] for r in rows if r["status"] == "malformed") == gaps


def test_flows_of_two_captures_are_audited_apart(spark, folder):
    from flowloom.operators.audit import audit_summary, flow_truth, strict_audit
    from flowloom.plans.flow_tables import FLOW_ID, stored

    write(f"{folder}/a.pcap", three_packets())
    write(f"{folder}/b.pcap", three_packets()[:2])
    flows = stored(flows_from_captures(spark, folder, label="BENIGN"), "flows")
    packets = stored(decode_frames(load(spark, folder)), "packets")
    assert flows.select("first_seq").distinct().count() == 1
    for flow_id in ("first_seq", FLOW_ID):
        assert sorted(r.n for r in flow_truth(flows, packets, flow_id).collect()) == [2, 3]
    report = stored(strict_audit(flows, packets, FLOW_ID), "report")
    assert report.filter("status <> 'PASS'").count() == 0
    lines = audit_summary(report).collect()
    assert sorted(r.is_total for r in lines) == [0, 0, 1]


def test_headers_of_a_batch_are_those_of_the_column_expressions(spark):
    """Whole, cut and damaged frames of all kinds, missing ones too."""
    import random

    from flowloom.sources.decode import _number, _transport_of_ipv6

    draw = random.Random(4)
    a, b = bytes.fromhex("20010db8" + "00" * 11 + "01"), bytes.fromhex("fe80" + "00" * 13 + "02")
    whole = udp(CLIENT, 5000, SERVER, 53, message(8, 0x8000, "a.b", opt=512, answers=2))
    six = udp(a, 53, b, 5000, message(7, 0, "a.b"), v6=True)
    chain = six[:20] + bytes([0]) + six[21:54] + bytes([44, 0] + [0] * 6) + bytes([17, 0, 0, 0] + [0] * 4) + six[54:]
    later = chain[:64] + bytes([1, 0]) + chain[66:]
    tcp = whole[:23] + b"\6" + whole[24:]
    seeds = [whole, six, chain, later, tcp, udp(CLIENT, 9, SERVER, 53, message(1, 0, "c"), vlan=True), whole + bytes(30)]
    rows = [(None, 1), (b"", 1), (whole, None)]
    for frame in seeds:
        rows += [(frame, link) for link in (0, 1, 113, 7)] + [(frame[14:], 7), (bytes(4) + frame[14:], 0)]
        rows += [(frame[: draw.randrange(len(frame))], 1) for _ in range(12)]
        for _ in range(25):
            spoilt = bytearray(frame)
            for _ in range(2):
                spoilt[draw.randrange(12, min(70, len(frame)))] = draw.randrange(256)
            rows.append((bytes(spoilt), draw.choice([1, 1, 1, 113, 0])))
    made = [("x", i, 1000 + i, link, 60, frame, "ok" if i % 9 else "malformed") for i, (frame, link) in enumerate(rows)]
    frames = spark.createDataFrame(made, "capture_id string, seq bigint, ts_ms bigint, link_type int, orig_len int, frame binary, status string").repartition(3)

    data, zero = F.col("frame"), F.lit(0)
    tags = [0x8100, 0x88A8]
    tag, second = _number(data, F.lit(12), 2), _number(data, F.lit(16), 2)
    start = F.when(tag.isin(tags) & second.isin(tags), 22).when(tag.isin(tags), 18).otherwise(14)
    link = F.col("link_type")
    l3 = F.when(link == 1, start).when(link == 113, 16).when(link == 0, 4).otherwise(zero)
    kind = F.when(link.isin(1, 113), _number(data, l3 - 2, 2))
    version = F.floor(_number(data, l3, 1) / 16)
    ip = F.when((version == 4) & (kind.isNull() | (kind == 0x0800)), 4).when((version == 6) & (kind.isNull() | (kind == 0x86DD)), 6)
    v4 = F.struct(
        F.when(_number(data, l3 + 6, 2) % 8192 == 0, _number(data, l3 + 9, 1)).alias("kind"),
        (l3 + (_number(data, l3, 1) % 16) * 4).alias("at"),
    )
    behind = F.when(ip == 4, v4).when(ip == 6, _transport_of_ipv6(data, l3))
    staged = frames.withColumns({"l3": l3, "ip": ip}).withColumn("behind", behind)
    at, proto, ip, l3 = F.col("behind.at"), F.col("behind.kind"), F.col("ip"), F.col("l3")
    enough = F.length(data) >= at + F.when(proto == 6, 20).otherwise(8)
    protocol = F.when((proto == 6) & enough, "TCP").when((proto == 17) & enough, "UDP")

    def by_ip(four, six):
        return F.when(ip == 4, four).when(ip == 6, six)

    def address(four, six):
        dotted = F.concat_ws(".", *[_number(data, l3 + four + i, 1).cast("string") for i in range(4)])
        return by_ip(dotted, F.concat_ws(":", *[F.lower(F.hex(_number(data, l3 + six + 2 * i, 2))) for i in range(8)]))

    wanted = staged.select(
        "seq",
        address(12, 8).alias("src_ip"),
        address(16, 24).alias("dst_ip"),
        F.when(protocol.isNotNull(), _number(data, at, 2)).alias("src_port"),
        F.when(protocol.isNotNull(), _number(data, at + 2, 2)).alias("dst_port"),
        protocol.alias("protocol"),
        F.length(data).alias("len"),
        by_ip(_number(data, l3 + 8, 1), _number(data, l3 + 7, 1)).alias("ip_ttl"),
        F.when((F.col("status") == "ok") & protocol.isNull(), "other").otherwise(F.col("status")).alias("status"),
    )
    found = decode_frames(frames)
    assert sorted(map(tuple, found.select(wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    assert found.filter("dns is not null").count() > 20


def test_small_ranges_share_a_task_and_their_split_points(spark, folder, monkeypatch):
    frames = many(6000)
    write(f"{folder}/a.pcap", frames, snap=200)
    write(f"{folder}/b.pcap", frames[:500], snap=200)
    reader = capture.CaptureReader({"path": folder, "splitbytes": "1000"})
    tasks = reader.partitions()
    assert sum(len(t.ranges) for t in tasks) > 500 and 32 <= len(tasks) <= 96
    looked = []
    monkeypatch.setattr(capture, "split_point", lambda read, start, *rest, f=capture.split_point: looked.append(start) or f(read, start, *rest))
    rows = [r for t in tasks for batch in reader.read(t) for r in batch.to_pylist()]
    assert len({(r["capture_id"], r["seq"]) for r in rows}) == len(rows) == 6500
    # Each range of its own would look at some six points for each of its ends.
    assert len(looked) < 6 * sum(len(t.ranges) for t in tasks)
