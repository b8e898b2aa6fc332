"""DNS names, response codes, answer times, and the attack rules on planted traffic."""

import math
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowloom.operators import name_features
from flowloom.operators.flow_features import flow_features, with_server_fanout
from flowloom.operators.packets import FLOW_KEY
from flowloom.operators.sessions import HotKeyPolicy, assign_flows
from flowloom.schemas import PACKET_SCHEMA
from flowloom.sources.decode import _parse_dns

T0 = 1704067200000


def labels(name):
    return b"".join(bytes([len(p)]) + p.encode() for p in name.split(".")) + b"\0"


def message(flags, questions, answers=(), others=()):
    head = struct.pack(">6H", 7, flags, len(questions), len(answers), len(others), 0)
    body = b"".join(q + struct.pack(">HH", 1, 1) for q in questions)
    body += b"".join(n + struct.pack(">HHIH", 1, 1, ttl, 4) + bytes(4) for n, ttl in [*answers, *others])
    return head + body


def test_names_codes_and_times_are_read():
    parsed = _parse_dns(message(0x8183, [labels("WWW.Example.com")], [(b"\xc0\x0c", 60), (b"\xc0\x10", 2**32 - 1)], [(b"\0", 9)]))
    assert parsed[1] and parsed[7:] == (3, [60, 2**32 - 1], ["www.example.com"])
    second = message(0, [labels("a.b"), b"\x01c\xc0\x0c"])
    assert _parse_dns(second)[9] == ["a.b", "c.a.b"]
    assert _parse_dns(message(0, [b"\0"]))[9] == [""]
    assert _parse_dns(message(0, [b"\x02\xff\x41\0"]))[9] == ["\\xffa"]


@pytest.mark.parametrize("name", [b"\xc0\x0c", b"\xc0\xff", b"\x01a\xc0\x0c", b"\x40\0", b"\x05ab"])
def test_names_that_lead_nowhere_are_no_dns(name):
    assert _parse_dns(message(0, [name])) is None


def packet(seq, ms, src, sp, dst, dp, length=100, protocol="UDP", dns=None):
    decoded = None
    if dns is not None:
        response, rcode, ttls, name = dns
        decoded = (seq % 1000, response, 0, 1, len(ttls), [1], [], rcode, ttls, [name])
    return ("c", seq, T0 + ms, src, dst, sp, dp, protocol, length, 64, decoded)


def planted():
    """One flow of each attack and a harmless one; clients are named by the attack."""
    rows, seq = [], 0

    def send(*args, **more):
        nonlocal seq
        rows.append(packet(seq, *args, **more))
        seq += 1

    for i in range(300):
        send(i, "10.0.0.1", 1000, "9.9.9.9", 53, protocol="TCP")
    for i in range(1200):
        send(2 * i, "10.0.0.2", 1000, "9.9.9.9", 53, dns=(False, 0, [], f"x{i}.victim.com"))
        send(2 * i + 1, "9.9.9.9", 53, "10.0.0.2", 1000, dns=(True, 3, [], f"x{i}.victim.com"))
    for i in range(5):
        send(500 * i, "10.0.0.3", 1000, "9.9.9.9", 53, 60, dns=(False, 0, [], "any.com"))
        send(500 * i + 9, "9.9.9.9", 53, "10.0.0.3", 1000, 3000, dns=(True, 0, [60], "any.com"))
        send(500 * i, "10.0.0.4", 1000, "9.9.9.9", 53, 90, dns=(False, 0, [], "many.com"))
        send(500 * i + 9, "9.9.9.9", 53, "10.0.0.4", 1000, 500, dns=(True, 0, [60] * 12, "many.com"))
        send(500 * i, "9.9.9.9", 53, "10.0.0.6", 1000, 100, dns=(True, 0, [1], "bank.com"))
        send(500 * i, "10.0.0.7", 1000, "9.9.9.9", 53, 80, dns=(False, 0, [], "good.com"))
        send(500 * i + 9, "9.9.9.9", 53, "10.0.0.7", 1000, 120, dns=(True, 0, [300], "good.com"))
    for i in range(600):
        send(2 * i, "10.0.0.5", 1000, "9.9.9.9", 53, dns=(False, 0, [], "one.com"))
    return rows


def rated(spark, policy=None):
    packets = spark.createDataFrame(planted(), PACKET_SCHEMA)
    more = {} if policy is None else {"policy": policy}
    assigned = assign_flows(packets, extra=name_features.NAME_FIELDS, **more)
    features = name_features.name_features(assigned)
    names = name_features.unique_names(name_features.names_asked(assigned), [*FLOW_KEY, "flow_no"])
    of_flows = features.join(names, [*FLOW_KEY, "flow_no"], "left")
    flows = flow_features(packets, keep=("capture_id", "first_seq"))
    key = ["capture_id", "first_seq"]
    rates = features.select(*key, "nxdomain_rate", "error_rate", "name_length_mean", "name_length_max", "name_entropy", "answer_ttl_mean")
    return name_features.with_attack_type(flows, rates, of_flows.select(*key, "unique_domains"), key).collect(), assigned, packets


@pytest.mark.parametrize("policy", [None, HotKeyPolicy(min_rows=100, one_in=1, chunk_span=64)])
def test_each_attack_gets_its_label(spark, policy):
    """Also where conversations are cut into chunks."""
    rows, _, _ = rated(spark, policy)
    client = lambda r: r.dst_ip if r.src_ip == "9.9.9.9" else r.src_ip
    assert {client(r): r.attack_type for r in rows} == {
        "10.0.0.1": "handshake flood",
        "10.0.0.2": "water torture",
        "10.0.0.3": "amplification",
        "10.0.0.4": "reflection",
        "10.0.0.5": "query flood",
        "10.0.0.6": "spoofing",
        "10.0.0.7": None,
    }
    torture = next(r for r in rows if client(r) == "10.0.0.2")
    names = [f"x{i}.victim.com" for i in range(1200)]
    chars = Counter("".join(names))
    entropy = -sum(c / chars.total() * math.log2(c / chars.total()) for c in chars.values())
    assert torture.name_entropy == pytest.approx(entropy) and torture.unique_domains == 1200
    assert torture.name_length_mean == pytest.approx(sum(map(len, names)) / 1200)
    assert (torture.name_length_max, torture.nxdomain_rate) == (16, 1.0)
    assert next(r for r in rows if client(r) == "10.0.0.7").answer_ttl_mean == 300.0


def test_merged_sketches_come_near_the_exact_count(spark):
    _, assigned, packets = rated(spark)
    sketches = name_features.name_sketches(name_features.names_asked(assigned))
    found = {r.client: r.estimated_domains for r in name_features.clients_of_sketches(sketches).collect()}
    exact = {r.client: r.unique_domains for r in name_features.names_of_clients(packets).collect()}
    assert set(found) == set(exact) and exact["10.0.0.2"] == 1200
    assert all(abs(found[c] - n) <= max(0.5, 0.05 * n) for c, n in exact.items())


def test_fanout_of_many_clients_is_joined_by_salts(spark):
    flows = flow_features(spark.createDataFrame(planted(), PACKET_SCHEMA))
    small, large = with_server_fanout(flows), with_server_fanout(flows, most_broadcast=0)
    assert "Broadcast" in small._jdf.queryExecution().toString()
    assert "_salt" in large._jdf.queryExecution().toString()
    assert small.exceptAll(large).count() == 0 and large.count() == flows.count()
    assert large.agg(F.max("dns_server_fanout")).first()[0] == 1
