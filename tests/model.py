"""A literal packet-by-packet flow model in plain Python, to compare the plans with.

Written from the rules of the survey, one packet at a time, with no windows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field


def packet(seq, ts, src="10.0.0.1", sp=40000, dst="192.0.2.1", dp=53, length=100, capture="c", protocol="UDP", ttl=64, dns=None):
    """A packet row; ``dns`` is ``(id, is_response, answers, [types])`` or None."""
    decoded = None
    if dns is not None:
        ident, response, answers, types = dns
        decoded = (ident, response, 0, len(types), answers, list(types), [], 0, [], [])
    return (capture, seq, ts, src, dst, sp, dp, protocol, length, ttl, decoded)


@dataclass
class Open:
    key: tuple
    start: int
    last: int
    lengths: list = field(default_factory=list)
    fwd: list = field(default_factory=list)
    bwd: list = field(default_factory=list)
    gaps: list = field(default_factory=list)
    dir_gaps: dict = field(default_factory=lambda: {True: [], False: []})
    dir_last: dict = field(default_factory=dict)
    pending: dict = field(default_factory=dict)
    times: list = field(default_factory=list)
    queries: list = field(default_factory=list)
    responses: list = field(default_factory=list)
    answers: int = 0
    types: list = field(default_factory=list)


def _std(values):
    if len(values) < 2:
        return 0.0
    mean = sum(values) / len(values)
    return math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1))


def _mean(values):
    return sum(values) / len(values) if values else 0.0


def run(rows, timeout=120000):
    """Flow rows (dicts) of the packets in ``seq`` order."""
    opened, done = {}, []
    for cap, _, ts, src, dst, sp, dp, proto, length, _, dns in sorted(rows, key=lambda r: r[1]):
        if not 1483228800000 <= ts <= 1893456000000 or proto not in ("TCP", "UDP"):
            continue
        key, back = (cap, src, sp, dst, dp, proto), (cap, dst, dp, src, sp, proto)
        found = key if key in opened else back if back in opened else None
        if found is not None and ts - opened[found].last > timeout:
            done.append(opened.pop(found))
            found = None
        if found is None:
            opened[key] = Open(key, ts, ts)
            found = key
        flow, forward = opened[found], found == key
        if flow.lengths and ts >= flow.last:
            flow.gaps.append(ts - flow.last)
        flow.lengths.append(length)
        (flow.fwd if forward else flow.bwd).append(length)
        if forward in flow.dir_last and ts >= flow.dir_last[forward]:
            flow.dir_gaps[forward].append(ts - flow.dir_last[forward])
        flow.dir_last[forward] = ts
        flow.last = max(flow.last, ts)
        if dns is not None and 53 in (sp, dp):
            ident, response, _, _, answers, types, *_ = dns
            flow.answers += answers
            flow.types += types
            if response:
                flow.responses.append(length)
                if ident in flow.pending:
                    flow.times.append(ts - flow.pending.pop(ident))
            else:
                flow.queries.append(length)
                flow.pending[ident] = ts
    return [_row(f) for f in done + list(opened.values())]


def _row(flow):
    q, r = len(flow.queries), len(flow.responses)
    qb, rb = sum(flow.queries), sum(flow.responses)
    duration = flow.last - flow.start
    seconds = duration / 1000 if duration > 0 else 1.0
    total = sum(flow.lengths)
    mean_time = _mean(flow.times)
    n = len(flow.times)
    is_dns = q + r > 0
    return {
        "capture_id": flow.key[0],
        "src_ip": flow.key[1],
        "src_port": flow.key[2],
        "dst_ip": flow.key[3],
        "dst_port": flow.key[4],
        "protocol": flow.key[5],
        "start_ms": flow.start,
        "flow_duration": duration,
        "total_fwd_packets": len(flow.fwd),
        "total_bwd_packets": len(flow.bwd),
        "total_fwd_bytes": float(sum(flow.fwd)),
        "total_bwd_bytes": float(sum(flow.bwd)),
        "dns_total_queries": q,
        "dns_total_responses": r,
        "dns_response_bytes": rb,
        "dns_amplification_factor": rb / qb if qb else 999.0 if rb else 0.0,
        "query_response_ratio": q / r if r else float(q),
        "dns_any_query_ratio": flow.types.count(255) / q if q else 0.0,
        "dns_txt_query_ratio": flow.types.count(16) / q if q else 0.0,
        "dns_response_inconsistency": abs(q - r),
        "dns_queries_per_second": q / seconds,
        "dns_mean_answers_per_query": flow.answers / r if r else 0.0,
        "port_53_traffic_ratio": (qb + rb) / total if is_dns else 0.0,
        "flow_bytes_per_sec": total / seconds,
        "flow_packets_per_sec": len(flow.lengths) / seconds,
        "flow_iat_mean": _mean(flow.gaps),
        "flow_iat_std": _std(flow.gaps),
        "flow_iat_min": float(min(flow.gaps, default=0)),
        "flow_iat_max": float(max(flow.gaps, default=0)),
        "fwd_iat_mean": _mean(flow.dir_gaps[True]),
        "bwd_iat_mean": _mean(flow.dir_gaps[False]),
        "fwd_packet_length_mean": _mean(flow.fwd),
        "bwd_packet_length_mean": _mean(flow.bwd),
        "packet_size_std": _std(flow.lengths),
        "average_packet_size": _mean(flow.lengths),
        "response_time_variance": sum((t - mean_time) ** 2 for t in flow.times) / n if n > 1 else 0.0,
    }
