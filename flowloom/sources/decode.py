"""Frames to packets: header fields of a batch of frames at once, by offsets into its bytes.

Only the DNS payload, whose names have variable length, is read row by row; a plan
that does not use its fields leaves that out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowloom.operators.packets import DNS_PORT
from flowloom.schemas import DNS_TYPE, PACKET_SCHEMA

# Fixed values of the link, network and transport headers.
LINK_ETHERNET = 1
LINK_NULL = 0
LINK_COOKED = 113
ETHERTYPE_IPV4 = 0x0800
ETHERTYPE_IPV6 = 0x86DD
VLAN_TAGS = [0x8100, 0x88A8]
PROTO_TCP = 6
PROTO_UDP = 17
IPV6_EXTENSIONS = [0, 43, 60]
IPV6_FRAGMENT = 44
DNS_TYPE_OPT = 41


def _number(data: Column, at: Column, size: int) -> Column:
    """Unsigned big-endian number; NULL beyond the end of the frame."""
    piece = F.substr(data, at + 1, F.lit(size))
    value = F.conv(F.hex(piece), 16, 10).cast("int")
    return F.when((at >= 0) & (F.length(data) >= at + size), value)


def _transport_of_ipv6(data: Column, at: Column) -> Column:
    """``(kind, at)`` of the transport header behind the extension headers, of one column of frames.

    :meth:`_Frames.behind_ipv6` is the same for a batch.
    """
    start = F.struct(_number(data, at + 6, 1).alias("kind"), (at + 40).alias("at"))

    def step(state: Column, _: Column) -> Column:
        kind, here = state["kind"], state["at"]
        later = F.struct(
            _number(data, here, 1).alias("kind"),
            (here + (_number(data, here + 1, 1) + 1) * 8).alias("at"),
        )
        first_fragment = F.floor(_number(data, here + 2, 2) / 8) == 0
        fragment = F.struct(
            F.when(first_fragment, _number(data, here, 1)).alias("kind"), (here + 8).alias("at")
        )
        return F.when(kind.isin(IPV6_EXTENSIONS), later).when(
            kind == IPV6_FRAGMENT, fragment
        ).otherwise(state)

    # Every header takes at least eight bytes, so a frame holds no more of them than this.
    most = F.greatest(F.lit(1), F.floor(F.length(data) / 8)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), most), start, step)


def _skip_name(payload: bytes, at: int) -> int:
    while True:
        size = payload[at]
        if size == 0:
            return at + 1
        if size >= 0xC0:
            return at + 2
        if size >= 0x40:
            raise ValueError("reserved label type")
        at += size + 1


def _read_name(payload: bytes, at: int) -> tuple[str, int]:
    """The name at ``at`` in lower case, and where reading goes on.

    A pointer must lead in front of all that was read of the name, so a message
    cannot lead in a circle.
    """
    labels, end, first = [], _skip_name(payload, at), at
    while size := payload[at]:
        if size >= 0xC0:
            target = (size & 0x3F) << 8 | payload[at + 1]
            if target >= first:
                raise ValueError("pointer leads into the name itself")
            at = first = target
            continue
        if size >= 0x40:
            raise ValueError("reserved label type")
        label = payload[at + 1 : at + 1 + size]
        if len(label) < size:
            raise IndexError("label beyond the message")
        labels.append(label.decode("ascii", "backslashreplace").lower())
        at += size + 1
    return ".".join(labels), end


def _parse_dns(payload: bytes | None):
    """Header counts and codes, questions, OPT sizes and times to live of answers; None if it is not DNS."""
    if payload is None or len(payload) < 12:
        return None
    ident, flags, qd, an, ns, ar = struct.unpack_from(">6H", payload)
    qtypes, opt_sizes, ttls, names, at = [], [], [], [], 12
    try:
        for _ in range(qd):
            name, at = _read_name(payload, at)
            names.append(name)
            qtypes.append(struct.unpack_from(">H", payload, at)[0])
            at += 4
        for i in range(an + ns + ar):
            at = _skip_name(payload, at)
            kind, size, ttl, length = struct.unpack_from(">HHIH", payload, at)
            if i < an:
                ttls.append(ttl)
            if kind == DNS_TYPE_OPT and i >= an + ns:
                opt_sizes.append(size)
            at += 10 + length
    except (IndexError, ValueError, struct.error):
        return None
    if at > len(payload):
        return None
    return ident, bool(flags >> 15), (flags >> 11) & 15, qd, an, qtypes, opt_sizes, flags & 15, ttls, names


_DNS_ARROW = to_arrow_type(DNS_TYPE)


@F.arrow_udf(DNS_TYPE)
def _dns_fields(payload: pa.Array) -> pa.Array:
    parsed = [None if p is None else _parse_dns(p) for p in payload.to_pylist()]
    known = [p for p in parsed if p is not None]
    columns = zip(*known) if known else [[]] * _DNS_ARROW.num_fields
    fields = [pa.array(c, f.type) for c, f in zip(columns, _DNS_ARROW)]
    found = pa.StructArray.from_arrays(fields, fields=list(_DNS_ARROW))
    is_known = np.fromiter((p is not None for p in parsed), bool, len(parsed))
    return found.take(pa.array(np.cumsum(is_known) - 1, mask=~is_known))


#: Stands for a missing number or place; it stays below 0 whatever is added to it.
_MISSING = -(1 << 40)


class _Frames:
    """Frames of a batch by their places in its bytes; numbers are read at a place of each frame."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray):
        self.data, self.begin, self.size = data, begin, size

    @classmethod
    def of(cls, frames: pa.Array) -> _Frames:
        frames = frames.cast(pa.large_binary())
        _, places, data = frames.buffers()
        places = np.frombuffer(places, np.int64, len(frames) + 1, 8 * frames.offset)
        present = frames.is_valid().to_numpy(zero_copy_only=False)
        held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        return cls(held, places[:-1], np.where(present, np.diff(places), _MISSING))

    def some(self, rows: np.ndarray) -> _Frames:
        return _Frames(self.data, self.begin[rows], self.size[rows])

    def number(self, at: np.ndarray | int, size: int) -> np.ndarray:
        """Unsigned big-endian number; missing beyond the end of the frame."""
        inside = (at >= 0) & (self.size >= at + size)
        place = np.where(inside, self.begin + at, 0)
        value = np.zeros(len(inside), np.int64)
        for i in range(size):
            value = value * 256 + self.data[np.where(inside, place + i, 0)]
        return np.where(inside, value, _MISSING)

    def behind_ipv6(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kind and place of the transport header behind the extension headers."""
        kind, here = self.number(at + 6, 1), at + 40
        # Every header takes at least eight bytes, so a frame holds no more of them than this.
        most, step = np.maximum(1, self.size // 8), 0
        while True:
            extended = (step < most) & np.isin(kind, IPV6_EXTENSIONS)
            fragment = (step < most) & (kind == IPV6_FRAGMENT)
            if not (extended | fragment).any():
                return kind, here
            following, length, offset = self.number(here, 1), self.number(here + 1, 1), self.number(here + 2, 2)
            first = (offset >= 0) & (offset < 8)
            kind = np.where(extended | (fragment & first), following, np.where(fragment, _MISSING, kind))
            further = np.where(length < 0, _MISSING, here + (length + 1) * 8)
            here = np.where(extended, further, np.where(fragment, here + 8, here))
            step += 1


def _texts(frames: _Frames, l3: np.ndarray, ip: np.ndarray, four: int, six: int) -> pa.Array:
    """Addresses at these places behind ``l3``: IPv4 dotted, IPv6 with all eight groups without
    leading zeros. Numbers beyond the end of the frame are left out.
    """
    made, place = [None], np.zeros(len(ip), np.int64)
    for version, start, groups, size, form, mark in ((4, four, 4, 1, "d", "."), (6, six, 8, 2, "x", ":")):
        rows = np.flatnonzero(ip == version)
        if not len(rows):
            continue
        some, at = frames.some(rows), l3[rows] + start
        numbers = np.stack([some.number(at + size * i, size) for i in range(groups)], axis=1)
        if version == 4:
            # As one number each, which is sorted faster than rows of four.
            keys = (np.where(numbers < 0, 256, numbers) << np.array([27, 18, 9, 0])).sum(axis=1)
            _, first, which = np.unique(keys, return_index=True, return_inverse=True)
            different = numbers[first]
        else:
            different, which = np.unique(numbers, axis=0, return_inverse=True)
        place[rows] = which.ravel() + len(made)
        made += [mark.join([format(n, form) for n in row if n >= 0]) for row in different.tolist()]
    return pa.array(made, pa.string()).take(pa.array(place))


def _known(values: np.ndarray) -> pa.Array:
    return pa.array(np.where(values < 0, 0, values), pa.int32(), mask=values < 0)


_HEADERS = "capture_id string, seq bigint, ts_ms bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, len int, ip_ttl int, _payload binary, status string"
_HEADER_NAMES = [c.split(" ")[0] for c in _HEADERS.split(", ")]


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Header fields of frames and, of datagrams from or to the DNS port, the payload."""
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch.column("frame")
        data = _Frames.of(held)
        link = batch.column("link_type").fill_null(-1).to_numpy(zero_copy_only=False)
        is_tag = np.isin(data.number(12, 2), VLAN_TAGS)
        tagged = np.where(is_tag & np.isin(data.number(16, 2), VLAN_TAGS), 22, np.where(is_tag, 18, 14))
        places = [link == LINK_ETHERNET, link == LINK_COOKED, link == LINK_NULL]
        l3 = np.select(places, [tagged, 16, 4], 0)
        kind = np.where(places[0] | places[1], data.number(l3 - 2, 2), _MISSING)
        first = data.number(l3, 1)
        ip = np.select(
            [
                (first // 16 == 4) & ((kind < 0) | (kind == ETHERTYPE_IPV4)),
                (first // 16 == 6) & ((kind < 0) | (kind == ETHERTYPE_IPV6)),
            ],
            [4, 6],
            0,
        )
        fragment = data.number(l3 + 6, 2)
        proto = np.where((ip == 4) & (fragment >= 0) & (fragment % 8192 == 0), data.number(l3 + 9, 1), _MISSING)
        at = np.where(ip == 4, l3 + first % 16 * 4, _MISSING)
        six = np.flatnonzero(ip == 6)
        if len(six):
            proto[six], at[six] = data.some(six).behind_ipv6(l3[six])
        whole = (at >= 0) & (data.size >= at + np.where(proto == PROTO_TCP, 20, 8))
        udp, tcp = whole & (proto == PROTO_UDP), whole & (proto == PROTO_TCP)
        there = np.where(udp | tcp, at, _MISSING)
        source, target = data.number(there, 2), data.number(there + 2, 2)
        # The UDP length leaves out link-layer padding behind the payload.
        end = at + np.maximum(data.number(at + 4, 2), 8)
        asked = udp & ((source == DNS_PORT) | (target == DNS_PORT))
        payloads: list[bytes | None] = [None] * len(at)
        raw = data.data.data
        for row in np.flatnonzero(asked).tolist():
            begin = int(data.begin[row])
            payloads[row] = bytes(raw[begin + int(at[row]) + 8 : begin + int(min(end[row], data.size[row]))])
        status = batch.column("status")
        other = ~(udp | tcp) & np.array([s == "ok" for s in status.to_pylist()], bool)
        ttl = np.select([ip == 4, ip == 6], [data.number(l3 + 8, 1), data.number(l3 + 7, 1)], _MISSING)
        protocol = pa.array(["TCP", "UDP"], pa.string()).take(pa.array(udp.astype(np.int8), mask=~(udp | tcp)))
        columns = [
            *(batch.column(c) for c in ("capture_id", "seq", "ts_ms")),
            _texts(data, l3, ip, 12, 8),
            _texts(data, l3, ip, 16, 24),
            _known(source),
            _known(target),
            protocol,
            _known(data.size),
            _known(ttl),
            pa.array(payloads, pa.binary()),
            pc.if_else(pa.array(other), "other", status),
        ]
        yield pa.RecordBatch.from_arrays(columns, _HEADER_NAMES)


def decode_frames(frames: DataFrame) -> DataFrame:
    """The packet table plus ``status``.

    Frames that are not IP over TCP or UDP keep a NULL protocol with status
    ``other``; damaged records keep the status of the reader. Filters such as
    :func:`flowloom.operators.packets.valid_packets` then drop both.
    """
    needed = {"capture_id": "string", "seq": "bigint", "ts_ms": "bigint", "link_type": "int", "frame": "binary", "status": "string"}
    plain = frames.select([F.col(c).cast(kind).alias(c) for c, kind in needed.items()])
    parsed = plain.mapInArrow(_headers, _HEADERS).withColumn("_dns", _dns_fields("_payload"))
    dns = F.when(F.col("_dns.id").isNotNull(), F.col("_dns"))
    columns = [dns.alias("dns") if n == "dns" else F.col(n) for n in PACKET_SCHEMA.fieldNames()]
    return parsed.select(*columns, "status")


def skipped_summary(decoded: DataFrame) -> DataFrame:
    """Records per status and their share of all records."""
    total = decoded.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = decoded.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", F.col("n") * 100.0 / total)
