"""Packets to bidirectional flows with an idle timeout.

A flow is a maximal run of packets of one conversation, in arrival order, in
which no packet comes more than ``timeout_ms`` after the latest time seen so
far. The first packet in arrival order defines the forward direction.

Ordinary conversations are handled by windows over one hash partitioning on the
flow key. Conversations above a row bound are *hot*: they are cut into chunks of
the arrival order, each chunk is an own window group, and what a chunk must know
about earlier chunks (running time, flow number, direction, last packet per
direction, open DNS transactions) is carried over chunk summaries. Both ways
give every packet the same columns, so all features are computed by the same
code and no row is dropped whichever way it takes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.ordered import before_chunks
from flowloom.operators.packets import FLOW_KEY, packet_facts, valid_packets, with_flow_key
from flowloom.tables import stored

# Fixed value: a gap of exactly this long still belongs to the flow.
IDLE_TIMEOUT_MS = 120000


@dataclass(frozen=True)
class HotKeyPolicy:
    """When a conversation is cut into chunks.

    ``min_rows``: a conversation above about this many packets is hot.
    ``one_in``: packets looked at to find hot keys, chosen by a hash of the
    packet's identity. This only routes: both routes give the same rows, so
    the estimate cannot change a result.
    ``chunk_span``: width of a chunk in units of ``seq``; with ``seq`` unique in
    a capture no window group holds more rows than that.
    """

    min_rows: int = 1 << 22
    one_in: int = 1024
    chunk_span: int = 1 << 20


DEFAULT_POLICY = HotKeyPolicy()

#: Packets of one task of the windows. Its sorts take about 1 KB a packet at a time.
TASK_ROWS = 1 << 19


def hot_keys(packets: DataFrame, policy: HotKeyPolicy = DEFAULT_POLICY) -> DataFrame | None:
    """All keys of hot conversations as a stored table, or None if there are none."""
    return _hot_keys(packets, policy)[0]


def _hot_keys(packets: DataFrame, policy: HotKeyPolicy) -> tuple[DataFrame | None, int]:
    """The table of :func:`hot_keys` and about how many packets there are.

    Runs one narrow job (key columns of one packet in ``one_in``), so the routing
    is fixed before the actual plan is built. Spark broadcasts the table where
    its stored size allows that and joins it by shuffle otherwise.
    """
    keyed = with_flow_key(packets)
    if policy.one_in > 1:
        keyed = keyed.filter(F.pmod(F.xxhash64("capture_id", "seq"), F.lit(policy.one_in)) == 0)
    # Stored, for it is read twice. An Observation would make models fitted later in the session unserializable.
    counted = stored(keyed.groupBy(*FLOW_KEY).count(), "key-counts")
    rows = (counted.agg(F.sum("count")).first()[0] or 0) * policy.one_in
    hot = counted.filter(F.col("count") >= max(1, policy.min_rows // policy.one_in))
    table = stored(hot.drop("count"), "hot-keys")
    return (None if table.isEmpty() else table), rows


def _dealt(facts: DataFrame, rows: int) -> DataFrame:
    """``facts`` in as many partitions as ``rows`` need where the session's number is too small.

    With a fixed number the rows of a task, and the memory of its sorts, grow with the input.
    """
    tasks = -(-rows // TASK_ROWS)
    usual = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return facts.repartition(tasks, *FLOW_KEY) if tasks > usual else facts


def _mark_starts(packets: DataFrame, part: list[str], timeout_ms: int, carried: bool) -> DataFrame:
    """``prev_max`` (latest time before the packet) and ``is_new`` (opens a flow)."""
    w = Window.partitionBy(*part).orderBy("seq")
    prev_max = F.max("ts_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    if carried:
        prev_max = F.greatest(prev_max, F.col("carry.top_ms"))
    return packets.withColumn("prev_max", prev_max).withColumn(
        "is_new", F.col("prev_max").isNull() | (F.col("ts_ms") - F.col("prev_max") > timeout_ms)
    )


def _number(packets: DataFrame, part: list[str], base: Column, open_rev: Column) -> DataFrame:
    """``flow_no`` (1, 2, ... per key) and ``flow_rev`` (direction of its first packet)."""
    w = Window.partitionBy(*part).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    started_rev = F.last(F.when(F.col("is_new"), F.col("rev")), ignorenulls=True).over(w)
    return packets.withColumns(
        {
            "flow_no": base + F.sum(F.col("is_new").cast("long")).over(w),
            "flow_rev": F.coalesce(started_rev, open_rev),
        }
    )


def _seen(flow_no: str = "flow_no") -> Column:
    return F.struct(F.col(flow_no).alias("flow_no"), F.col("ts_ms").alias("ts_ms"))


def _gaps(packets: DataFrame, part: list[str], carried: bool) -> DataFrame:
    """Inter-arrival times: of the flow (from its latest time) and per direction.

    A late packet has no flow gap. The directional gap starts at the previous
    packet of the same direction in arrival order, and only gaps >= 0 count.
    """
    w = Window.partitionBy(*part).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)

    def previous(reverse: bool) -> Column:
        match = F.col("rev") if reverse else ~F.col("rev")
        seen = F.last(F.when(match, _seen()), ignorenulls=True).over(w)
        return F.coalesce(seen, F.col("carry.rev" if reverse else "carry.fwd")) if carried else seen

    late = F.col("ts_ms") < F.col("prev_max")
    packets = packets.withColumn(
        "prev_same", F.when(F.col("rev"), previous(True)).otherwise(previous(False))
    )
    dir_gap = F.col("ts_ms") - F.col("prev_same.ts_ms")
    same_flow = F.col("prev_same.flow_no") == F.col("flow_no")
    return packets.withColumns(
        {
            "is_fwd": F.col("rev") == F.col("flow_rev"),
            "flow_iat": F.when(~F.col("is_new") & ~late, F.col("ts_ms") - F.col("prev_max")),
            "dir_iat": F.when(same_flow & (dir_gap >= 0), dir_gap),
        }
    ).drop("prev_same", "prev_max")


def _pair(packets: DataFrame, part: list[str], carry: Column | None) -> DataFrame:
    """``response_ms``: time from the latest unanswered query with the same id.

    A response is answered by the DNS packet just before it with its id: if that
    is a query of the same flow, the two are a pair; otherwise none is open.
    """
    # As with the key, a hash in front keeps the sort on machine words.
    packets = packets.withColumn("id_hash", F.xxhash64(part[0], "dns_id"))
    w = Window.partitionBy("id_hash", "dns_id", *part).orderBy("seq")
    before = F.lag(F.struct("flow_no", "ts_ms", "is_response")).over(w)
    packets = packets.withColumn("dns_before", before if carry is None else F.coalesce(before, carry))
    paired = (
        F.col("is_response")
        & (F.col("dns_before.flow_no") == F.col("flow_no"))
        & ~F.col("dns_before.is_response")
    )
    return packets.withColumn(
        "response_ms", F.when(paired, F.col("ts_ms") - F.col("dns_before.ts_ms"))
    ).drop("dns_before", "id_hash")


def _ordinary(facts: DataFrame, timeout_ms: int) -> DataFrame:
    marked = _mark_starts(facts, FLOW_KEY, timeout_ms, carried=False)
    numbered = _number(marked, FLOW_KEY, F.lit(0), F.lit(None).cast("boolean"))
    return _pair(_gaps(numbered, FLOW_KEY, carried=False), FLOW_KEY, None)


def _chunked(facts: DataFrame, timeout_ms: int, span: int) -> DataFrame:
    """Flow columns chunk by chunk. ``facts`` is a stored table, for it is read twice.

    The hot rows are shuffled three times: to number flows inside the chunks
    (stored), for the gaps, and for the open transactions. All else are chunk
    summaries.
    """
    part = ["chunk", *FLOW_KEY]
    facts = facts.withColumn("chunk", F.floor(F.col("seq") / F.lit(span)))

    # Latest time before each chunk.
    top = facts.groupBy(*part).agg(F.max("ts_ms").alias("chunk_top"))
    top = before_chunks(stored(top, "tops"), FLOW_KEY, {"top_ms": ("max", "chunk_top")})
    top = top.select(*part, F.struct("top_ms").alias("carry"))
    marked = _mark_starts(facts.join(top, part, "left"), part, timeout_ms, carried=True)

    # Flows are numbered inside the chunks first.
    local = stored(_number(marked.drop("carry"), part, F.lit(0), F.lit(None).cast("boolean")), "chunks")

    # Flow number, direction and last packet per direction before each chunk.
    by_seq = F.struct("seq", "flow_no", "ts_ms")
    ends = local.groupBy(*part).agg(
        F.sum(F.col("is_new").cast("long")).alias("starts"),
        F.max(F.when(F.col("is_new"), F.struct("seq", "rev")))["rev"].alias("last_start_rev"),
        F.max(F.when(~F.col("rev"), by_seq)).alias("last_fwd"),
        F.max(F.when(F.col("rev"), by_seq)).alias("last_rev"),
    )
    ends = stored(before_chunks(stored(ends, "ends"), FLOW_KEY, {"base": ("sum", "starts")}), "ends")

    def numbered_end(name: str) -> Column:
        end = F.col(name)
        number = (F.col("base") + end["flow_no"]).alias("flow_no")
        return F.when(end.isNotNull(), F.struct(number, end["ts_ms"].alias("ts_ms")))

    ends = ends.withColumns({"end_fwd": numbered_end("last_fwd"), "end_rev": numbered_end("last_rev")})
    carried = {
        "open_rev": ("last", "last_start_rev"),
        "fwd": ("last", "end_fwd"),
        "back": ("last", "end_rev"),
    }
    carry = before_chunks(ends, FLOW_KEY, carried).select(
        *part, F.struct("base", "open_rev", "fwd", F.col("back").alias("rev")).alias("carry")
    )
    numbered = local.join(stored(carry, "carries"), part, "left").withColumns(
        {
            "flow_no": F.col("carry.base") + F.col("flow_no"),
            "flow_rev": F.coalesce("flow_rev", F.col("carry.open_rev")),
        }
    )
    gapped = _gaps(numbered, part, carried=True).drop("carry")

    # Last DNS packet per transaction id before each chunk.
    last_dns = (
        numbered.filter(F.col("dns_id").isNotNull())
        .groupBy(*part, "dns_id")
        .agg(F.max(F.struct("seq", "flow_no", "ts_ms", "is_response")).alias("last"))
    )
    dns_carry = before_chunks(stored(last_dns, "open"), [*FLOW_KEY, "dns_id"], {"earlier": ("last", "last")})
    dns_carry = dns_carry.select(
        *part, "dns_id", F.struct("earlier.flow_no", "earlier.ts_ms", "earlier.is_response").alias("open")
    )
    paired = _pair(gapped.join(dns_carry, part + ["dns_id"], "left"), part, F.col("open"))
    return paired.drop("chunk", "open")


def flow_parts(
    packets: DataFrame,
    timeout_ms: int = IDLE_TIMEOUT_MS,
    policy: HotKeyPolicy | None = DEFAULT_POLICY,
    questions: str = "all",
    extra: Sequence[str] = (),
) -> list[DataFrame]:
    """Packets with flow columns, one DataFrame per route (ordinary, then hot)."""
    packets = valid_packets(packets)
    facts = packet_facts(packets, questions, extra)
    hot, rows = _hot_keys(packets, policy) if policy else (None, 0)
    if hot is None:
        return [_ordinary(_dealt(facts, rows), timeout_ms)]
    # The packets are read and decoded once for both routes.
    routed = facts.join(hot.withColumn("is_hot", F.lit(True)), FLOW_KEY, "left")
    routed = routed.withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
    table = stored(routed, "facts", by="is_hot")
    return [
        _ordinary(_dealt(table.filter(~F.col("is_hot")).drop("is_hot"), rows), timeout_ms),
        _chunked(table.filter("is_hot").drop("is_hot"), timeout_ms, policy.chunk_span),
    ]


def assign_flows(
    packets: DataFrame,
    timeout_ms: int = IDLE_TIMEOUT_MS,
    policy: HotKeyPolicy | None = DEFAULT_POLICY,
    questions: str = "all",
    extra: Sequence[str] = (),
) -> DataFrame:
    """Valid packets with ``flow_no``, ``is_new``, ``is_fwd`` and inter-arrival times."""
    first, *rest = flow_parts(packets, timeout_ms, policy, questions, extra)
    for part in rest:
        first = first.unionByName(part)
    return first
