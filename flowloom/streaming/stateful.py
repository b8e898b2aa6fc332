"""Flows from a packet stream with arrival-order state per conversation.

Gives all 40 columns, including those that depend on the arrival order. Each
micro-batch of a conversation is processed as arrays: running maximum, flow
boundaries and sums per flow. Only the open flow is kept as state; open DNS
queries are kept per transaction id. An event-time timer closes idle flows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowloom.operators.flow_features import derive_dns, derive_rates
from flowloom.operators.sessions import IDLE_TIMEOUT_MS
from flowloom.schemas import FLOW_FIELDS
from flowloom.streaming.sessions import DEFAULT_DELAY, timed_facts

# State of the open flow: sums over its packets, all integers.
_SUMS = [
    "fwd_packets",
    "bwd_packets",
    "fwd_bytes",
    "bwd_bytes",
    "len_sq",
    "iat_n",
    "iat_sum",
    "iat_sq",
    "fwd_iat_n",
    "fwd_iat_sum",
    "bwd_iat_n",
    "bwd_iat_sum",
    "dns_packets",
    "queries",
    "responses",
    "query_bytes",
    "response_bytes",
    "answers",
    "any_questions",
    "txt_questions",
    "pair_n",
    "pair_sum",
    "pair_sq",
]
_MARKS = ["start_ms", "end_ms", "flow_rev", "len_min", "len_max", "iat_min", "iat_max"]
_LAST = ["last_lo", "last_hi"]
_STATE = _MARKS + _LAST + _SUMS
_STATE_TYPE = T.StructType([T.StructField(n, T.LongType()) for n in _STATE])

_KEY_FIELDS = ["capture_id", "lo_ip", "lo_port", "hi_ip", "hi_port", "protocol"]
_KEY_DDL = "capture_id string, lo_ip string, lo_port int, hi_ip string, hi_port int, protocol string"
_OUT_FIELDS = _MARKS + _SUMS
_OUT_COLUMNS = pd.Index(_KEY_FIELDS + _OUT_FIELDS)
_OUT_DDL = _KEY_DDL + ", " + ", ".join(f"{n} bigint" for n in _OUT_FIELDS)


def _smaller(a, b):
    return b if a is None else a if b is None else min(a, b)


def _larger(a, b):
    return b if a is None else a if b is None else max(a, b)


class _Batch:
    """Packets of one conversation in arrival order, as arrays.

    Flow 0 is the flow that was open before the batch; later ones start in it.
    NaN stands for "no value" in the gap and response-time arrays.
    """

    def __init__(self, parts: list[pd.DataFrame], state: dict | None, timeout_ms: int):
        order = np.argsort(np.concatenate([p["seq"].to_numpy() for p in parts]), kind="stable")

        def column(name: str, dtype: type) -> np.ndarray:
            return np.concatenate([p[name].to_numpy(dtype) for p in parts])[order]

        self.ts = column("ts_ms", np.int64)
        self.rev = column("rev", bool)
        self.length = column("len", np.int64)
        self.dns_id = column("dns_id", np.int64)
        self.response = column("is_response", bool)
        self.counts = np.column_stack([column(n, np.int64) for n in ("ancount", "any_questions", "txt_questions")])
        self._split(state, timeout_ms)
        self.gap = self._same_direction_gaps(state)

    def _split(self, state: dict | None, timeout_ms: int) -> None:
        # Without an open flow the clock is far enough back to start one.
        before = self.ts[0] - timeout_ms - 1 if state is None else state["end_ms"]
        top = np.maximum.accumulate(np.concatenate([[before], self.ts]))[:-1]
        new = self.ts - top > timeout_ms
        self.flow = np.cumsum(new)
        self.starts = np.flatnonzero(np.concatenate([[True], self.flow[1:] != self.flow[:-1]]))
        self.iat = np.where(~new & (self.ts >= top), self.ts - top, np.nan)
        first_rev = self.rev[self.starts].copy()
        if self.flow[0] == 0:
            first_rev[0] = bool(state["flow_rev"])
        sizes = np.diff(np.append(self.starts, len(self.ts)))
        self.first_rev = first_rev
        self.fwd = self.rev == np.repeat(first_rev, sizes)

    def _same_direction_gaps(self, state: dict | None) -> np.ndarray:
        gap = np.full(len(self.ts), np.nan)
        for side, name in ((False, "last_lo"), (True, "last_hi")):
            at = np.flatnonzero(self.rev == side)
            if not len(at):
                continue
            same = self.flow[at[1:]] == self.flow[at[:-1]]
            gap[at[1:]] = np.where(same, self.ts[at[1:]] - self.ts[at[:-1]], np.nan)
            if self.flow[at[0]] == 0 and state[name] is not None:
                gap[at[0]] = self.ts[at[0]] - state[name]
        return np.where(gap >= 0, gap, np.nan)

    def sums(self, pair: np.ndarray) -> np.ndarray:
        """Per flow the sums named in ``_SUMS``."""
        fwd, bwd, dns = self.fwd, ~self.fwd, self.dns_id >= 0
        query, answer = dns & ~self.response, dns & self.response

        def spread(values: np.ndarray, where: np.ndarray) -> list[np.ndarray]:
            held = np.where(where & ~np.isnan(values), values, 0).astype(np.int64)
            return [where & ~np.isnan(values), held, held * held]

        everywhere = np.ones(len(self.ts), bool)
        columns = [
            fwd,
            bwd,
            self.length * fwd,
            self.length * bwd,
            self.length * self.length,
            *spread(self.iat, everywhere),
            *spread(self.gap, fwd)[:2],
            *spread(self.gap, bwd)[:2],
            dns,
            query,
            answer,
            self.length * query,
            self.length * answer,
            *self.counts.T,
            *spread(pair, everywhere),
        ]
        return np.add.reduceat(np.column_stack(columns).astype(np.int64), self.starts, axis=0)

    def flows(self, state: dict | None, pair: np.ndarray) -> list[dict]:
        """The flows of the batch; the first one continues the open flow if there is one."""
        sums = self.sums(pair)
        ends = np.append(self.starts[1:], len(self.ts))
        result = []
        for i, (low, high) in enumerate(zip(self.starts, ends)):
            if self.flow[low] == 0:
                flow = dict(state)
            else:
                flow = dict.fromkeys(_SUMS, 0) | dict.fromkeys(_MARKS + _LAST)
                flow |= {"start_ms": int(self.ts[low]), "flow_rev": int(self.first_rev[i])}
            for name, value in zip(_SUMS, sums[i]):
                flow[name] += int(value)
            part = slice(low, high)
            gaps = self.iat[part][~np.isnan(self.iat[part])]
            flow["end_ms"] = _larger(flow["end_ms"], int(self.ts[part].max()))
            flow["len_min"] = _smaller(flow["len_min"], int(self.length[part].min()))
            flow["len_max"] = _larger(flow["len_max"], int(self.length[part].max()))
            if len(gaps):
                flow["iat_min"] = _smaller(flow["iat_min"], int(gaps.min()))
                flow["iat_max"] = _larger(flow["iat_max"], int(gaps.max()))
            for side, name in ((False, "last_lo"), (True, "last_hi")):
                times = self.ts[part][self.rev[part] == side]
                if len(times):
                    flow[name] = int(times[-1])
            result.append(flow)
        return result


class FlowProcessor(StatefulProcessor):
    """Keeps the open flow of one conversation and emits flows as they close."""

    def __init__(self, timeout_ms: int = IDLE_TIMEOUT_MS):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", _STATE_TYPE)
        self.pending = handle.getMapState("pending", "id int", "ts_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self._load()
        batch = _Batch(list(rows), state, self.timeout_ms)
        flows = batch.flows(state, self._response_times(batch, state is not None))
        if state is not None and batch.flow[0] > 0:
            flows.insert(0, state)
        *closed, last = flows
        self._store(last)
        if closed:
            yield self._emit(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._load()
        # Timers of earlier packets fire as well; only the last one closes the flow.
        due = expiredTimerInfo.getExpiryTimeInMs()
        if state is not None and due >= state["end_ms"] + self.timeout_ms + 1:
            self.flow.clear()
            self.pending.clear()
            yield self._emit(key, [state])

    def close(self) -> None:
        pass

    def _load(self) -> dict | None:
        held = self.flow.get()
        return None if held is None else dict(zip(_STATE, held))

    def _store(self, state: dict) -> None:
        self.flow.update(tuple(state[n] for n in _STATE))
        self.handle.registerTimer(state["end_ms"] + self.timeout_ms + 1)

    def _response_times(self, batch: _Batch, continued: bool) -> np.ndarray:
        """Time since the open query with the same id, and the open queries for later."""
        pair = np.full(len(batch.ts), np.nan)
        at = np.flatnonzero(batch.dns_id >= 0)
        at = at[np.lexsort((at, batch.dns_id[at], batch.flow[at]))]
        if len(at):
            ident, flow = batch.dns_id[at], batch.flow[at]
            follows = np.concatenate([[False], (ident[1:] == ident[:-1]) & (flow[1:] == flow[:-1])])
            asked = np.concatenate([[False], ~batch.response[at[:-1]]])
            sent = np.concatenate([[0], batch.ts[at[:-1]]])
            hit = follows & asked & batch.response[at]
            pair[at[hit]] = batch.ts[at[hit]] - sent[hit]
            for i in at[~follows & batch.response[at] & (flow == 0)]:
                mark = (int(batch.dns_id[i]),)
                if self.pending.containsKey(mark):
                    pair[i] = batch.ts[i] - self.pending.getValue(mark)[0]
        if continued and batch.flow[-1] > 0:
            self.pending.clear()
        if len(at):
            ends = np.append(~follows[1:], True) & (flow == batch.flow[-1])
            for i in at[ends]:
                mark = (int(batch.dns_id[i]),)
                if not batch.response[i]:
                    self.pending.updateValue(mark, (int(batch.ts[i]),))
                elif batch.flow[-1] == 0 and self.pending.containsKey(mark):
                    self.pending.removeKey(mark)
        return pair

    @staticmethod
    def _emit(key, states: list[dict]) -> pd.DataFrame:
        # One block of objects: to type each column takes longer than all the rest of a conversation.
        rows = np.empty((len(states), len(_OUT_COLUMNS)), dtype=object)
        for row, state in zip(rows, states, strict=True):
            row[:] = [*key, *(state[n] for n in _OUT_FIELDS)]
        return pd.DataFrame(rows, columns=_OUT_COLUMNS, copy=False)


def _sample_std(n: str, total: str, squares: str):
    count, size = F.col(n).cast("double"), F.col(total).cast("double")
    dev = F.greatest(F.col(squares) - size * size / count, F.lit(0.0))
    return F.when(count > 1, F.sqrt(dev / (count - 1))).otherwise(F.lit(0.0))


def _mean(total, count):
    return F.when(count > 0, total / count).otherwise(F.lit(0.0))


def _finish(raw: DataFrame) -> DataFrame:
    """State sums to the 40 flow columns, with the same expressions as in batch."""
    reverse = F.col("flow_rev") == 1

    def side(when_reverse: str, otherwise: str):
        return F.when(reverse, F.col(when_reverse)).otherwise(F.col(otherwise))

    n = F.col("fwd_packets") + F.col("bwd_packets")
    size = F.col("fwd_bytes") + F.col("bwd_bytes")
    pairs = F.col("pair_n").cast("double")
    mean_pair = F.col("pair_sum") / pairs
    flows = raw.withColumns(
        {
            "src_ip": side("hi_ip", "lo_ip"),
            "dst_ip": side("lo_ip", "hi_ip"),
            "src_port": side("hi_port", "lo_port"),
            "dst_port": side("lo_port", "hi_port"),
            "packet_total": n,
            "byte_total": size,
            "total_fwd_packets": F.col("fwd_packets"),
            "total_bwd_packets": F.col("bwd_packets"),
            "dns_total_queries": F.col("queries"),
            "dns_total_responses": F.col("responses"),
            "dns_query_bytes": F.col("query_bytes"),
            "dns_response_bytes": F.col("response_bytes"),
            "answer_total": F.col("answers"),
            "any_total": F.col("any_questions"),
            "txt_total": F.col("txt_questions"),
            "response_pairs": F.col("pair_n"),
            "response_var": F.when(pairs > 1, F.col("pair_sq") / pairs - mean_pair * mean_pair),
        }
    )
    flows = derive_dns(derive_rates(flows))
    flows = flows.withColumns(
        {
            "flow_length_min": F.col("len_min"),
            "flow_length_max": F.col("len_max"),
            "average_packet_size": _mean(F.col("byte_total"), F.col("packet_total")),
            "packet_size_std": _sample_std("packet_total", "byte_total", "len_sq"),
            "fwd_packet_length_mean": _mean(F.col("fwd_bytes"), F.col("fwd_packets")),
            "bwd_packet_length_mean": _mean(F.col("bwd_bytes"), F.col("bwd_packets")),
            "flow_iat_mean": _mean(F.col("iat_sum"), F.col("iat_n")),
            "flow_iat_std": _sample_std("iat_n", "iat_sum", "iat_sq"),
            "flow_iat_min": F.coalesce("iat_min", F.lit(0)),
            "flow_iat_max": F.coalesce("iat_max", F.lit(0)),
            "fwd_iat_mean": _mean(F.col("fwd_iat_sum"), F.col("fwd_iat_n")),
            "bwd_iat_mean": _mean(F.col("bwd_iat_sum"), F.col("bwd_iat_n")),
        }
    )
    return flows.select(
        "capture_id", "start_ms", *[F.col(c).cast(t).alias(c) for c, t in FLOW_FIELDS]
    )


def arrival_order_flows(
    packets: DataFrame,
    delay: str = DEFAULT_DELAY,
    timeout_ms: int = IDLE_TIMEOUT_MS,
    questions: str = "all",
) -> DataFrame:
    """Closed flows of a packet stream with all 40 columns.

    Needs the RocksDB state store. A conversation is one state key; the rows of
    one key per batch are bounded by the trigger (``maxFilesPerTrigger`` or the
    like), which also bounds the memory of a task.
    """
    facts = timed_facts(packets, delay, questions)
    flat = facts.select(
        F.col("capture_id"),
        F.col("ep_lo.ip").alias("lo_ip"),
        F.col("ep_lo.port").alias("lo_port"),
        F.col("ep_hi.ip").alias("hi_ip"),
        F.col("ep_hi.port").alias("hi_port"),
        F.col("protocol"),
        "ts",
        "seq",
        "ts_ms",
        "rev",
        "len",
        # No id means no DNS; ids are not negative.
        F.coalesce("dns_id", F.lit(-1)).alias("dns_id"),
        F.coalesce("is_response", F.lit(False)).alias("is_response"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ancount", "any_questions", "txt_questions")],
    )
    raw = flat.groupBy(*_KEY_FIELDS).transformWithStateInPandas(
        statefulProcessor=FlowProcessor(timeout_ms),
        outputStructType=_OUT_DDL,
        outputMode="Append",
        timeMode="eventTime",
    )
    return _finish(raw)
