"""Slots over streams of packets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEY = ["capture_id", "ip_a", "port_a", "ip_b", "port_b", "proto"]


def absolute_slots(packets: DataFrame, width: str, late: str, time: str = "ts") -> DataFrame:
    """Packets and payload of each flow in windows of absolute time, in all and from either end; packets later than late are
    dropped, and a window is given out once the watermark has passed it."""
    p = packets.withWatermark(time, late).groupBy(*KEY, F.window(time, width))
    from_a = F.col("src") == F.col("ip_a")
    sums = [F.count(F.lit(1)).alias("packets"), F.sum("payload").alias("payload")]
    for end, own in (("a", from_a), ("b", ~from_a)):
        sums += [F.count_if(own).alias(f"packets_{end}"), F.coalesce(F.sum(F.when(own, F.col("payload"))), F.lit(0.0)).alias(f"payload_{end}")]
    names = ["packets", "payload", "packets_a", "payload_a", "packets_b", "payload_b"]
    return p.agg(*sums).select(*KEY, F.col("window.start").alias("start"), *names)


class _FirstPacket(StatefulProcessor):
    """Keeps a flow's first packet's time and source, its number of packets and when it ends; gives out each packet's slot."""

    def __init__(self, w_ns: int, horizon_ns: int) -> None:
        self.w_ns, self.horizon_ns = w_ns, horizon_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", "t_ns long, src string, n long, ends_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        p = pd.concat(list(rows)).sort_values(["t_ns", "row_pos"], kind="stable")
        if self.flow.exists():
            start, src, n, ends = self.flow.get()
            self.handle.deleteTimer(ends)
        else:
            start, src, n, ends = int(p["t_ns"].iloc[0]), str(p["src"].iloc[0]), 0, 0
        nth = pd.Series(range(n + 1, n + len(p) + 1), index=p.index)
        ends = max(ends, (int(p["t_ns"].max()) + self.horizon_ns) // 1_000_000 + 1)
        self.flow.update((start, src, n + len(p), ends))
        self.handle.registerTimer(ends)
        elapsed = p["t_ns"] - start
        slot = (elapsed // self.w_ns).clip(upper=self.horizon_ns // self.w_ns).astype("Int64").mask(elapsed < 0)
        out = pd.DataFrame({"capture_id": key[0], "row_pos": p["row_pos"], "slot": slot, "fwd": p["src"] == src, "payload": p["payload"], "nth": nth})
        yield out[elapsed <= self.horizon_ns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.flow.clear()
        return iter([])

    def close(self) -> None:
        pass


def relative_slots(packets: DataFrame, w_ns: int, horizon_ns: int, late: str = "1 minute") -> DataFrame:
    """Slot, direction and number of each packet since its flow's first packet, with one small state per flow.

    Packets later than late are dropped. One that is older than the first packet already given out has no slot. Packets
    beyond the horizon count, but have no row. A flow's state goes when the watermark is a horizon past its last packet: a
    flow that pauses for longer starts anew.
    """
    out = "capture_id string, row_pos long, slot long, fwd boolean, payload double, nth long"
    # the first watermark is the epoch, and what is not after it counts as late
    timed = packets.withColumn("__time", F.timestamp_micros(F.floor(F.col("t_ns") / 1000) + 1)).withWatermark("__time", late)
    return timed.groupBy(*KEY).transformWithStateInPandas(statefulProcessor=_FirstPacket(w_ns, horizon_ns), outputStructType=out, outputMode="Append", timeMode="EventTime")


class _InOrder(StatefulProcessor):
    """Keeps packets until the watermark has passed them and hands them on by time, whatever order they came in.

    A timer stands at the first waiting packet; when it fires, all packets before the watermark go to released(), and the
    next timer is set. A packet that comes later than the watermark is dropped before it gets here, so the order is final.
    Once nothing waits, a timer at the flow's end clears all state; a packet after that end starts a new flow, whether the
    timer came first or not. Subclasses keep their own state in flow, a row whose last field is the end in nanoseconds, and
    say at which millisecond to wake them though no packet comes.
    """

    def __init__(self, w_ns: int, horizon_ns: int) -> None:
        self.w_ns, self.horizon_ns = w_ns, horizon_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t_ns long, row_pos long, src string, payload double")
        self.flow = handle.getValueState("flow", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for p in rows:
            self.waiting.appendList([(int(t), int(r), s, float(v)) for t, r, s, v in zip(p["t_ns"], p["row_pos"], p["src"], p["payload"], strict=True)])
            least = int(p["t_ns"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first // 1_000_000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        packets = sorted(self.waiting.get(), key=lambda p: (p[0], p[1])) if self.waiting.exists() else []
        ready = [p for p in packets if p[0] < now * 1_000_000]
        state = self.flow.get() if self.flow.exists() else None
        rows, state, wake = self.released(ready, state, now)
        left = packets[len(ready) :]
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1_000_000 + 1)
        elif packets:
            self.waiting.clear()
        if state is None or (not left and state[-1] < now * 1_000_000):
            self.flow.clear()
        else:
            self.flow.update(state)
            self.handle.registerTimer(max(min(wake, state[-1] // 1_000_000 + 1), now + 1))
        if rows:
            yield pd.DataFrame([(*key, *r) for r in rows], columns=[*KEY, *self.columns])

    def close(self) -> None:
        pass


class _SlotsInOrder(_InOrder):
    """The slot, direction and number of each packet of a flow."""

    state = "t_ns long, src string, n long, ends_ns long"
    columns = ("row_pos", "slot", "fwd", "payload", "nth")

    def released(self, packets: list, state, now: int):
        start, src, n, ends = state or (None, None, 0, 0)
        rows = []
        for t, row, own, payload in packets:
            if start is None or t > ends:
                start, src, n = t, own, 0
            n, ends = n + 1, t + self.horizon_ns
            if t - start <= self.horizon_ns:
                rows.append((row, min((t - start) // self.w_ns, self.horizon_ns // self.w_ns), own == src, payload, n))
        return rows, None if start is None else (start, src, n, ends), ends // 1_000_000 + 1


class _FeaturesInOrder(_InOrder):
    """The eight features of each slot of a flow, given out when the watermark has passed the slot, zeros between packets."""

    state = "t_ns long, src string, base long, slot long, f0 double, f1 double, f3 double, f4 double, given boolean, ends_ns long"
    columns = ("slot", *[f"f{k}" for k in range(8)])

    def __init__(self, w_ns: int, horizon_ns: int, absolute: bool) -> None:
        super().__init__(w_ns, horizon_ns)
        self.absolute = absolute

    def _row(self, slot: int, a: float = 0.0, n: float = 0.0, b: float = 0.0, m: float = 0.0) -> tuple:
        return (slot, a, n, a / n if n > 0 else 0.0, b, m, b / m if m > 0 else 0.0, a / b if b > 0 else 0.0, slot * (self.w_ns / 1e9))

    def _rest(self, slot: int, a: float, n: float, b: float, m: float, given: bool, last: int) -> list[tuple]:
        """The current slot, if it is not out yet, and the rest of a grid."""
        return ([] if given else [self._row(slot, a, n, b, m)]) + [self._row(k) for k in range(slot + 1, last + 1) if not self.absolute]

    def released(self, packets: list, state, now: int):
        """given tells that the current slot is out already; base is where slot 0 begins."""
        rows, last = [], self.horizon_ns // self.w_ns
        start, src, base, slot, a, n, b, m, given, ends = state or (None, None, 0, 0, 0.0, 0.0, 0.0, 0.0, False, 0)
        for t, _, own, payload in packets:
            if start is not None and t > ends:
                rows += self._rest(slot, a, n, b, m, given, last)
                start = None
            if start is None:
                start, src, base = t, own, (t // self.w_ns * self.w_ns if self.absolute else t)
                slot, a, n, b, m, given = 0, 0.0, 0.0, 0.0, 0.0, False
            ends = t + self.horizon_ns
            if not self.absolute and t - start > self.horizon_ns:
                continue
            at = (t - base) // self.w_ns if self.absolute else min((t - base) // self.w_ns, last)
            if at > slot:
                rows += [] if given else [self._row(slot, a, n, b, m)]
                rows += [self._row(k) for k in range(slot + 1, at)]
                slot, a, n, b, m, given = at, 0.0, 0.0, 0.0, 0.0, False
            if own == src:
                a, n = a + payload, n + 1
            else:
                b, m = b + payload, m + 1
        if start is None:
            return rows, None, 0
        past, wake, over = now * 1_000_000, ends // 1_000_000 + 1, start + self.horizon_ns + 1
        close = base + (slot + 1) * self.w_ns if self.absolute or slot < last else over
        if not self.absolute and over <= past and slot <= last:  # the rest of the grid
            rows += self._rest(slot, a, n, b, m, given, last)
            slot, given = last + 1, True
        elif not given and close <= past:
            rows.append(self._row(slot, a, n, b, m))
            given = True
        if not given:
            wake = min(wake, close // 1_000_000 + 1)
        elif not self.absolute and slot <= last:
            wake = min(wake, over // 1_000_000 + 1)
        return rows, (start, src, base, slot, a, n, b, m, given, ends), wake


def _in_order(packets: DataFrame, processor: _InOrder, types: str, late: str) -> DataFrame:
    # the first watermark is the epoch, and what is not after it counts as late
    timed = packets.withColumn("__time", F.timestamp_micros(F.floor(F.col("t_ns") / 1000) + 1)).withWatermark("__time", late)
    key = "capture_id string, ip_a string, port_a int, ip_b string, port_b int, proto int, "
    columns = timed.select(*[F.col(c).cast("int") if c in ("port_a", "port_b", "proto") else c for c in KEY], "t_ns", "row_pos", "src", F.col("payload").cast("double"), "__time")
    return columns.groupBy(*KEY).transformWithStateInPandas(statefulProcessor=processor, outputStructType=key + types, outputMode="Append", timeMode="EventTime")


def relative_slots_in_order(packets: DataFrame, w_ns: int, horizon_ns: int, late: str = "1 minute") -> DataFrame:
    """The key, row_pos, slot, fwd, payload and nth of each packet within the horizon of its flow's first packet by time.

    Packets wait until the watermark is past them and are then taken by time and row_pos, so the rows are those of the batch
    form for any order of arrival within late; later packets are dropped. A flow's state goes a horizon after its last
    packet; a flow that pauses for longer starts anew. What waits is bounded by late, and is given out when newer packets of
    any flow move the watermark.
    """
    return _in_order(packets, _SlotsInOrder(w_ns, horizon_ns), "row_pos long, slot long, fwd boolean, payload double, nth long", late)


def slot_features_stream(packets: DataFrame, w_ns: int, horizon_ns: int, late: str = "1 minute", absolute: bool = False) -> DataFrame:
    """The key, slot and eight features of every slot of a flow, packets taken by time as in relative_slots_in_order().

    Relative slots begin at a flow's first packet and fill the grid up to the horizon, whose last slot takes what is exactly
    at it; later packets are left out. Absolute slots are windows of w_ns since the epoch, numbered from the flow's first one,
    and go on to the last one with packets. A slot is given out when the watermark has passed it, and slots without packets
    between are zeros.
    """
    return _in_order(packets, _FeaturesInOrder(w_ns, horizon_ns, absolute), "slot long, " + ", ".join(f"f{k} double" for k in range(8)), late)
