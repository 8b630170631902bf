"""Keyed streaming state: events of a request are held until the watermark passes them and then handled in
event-time order, so that batches may bring them in any order within the delay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cellselect.streaming.events import TERMINAL

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Events as blocks of columns: a block is one value of the state.
_EVENTS = "request array<long>, ts array<long>, event_id array<long>, event array<string>"
_BLOCK = 10_000
#: Groups into which requests are dealt by a hash of their id. One call handles all requests of a group that are
#: due, so calls and timers grow with groups and batches, not with requests. Part of a checkpoint's state.
GROUPS = 1024


def dealt(events: DataFrame, groups: int = GROUPS) -> DataFrame:
    """``events`` with their group and whether they lack a request, which is then a request of its own (and 0 here: pandas
    would turn the ids beside a null into floats)."""
    return events.select(F.coalesce("request_id", F.lit(0)).alias("request_id"), "event_id", "ts", "event", F.pmod(F.xxhash64("request_id"), F.lit(groups)).alias("_group"),
                         F.isnull("request_id").alias("_none"))


def micros(ts: pd.Series) -> np.ndarray:
    return (ts.dt.tz_localize(None) if ts.dt.tz is not None else ts).astype("datetime64[us]").astype("int64").to_numpy()


def stamps(us: list[int]) -> pd.Series:
    return pd.Series(us, dtype="int64").astype("datetime64[us]")


def _due_at(us: int) -> int:
    """The first millisecond at which the moment has come."""
    return -(-us // 1000)


class InOrder(StatefulProcessor):
    """Typed list state of a group's events ahead of the watermark, what is kept of its requests, and one timer at
    the earliest moment something is due.

    ``settle(kept, events, now, more)`` gets a request's ``fields`` (None: none are kept), those of its events that no
    earlier one can follow any more, in order (possibly none), the watermark in microseconds and whether later events
    are held; it returns output rows, the fields to keep or None, and the next moment at which it wants to be
    called without an event, or None."""

    fields: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _EVENTS)
        columns = ["request long", "due long", *self.fields]
        self.requests = handle.getValueState("requests", ", ".join("{} array<{}>".format(*c.split()) for c in columns))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            ts = micros(batch["ts"]).tolist()
            if ts:
                self.pending.appendList(self._blocks(list(zip(batch["request_id"].tolist(), ts, batch["event_id"].tolist(), batch["event"].tolist()))))
                first = min(ts) if first is None else min(first, min(ts))
        if first is not None:
            self._wake(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [event for block in self.pending.get() for event in zip(*block)] if self.pending.exists() else []
        due: dict[int, list[tuple]] = {}
        for request, *event in sorted(r for r in held if r[1] <= now):
            due.setdefault(request, []).append(tuple(event))
        rest = [r for r in held if r[1] > now]
        if due:
            blocks = self._blocks(rest)
            if blocks:
                self.pending.put(blocks)
            else:
                self.pending.clear()
        later = {r[0] for r in rest}
        kept = {request: (at, fields) for request, at, *fields in zip(*self.requests.get())} if self.requests.exists() else {}
        out = []
        for request in sorted(due.keys() | {r for r, (at, _) in kept.items() if at is not None and at <= now}):
            rows, fields, again = self.settle(kept.get(request, (None, None))[1], due.get(request, []), now, request in later)
            out += [(None if key[1] else request, *row) for row in rows]
            kept.pop(request, None)
            if fields is not None:
                kept[request] = (again, fields)
        if kept:
            self.requests.update(tuple(list(c) for c in zip(*((request, at, *fields) for request, (at, fields) in kept.items()))))
        else:
            self.requests.clear()
        moments = [at for at, _ in kept.values() if at is not None] + [r[1] for r in rest]
        if moments:
            self.handle.registerTimer(_due_at(min(moments)))
        if out:
            yield self.frame(out)

    def _blocks(self, events: list[tuple]) -> list[tuple]:
        return [tuple(list(c) for c in zip(*events[i:i + _BLOCK])) for i in range(0, len(events), _BLOCK)]

    def _wake(self, us: int) -> None:
        """One timer a group: an earlier one takes the place of a later one."""
        at = _due_at(us)
        timers = list(self.handle.listTimers())
        if not timers or at < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    def close(self) -> None:
        """State goes with its timers; nothing is held outside it."""


class _LeastGap(InOrder):
    fields = ("last long",)

    def __init__(self, gap: int):
        self.gap = gap

    def settle(self, kept, events, now, more):
        last = kept[0] if kept else None
        out = []
        for event in events:
            if last is None or event[0] - last >= self.gap:
                out.append(event)
                last = event[0]
        if last is None or now >= last + self.gap:  # whatever comes now is far enough
            return out, None, None
        return out, (last,), last + self.gap

    def frame(self, rows):
        requests, ts, ids, events = zip(*rows)
        return pd.DataFrame({"request_id": requests, "event_id": ids, "ts": stamps(list(ts)), "event": events})


class _Stalled(InOrder):
    fields = ("first long", "last long", "terminal boolean", "told boolean")

    def __init__(self, gap: int, limit: int):
        self.gap, self.limit = gap, limit

    def settle(self, kept, events, now, more):
        first, last, terminal, told = kept or (None, None, True, False)
        out = []
        for t, _, event in events:
            if not terminal and t - last > self.gap:
                out.append((last, "gap"))
            first, last, terminal = t if first is None else first, t, event in TERMINAL
            if not told and last - first > self.limit:
                out.append((first + self.limit, "total"))
                told = True
        if last is None:
            return out, None, None
        if now > last + self.gap and not more:
            if not terminal:
                out.append((last, "silent"))
            return out, None, None
        return out, (first, last, terminal, told), None if more else last + self.gap + 1

    def frame(self, rows):
        requests, after, reasons = zip(*rows)
        return pd.DataFrame({"request_id": requests, "after": stamps(list(after)), "reason": reasons})


def _keyed(events: DataFrame, processor: InOrder, schema: str, delay: str) -> DataFrame:
    conf = events.sparkSession.conf
    if conf.get("spark.sql.streaming.stateStore.providerClass", "") != _STORE:
        conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)  # the store this kind of state needs
    e = dealt(events).withWatermark("ts", delay)
    return e.groupBy("_group", "_none").transformWithStateInPandas(processor, schema, "Append", "EventTime")


_THROTTLED = "request_id long, event_id long, ts timestamp, event string"


def least_gap(events: DataFrame, gap_seconds: float = 1.0, delay: str = "1 hour") -> DataFrame:
    """Events of each request no two of which are closer than the gap: the first, and then always the first one
    that lies the gap or more after the last one kept; equal times by event_id.

    In a stream a request's state is its last kept time, gone once the watermark is the gap past it, and the
    events ahead of the watermark. A batch runs through sorted partitions with the last kept time in hand.
    """
    gap = int(gap_seconds * 1_000_000)
    if events.isStreaming:
        return _keyed(events, _LeastGap(gap), _THROTTLED, delay)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        request = last = None
        for batch in batches:
            ids, us = batch["request_id"].to_numpy(), batch["us"].to_numpy()
            keep = []
            edges = np.r_[np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]), len(ids)] if len(ids) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                if ids[a] != request:
                    request, last = ids[a], None
                while a < b:
                    if last is not None:
                        a += int(np.searchsorted(us[a:b], last + gap))
                    if a < b:
                        keep.append(a)
                        last = int(us[a])
                        a += 1 if gap <= 0 else 0
            yield batch.take(pa.array(keep, pa.int64())).select(["request_id", "event_id", "ts", "event"])

    rows = (events.select("request_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
            .repartition("request_id").sortWithinPartitions("request_id", "us", "event_id"))
    return rows.mapInArrow(run, _THROTTLED)


def stalled_keyed(events: DataFrame, gap_seconds: int, total_seconds: int, delay: str = "1 hour") -> DataFrame:
    """Stream of (request_id, after, reason) as ``events.stalled`` tells them, whatever the order in which batches
    bring a request's events within the delay. ``silent`` is told when the watermark passes the gap after the
    last event; ``total`` with the first event past the limit."""
    return _keyed(events, _Stalled(gap_seconds * 1_000_000, total_seconds * 1_000_000), "request_id long, after timestamp, reason string", delay)
