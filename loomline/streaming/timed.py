"""The lifecycle in event time: entries run out by themselves and waits end, as a stream with timers and as a batch.

Events come in any order within the watermark's delay. A key's events wait in its state until the watermark has passed them and are
then applied in order of (at, seq), so the stream gives what the batch gives for the same events. A ready result stays cached
for the time to live, reading it doesn't prolong it; an entry that is READY then becomes EXPIRED. A ``wait`` ends when the entry's
item is known or its state is final, or else at its deadline.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import astuple, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomline.operators.waits import TERMINAL
from loomline.streaming import lifecycle
from loomline.streaming.lifecycle import Entry

#: Lifecycle events with their time; a ``wait`` has its name in ``claimer`` and its length in ``wait_ms``.
EVENTS = lifecycle.EVENTS.replace("seq long", "at timestamp, seq long") + ", wait_ms long"
#: What happened to a key: ``state`` (an event changed it), ``expired``, ``met`` or ``deadline`` (a wait ended), and when.
CHANGES = "key long, at long, what string, wait string, state string, epoch int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Timed:
    """An entry in time, in milliseconds."""

    ttl: int
    entry: Entry = field(default_factory=Entry)
    expires: int | None = None
    waits: list[list] = field(default_factory=list)  # of [deadline, name]

    def _row(self, at: int, what: str, wait: str | None = None) -> tuple:
        return at, what, wait, self.entry.state or "ABSENT", self.entry.epoch

    def _met(self, at: int) -> Iterator[tuple]:
        if self.waits and (self.entry.item is not None or self.entry.state in TERMINAL):
            ended, self.waits = self.waits, []
            yield from (self._row(at, "met", name) for _, name in sorted(ended, key=lambda w: (w[0], w[1] or "")))

    def settle(self, now: int, after: bool) -> Iterator[tuple]:
        """What falls due up to ``now``, in order of time; deadlines of this moment only ``after`` its events."""
        while True:
            due = [(self.expires, 0)] if self.expires is not None and self.expires <= now else []
            due += [(d, 1) for d, _ in self.waits if d < now or after and d == now]
            if not due:
                return
            at, kind = min(due)
            if kind:
                ended = [w for w in self.waits if w[0] == at]
                self.waits = [w for w in self.waits if w[0] != at]
                yield from (self._row(at, "deadline", name) for _, name in sorted(ended, key=lambda w: w[1] or ""))
                continue
            self.expires, self.entry.cached = None, False
            if self.entry.state == "READY":
                self.entry.state = "EXPIRED"
                yield self._row(at, "expired")
                yield from self._met(at)

    def apply(self, at: int, event: dict) -> Iterator[tuple]:
        yield from self.settle(at, False)
        entry = self.entry
        if event["event"] == "wait":
            self.waits.append([at + (event["wait_ms"] or 0), event["claimer"]])
        else:
            before = entry.state, entry.epoch
            if entry.apply(event) and event["event"] == "ready":
                self.expires = at + self.ttl
            if not entry.cached:
                self.expires = None
            if (entry.state, entry.epoch) != before:
                yield self._row(at, "state")
        yield from self._met(at)

    def due(self) -> list[int]:
        return [t for t in (self.expires, *(d for d, _ in self.waits)) if t is not None]


_FIELDS = [f.split() for f in EVENTS.split(", ")]
_NAMES = [n for n, _ in _FIELDS if n not in ("key", "at")]
_ENTRY = ", ".join(f"{f} {t}" for f, t in lifecycle.FIELDS.items()) + ", expires long, waits string, pending long"


def fold(events: DataFrame, ttl_ms: int, until_ms: int | None = None) -> DataFrame:
    """CHANGES of EVENTS rows up to a moment (none: to the last that falls due). Events without a key or a time are of no entry.

    A key's events are streamed in order through one task, which holds its entry and open waits.
    """
    schema = pa.schema([("key", pa.int64()), ("at", pa.int64()), ("what", pa.string()), ("wait", pa.string()), ("state", pa.string()), ("epoch", pa.int32())])
    end = (1 << 62) if until_ms is None else until_ms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, Timed(ttl_ms)
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                if e["key"] != key:
                    out += [(key, *r) for r in now.settle(end, True)]
                    key, now = e["key"], Timed(ttl_ms)
                out += [(key, *r) for r in now.apply(e["at"], e)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), schema.types)], schema=schema)
        if out := [(key, *r) for r in now.settle(end, True)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), schema.types)], schema=schema)

    rows = events.select("key", F.unix_millis("at").alias("at"), *_NAMES).where(F.col("key").isNotNull() & F.col("at").isNotNull() & (F.col("at") <= end))
    return rows.repartition("key").sortWithinPartitions("key", "at", "seq").mapInArrow(run, CHANGES)


class _Lifecycle(StatefulProcessor):
    """State of a key: its entry, and its events by time until the watermark has passed them."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("entry", _ENTRY)
        self.buffer = handle.getMapState("events", "at long", "rows string")

    def _load(self) -> tuple[Timed, int]:
        if not self.value.exists():
            return Timed(self.ttl), 0
        *kept, expires, waits, pending = self.value.get()
        return Timed(self.ttl, Entry(*kept), expires, json.loads(waits)), pending

    def _keep(self, now: Timed, pending: int) -> None:
        self.value.update((*astuple(now.entry), now.expires, json.dumps(now.waits), pending))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        by_time: dict[int, list] = {}
        for row in rows:
            by_time.setdefault(row["ms"], []).append([row[n] for n in _NAMES])
        now, pending = self._load()
        for at, new in by_time.items():
            held = json.loads(self.buffer.getValue((at,))[0]) if self.buffer.containsKey((at,)) else []
            self.buffer.updateValue((at,), (json.dumps(held + new),))
            pending += not held
            self.handle.registerTimer(at)
        self._keep(now, pending)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        now, pending = self._load()
        out = []
        if self.buffer.containsKey((at,)):
            events = [dict(zip(_NAMES, e, strict=True)) for e in json.loads(self.buffer.getValue((at,))[0])]
            self.buffer.removeKey((at,))
            pending -= 1
            for e in sorted(events, key=lambda e: e["seq"]):
                out += now.apply(at, e)
        # With events to come before it, what falls due later is left to them and to its own timer.
        out += now.settle(at if pending else max(at, passed), True)
        for t in {t for t in now.due() if t > at}:
            self.handle.registerTimer(t)
        self._keep(now, pending)
        yield from (Row(key=key[0], at=r[0], what=r[1], wait=r[2], state=r[3], epoch=r[4]) for r in out)

    def close(self) -> None:
        pass


def stream(events: DataFrame, ttl_ms: int, delay: str) -> DataFrame:
    """CHANGES of a stream of EVENTS rows, each as soon as the watermark has passed it; events later than ``delay`` are dropped.

    Asks for the RocksDB state store (ROCKS), in which only the keys at hand are in memory.
    """
    rows = events.where("key is not null and at is not null").withWatermark("at", delay)
    timed = rows.select("key", "at", F.unix_millis("at").alias("ms"), *_NAMES)
    return timed.groupBy("key").transformWithState(_Lifecycle(ttl_ms), CHANGES, "append", "EventTime")

