"""Lifecycle of media items: a keyed state machine with epochs, as a batch fold and as a stream.

Rows are events of one key in order. A key starts with ``prepare``. Results of another epoch than the entry's are
dropped, as are results for an entry that a fallback has claimed; claims and publications of another handle than the
entry's (epoch, request, idx) are denied. A ready or failed result ends the flight of the entry even if it is dropped.

The fold names the rule each event falls under and what every rule does to a field, in SQL that Catalyst runs over the
sorted events of a key; the stream keeps an ``Entry`` in its state. A key's events are folded in one task, as their order asks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIVE = ("QUEUED", "SIDECAR_RUNNING", "READY")
CLAIMABLE = ("QUEUED", "SIDECAR_RUNNING", "FAILED", "EXPIRED", "ABSENT")
#: handle (epoch, request, idx), item (tokens of a schedule item), timings of probing and of putting, ok (a result has its payload).
EVENTS = "key long, seq long, event string, epoch int, request string, idx int, claimer string, item int, t_probe double, t_put double, ok boolean, error string, worker int"
FIELDS = {
    "state": "string", "epoch": "int", "request": "string", "idx": "int", "claimed_by": "string", "item": "int", "t_probe": "double", "t_put": "double",
    "error": "string", "worker": "int", "in_flight": "boolean", "cached": "boolean", "payload": "boolean", "n_applied": "long", "n_dropped": "long",
}
STATES = "key long, " + ", ".join(f"{f} {t}" for f, t in FIELDS.items())

_live = "s.state IN ('QUEUED', 'SIDECAR_RUNNING', 'READY')"
_fresh = "x.epoch = s.epoch"
_held = "x.epoch = s.epoch AND x.request = s.request AND x.idx = s.idx"
_result = "x.epoch = s.epoch AND s.state <> 'FALLBACK_CLAIMED'"
#: What an event comes to, first match first; others are dropped.
RULES = {
    "keep": f"x.event = 'prepare' AND {_live}",
    "hit": "x.event = 'prepare' AND s.cached",
    "queue": "x.event = 'prepare'",
    "free": "x.event = 'claim' AND s.state IS NULL",
    "unknown": "s.state IS NULL",
    "start": f"x.event = 'started' AND {_fresh} AND s.state = 'QUEUED'",
    "probe": f"x.event = 'probed' AND {_fresh}",
    "put": f"x.event = 'ready_put_done' AND {_fresh}",
    "ready": f"x.event = 'ready' AND {_result} AND x.ok",
    "fail": f"x.event = 'failed' AND {_result}",
    "late": "x.event IN ('ready', 'failed')",
    "claim": f"x.event = 'claim' AND {_held} AND s.state IN ('QUEUED', 'SIDECAR_RUNNING', 'FAILED', 'EXPIRED', 'ABSENT')",
    "again": f"x.event = 'claim' AND {_held} AND s.state = 'FALLBACK_CLAIMED' AND s.claimed_by = x.claimer",
    "publish": f"x.event = 'publish' AND {_held} AND s.claimed_by = x.claimer",
    "done": "x.event = 'done' AND s.state = 'FALLBACK_CLAIMED' AND s.claimed_by = x.claimer",
    "evict": "x.event = 'evict' AND s.cached",
    "expire": "x.event = 'fetch' AND s.state = 'READY' AND NOT s.cached",
    "fetch": "x.event = 'fetch' AND (s.state = 'READY' OR s.state = 'FALLBACK_LOCAL_DONE' AND s.payload)",
}
_renewed = {"hit", "queue"}
#: What rules make of a field; other rules leave it.
EFFECTS = {
    "state": {"hit": "'READY'", "queue": "'QUEUED'", "start": "'SIDECAR_RUNNING'", "ready": "'READY'", "fail": "'FAILED'", "claim": "'FALLBACK_CLAIMED'", "publish": "'FALLBACK_LOCAL_DONE'", "done": "'FALLBACK_LOCAL_DONE'", "expire": "'EXPIRED'"},
    "epoch": dict.fromkeys((*_renewed, "claim"), "s.epoch + 1"),
    "request": dict.fromkeys((*_renewed, "keep"), "x.request"),
    "idx": dict.fromkeys((*_renewed, "keep"), "x.idx"),
    "claimed_by": dict.fromkeys(_renewed, "NULL") | {"claim": "x.claimer"},
    "item": {"queue": "NULL"} | dict.fromkeys(("probe", "ready"), "coalesce(x.item, s.item)"),
    "t_probe": {"queue": "NULL", "probe": "CASE WHEN x.t_put IS NULL THEN coalesce(x.t_probe, s.t_probe) ELSE x.t_probe END", "put": "coalesce(x.t_probe, s.t_probe)", "fail": "x.t_probe"},
    "t_put": {"queue": "NULL", "probe": "CASE WHEN x.t_probe IS NULL THEN coalesce(x.t_put, s.t_put) ELSE x.t_put END", "put": "coalesce(x.t_put, s.t_put)", "fail": "x.t_put"},
    "error": dict.fromkeys((*_renewed, "ready"), "NULL") | {"fail": "x.error"},
    "worker": {"queue": "x.worker"},
    "in_flight": {"queue": "TRUE"} | dict.fromkeys(("ready", "fail", "late"), "FALSE"),
    "cached": {"ready": "TRUE", "evict": "FALSE"},
    "payload": dict.fromkeys((*_renewed, "claim"), "FALSE") | {"publish": "TRUE"},
    "n_applied": {},
    "n_dropped": {},
}
DROPPED = ("unknown", "late", "expire")


def rule_sql() -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, c in RULES.items()) + " ELSE 'drop' END"


def effect_sql(field: str, rule: str) -> str:
    """The field's next value, where ``rule`` is the expression that names the event's rule."""
    if field in ("n_applied", "n_dropped"):
        dropped = f"{rule} IN ('drop', " + ", ".join(f"'{r}'" for r in DROPPED) + ")"
        return f"s.{field} + CASE WHEN {dropped} THEN {int(field == 'n_dropped')} ELSE {int(field == 'n_applied')} END"
    if not EFFECTS[field]:
        return f"s.{field}"
    return f"CASE {rule} " + " ".join(f"WHEN '{r}' THEN {e}" for r, e in EFFECTS[field].items()) + f" ELSE s.{field} END"


ZERO = {f: "0" if f in ("epoch", "n_applied", "n_dropped") else "FALSE" if t == "boolean" else "NULL" for f, t in FIELDS.items()}


def fold(events: DataFrame) -> DataFrame:
    """The last state of each key, from EVENTS rows."""
    kind = "STRUCT<" + ", ".join(f"{f}: {t}" for f, t in FIELDS.items()) + ">"
    zero = f"CAST(named_struct({', '.join(f'{f!r}, {ZERO[f]}' for f in FIELDS)}) AS {kind})"
    step = "named_struct(" + ", ".join(f"'{f}', {effect_sql(f, 'r')}" for f in FIELDS) + ")"
    columns = [c.split()[0] for c in EVENTS.split(", ")[1:]]
    rows = events.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("e"))
    rows = rows.select("key", F.expr(f"aggregate(e, {zero}, (s, x) -> CAST(transform(array({rule_sql()}), r -> {step})[0] AS {kind}))").alias("s"))
    return rows.select("key", *(F.coalesce("s.state", F.lit("ABSENT")).alias("state") if f == "state" else F.col(f"s.{f}") for f in FIELDS))


@dataclass
class Entry:
    state: str | None = None
    epoch: int = 0
    request: str | None = None
    idx: int | None = None
    claimed_by: str | None = None
    item: int | None = None
    t_probe: float | None = None
    t_put: float | None = None
    error: str | None = None
    worker: int | None = None
    in_flight: bool = False
    cached: bool = False
    payload: bool = False
    n_applied: int = 0
    n_dropped: int = 0

    def apply(self, x: dict) -> bool:
        """Whether the event counted."""
        done = self._apply(x)
        self.n_applied += done
        self.n_dropped += not done
        return done

    def _prepare(self, x: dict) -> bool:
        live = self.state in LIVE
        self.request, self.idx = x["request"], x["idx"]
        if live:
            return True
        self.epoch, self.claimed_by, self.error, self.payload = self.epoch + 1, None, None, False
        if self.cached:
            self.state = "READY"
        else:
            self.state, self.item, self.t_probe, self.t_put, self.worker, self.in_flight = "QUEUED", None, None, None, x["worker"], True
        return True

    def _apply(self, x: dict) -> bool:
        event, fresh = x["event"], x["epoch"] is not None and x["epoch"] == self.epoch
        held = fresh and x["request"] == self.request and x["idx"] == self.idx and x["request"] is not None
        mine = x["claimer"] is not None and self.claimed_by == x["claimer"]
        if event == "prepare":
            return self._prepare(x)
        if self.state is None:
            return event == "claim"  # an unknown key may be worked on locally at once
        if event == "claim":
            if held and self.state in CLAIMABLE:
                self.state, self.epoch, self.claimed_by, self.payload = "FALLBACK_CLAIMED", self.epoch + 1, x["claimer"], False
                return True
            return held and self.state == "FALLBACK_CLAIMED" and mine
        if event == "publish":
            if not (held and mine):
                return False
            self.state, self.payload = "FALLBACK_LOCAL_DONE", True
        elif event == "done":
            if not (self.state == "FALLBACK_CLAIMED" and mine):
                return False
            self.state = "FALLBACK_LOCAL_DONE"
        elif event == "evict":
            was, self.cached = self.cached, False
            return was
        elif event == "fetch":
            if self.state == "READY" and not self.cached:
                self.state = "EXPIRED"
                return False
            return self.state == "READY" or self.state == "FALLBACK_LOCAL_DONE" and self.payload
        elif event in ("ready", "failed"):
            self.in_flight = False
            if not fresh or self.state == "FALLBACK_CLAIMED" or event == "ready" and not x["ok"]:
                return False
            if event == "ready":
                self.state, self.cached, self.error = "READY", True, None
                self.item = self.item if x["item"] is None else x["item"]
            else:
                self.state, self.error, self.t_probe, self.t_put = "FAILED", x["error"], x["t_probe"], x["t_put"]
        elif not fresh:
            return False
        elif event == "started":
            if self.state != "QUEUED":
                return False
            self.state = "SIDECAR_RUNNING"
        elif event == "probed":
            self.item = self.item if x["item"] is None else x["item"]
            if x["t_probe"] is not None or x["t_put"] is not None:
                self.t_probe, self.t_put = x["t_probe"], x["t_put"]
        elif event == "ready_put_done":
            self.t_probe = self.t_probe if x["t_probe"] is None else x["t_probe"]
            self.t_put = self.t_put if x["t_put"] is None else x["t_put"]
        else:
            return False
        return True


def stream(events: DataFrame) -> DataFrame:
    """The same as a stream: each trigger gives the new state of the keys that had events."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry = Entry(*state.get) if state.exists else Entry()
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        for row in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            entry.apply(row | {c: None if row[c] is None else int(row[c]) for c in ("epoch", "idx", "item", "worker")})
        state.update(astuple(entry))
        shown = astuple(entry)
        yield pd.DataFrame([(key[0], shown[0] or "ABSENT", *shown[1:])], columns=["key", *FIELDS]).astype({"idx": "Int32", "item": "Int32", "worker": "Int32"})

    kept = ", ".join(f"{f} {t}" for f, t in FIELDS.items())
    return events.groupBy("key").applyInPandasWithState(run, STATES, kept, "update", GroupStateTimeout.NoTimeout)
