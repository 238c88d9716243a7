"""Keyed streams in event time: rows wait in state until the watermark has passed them and are then taken in their order, so that results don't depend on
how rows fall into batches (STR-03, STR-04, STR-08, STR-09, SNK-12).

A machine tells what a row does to the state of its key, and when a state changes by itself (an entry expires, a breaker half opens). Rows of a key wait in slices of
time, of which one at a time is read; each key has a timer at its next row or change. A row counts once the watermark has reached its time; rows that come later than
the watermark are dropped, and those that it hasn't reached at the end of a stream wait. Rows of one time go by `seq`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Machine:
    """States are JSON values, None to begin with; times are milliseconds. `columns`: what is given out besides the key."""

    columns: str
    #: Whether every row can give something out; else a key gives its state whenever that may have changed.
    by_row = False

    def event(self, state: Any, at: int, kind: str | None, value: Any) -> tuple[Any, list | None]:
        """The state after a row, and what the row gives out (by_row alone)."""
        raise NotImplementedError

    def deadline(self, state: Any) -> int | None:
        """When the state changes by itself."""
        return None

    def passed(self, state: Any) -> Any:
        """The state once its deadline has passed."""
        return None

    def told(self, state: Any) -> list:
        """Values of `columns` for a state."""
        raise NotImplementedError


class Nonces(Machine):
    """STR-08: kind `issue` stores a value for the key, which replaces one that is there; `use` takes it out, and gets it if its time to live hasn't passed."""

    columns, by_row = "at_ms bigint, granted boolean, value string", True

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def event(self, state: Any, at: int, kind: str | None, value: Any) -> tuple[Any, list | None]:
        if kind == "issue":
            return [at, value], None
        return None, [at, state is not None, state[1] if state else None]

    def deadline(self, state: Any) -> int | None:
        return state and state[0] + self.ttl


class Cache(Machine):
    """STR-09: a value replaces the key's entry and starts its time to live anew; a null (an empty result) takes the entry out."""

    columns = "at_ms bigint, value string"

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def event(self, state: Any, at: int, kind: str | None, value: Any) -> tuple[Any, list | None]:
        return (None if value is None else [at, value]), None

    def deadline(self, state: Any) -> int | None:
        return state and state[0] + self.ttl

    def told(self, state: Any) -> list:
        return list(state or (None, None))


class Progress(Machine):
    """STR-03, SNK-12: the fields of a job. A row (kind: status, value: a struct of processed, total and error) sets those that it has, so an error stays; each row starts the job's time to live anew, after which all fields are gone."""

    columns = "at_ms bigint, status string, processed bigint, total bigint, percentage double, error string"

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def event(self, state: Any, at: int, kind: str | None, value: Any) -> tuple[Any, list | None]:
        new = {"status": kind, **{k: (value or {}).get(k) for k in ("processed", "total", "error")}}
        return {**(state or {}), **{k: v for k, v in new.items() if v is not None}, "at": at}, None

    def deadline(self, state: Any) -> int | None:
        return state and state["at"] + self.ttl

    def told(self, state: Any) -> list:
        s = state or {}
        done, total = s.get("processed"), s.get("total")
        share = None if not s else round(100 * (done or 0) / total, 2) if total and total > 0 else 0.0
        return [s.get("at"), s.get("status"), done, total, share, s.get("error")]


class Breaker(Machine):
    """STR-04: kind `bad` is a failure. Failures add up over successes while it is closed (T16); at the limit it opens and takes nothing in until it half opens, where one row decides."""

    columns = "state string, failures bigint, opened bigint"

    def __init__(self, limit: int, wait: int) -> None:
        self.limit, self.wait = limit, wait

    def event(self, state: Any, at: int, kind: str | None, value: Any) -> tuple[Any, list | None]:
        name, failures, opened = state or ("CLOSED", 0, None)
        if name == "OPEN":
            return state, None
        if kind == "bad":
            failures += 1
            return (["OPEN", failures, at] if name == "HALF_OPEN" or failures >= self.limit else [name, failures, opened]), None
        return (["CLOSED", 0, opened] if name == "HALF_OPEN" else [name, failures, opened]), None

    def deadline(self, state: Any) -> int | None:
        return state[2] + self.wait if state and state[0] == "OPEN" else None

    def passed(self, state: Any) -> Any:
        return ["HALF_OPEN", *state[1:]]

    def told(self, state: Any) -> list:
        return list(state or ("CLOSED", 0, None))


class InOrder(StatefulProcessor):
    """Feeds a machine with the rows of each key in order."""

    def __init__(self, machine: Machine, key: str, names: list[str], slice_ms: int) -> None:
        self.machine, self.key, self.names, self.slice = machine, key, names, slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string")
        self.timer = handle.getValueState("timer", "at bigint")
        self.waiting = handle.getMapState("waiting", "slice bigint", "rows string")

    def set_timer(self, at: int, anew: bool = False) -> None:
        """A timer at `at`, unless there is an earlier one."""
        known = None if anew else self.timer.get()
        if known is None or at < known[0]:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for frame in rows:
            some = list(zip(frame["at"].tolist(), frame["seq"].tolist(), frame["kind"].tolist(), frame["value"].tolist(), strict=True))
            by_slice: dict[int, list] = {}
            for row in some:
                by_slice.setdefault(row[0] // self.slice, []).append(row)
            for place, own in by_slice.items():
                old = json.loads(self.waiting.getValue((place,))[0]) if self.waiting.containsKey((place,)) else []
                self.waiting.updateValue((place,), (json.dumps(old + own),))
            least = min(r[0] for r in some)
            first = least if first is None else min(first, least)
        if first is not None:
            self.set_timer(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.timer.get()
        if known is None or known[0] != expiredTimerInfo.getExpiryTimeInMs():
            return  # an earlier one has done its work
        reached, machine, given = timerValues.getCurrentWatermarkInMs(), self.machine, []
        stored = self.now.get()
        state = json.loads(stored[0]) if stored else None
        ahead = None
        for place in sorted(k[0] for k in self.waiting.keys()):
            if place * self.slice > reached:
                ahead = place * self.slice if ahead is None else ahead
                break
            rows = sorted(json.loads(self.waiting.getValue((place,))[0]), key=lambda r: r[:2])
            for at, _, kind, value in (r for r in rows if r[0] <= reached):
                if (end := machine.deadline(state)) is not None and end <= at:
                    state = machine.passed(state)
                state, out = machine.event(state, at, kind, None if value is None else json.loads(value).get("v"))
                if out:
                    given.append(out)
            if left := [r for r in rows if r[0] > reached]:
                self.waiting.updateValue((place,), (json.dumps(left),))
                ahead = left[0][0]
                break
            self.waiting.removeKey((place,))
        if (end := machine.deadline(state)) is not None and end <= reached:
            state = machine.passed(state)
        if not machine.by_row:
            given = [machine.told(state)]
        if state is None:
            self.now.clear()
        else:
            self.now.update((json.dumps(state),))
        nearest = min((t for t in (ahead, machine.deadline(state)) if t is not None), default=None)
        if nearest is None:
            self.timer.clear()
        else:
            self.set_timer(nearest, anew=True)
        if given:
            yield pd.DataFrame([[key[0], *g] for g in given], columns=[self.key, *self.names], dtype=object)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, ts: str, seq: str, machine: Machine, kind: Column, value: Column | None = None, late: str | None = "1 day", slice_hours: int = 24) -> DataFrame:
    """What a machine gives out for a stream, for update mode: a row for each key whose state may have changed, or what its rows give.

    events must have the columns key, ts (timestamp; rows without one are left out) and seq (integer); late is the watermark's delay (None: events have a watermark on ts). value:
    whatever to_json() takes. Sessions need the setting STORE.
    """
    rows = events.where(F.col(ts).isNotNull())
    rows = rows.withWatermark(ts, late) if late else rows
    wrapped = F.lit(None).cast("string") if value is None else F.to_json(F.struct(value.alias("v")))
    rows = rows.select(key, ts, F.unix_millis(ts).alias("at"), F.coalesce(F.col(seq).cast("bigint"), F.lit(0)).alias("seq"), kind.cast("string").alias("kind"), wrapped.alias("value"))
    names = [c.strip().split(" ")[0] for c in machine.columns.split(",")]
    shape = f"{key} {events.schema[key].dataType.simpleString()}, {machine.columns}"
    return rows.groupBy(key).transformWithStateInPandas(InOrder(machine, key, names, slice_hours * 3_600_000), shape, "update", "eventTime")
