"""Rate windows, leases and one-shot tokens as state machines on a stream, one after the other in event time.

Events arrive late and more than once. They wait in the state, by time and id (so a repeated one is
the same entry), until the watermark has passed them; a timer then runs the key's machine over what is due, in order.
So for all events within the watermark's delay the output is that of the batch fold (`operators.state`).
A key whose machine is at rest leaves the state. The state store has to be RocksDB's
(`spark.sql.streaming.stateStore.providerClass`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine:
    """What a key does: its state's schema and begin, a step for an event, and when it is at rest."""

    state: str
    begin: tuple
    output: str

    def step(self, state: tuple, ms: int, action: str, number: int) -> tuple[tuple, tuple]:
        raise NotImplementedError

    def rests_at(self, state: tuple) -> int | None:
        """The time after which the state is that of a new key; None: never."""
        raise NotImplementedError


class Rate(Machine):
    """Fixed windows from a key's first event: (allowed, remaining, retry_after_ms) of each event."""

    state, begin, output = "reset long, count long", (-1, 0), "allowed boolean, remaining long, retry_after_ms long"

    def __init__(self, limit: int, window_ms: int) -> None:
        self.limit, self.window_ms = limit, window_ms

    def step(self, state: tuple, ms: int, action: str, number: int) -> tuple[tuple, tuple]:
        reset, count = state
        if reset < ms:
            reset, count = ms + self.window_ms, 0
        count += 1
        return (reset, count), (count <= self.limit, max(0, self.limit - count), 0 if count <= self.limit else reset - ms)

    def rests_at(self, state: tuple) -> int | None:
        return state[0]


class Lease(Machine):
    """Leases by job: acquire, done, error and recover; (status, job_id) after each event. With `stale_ms`, a lease that
    is held so long fails before the next event is looked at."""

    state, begin, output = "status string, job long, since long", ("none", -1, -1), "status string, job_id long"

    def __init__(self, stale_ms: int | None = None) -> None:
        self.stale_ms = stale_ms

    def step(self, state: tuple, ms: int, action: str, number: int) -> tuple[tuple, tuple]:
        status, job, since = state
        if self.stale_ms is not None and status == "parsing" and ms - since > self.stale_ms:
            status = "error"
        if action == "acquire" and status != "parsing":
            status, job, since = "parsing", number, ms
        elif action in ("done", "error") and status == "parsing" and number == job:
            status = action
        elif action == "recover" and status == "parsing":
            status = "error"
        return (status, job, since), (status, None if job < 0 else job)

    def rests_at(self, state: tuple) -> int | None:
        return None


class Token(Machine):
    """One-shot tokens: the first use of the wanted kind (`action`), at or before the expiry (`number`, ms), consumes it."""

    state, begin, output = "used boolean, expires long", (False, -1), "consumed boolean"

    def __init__(self, wanted: str) -> None:
        self.wanted = wanted

    def step(self, state: tuple, ms: int, action: str, number: int) -> tuple[tuple, tuple]:
        used, _ = state
        now = not used and action == self.wanted and ms <= number
        return (used or now, number), (now,)

    def rests_at(self, state: tuple) -> int | None:
        return state[1]


class InOrder(StatefulProcessor):
    """Holds events until the watermark passes them and steps the key's machine over them."""

    def __init__(self, machine: Machine) -> None:
        self.machine = machine
        self.columns = [c.split(" ")[0] for c in machine.output.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long, event_id long", "action string, number long")
        self.own = handle.getValueState("own", self.machine.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for ms, event_id, action, number in zip(batch["ms"].tolist(), batch["event_id"].tolist(), batch["action"].tolist(), batch["number"].tolist(), strict=True):
                self.waiting.updateValue((ms, event_id), (action, number))
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted((k, v) for k, v in self.waiting.iterator() if k[0] <= passed)
        state, out = tuple(self.own.get()) if self.own.exists() else self.machine.begin, []
        for (ms, event_id), (action, number) in due:
            state, told = self.machine.step(state, ms, action, number)
            out.append((key[0], event_id, *told))
            self.waiting.removeKey((ms, event_id))
        rest = self.machine.rests_at(state)
        if rest is not None and rest < passed:
            self.own.clear()
        elif due:
            self.own.update(state)
            if rest is not None:
                self.handle.registerTimer(rest + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "event_id", *self.columns])

    def close(self) -> None:
        pass


def run(events: DataFrame, machine: Machine, key: str, ts: str, event_id: str, action: str | None = None, number: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(key, event_id and the machine's output) for each event of a stream, in append mode.

    action and number: columns that the machine reads. delay: how late an event may be.
    """
    told = {"action": F.col(action) if action else F.lit("use"), "number": F.col(number).cast("long") if number else F.lit(0).cast("long")}
    plain = events.withWatermark(ts, delay).select(F.col(key).cast("long").alias("key"), F.col(event_id).cast("long").alias("event_id"), F.col(ts), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), *(v.alias(k) for k, v in told.items()))
    return plain.groupBy("key").transformWithStateInPandas(InOrder(machine), f"key long, event_id long, {machine.output}", "append", "eventTime")
