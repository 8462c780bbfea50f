"""Stateful processors of the event streams. State is kept in RocksDB; a key's timer tells when it is of no use any more."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_stateful(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str = "append") -> DataFrame:
    """The keys' rows through the processor in event time. Sets the session's state store to RocksDB, which this needs."""
    _use_rocksdb(df.sparkSession)
    return df.groupBy(*keys).transformWithState(processor, schema, mode, "EventTime")


def _use_rocksdb(spark: SparkSession) -> None:
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, "") or ""):
        spark.conf.set(name, _PROVIDER)


class _Timed(StatefulProcessor):
    """One timer a key, which moves on with the key's events."""

    handle: StatefulProcessorHandle

    def _wake(self, us: int, timer_values) -> None:
        """Moves the key's timer on to the first millisecond that isn't before us, or the next one if the watermark is past it."""
        held = [t for (t, *_) in _each(self.handle.listTimers())]
        at = max(-(-us // 1000), timer_values.getCurrentWatermarkInMs() + 1, *held)
        if at not in held:
            self.handle.registerTimer(at)
        for t in held:
            if t != at:
                self.handle.deleteTimer(t)

    def close(self) -> None:
        pass


def _each(timers) -> Iterator[tuple]:
    for t in timers:
        yield t if isinstance(t, tuple) else (t,)


class InOrder(_Timed):
    """A key's rows (us, event, ok) of a micro-batch through a rule in order of time and event.

    The rows are held as two numbers and a bit each until they are sorted, and the rule's answers go out one by one. The
    key's state goes once the watermark is keep_us past its last event.
    """

    def __init__(self, rule, keep_us: int):
        self.rule, self.keep_us = rule, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rule.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        us, event, known, ok = array("q"), array("q"), bytearray(), bytearray()
        for r in rows:
            us.append(r["us"])
            event.append(r["event"] if r["event"] is not None else 0)
            known.append(r["event"] is not None)
            ok.append(bool(r["ok"]))
        times, events, sure = np.frombuffer(us, np.int64), np.frombuffer(event, np.int64), np.frombuffer(known, np.uint8)
        state = self.rule.load()
        for i in np.lexsort((events, sure, times)).tolist():
            yield Row(*self.rule.names)(*self.rule.row(key, event[i] if known[i] else None, self.rule.step(state, us[i], bool(ok[i]))))
        self.rule.save(state)
        self._wake(int(times.max()) + self.keep_us, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.rule.clear()
        return iter(())


class Sliding:
    """Times of the allowed events within the window, at most limit of them."""

    names = ("key", "event", "allowed", "current", "remaining")

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("allowed", "us long")

    def load(self) -> list[int]:
        return [us for (us,) in self.log.get()] if self.log.exists() else []

    def save(self, state: list[int]) -> None:
        if state:
            self.log.put([(us,) for us in state])
        else:
            self.log.clear()

    def clear(self) -> None:
        self.log.clear()

    def step(self, state: list[int], us: int, ok: bool) -> tuple:
        state[:] = [x for x in state if x > us - self.window_us]
        allowed = len(state) < self.limit
        if allowed:
            state.append(us)
        return allowed, len(state), self.limit - len(state)

    def row(self, key: tuple, event: int | None, answer: tuple) -> tuple:
        return (key[0], event, *answer)


class _OneValue:
    fields: str

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.fields)

    def load(self) -> list[int]:
        return list(self.held.get()) if self.held.exists() else []

    def save(self, state: list[int]) -> None:
        if state:
            self.held.update(tuple(state))
        else:
            self.held.clear()

    def clear(self) -> None:
        self.held.clear()


class Fixed(_OneValue):
    """Begin of the open window and events in it."""

    names, fields = Sliding.names, "start long, n long"

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def step(self, state: list[int], us: int, ok: bool) -> tuple:
        if not state or us >= state[0] + self.window_us:
            state[:] = [us, 0]
        state[1] += 1
        return state[1] <= self.limit, state[1], max(0, self.limit - state[1])

    row = Sliding.row


class Once(_OneValue):
    """Time of the stored success."""

    names, fields = ("event", "replay"), "us long"

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def step(self, state: list[int], us: int, ok: bool) -> tuple:
        replay = bool(state) and us < state[0] + self.ttl_us
        if not replay and ok:
            state[:] = [us]
        return (replay,)

    def row(self, key: tuple, event: int | None, answer: tuple) -> tuple:
        return (event, *answer)


class Latest(_Timed):
    """The last value of a key; a change goes out when it is set, revoked or out of date.

    The last event is remembered until its time is over, also where it revokes, so that older ones that come later
    don't bring a value back.
    """

    names = ("key", "value", "at_us", "live")

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "us long, event long, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        was = self.held.get() if self.held.exists() else None
        order = lambda x: (x[0], x[1] is not None, x[1] or 0)
        last = max(((r["us"], r["event"], r["value"]) for r in rows), key=order)
        if was is not None and order(was) >= order(last):
            return
        live, was_live = last[2] is not None, was is not None and was[2] is not None
        self.held.update(last)
        self._wake(last[0] + self.ttl_us, timerValues)
        if live or was_live:
            yield Row(*self.names)(key[0], last[2], last[0], live)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        us, _, value = self.held.get()
        self.held.clear()
        if value is not None:
            yield Row(*self.names)(key[0], None, us, False)
