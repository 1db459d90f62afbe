"""State machines of the log streams, one instance a key, on transformWithState.

They need the RocksDB state store: start the query within rocksdb_state(). State is kept as small as the answer
allows, and rows of a batch are taken one Arrow frame at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own setting is put back."""
    had = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if had is None else spark.conf.set(_PROVIDER, had)


class Attempts(StatefulProcessor):
    """Opened, closed, alert and retracted of one package, in the order of event time.

    Events wait until the watermark has passed them, so they are replayed in one order however they come in; what
    waits is what one package has within the watermark. One timer is set at a time: to the next waiting event, or
    the deadline of the open attempt.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "opened long, alerted boolean, wake long")
        self.waiting = handle.getListState("waiting", "at long, run_id long, sequence long, closes boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        opened, alerted, wake = self.open.get() if self.open.exists() else (None, False, None)
        first = wake
        for frame in rows:
            events = list(zip(*(frame[c].tolist() for c in ("at", "run_id", "sequence", "closes"))))
            self.waiting.appendList(events)
            least = min(e[0] for e in events)
            first = least if first is None else min(first, least)
        if first != wake:
            self.handle.registerTimer(first)
            self.open.update((opened, alerted, first))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        opened, alerted, _ = self.open.get() if self.open.exists() else (None, False, None)
        events = sorted(self.waiting.get()) if self.waiting.exists() else []
        later = [e for e in events if e[0] > now]
        out: list[tuple[str, int]] = []

        def alert(until: int) -> bool:
            due = opened is not None and not alerted and opened + self.timeout_ms <= until
            if due:
                out.append(("alert", opened + self.timeout_ms))
            return alerted or due

        for at, _, _, closes in events[: len(events) - len(later)]:
            alerted = alert(at)
            if not closes and opened is None:
                opened, alerted = at, False
                out.append(("opened", at))
            elif closes and opened is not None:
                out.append(("retracted" if alerted else "closed", at))
                opened, alerted = None, False
        alerted = alert(now)
        if events and later:
            self.waiting.put(later)
        elif events:
            self.waiting.clear()
        wakes = [later[0][0]] if later else []
        if opened is not None and not alerted:
            wakes.append(opened + self.timeout_ms)
        if wakes:
            self.handle.registerTimer(min(wakes))
        if opened is None and not wakes:
            self.open.clear()
        else:
            self.open.update((opened, alerted, min(wakes, default=None)))
        if out:
            yield pd.DataFrame({"package_id": [key[0]] * len(out), "change": [c for c, _ in out], "at": [a for _, a in out]})


def merged(spans: list[tuple[int, int]], numbers: np.ndarray) -> list[tuple[int, int]]:
    """Sorted spans of whole numbers, none touching the next, with these numbers added."""
    numbers = np.unique(numbers)
    cut = np.flatnonzero(np.diff(numbers) > 1)
    added = zip(numbers[np.concatenate([[0], cut + 1])].tolist(), numbers[np.append(cut, len(numbers) - 1)].tolist()) if len(numbers) else ()
    out: list[tuple[int, int]] = []
    for start, end in sorted([*spans, *added]):
        if out and start <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def gaps(spans: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """(first missing number, next seen one) below each span, counting from 1."""
    ends = [0, *(end for _, end in spans)]
    return {(end + 1, start) for end, (start, _) in zip(ends, spans) if start > end + 1}


class Gaps(StatefulProcessor):
    """Gaps in the numbers of one run, and those that late numbers have filled.

    State is the run's spans of seen numbers, which are as many as its gaps. It goes when the run has had no event
    for `forget_ms` of event time; gaps that are open then stay reported.
    """

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getMapState("spans", "start long", "end long")
        self.newest = handle.getValueState("newest", "newest long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        had = sorted((k[0], v[0]) for k, v in self.spans.iterator()) if self.spans.exists() else []
        newest = self.newest.get()[0] if self.newest.exists() else None
        have, latest = had, newest
        for frame in rows:
            numbers = frame["sequence"].to_numpy()
            have = merged(have, numbers[numbers > 0])
            latest = max(int(frame["at"].max()), frame["at"].max() if latest is None else latest)
        for start, _ in set(had) - set(have):
            self.spans.removeKey((start,))
        for start, end in set(have) - set(had):
            self.spans.updateValue((start,), (end,))
        if latest != newest:
            self.newest.update((int(latest),))
            self.handle.registerTimer(int(latest) + self.forget_ms)
        was, now = gaps(had), gaps(have)
        out = [("filled", *g) for g in sorted(was - now)] + [("gap", *g) for g in sorted(now - was)]
        if out:
            yield pd.DataFrame({"run_id": [key[0]] * len(out), "change": [x[0] for x in out], "expected": [x[1] for x in out], "found": [x[2] for x in out]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        # timers of events before the newest one find it within its time
        if self.newest.exists() and self.newest.get()[0] + self.forget_ms <= timerValues.getCurrentWatermarkInMs():
            self.spans.clear()
            self.newest.clear()
        return iter(())
