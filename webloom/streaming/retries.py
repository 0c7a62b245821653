"""Retries that wait: a state for each URL, with event-time timers for what is due and for what may be forgotten."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from webloom.config import DEFAULT

_OUT = "url string, event string, tries int, at long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@dataclass
class Task:
    """A URL's task, times in microseconds.

    ``tries`` made so far; ``due`` is when the next is to be made, and ``called`` whether that has been said;
    ``downloaded`` and ``failed`` are when tasks of the URL ended so.
    """

    tries: int = 0
    due: int | None = None
    called: bool = False
    downloaded: int | None = None
    failed: int | None = None
    failures: int = 0

    def upto(self, now: int, keep: int) -> list[tuple[str, int, int]]:
        """What happens by ``now``: a retry falls due, a retry without an outcome is given up, ended tasks are forgotten."""
        out = []
        if self.due is not None and self.due <= now and not self.called:
            out.append(("retry", self.tries, self.due))
            self.called = True
        if self.due is not None and self.due + keep <= now:
            out.append(("lost", self.tries, self.due + keep))
            self.tries, self.due, self.called = 0, None, False
        if self.downloaded is not None and self.downloaded + keep <= now:
            self.downloaded = None
        if self.failed is not None and self.failed + keep <= now:
            self.failed, self.failures = None, 0
        return out

    def outcome(self, at: int, ok: bool, retries: int, backoff: int, keep: int) -> list[tuple[str, int, int]]:
        """What an outcome brings, after what was due by then. It is nobody's while a retry waits or once the URL is downloaded."""
        out = self.upto(at, keep)
        if self.downloaded is not None or self.due is not None and at < self.due:
            return out
        self.tries += 1
        if ok or self.tries > retries:
            out.append(("downloaded" if ok else "failed", self.tries, at))
            if ok:
                self.downloaded = at
            else:
                self.failed, self.failures = at, self.failures + 1
            self.tries, self.due, self.called = 0, None, False
        else:
            self.due, self.called = at + backoff * self.tries, False
        return out

    def wake(self, keep: int) -> int | None:
        """When something is next to happen without an outcome."""
        times = [self.due + (keep if self.called else 0)] if self.due is not None else []
        times += [t + keep for t in (self.downloaded, self.failed) if t is not None]
        return min(times, default=None)


class Retries(StatefulProcessor):
    """Keeps a ``Task`` for each URL: an open one as a value, ended ones by their state in a map."""

    def __init__(self, order: tuple[str, ...], retries: int, backoff_ms: int, keep_ms: int) -> None:
        self.order, self.retries, self.backoff, self.keep = list(order), retries, backoff_ms * 1000, keep_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "tries int, due long, called boolean, timer long")
        self.ended = handle.getMapState("ended", "state string", "at long, times int")

    def _load(self) -> tuple[Task, int | None]:
        task, timer = Task(), None
        if self.open.exists():
            task.tries, task.due, task.called, timer = self.open.get()
        for (state,), (at, times) in list(self.ended.iterator()):
            if state == "downloaded":
                task.downloaded = at
            else:
                task.failed, task.failures = at, times
        return task, timer

    def _store(self, before: Task, task: Task, timer: int | None, fired: bool) -> None:
        for state, was, now in (("downloaded", (before.downloaded, 1), (task.downloaded, 1)), ("failed", (before.failed, before.failures), (task.failed, task.failures))):
            if was != now:
                if now[0] is None:
                    self.ended.removeKey((state,))
                else:
                    self.ended.updateValue((state,), now)
        wake = task.wake(self.keep)
        wake = None if wake is None else wake // 1000
        if timer is not None and timer != wake and not fired:
            self.handle.deleteTimer(timer)
        if wake is not None and (timer != wake or fired):
            self.handle.registerTimer(wake)
        if wake is None:
            self.open.clear()
        else:
            self.open.update((task.tries, task.due, task.called, wake))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        task, timer = self._load()
        before = Task(**vars(task))
        # Of a URL's rows in a batch only when, in which order and how they ended; what a batch holds bounds them.
        made = pd.concat([r[[*self.order, "at", "ok"]] for r in rows]).sort_values(["at", *self.order], kind="stable")
        out = [x for at, ok in zip(made["at"], made["ok"], strict=True) for x in task.outcome(int(at), bool(ok), self.retries, self.backoff, self.keep)]
        self._store(before, task, timer, False)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["url", "event", "tries", "at"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        task, timer = self._load()
        before = Task(**vars(task))
        out = task.upto(timerValues.getCurrentWatermarkInMs() * 1000 - 1, self.keep)
        self._store(before, task, timer, True)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["url", "event", "tries", "at"])

    def close(self) -> None:
        pass


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """While a stream with timers starts: the state store that holds them."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def retries(stream: DataFrame, time: str = "ts", *order: str, ok: str = "ok", url: str = "url", delay: str = "1 hour", most: int = DEFAULT.retries, backoff_ms: int = DEFAULT.backoff_ms, keep_ms: int = 86_400_000) -> DataFrame:
    """(url, event, tries, happened) of each task of ``stream`` (url, time, ok: outcomes of fetches), as it happens.

    After a failure the next try is due ``backoff_ms`` times the tries so far later (event 'retry', at that time),
    ``most`` times; then the task has failed ('failed'), or before that succeeded ('downloaded'). A downloaded URL's
    further outcomes are nobody's for ``keep_ms``; a failed one's start a new task. A retry that has no outcome
    ``keep_ms`` after it was due is given up ('lost'). Nothing older than ``keep_ms`` stays in the state, whatever the
    number of URLs. Outcomes of one time are taken in the columns of ``order``; those later than ``delay`` are left
    out. Rows of null url, time or ok are left out.
    """
    given = stream.where(F.col(url).isNotNull() & F.col(time).isNotNull() & F.col(ok).isNotNull())
    rows = given.select(F.col(url).cast("string").alias("url"), F.col(time).cast("timestamp").alias("_time"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(ok).alias("ok"), *order)
    made = rows.withWatermark("_time", delay).groupBy("url").transformWithStateInPandas(Retries(order, most, backoff_ms, keep_ms), _OUT, "Append", "EventTime")
    return made.select("url", "event", "tries", F.timestamp_micros("at").alias("happened"))
