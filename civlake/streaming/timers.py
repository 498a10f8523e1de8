"""Missed runs told by timers: keyed state with a timer at the next slot plus grace."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from civlake.operators.jobs import next_slots

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MISSES = "job string, last_started timestamp, next_slot timestamp"
#: Event times that no row has are below this.
_EPOCH = datetime(1970, 1, 1)


def _ms(t: datetime) -> int:
    return -((_EPOCH - t.replace(tzinfo=None)) // timedelta(milliseconds=1))


class _Watch(StatefulProcessor):
    """Of one job: runs that the watermark has not passed, and the last one that it has, with the slot that follows it.

    A run settles when the watermark comes to it, by a timer, so that rows out of order within the watermark's delay do no harm. A slot is missed if its grace ends before the next
    run, which a timer at that moment tells, or the next run's settling where both come in one batch. A batch's runs of a job go into the state at once and have one timer, so that
    calls grow with jobs, not with runs.
    """

    def __init__(self, grace_ms: int):
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "started timestamp, due timestamp")
        self.last = handle.getValueState("last", "started timestamp, due timestamp, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            known = pdf[pdf["started"].notna()].drop_duplicates("started")
            new += [(started.to_pydatetime(), None if pd.isna(due) else due.to_pydatetime()) for started, due in zip(known["started"], known["due"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self._wake(min(started for started, _ in new), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed at once: a timer set for a moment behind it would wait for another batch
        now, found = timerValues.getCurrentWatermarkInMs(), []
        waiting = dict(self.waiting.get()) if self.waiting.exists() else {}
        settled = sorted(started for started in waiting if _ms(started) <= now)
        last = self.last.get() if self.last.exists() else None
        for started in settled:
            last = self._judged(last, _ms(started), found)
            if last is None or last[0] < started:
                last = (started, waiting.pop(started), False)
            else:
                del waiting[started]
        last = self._judged(last, now, found)
        if settled:
            self.waiting.clear()
            if waiting:
                self.waiting.appendList(list(waiting.items()))
                self._wake(min(waiting), now)
            if last[1] is not None and not last[2]:
                self.handle.registerTimer(max(_ms(last[1]) + self.grace_ms + 1, now + 1))
        if last is not None and (settled or found):
            self.last.update(last)
        if found:
            yield pd.DataFrame({"job": [key[0]] * len(found), "last_started": pd.to_datetime([f[0] for f in found]), "next_slot": pd.to_datetime([f[1] for f in found])})

    def _wake(self, started: datetime, now: int) -> None:
        """One timer for the earliest run that waits; it sets the next."""
        self.handle.registerTimer(max(_ms(started), now + 1))

    def _judged(self, last: tuple | None, now: int, found: list[tuple]) -> tuple | None:
        if last is None or last[2] or last[1] is None or _ms(last[1]) + self.grace_ms >= now:
            return last
        found.append((last[0], last[1]))
        return (last[0], last[1], True)

    def close(self) -> None:
        """State is the store's."""


def missed_run_stream(runs: DataFrame, schedules: DataFrame, grace_hours: int = 12, late: str = "1 day") -> DataFrame:
    """job, last_started, next_slot: a row for each slot behind a job's scheduled run that no run has followed when its grace has passed.

    runs is a stream of job, event and started; schedules a table as missed_runs() takes it. Time is the runs' own: the watermark is the latest start less `late`, and rows behind it are not
    taken. A slot's row comes once, also over restarts from one checkpoint. The session's state store must be RocksDB.
    """
    per_job = schedules.groupBy("job").agg(F.collect_list(F.struct("minutes", "hours", "doms", "months", "dows", "any_dom", "any_dow")).alias("__s"))
    timed = runs.withColumn("started", F.col("started").cast("timestamp")).withWatermark("started", late)
    met = timed.join(per_job, "job", "left")
    due = F.array_min(F.flatten(F.transform("__s", lambda s: next_slots(F.col("started"), 1, lambda c: s[c]))))
    # rows without a job only move the watermark
    asked = met.filter("event = 'schedule' or job is null").select("job", "started", F.when(F.col("job").isNotNull(), due).alias("due"))
    return asked.groupBy("job").transformWithStateInPandas(_Watch(grace_hours * 3_600_000), MISSES, "append", "eventtime")
