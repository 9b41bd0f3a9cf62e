"""Retries with timers: a failed visit is due again after a wait, a limited number of times; finished keys are forgotten."""

from __future__ import annotations

import sys
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "attempts int, last long, failed boolean"


class Retries(StatefulProcessor):
    """State of a key: its attempts so far, when the last one was (microseconds), and whether it failed.

    In event time a timer is due when the watermark passes it, so a replay fires the same timers; finished keys go by a timer,
    too. In processing time timers follow the clock, and finished keys go by the state's time to live.
    """

    def __init__(self, key: str, retries: int, wait: int, keep: int, event_time: bool):
        self.key, self.retries, self.wait, self.keep, self.event_time = key, retries, wait, keep, event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("visits", STATE, None if self.event_time else self.keep)

    def row(self, key, event, attempt, at, reached):
        import pandas as pd

        return pd.DataFrame({self.key: [key[0]], "event": [event], "attempt": pd.array([attempt], "int32"), "at": pd.array([at], "datetime64[us]"), "last": [attempt > self.retries], "reached": pd.array([reached], "boolean")})

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np

        # a key's rows of one trigger, nine bytes each, put in order
        parts = [(f["visit_at"].to_numpy("datetime64[us]").astype(np.int64), f["visit_failed"].to_numpy(bool)) for f in rows]
        at, failed = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((failed, at))
        at, failed = at[order], failed[order]
        attempts, last, bad = self.state.get() if self.state.exists() else (0, 0, True)
        was = attempts
        while bad and attempts <= self.retries:
            i = int(np.searchsorted(at, last + 1000 * self.wait)) if attempts else 0
            if i == len(at):
                break
            attempts, last, bad = attempts + 1, int(at[i]), bool(failed[i])
        if attempts > was:
            self.state.update((attempts, last, bad))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            open_ = bad and attempts <= self.retries
            if open_ or self.event_time:
                start = last // 1000 if self.event_time else timerValues.getCurrentProcessingTimeInMs()
                self.handle.registerTimer(start + (self.wait if open_ else self.keep))
            yield self.row(key, "seen", attempts, last, not bad)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.state.exists():
            return
        attempts, last, bad = self.state.get()
        if bad and attempts <= self.retries:
            yield self.row(key, "due", attempts + 1, 1000 * expiredTimerInfo.getExpiryTimeInMs(), None)
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def retries(visits: DataFrame, key: str, at: str, failed: str, retries: int = 2, wait_ms: int = 300_000, keep_ms: int = 30 * 86_400_000, late: str = "0 seconds", event_time: bool = True) -> DataFrame:
    """A stream of events of each key from a stream of its visits, where `at` is a timestamp and failed a boolean.

    seen: an attempt counts: the first visit, and up to `retries` more, each the first one at least wait_ms after a failure;
    attempt, at and reached tell of it, last that no more is allowed. due: such a wait is over and the named attempt is to be
    made; last marks the final one. Visits with a null key, time or outcome are left out. A finished key is forgotten after
    keep_ms and begins anew. Start it within rocks().
    """
    v = visits.select(key, F.col(at).alias("visit_at"), F.col(failed).alias("visit_failed")).where(F.col(key).isNotNull() & F.col("visit_at").isNotNull() & F.col("visit_failed").isNotNull())
    kind = visits.schema[key].dataType.simpleString()
    processor = Retries(key, retries, wait_ms, keep_ms, event_time)
    return v.withWatermark("visit_at", late).groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, event string, attempt int, at timestamp, last boolean, reached boolean", "Append", "EventTime" if event_time else "ProcessingTime")


@contextmanager
def rocks(spark: SparkSession):
    """Queries started within keep their state in RocksDB, which state with timers needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def outcomes(events: DataFrame, key: str) -> DataFrame:
    """key, attempts and reached after all `seen` events, as the batch fold has them."""
    return events.where("event = 'seen'").groupBy(key).agg(F.max("attempt").alias("attempts"), F.max_by("reached", "attempt").alias("reached"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
