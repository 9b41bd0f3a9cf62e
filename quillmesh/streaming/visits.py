"""Availability checks as a stream: each key's state folds its visits; the batch fold is what it converges to."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quillmesh.operators.storage import shared_root

OUT = "user_id long, offline_count long, first_online timestamp_ntz, first_offline timestamp_ntz, last_updated timestamp_ntz, seen long"
STATE = "offline_count long, first_online timestamp_ntz, first_offline timestamp_ntz, last_updated timestamp_ntz, seen long"


def fold(key, frames, state):
    """One trigger's visits of a key, in any order, on top of its state.

    Frames are folded one by one: of what is read, only failures after the latest success so far are kept, as two numbers each.
    """
    import numpy as np
    import pandas as pd

    count, online, offline, updated, seen = state.get if state.exists else (0, None, None, None, 0)
    last, first, rest, ids, newest = None, None, np.zeros(0, "datetime64[us]"), np.zeros(0, np.int64), None
    for f in frames:
        ts, number, failed = f["ts"].to_numpy("datetime64[us]"), f["event_id"].to_numpy(np.int64), f["failed"].to_numpy(bool)
        if not len(ts):
            continue
        seen, newest = seen + len(ts), ts.max() if newest is None else max(newest, ts.max())
        good = np.flatnonzero(~failed)
        if len(good):
            first = ts[good].min() if first is None else min(first, ts[good].min())
            top = max(good, key=lambda i: (ts[i], number[i]))
            last = max(last, (ts[top], number[top])) if last else (ts[top], number[top])
        rest, ids = np.concatenate([rest, ts[failed]]), np.concatenate([ids, number[failed]])
        if last:  # what failed before the last success counts no more
            after = (rest > last[0]) | (rest == last[0]) & (ids > last[1])
            rest, ids = rest[after], ids[after]
    moment = lambda t: pd.Timestamp(t).to_pydatetime()
    if last:
        online, count, offline = online or moment(first), 0, None
    if len(rest):
        count, offline = count + len(rest), offline or moment(rest.min())
    updated = moment(newest) if newest is not None else updated
    state.update((count, online, offline, updated, seen))
    yield pd.DataFrame({"user_id": [key[0]], "offline_count": [count], "first_online": pd.Series([online], dtype="datetime64[us]"), "first_offline": pd.Series([offline], dtype="datetime64[us]"), "last_updated": pd.Series([updated], dtype="datetime64[us]"), "seen": [seen]})


def visit_states(visits: DataFrame) -> DataFrame:
    """A stream of states from a stream (user_id, ts, event_id, failed).

    A state is a few numbers a key and is kept as long as the stream: a key that is visited again goes on from it.
    """
    return visits.groupBy("user_id").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by window and kind; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def drained(spark: SparkSession, stream: DataFrame, folder: str | None = None, mode: str = "update") -> DataFrame:
    """All rows that a stream gives until what is available now is read. Batches are written under their number, so a batch
    that is repeated after a failure replaces itself; with a folder, a later call goes on from there and gives all rows so far.
    """
    at = folder or _fresh(spark)
    _run(stream, at, mode)
    return spark.read.schema(stream.schema).parquet(f"{at}/out/batch=*")


def _fresh(spark: SparkSession) -> str:
    import uuid

    return f"{shared_root(spark)}/quillmesh/stream-{uuid.uuid4().hex}"


def _run(stream: DataFrame, at: str, mode: str = "update"):
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}")).start()
    q.awaitTermination()
    return q


def metered(spark: SparkSession, stream: DataFrame, counters: dict[str, Column], folder: str | None = None) -> tuple[DataFrame, list[dict]]:
    """drained(), and for each trigger that had rows its number and counters, aggregates that are taken as the rows pass by:
    no pass of its own is made for them, and nothing but the numbers comes to the driver.
    """
    at = folder or _fresh(spark)
    q = _run(stream.observe("counters", *[c.alias(n) for n, c in counters.items()]), at)
    seen = {p["batchId"]: p["observedMetrics"]["counters"].asDict() for p in q.recentProgress if p["observedMetrics"].get("counters")}
    return spark.read.schema(stream.schema).parquet(f"{at}/out/batch=*"), [{"batch": n} | c for n, c in sorted(seen.items())]


def run_to_end(spark: SparkSession, states: DataFrame, key: str = "user_id", order: str = "seen") -> DataFrame:
    """All that is available now, folded; the newest state of each key."""
    out = drained(spark, states)
    rest = [c for c in out.columns if c != key]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
