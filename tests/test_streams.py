"""Streams with timers and state against their batch folds."""

import datetime

from pyspark.sql import functions as F

from quillmesh.streaming import retries as T
from quillmesh.streaming import visits as S


def test_retries_fire_after_the_wait(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    minute = lambda m: t0 + datetime.timedelta(minutes=m)
    schema = "key long, at timestamp, failed boolean, event string"
    feed, at = str(tmp_path / "feed"), str(tmp_path / "state")
    (tmp_path / "feed").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)

    def step(n, rows):
        spark.createDataFrame([(k, minute(m), f, "x") for k, m, f in rows], schema).coalesce(1).write.mode("append").parquet(feed)
        with T.rocks(spark):
            out = S.drained(spark, T.retries(stream, "key", "at", "failed", wait_ms=300_000, keep_ms=3_600_000), at)
        return sorted((r.key, r.event, r.attempt, round((r.at.replace(tzinfo=datetime.timezone.utc) - t0).total_seconds() / 60, 2), r.last, r.reached) for r in out.collect())

    step(0, [(1, 0, True), (2, 0, False), (3, 0, True), (3, 2, True), (3, 6, True), (None, 1, True), (4, 1, None)])
    step(1, [(9, 4, True), (1, 4, True)])  # a visit within the wait counts for nothing
    got = step(2, [(9, 30, True)])
    assert [x for x in got if x[0] == 1] == [(1, "due", 2, 5.0, False, None), (1, "seen", 1, 0.0, False, False)]
    assert [x for x in got if x[0] == 2] == [(2, "seen", 1, 0.0, False, True)]
    assert [x for x in got if x[0] == 3] == [(3, "due", 3, 11.0, True, None), (3, "seen", 2, 6.0, False, False)]
    got = step(3, [(1, 31, True), (3, 32, True), (3, 40, False)])
    got = step(4, [(9, 50, True)])
    assert [x for x in got if x[0] == 1] == [(1, "due", 2, 5.0, False, None), (1, "due", 3, 36.0, True, None), (1, "seen", 1, 0.0, False, False), (1, "seen", 2, 31.0, False, False)]
    assert [x for x in got if x[0] == 3 and x[1] == "seen"] == [(3, "seen", 2, 6.0, False, False), (3, "seen", 3, 32.0, True, False)]  # no fourth one
    step(5, [(9, 200, True)])
    got = step(6, [(2, 201, True)])  # forgotten: it begins anew
    assert [x for x in got if x[0] == 2] == [(2, "seen", 1, 0.0, False, True), (2, "seen", 1, 201.0, False, False)]


def test_retries_by_the_clock(spark, tmp_path):
    """With the clock's timers a stream has always more to do, so it runs for a while and is stopped."""
    schema = "key long, at timestamp, failed boolean"
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), True)], schema).write.parquet(feed)
    stream = T.retries(spark.readStream.schema(schema).parquet(feed), "key", "at", "failed", wait_ms=1, event_time=False)
    with T.rocks(spark):
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(processingTime="1 second").start(out)
    try:
        for _ in range(40):
            q.awaitTermination(1)
            if (tmp_path / "out" / "_spark_metadata").exists() and spark.read.schema(stream.schema).parquet(out).where("event = 'due'").count():
                break
    finally:
        q.stop()
    assert {(1, "seen", 1), (1, "due", 2)} <= {(r.key, r.event, r.attempt) for r in spark.read.parquet(out).collect()}


def test_second_pass_joins_as_it_arrives(spark, tmp_path):
    from quillmesh.streaming import passes

    t0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    schema = "k long, at timestamp, ok boolean, s string"
    for name in ("direct", "rescan"):
        (tmp_path / name).mkdir()
    streams = [spark.readStream.schema(schema).parquet(str(tmp_path / name)) for name in ("direct", "rescan")]

    def step(direct, rescan):
        for name, rows in (("direct", direct), ("rescan", rescan)):
            data = [(k, t0 + datetime.timedelta(minutes=m), ok, name) for k, m, ok in rows]
            spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        out = S.drained(spark, passes.two_pass(*streams, "k", "at", "ok"), str(tmp_path / "state"), "append")
        return sorted((r.k, r.s, r.ok) for r in out.collect())

    got = step([(1, 0, True), (2, 0, False), (3, 1, False), (2, 1, False), (4, 1, None)], [(1, 5, True), (3, 9, False)])
    assert (1, "direct", True) in got and (3, "rescan", False) in got and not any(k == 2 for k, _, _ in got)
    got = step([(9, 20, True)], [(2, 21, True)])
    assert (2, "rescan", True) in got and not any(k == 4 for k, _, _ in got)
    got = step([(9, 300, True)], [(8, 300, True)])
    assert got == [(1, "direct", True), (2, "rescan", True), (3, "rescan", False), (4, "direct", None), (9, "direct", True), (9, "direct", True)]


def test_failed_writes_go_aside(spark, tmp_path):
    from quillmesh.streaming import passes

    calls = []

    def write(df, n):
        calls.append(n)
        if n == 1 or len(calls) == 1:
            raise OSError("no room")
        df.write.mode("overwrite").parquet(str(tmp_path / f"out/{n}"))

    run = passes.saved(write, str(tmp_path / "aside"), retries=1)
    for n in (0, 1, 1):
        run(spark.range(3), n)
    assert calls == [0, 0, 1, 1, 1, 1] and spark.read.parquet(str(tmp_path / "out/0")).count() == 3
    aside = spark.read.parquet(str(tmp_path / "aside")).collect()
    assert len(aside) == 3 and {(r.batch, r.error) for r in aside} == {(1, "no room")}
