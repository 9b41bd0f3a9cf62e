"""A stored table that is merged into, with runs that fail, come again, or meet."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import relational as R
from quillmesh.sources.merged import MergedTable

SCHEMA = "k long, s string, n long"


def rows(t):
    return sorted(map(tuple, t.read().collect()))


def upsert(old, new):
    return R.upsert(old, new, ["k"])


def test_merges(spark, tmp_path):
    t = MergedTable(spark, str(tmp_path), SCHEMA, ["k"], 8)
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    assert rows(t) == [] and t.version() == 0
    assert t.merge(frame([(k, "a", k) for k in range(100)]), upsert, "one")
    first = t.manifest()

    def fails(old, new):
        return upsert(old, new).withColumn("s", F.when(F.col("k") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("s")))

    with pytest.raises(Exception):
        t.merge(frame([(3, "b", None), (500, "b", 1)]), fails, "two")
    assert t.manifest() == first and len(rows(t)) == 100  # as before
    assert t.merge(frame([(3, "b", None), (500, "b", 1)]), upsert, "two")
    second = t.manifest()
    assert sum(second["buckets"].get(b) != p for b, p in first["buckets"].items()) <= 2  # touched buckets only
    assert not t.merge(frame([(3, "b", None), (500, "b", 1)]), upsert, "two") and t.manifest() == second
    want = sorted([(k, "b" if k == 3 else "a", k) for k in range(100)] + [(500, "b", 1)])
    assert rows(t) == want and t.read(1).count() == 100
    assert t.merge(frame([]), upsert, "none") and rows(t) == want
    gone = frame([(k, None, None) for k in range(100)])
    assert t.merge(gone, lambda old, new: old.join(new, "k", "left_anti"), "delete") and rows(t) == [(500, "b", 1)]
    assert t.clean(1) > 0 and rows(t) == [(500, "b", 1)] and t.clean(1) == 0
    assert not t.merge(gone, upsert, "one")  # still known


def test_merges_that_meet(spark, tmp_path):
    """Of two merges into one version one fails and can be run again."""
    t = MergedTable(spark, str(tmp_path), SCHEMA, ["k"], 4)

    def other(old, new):
        MergedTable(spark, str(tmp_path), SCHEMA, ["k"], 4).merge(spark.createDataFrame([(7, "other", 1)], SCHEMA), upsert, "other")
        return upsert(old, new)

    mine = spark.createDataFrame([(7, "mine", None)], SCHEMA)
    with pytest.raises(Exception):
        t.merge(mine, other, "mine")
    assert rows(t) == [(7, "other", 1)]
    assert t.merge(mine, upsert, "mine") and rows(t) == [(7, "mine", 1)]


def test_stream_is_merged_once(spark, tmp_path):
    feed, table = tmp_path / "feed", MergedTable(spark, str(tmp_path / "table"), SCHEMA, ["k"], 4)
    feed.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(feed))

    def added(old, new):
        both = old.unionByName(new).groupBy("k").agg(F.max("s").alias("s"), F.sum("n").alias("n"))
        return both

    for data in ([(1, "a", 1), (2, "a", 1), (1, "a", 1)], [(1, "b", 1)]):
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(feed))
        table.merge_stream(stream, added, str(tmp_path / "state"), "adds")
    assert rows(table) == [(1, "b", 3), (2, "a", 1)]
    # the last batch again, as if its commit had been lost
    last = max((tmp_path / "state" / "commits").iterdir(), key=lambda p: int(p.name) if p.name.isdigit() else -1)
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    table.merge_stream(stream, added, str(tmp_path / "state"), "adds")
    assert rows(table) == [(1, "b", 3), (2, "a", 1)]
