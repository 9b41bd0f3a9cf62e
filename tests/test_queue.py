"""The queue, labels of JSON and counters of streams."""

import json

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import variants
from quillmesh.sources.queue import StreamQueue
from quillmesh.streaming import visits as S


def test_queue(spark, tmp_path):
    q = StreamQueue(spark, str(tmp_path), "url string, prio int", ["url"], 4)
    frame = lambda rows: spark.createDataFrame(rows, "url string, prio int")
    assert q.waiting().count() == 0
    assert q.push(frame([("a", 1), ("b", 2), ("a", 0)]), "one") and not q.push(frame([("a", 1)]), "one")
    take = lambda: sorted((r.url, r.prio, r.since) for r in S.drained(spark, q.stream(1), str(tmp_path / "worker")).collect())
    assert take() == [("a", 0, "one"), ("b", 2, "one")]
    q.push(frame([("b", 9), ("c", 3)]), "two")
    q.push(frame([]), "three")
    # a run that died before it had published
    publish, q.publish = q.publish, lambda run: (_ for _ in ()).throw(OSError("died"))
    with pytest.raises(OSError):
        q.push(frame([("d", 4)]), "four")
    assert take() == [("a", 0, "one"), ("b", 2, "one"), ("c", 3, "two")]
    q.publish = publish
    assert not q.push(frame([("d", 4)]), "four")
    assert take() == take() == [("a", 0, "one"), ("b", 2, "one"), ("c", 3, "two"), ("d", 4, "four")]
    assert q.finish(frame([("a", None), ("x", None)]), "w1") and sorted(r.url for r in q.waiting().collect()) == ["b", "c", "d"]
    q.push(frame([("a", 5)]), "five")  # done items don't come back
    assert sorted(r.url for r in q.waiting().collect()) == ["b", "c", "d"]


def flat(v, path=""):
    if isinstance(v, dict):
        return [x for k, item in v.items() for x in flat(item, f"{path}.{k}" if path else k)]
    if isinstance(v, list):
        return [x for item in v for x in flat(item, path + "[]")]
    return [(path, None if v is None else {True: "true", False: "false"}.get(v, str(v)) if isinstance(v, bool) else str(v))]


def test_labels(spark):
    texts = ['{"CMS": "WordPress 5.8.1", "apps": [{"name": "a", "n": [1, [2, 3]]}, {"name": null}], "ok": true}', '{"new label": {"x": {"y": 1.5}}}', "{}", "[]", "[1, [2]]", "5", '{"broken": ', "no json", "", None]
    d = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "id int, body string, path string").drop("path")
    got = sorted(((r.id, r.path, r.value) for r in variants.labels(d, "body", ["id"]).collect()), key=repr)
    want = []
    for i, t in enumerate(texts):
        try:
            v = json.loads(t)
        except (TypeError, ValueError):
            continue
        want += [(i, p, x) for p, x in flat(v)] if isinstance(v, (dict, list)) else []
    assert got == sorted(want, key=repr)
    deep = variants.labels(spark.createDataFrame([(1, '{"a": {"b": {"c": 1}}}')], "id int, body string"), "body", ["id"], 2).collect()
    assert [(r.path, r.value) for r in deep] == [("a.b", '{"c":1}')]
    assert "new label" in variants.shape(d.where("id < 2"), "body") and variants.shape(d, "body") == "VARIANT" and variants.shape(d.where("id = 9"), "body") in (None, "VOID")


def test_counters(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    stream = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(str(feed))
    for n in (3, 4):
        spark.range(n).selectExpr("id AS k").coalesce(1).write.mode("append").parquet(str(feed))
    rows, counters = S.metered(spark, stream, {"n": F.count("*"), "odd": F.count_if(F.col("k") % 2 == 1)}, str(tmp_path / "at"))
    assert rows.count() == 7 and sorted((c["n"], c["odd"]) for c in counters) == [(3, 1), (4, 2)]
    assert S.metered(spark, stream, {"n": F.count("*")}, str(tmp_path / "at"))[1] == []
