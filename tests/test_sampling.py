"""Samples, batches, near pairs, clusters by batches and ways through graphs against brute force."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import incremental, lsh, resolve, sampling, vectors


def test_weighted_samples(spark):
    rows = [("g", i, 1.0 + 9 * (i % 2)) for i in range(400)] + [("h", 1000, 1.0), ("h", 1001, None), ("h", 1002, 0.0), ("h", None, 1.0)]
    d = spark.createDataFrame(rows, "label string, key long, w double")
    hits = collections.Counter()
    for seed in range(12):
        got = sampling.weighted_sample(d, ["label"], "key", "w", 40, str(seed)).collect()
        assert collections.Counter(r.label for r in got) == {"g": 40, "h": 1} and len({r.key for r in got}) == 41
        hits.update(r.key % 2 for r in got if r.label == "g")
    assert 6 < hits[1] / hits[0] < 14  # ten times as likely
    again = sampling.weighted_sample(d.repartition(7), ["label"], "key", "w", 40, "3").select("key").collect()
    assert sorted(again) == sorted(sampling.weighted_sample(d, ["label"], "key", "w", 40, "3").select("key").collect())


def test_balanced_batches(spark):
    rows = [("hot", i) for i in range(300)] + [(f"c{i % 9}", 1000 + i) for i in range(90)] + [("tiny", 5000), (None, 1), ("hot", None)]
    got = sampling.balanced_batches(spark.createDataFrame(rows, "kind string, id long"), "kind", "id", 4, 16).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.batch].append(r)
    assert sorted(by) == list(range(391 // 16))
    for batch in by.values():
        assert sorted(r.slot for r in batch) == list(range(16))
        counts = collections.Counter(r.label for r in batch)
        assert len(counts) == 4 and set(counts.values()) == {4}
        assert all(len({r.key for r in batch if r.label == label}) == (1 if label == "tiny" else 4) for label in counts)
    assert len({r.label for r in got}) == 11  # none is left out of an epoch of this length
    assert all((r.label, r.key) in set(rows) for r in got)
    with pytest.raises(ValueError):
        sampling.balanced_batches(spark.createDataFrame(rows, "kind string, id long"), "kind", "id", 40, 80)


def blobs(rng, sizes, dims=12, spread=0.02):
    rows, at = [], 0
    for c, n in enumerate(sizes):
        center = rng.normal(size=dims) * 3
        rows += [(at + i, (center + rng.normal(size=dims) * spread).tolist(), c) for i in range(n)]
        at += n
    return rows


def test_lsh_finds_near_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = blobs(rng, [1] * 600 + [40] * 10, spread=0.1)
    m = np.array([v for _, v, _ in rows])
    d2 = ((m[:, None] - m[None]) ** 2).sum(-1)
    eps = 0.6
    want = {(a, b) for a, b in zip(*np.nonzero(d2 <= eps * eps)) if a < b}
    d = spark.createDataFrame(rows, "id long, vec array<double>, t int").repartition(3)
    for block in (2048, 8):
        monkeypatch.setattr(lsh, "BLOCK", block)
        got = lsh.lsh_join(d, "id", "vec", eps, recall=0.95)
        found = [(r.a, r.b) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) <= want and len(found) >= 0.9 * len(want)
    assert abs(lsh.same_cell(4.0) - 0.8) < 0.01 and lsh.tables_for(0.95) == 10
    assert lsh.lsh_join(d.limit(0), "id", "vec", eps).count() == 0
    # of all pairs of vectors, less than a tenth is looked at
    seen = []
    cut = lsh.cut
    monkeypatch.setattr(lsh, "cut", lambda df, name: seen.append((name, out := cut(df, name))) or out)
    lsh.lsh_join(d, "id", "vec", eps, recall=0.95)
    hashed = next(df for name, df in seen if name == "hashed")
    sizes = hashed.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").count().where("count > 1").collect()
    tables = lsh.tables_for(0.95)
    assert sum(r["count"] * (r["count"] - 1) / 2 for r in sizes) / tables < 0.1 * len(rows) * (len(rows) - 1) / 2


def test_clusters_by_batches(spark):
    rng = np.random.default_rng(6)
    rows = blobs(rng, [60, 45, 30, 1, 1, 9])
    d = spark.createDataFrame(rows, "id long, vec array<double>, t int")
    whole = {r.id: r.cluster for r in vectors.dbscan(d, "id", "vec", 0.5, 8).collect()}
    got = {r.id: r.cluster for r in incremental.batch_clusters(d, "id", "vec", 0.5, 8, batch=50).collect()}
    # nine vectors over three batches are noise at first, and come in later
    assert got == whole and len(set(got.values())) == 5 and sum(c == -1 for c in got.values()) == 2
    stopped = incremental.batch_clusters(d, "id", "vec", 0.5, 8, batch=50, enough=lambda new, noise: True).collect()
    assert 0 < len(stopped) <= 50
    assert incremental.batch_clusters(d.limit(0), "id", "vec", 0.5, 8).count() == 0


def test_clusters_that_meet_are_one(spark):
    # two ends first, the bridge between them in a later batch
    line = [(i, [float(i) * 0.3], 0) for i in range(40)]
    d = spark.createDataFrame(line, "id long, vec array<double>, t int")
    got = {r.id: r.cluster for r in incremental.batch_clusters(d, "id", "vec", 0.7, 3, batch=14, anchors=20).collect()}
    assert set(got.values()) == {0}


def brute_ways(edges, starts):
    out = {(d, n): (n,) for d, n in starts}
    front = dict(out)
    while front:
        step = {}
        for (d, n), way in front.items():
            for e, s, t in edges:
                if (e, s) == (d, n) and (d, t) not in out:
                    step[d, t] = min(step.get((d, t), (1 << 60,)), way + (t,))
        out |= step
        front = step
    return out


def test_ways(spark, monkeypatch):
    rng = np.random.default_rng(9)
    edges = [(g, int(a), int(b)) for g in range(3) for a, b in rng.integers(0, 25, (60, 2))] + [(9, 0, i) for i in range(1, 50)] + [(9, i, i + 100) for i in range(1, 50)] + [(7, i, i + 1) for i in range(12)]
    starts = [(0, 1), (0, 2), (1, 0), (9, 0), (7, 0), (8, 5)]
    e = spark.createDataFrame([*edges, (1, None, 2), (None, 1, 2)], "doc int, src int, dst int")
    s = spark.createDataFrame([*starts, (None, 1)], "doc int, node int")
    got = {(r.doc, r.node): tuple(r.way) for r in resolve.ways(e, s).collect()}
    want = brute_ways(edges, starts)
    assert got == want
    goals = spark.createDataFrame([(9, 3), (7, 2), (7, 4)], "doc int, node int")
    some = {(r.doc, r.node): r.depth for r in resolve.ways(e, s, goals).collect()}
    assert some[9, 3] == 1 and some[7, 4] == 4 and (7, 6) not in some and (9, 101) not in some


def test_nearest_of_many_centers(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CENTERS", 4)
    monkeypatch.setattr(vectors, "TOGETHER", 3)
    rng = np.random.default_rng(1)
    centers, points = rng.normal(size=(50, 3)), rng.normal(size=(80, 3))
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(centers)], "cid long, c array<double>")
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "id long, v array<double>")
    got = vectors.nearest(p, "id", "v", c, "cid", "c")
    d = np.sqrt(((points[:, None] - centers[None]) ** 2).sum(-1))
    assert {r.id: r.nearest for r in got.collect()} == dict(enumerate(d.argmin(axis=1).tolist()))
    assert "Cartesian" not in (plan := got._jdf.queryExecution().toString()) and "NestedLoop" not in plan
