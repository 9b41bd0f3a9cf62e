"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from quillmesh.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([norm(x) for x in r]) for r in df.select(*names).collect())
    cur = duck.execute(catalog.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    assert got == sorted(repr([norm(r[cols.index(n)]) for n in names]) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_clusters_settle(spark):
    from quillmesh.operators import resolve, vectors

    rows = [(i, [float(c) * 3 + (i % 40) * 0.001, 0.0], c) for c in range(3) for i in range(c * 40, c * 40 + 40)] + [(500, [50.0, 50.0], 9)]
    v = spark.createDataFrame(rows, "id long, v array<double>, label int")
    labels = vectors.dbscan(v, "id", "v", 0.5, 30).collect()
    assert {r.id: r.cluster for r in labels} == {**{i: i // 40 * 40 for i in range(120)}, 500: -1}
    old = vectors.BLOCK
    try:
        vectors.BLOCK = 16
        assert vectors.range_join(v, "id", "v", 0.5).count() == 3 * 40 * 39 // 2
    finally:
        vectors.BLOCK = old
    loss = resolve.triplet_loss(resolve.triplets(v), v, 0.2)
    assert loss.where("loss < 0").count() == 0 and loss.count() > 0


@pytest.mark.parametrize("ring", [10_000, 3])
def test_each_anchor_has_a_triplet(spark, ring, monkeypatch):
    import hashlib

    from quillmesh.operators import resolve

    monkeypatch.setattr(resolve, "RING", ring)
    # one label holds most rows; 8 is alone, so it is no anchor; no label is no label
    rows = [(i, [float(i)], 1 if i < 95 else 2) for i in range(100)] + [(100, [0.0], 8), (101, [0.0], None)]
    label = {i: k for i, _, k in rows}
    got = resolve.triplets(spark.createDataFrame(rows, "id long, v array<double>, label int")).collect()
    assert sorted(r.id for r in got) == list(range(100))
    assert all(label[r.positive] == label[r.id] == r.label and r.positive != r.id and label[r.negative] not in (r.label, None) for r in got)
    if ring == 10_000:  # a single ring: the next of another label, around the end
        order = sorted((i for i, k in label.items() if k), key=lambda i: (hashlib.md5(f"{i}|7".encode()).hexdigest(), i))
        for r in got:
            at = order.index(r.id)
            assert r.negative == next(i for i in order[at + 1 :] + order[:at] if label[i] != r.label)
    alone = spark.createDataFrame([(1, [0.0], 1), (2, [1.0], 1)], "id long, v array<double>, label int")
    assert resolve.triplets(alone).count() == 0


def test_xor_search(spark):
    import re

    from quillmesh.operators import search

    def brute(content, needle, flags=0):
        return [(k, m.start()) for k in range(256) for m in re.finditer(b"(?=" + re.escape(needle) + b")", bytes(c ^ k for c in content), flags)]

    hidden = lambda k, t: bytes(c ^ k for c in t)
    rows = [(1, b"GET http://a http://b"), (2, b"\x00" * 9 + hidden(0x5A, b"x http://a.b/ HTTP://c") + b"\xff"), (3, b""), (4, None), (5, hidden(255, b"http://")), (6, bytes(range(256)) * 2), (7, b"aaaa")]
    d = spark.createDataFrame(rows, "i int, c binary")
    for needle in (b"http://", b"aa", b"\x01", b"aB"):
        for flags in (0, re.I):
            got = sorted((r.i, r.key, r.offset) for r in search.xor_search(d, "i", "c", needle, bool(flags)).collect())
            assert got == sorted((i, *h) for i, c in rows if c for h in brute(c, needle, flags))
    with pytest.raises(ValueError):
        search.xor_search(d, "i", "c", b"")
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if r.text]
    got = sorted(tuple(r) for r in catalog.QUERIES["xor_documents"](spark, SF).select("doc_id", "key", "offset").collect())
    assert got == sorted((r.doc_id, *h) for r in docs for h in brute(r.text.encode(), b"token"))


def test_conflicts_settle_by_element(spark):
    from quillmesh.operators import resolve

    # clusters: 0 conflict of 10 and 11, 1 known, 2 new, 3 unresolved, -1 noise; centroid 12 is nearest to all but not involved
    rows = [(1, 0, 0.0), (2, 0, 1.0), (3, 0, 4.0), (4, 0, 5.0), (5, 0, 2.5), (6, 1, 0.0), (7, 1, 9.0), (8, 2, 0.0), (9, 3, 0.0), (10, 3, 1.0), (11, -1, 0.0)]
    clustered = spark.createDataFrame([(i, c, [x, 0.0]) for i, c, x in rows], "id long, cluster long, v array<double>")
    anchors = spark.createDataFrame([(1, 10), (4, 11), (6, 12), (9, 10), (10, 13)], "id long, known long")
    campaigns = spark.createDataFrame([(10, 1), (11, 1), (12, 1), (13, 2)], "known long, campaign long")
    centers = spark.createDataFrame([(10, [0.0, 0.0]), (11, [5.0, 0.0]), (12, [2.0, 0.0]), (13, [9.0, 0.0])], "known long, centroid array<double>")
    got = {r.id: (r.cluster, r.verdict, r.known) for r in resolve.settle_clusters(clustered, anchors, campaigns, centers).collect()}
    conflict = {1: 10, 2: 10, 3: 11, 4: 11, 5: 10}
    assert got == {**{i: (0, "conflict", k) for i, k in conflict.items()}, 6: (1, "known", 12), 7: (1, "known", 12), 8: (2, "new", None), 9: (3, "unresolved", -1), 10: (3, "unresolved", -1), 11: (-1, "noise", -1)}
    whole = catalog.QUERIES["cluster_settle"](spark, "/root/testdata/sf0.01")
    assert whole.count() == spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").count()
    assert {r.verdict for r in whole.select("verdict").distinct().collect()} == {"noise", "new", "known", "conflict", "unresolved"}


def test_walk_goes_to_the_end(spark, monkeypatch):
    from quillmesh.operators import resolve, storage

    monkeypatch.setattr(storage, "cut", lambda df, name: df.coalesce(1).localCheckpoint())  # many short rounds
    chain = spark.range(102).selectExpr("id AS src", "(id + 1) % 102 AS dst").union(spark.createDataFrame([(200, 201)], "src long, dst long")).coalesce(1).localCheckpoint()
    got = resolve.reach(chain, spark.range(1).selectExpr("id AS node")).collect()
    assert {r.node: r.depth for r in got} == {n: n for n in range(102)}


def test_upserts(spark):
    from quillmesh.operators import relational as R

    old = spark.createDataFrame([(1, "a", None), (2, "b", 2)], "k int, s string, n int")
    new = spark.createDataFrame([(2, None, 3), (3, "c", 4)], "k int, s string, n int")
    assert sorted(R.upsert(old, new, ["k"]).collect()) == [(1, "a", None), (2, "b", 3), (3, "c", 4)]
    assert sorted(R.upsert(old, new, ["k"], prefer_new=False).collect()) == [(1, "a", None), (2, "b", 2), (3, "c", 4)]
    assert sorted(R.insert_missing(old, new.union(new), ["k"]).collect()) == [(1, "a", None), (2, "b", 2), (3, "c", 4)]


def test_late_events_fall_out(spark):
    from quillmesh.streaming import visits

    e = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/[e]vents.parquet").withColumn("ts", __import__("pyspark.sql.functions", fromlist=["col"]).col("ts").cast("timestamp"))
    q = visits.windowed_counts(e).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM counts").first().n == 1000
