"""What the third round of findings showed: larger keys and more rows than the small tables have."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.functions import text
from quillmesh.operators import resolve, storage, vectors
from quillmesh.plans import catalog
from quillmesh.sources import pdf_filters


def same(spark, path, name, table):
    """Whether a query's rows on a folder are those of its SQL."""
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    got = sorted(map(repr, map(tuple, catalog.QUERIES[name](spark, str(path)).collect())))
    return got == sorted(map(repr, c.execute(catalog.ORACLE_SQL[name]).fetchall()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_searches_do_not_broadcast_what_they_wrote(spark, monkeypatch):
    plans, cut = [], storage.cut
    monkeypatch.setattr(storage, "cut", lambda df, name: plans.append(plan(df)) or cut(df, name))
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(4)], "doc int, src int, dst int")
    starts = spark.createDataFrame([(0, 0)], "doc int, node int")
    assert resolve.ways(edges, starts, starts.withColumn("node", F.lit(4))).count() == 5
    assert resolve.reach(cut(edges.select("src", "dst"), "edges"), starts.select("node")).count() == 5
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_batch_clusters_of_groups_that_meet(spark, tmp_path):
    # all vectors are one, so only their numbers keep the groups apart
    v = spark.range(110).selectExpr("id AS vec_id", "array(cast(0.5 AS float), cast(0.5 AS float)) AS embedding", "cast(id % 3 AS int) AS label")
    v.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert same(spark, tmp_path, "batch_clusters", "embeddings")


def test_human_size_rounds_halves_to_even(spark):
    sizes = [0, 2304, 11520, 2816, 8096, 1023, 1 << 50, (1 << 50) * 5 // 4, 90_000 * 10**12, None]
    got = [r[0] for r in spark.createDataFrame([(None if n is None else float(n),) for n in sizes], "n double").select(text.human_size(F.col("n"))).collect()]
    assert got == ["0.0B", "2.2KB", "11.2KB", "2.8KB", "7.9KB", "1023.0B", "1.0PB", "1.2PB", f"{90_000 * 10**12 / 2**50:.1f}PB", None]


def test_script_unescape_of_large_keys(spark, tmp_path):
    c = spark.range(65_530, 65_560).union(spark.range(1_000_000, 1_000_006)).union(spark.range(3)).selectExpr("id AS c_custkey", "'name ' || id AS c_name")
    c.write.parquet(str(tmp_path / "customer.parquet"))
    assert same(spark, tmp_path, "script_unescape", "customer")


@pytest.mark.parametrize("ring", [1, 7, 90])
def test_rings_cut_into_arcs_are_one_ring(spark, ring, monkeypatch):
    monkeypatch.setattr(resolve, "RING", ring)
    label = {i: 0 if i < 80 else i % 4 for i in range(90)}
    got = resolve.triplets(spark.createDataFrame([(i, [float(i)], k) for i, k in label.items()], "id long, v array<double>, label int")).collect()
    order = sorted(label, key=lambda i: (hashlib.md5(f"{i}|7".encode()).hexdigest(), i))
    after = lambda i: order[order.index(i) + 1 :] + order[: order.index(i)]
    want = {i: (next(j for j in after(i) if label[j] == label[i]), next(j for j in after(i) if label[j] != label[i])) for i in order}
    assert {r.id: (r.positive, r.negative) for r in got} == want


def frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")


@pytest.mark.parametrize("eps", [0.5, 30.0])
def test_blocks_grow_with_the_rows(spark, eps, monkeypatch):
    for name, n in (("BLOCK", 5), ("BLOCKS", 4), ("TILE", 16), ("CHUNK", 7)):
        monkeypatch.setattr(vectors, name, n, raising=False)
    m = np.random.default_rng(4).normal(size=(200, 3))
    placed = vectors.in_cells(frame(spark, m), "id", "v", eps)
    cells = placed.select("cell").distinct().count()
    assert vectors.meetings(placed).count().count() <= (4 + cells) ** 2
    far = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    got = [(r.a, r.b) for r in vectors.range_join(frame(spark, m), "id", "v", eps).collect()]
    assert sorted(got) == [(i, j) for i in range(200) for j in range(i + 1, 200) if far[i, j] <= eps]


def test_near_pairs_far_from_the_origin(spark):
    # of products of such numbers the distances' digits would be lost
    m = 1e6 + np.arange(50)[:, None] * np.array([[1e-3, 0.0]])
    assert vectors.range_join(frame(spark, m), "id", "v", 1.5e-3).count() == 49


def test_clusters_without_pairs(spark, monkeypatch):
    for name, n in (("BLOCK", 20), ("BLOCKS", 3), ("TILE", 8), ("CHUNK", 5)):
        monkeypatch.setattr(vectors, name, n, raising=False)
    monkeypatch.setattr(vectors, "range_join", None)  # pairs would grow with the square of the rows
    m = np.random.default_rng(8).normal(size=(150, 2))
    near = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1)) <= 0.3
    core = near.sum(1) >= 6
    label = {i: i for i in np.flatnonzero(core)}
    for _ in label:
        label = {i: min(label[j] for j in np.flatnonzero(near[i] & core)) for i in label}
    want = {i: label[i] if core[i] else next((label[j] for j in np.flatnonzero(near[i] & core)), -1) for i in range(150)}
    got = vectors.dbscan(frame(spark, m), "id", "v", 0.3, 6).collect()
    assert {r.id: r.cluster for r in got} == want and {r.id for r in got if r.core} == set(np.flatnonzero(core))
    assert len(set(want.values())) > 2 and -1 in want.values()
    steps = resolve.ladder(frame(spark, m), [30.0, 0.3], 6, lambda x: x.select("cluster").distinct().count() > 1)
    assert {r.id: r.cluster for r in steps.collect()} == want


def test_a_dense_group_is_joined_in_little_memory():
    import tracemalloc

    m, k = np.zeros((3000, 64)), np.arange(3000)
    tracemalloc.start()
    assert sum(len(d) for _, _, d in vectors.near_pairs(k, m, 0, 1.0)) == 3000 * 2999 // 2
    assert tracemalloc.get_traced_memory()[1] < 400 << 20  # the differences of all pairs would be 2 GB
    tracemalloc.stop()


def test_stream_filters_take_a_step_a_code():
    text = b"several words, several more words, and words again. " * 4000
    for name in pdf_filters.ENCODERS:
        for data in (b"", b"a", b"\0" * 9, bytes(range(256)) * 20, text):
            assert pdf_filters.decode(pdf_filters.encode(data, [name]), [name], []) == (data, [])
    assert pdf_filters.ENCODERS["ASCII85Decode"](b"\0" * 4 + b"ab") == b"z@:B~>"
    codes = [256, *range(200), 257]  # a reader's width is 9 up to code 254
    bits = "".join(f"{c:09b}" for c in codes)
    want = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert pdf_filters.lzw_encode(bytes(range(200))) == want and pdf_filters.lzw(want) == bytes(range(200))


def test_what_a_vector_is_sent_to_does_not_grow(spark):
    def sent(n):
        placed = spark.range(n).selectExpr("id AS k", "array(cast(id % 97 AS double) / 97) AS v", "array(0L) AS cell")
        return vectors.meetings(placed).count().agg(F.sum("count")).first()[0] / n

    assert sent(9_000) == sent(36_000) == vectors.BLOCKS


@pytest.mark.parametrize("scale", [1.0, 1e-3, 3e4])
def test_distances_at_eps_are_told_exactly(scale):
    # beside an unrelated far row single precision can't tell the lattice's neighbours from eps
    m = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)] + [[300.0, 0, 0]]) * scale
    k = np.arange(len(m))
    want = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1)) <= scale
    x, y = vectors.finder(k, m, scale)(k, k)
    assert sorted(zip(x, y)) == sorted((i, j) for i, j in zip(*np.nonzero(want)) if i != j)


def test_pairs_of_a_dense_group_take_little_more_memory_than_a_tile():
    import tracemalloc

    m = np.random.default_rng(3).normal(size=(4000, 64)) * 1e-3
    tracemalloc.start()
    assert sum(len(d) for _, _, d in vectors.near_pairs(np.arange(4000), m, 0, 1.0)) == 4000 * 3999 // 2
    assert tracemalloc.get_traced_memory()[1] < 96 << 20
    tracemalloc.stop()
