"""Numbers, splits, updates, attempts and conversions against plain versions."""

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.functions import convert as K
from quillmesh.operators import relational as R
from quillmesh.operators import vectors as V
from quillmesh.sources import pdf_filters


@pytest.mark.parametrize("n, parts", [(0, 3), (1, 3), (100, 7), (23, 40)])
def test_numbers_and_parts(spark, n, parts):
    d = spark.range(n).select(F.col("id"), (F.col("id") * 37 % 101).alias("o"), F.lit(1).alias("_id"))
    rows, total = R.numbered(d.repartition(5), ["o", "id"], parts=6)
    got = sorted((r.o, r.id, r.row) for r in rows.collect())
    assert total == n and [x[2] for x in got] == list(range(n))
    cut = [r.part for r in rows.select("row", R.near_equal(F.col("row"), total, parts).alias("part")).orderBy("row").collect()]
    want = [k + 1 for k in range(parts) for _ in range(n // parts + (k < n % parts))]
    assert cut == want


def test_splits(spark):
    rows = [(i, "a") for i in range(60)] + [(100 + i, "b") for i in range(5)] + [(200, None)]
    got = {r.id: r.split for r in R.split_by_class(spark.createDataFrame(rows, "id long, k string"), "k", [F.col("id")], 20, 10, 40).collect()}
    assert got == {i: "train" if i < 20 else "val" if i < 30 else "test" for i, _ in rows}


def test_updates(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, None, 3)], "k int, v string, w int")
    v = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, v string")
    assert sorted(map(tuple, R.update_from(t, v, ["k"], ["v"]).collect())) == [(1, "a", 1), (2, "y", 2), (3, None, 3)]
    assert sorted(map(tuple, R.update_from(t, v, ["k"], ["v"], only_null=False).collect())) == [(1, "x", 1), (2, "y", 2), (3, None, 3)]
    assert sorted(r.id for r in R.new_ids(t.select("k"), spark.createDataFrame([(7,)], "id long"), "id", ["k"]).collect()) == [8, 9, 10]
    assert sorted(r.id for r in R.new_ids(t.select("k"), spark.createDataFrame([], "id long"), "id", ["k"]).collect()) == [1, 2, 3]


def test_attempts(spark):
    r = random.Random(4)
    rows = [(k, m * 60, r.random() < 0.7) for k in range(40) for m in sorted(r.sample(range(60), r.randint(1, 12)))]
    d = spark.createDataFrame(rows, "k int, s long, failed boolean").select("k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("at"), "failed")
    want = {}
    for k in range(40):
        last, attempts, ok = None, 0, False
        for _, s, failed in (x for x in rows if x[0] == k):
            if not ok and attempts < 3 and (last is None or s >= last + 600):
                last, attempts, ok = s, attempts + 1, not failed
        want[k] = (attempts, ok)
    assert {x.k: (x.attempts, x.reached) for x in R.spaced_attempts(d, "k", "at", F.col("failed"), wait="10 minutes").collect()} == want


def test_axes(spark):
    r = np.random.default_rng(1)
    m = r.normal(size=(300, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + 4
    d = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "i int, v array<double>").repartition(3)
    mean, axes = V.principal_axes(d, "v")
    u = np.linalg.svd(m - m.mean(0))[2][:2]
    assert np.allclose(mean, m.mean(0)) and np.allclose(np.abs(axes @ u.T), np.eye(2), atol=1e-6)
    got = np.array([[x.x, x.y] for x in V.projected(d, "v", mean, axes).orderBy("i").collect()])
    assert np.allclose(got, (m - mean) @ axes.T)


def column(spark, values, kind, expression):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in d.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_conversions(spark):
    assert column(spark, ["a.b(c)\\d", "", None], "string", K.regex_escape) == ["a\\.b\\(c\\)\\\\d", "", None]
    assert column(spark, ["a\tbé", "", None], "string", K.non_printable) == [2, 0, None]
    assert [[(x.value, x.n) for x in r] for r in column(spark, [[3, 1, 3], []], "array<int>", K.element_counts)] == [[(3, 2), (1, 1)], []]
    names = ["/A B", "Name1", "/é"]
    coded = column(spark, names, "string", K.name_encode)
    assert coded == ["/#41#20#42", "/#4e#61#6d#65#31", "/#e9"] and column(spark, coded, "string", K.name_decode) == ["/A B", "/Name1", "/é"]
    assert column(spark, ["a(b)", "\\101 \\x", "a\\(b", "x\n\t", None], "string", K.string_escape) == ["a\\(b\\)", "\\101 \\\\x", "a\\\\(b", "x\\n\\t", None]
    plain = ["Ab é", "", None]
    octal = column(spark, plain, "string", K.octal_encode)
    assert octal == ["\\101\\142\\040\\351", "", None] and column(spark, octal, "string", K.octal_decode) == plain
    assert column(spark, [5, 255, 256, None], "long", K.bits) == ["00000101", "11111111", None, None]
    data = [bytes(range(7)), b"", None]
    digits = column(spark, data, "binary", K.bits_of)
    assert digits[0] == "".join(f"{b:08b}" for b in range(7)) and digits[1:] == ["", None]
    assert [x and bytes(x) for x in column(spark, digits[:1], "string", K.bytes_of)] == [data[0]]
    assert column(spark, [b"\x12\x34\x56"], "binary", lambda c: K.numbers(c, 12)) == [[0x123, 0x456]]
    assert [x and bytes(x) for x in column(spark, [258, 70000], "long", lambda c: K.number_hex(c, 2))] == [b"\x01\x02", None]
    assert column(spark, [42, 12345], "long", lambda c: K.number_text(c, 4)) == ["0042", None]


def test_merged_maps(spark):
    d = spark.createDataFrame([({"a": "1"}, {"b": "2", "a": "1"})], "x map<string,string>, y map<string,string>")
    assert d.select(K.merge_maps(F.col("x"), F.col("y")).alias("m")).first().m == {"a": "1", "b": "2"}
    with pytest.raises(Exception, match="Conflict at a"):
        d.select(K.merge_maps(F.col("x"), F.map_concat(F.map_filter("y", lambda k, v: k != "a"), F.create_map(F.lit("a"), F.lit("9")))).alias("m")).collect()


def test_encoders():
    r = random.Random(1)
    for data in (b"", b"a", b"aaaa", bytes(range(256)) * 40, r.randbytes(20_000), b"the quick brown " * 5000, bytes(300) + b"ab" * 3000):
        for name in pdf_filters.ENCODERS:
            assert pdf_filters.decode(pdf_filters.encode(data, [name]), [name], []) == (data, [])
        both = ["ASCII85Decode", "LZWDecode"]
        assert pdf_filters.decode(pdf_filters.encode(data, both), both, []) == (data, [])
        for mode in (0, 1, 2):
            assert pdf_filters.predicted(pdf_filters.predict(data, 7, mode), {"Predictor": 10 + mode, "Columns": 7}) == data
    assert pdf_filters.encode(b"x", ["ASCII85Decode"]) == base64.a85encode(b"x") + b"~>"
    with pytest.raises(ValueError):
        pdf_filters.encode(b"x", ["Nope"])


@pytest.mark.parametrize("block", [2048, 5])
def test_range_join(spark, monkeypatch, block):
    """Blobs far apart, a line across many cells, repeated vectors and a null, with cells of several blocks."""
    monkeypatch.setattr(V, "BLOCK", block)
    r = np.random.default_rng(3)
    m = np.concatenate([r.normal(c, 0.05, (25, 4)) for c in (0, 3, -5)] + [np.linspace(-8, 8, 40)[:, None] * np.array([1, 0.5, 0, 0]), np.zeros((3, 4))])
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(m)] + [(999, None)]
    d = spark.createDataFrame(rows, "id int, v array<double>")
    for eps in (0.1, 0.5, 30.0):
        far = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
        want = {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if far[i, j] <= eps}
        got = V.range_join(d, "id", "v", eps).collect()
        assert len(got) == len(want) and {(x.a, x.b) for x in got} == want
    assert V.range_join(d.limit(0), "id", "v", 1.0).count() == 0


def test_nearest_centers(spark, monkeypatch):
    r = np.random.default_rng(5)
    v, c = r.normal(size=(60, 3)), r.normal(size=(23, 3))
    c[7] = c[3]  # equal centers
    rows = lambda m: [(i, [float(x) for x in row]) for i, row in enumerate(m)]
    d, centers = spark.createDataFrame(rows(v), "k int, v array<double>"), spark.createDataFrame(rows(c), "i int, c array<double>")
    far = np.sqrt(((v[:, None] - c[None]) ** 2).sum(-1))
    for block in (256, 4):
        monkeypatch.setattr(V, "CENTERS", block)
        got = {x.k: x for x in V.nearest(d, "k", "v", centers, "i", "c").collect()}
        assert {k: x.nearest for k, x in got.items()} == dict(enumerate(far.argmin(1)))
        assert all(abs(x.distance - far[k].min()) < 1e-9 for k, x in got.items())
