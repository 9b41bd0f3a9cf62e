"""Archives, lists and folders written here, read as tables."""

import gzip
import io
import zipfile

import pandas as pd

from quillmesh.functions import unpack
from quillmesh.operators import resolve
from quillmesh.sources import files


def packed(**content):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in content.items():
            z.writestr(name.replace("_", "."), data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    inner = packed(body_txt="inside", x_json_gz=gzip.compress(b"{}"))
    (tmp_path / "a.zip").write_bytes(packed(job_json='{"url": 1}', bodies_zip=inner, broken_gz=b"no"))
    (tmp_path / "b.zip").write_bytes(b"damaged")
    (tmp_path / "c.zip").write_bytes(packed())
    got = {(r.path.rsplit("/")[-1], r.member): (r.body, r.error is None) for r in files.archives(spark, str(tmp_path)).collect()}
    assert got == {
        ("a.zip", "job.json"): ('{"url": 1}', True),
        ("a.zip", "bodies.zip/body.txt"): ("inside", True),
        ("a.zip", "bodies.zip/x.json"): ("{}", True),
        ("a.zip", "broken.gz"): (None, False),
        ("b.zip", ""): (None, False),
    }


def test_nested_too_deep():
    data = packed(x_txt="x")
    for _ in range(6):
        data = packed(in_zip=data)
    assert [(b, e) for _, b, e in files.members("", data)] == [("x", None)]
    assert [e for _, _, e in files.members("", data, 6)] == ["nested too deep"] and [b for _, b, _ in files.members("", data, 7)] == ["x"]


def test_lists_and_folders(spark, tmp_path):
    (tmp_path / "list.txt").write_text("// note\n com \n*.ck\n\ncom\n// xn--p1ai (x) : RU\n")
    assert {(r.suffix, r.kind) for r in files.public_suffixes(spark, str(tmp_path / "list.txt")).collect()} == {("com", "exact"), ("ck", "wildcard"), ("xn--p1ai", "punycode")}
    for name in ("benign/news/1.pdf", "malicious/seo/2.pdf", "rest/3.pdf"):
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_bytes(b"12")
    assert {(r.category, r.label, r.size) for r in files.labelled(spark, str(tmp_path)).collect()} == {("news", 0, 2), ("seo", 1, 2), ("rest", -1, 2)}


def test_prefer_and_report(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, None)], "k int, body string")
    b = spark.createDataFrame([(1, "y"), (2, "z"), (9, "w")], "k int, body string")
    got = files.prefer(a, b, ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (2, "z"), (3, None)]
    assert [r.value for r in files.report(got.where("k = 1")).collect()] == ['{"k":1,"body":"x"}']
    assert "<body>x</body>" in files.report(got.where("k = 1"), "xml").first().value


def test_triplet_rules():
    f = pd.DataFrame({"id": [4, 1, 2, 3], "v": [[0.3, 0.0], [0.0, 0.0], [0.1, 0.0], [5.0, 0.0]], "label": [1, 0, 0, 1]})
    rows = lambda rule: {(r.anchor, r.positive, r.negative): round(r.loss, 3) for r in resolve.choose_triplets(f, 0.2, rule).dropna().itertuples()}
    # pair (1, 2): losses 0.01 - 0.09 + 0.2 and 0.01 - 25 + 0.2; pair (3, 4): 22.09 - 25 + 0.2 and 22.09 - 24.01 + 0.2
    assert rows("hardest") == rows("all") == rows("semihard") == rows("random") == {(1, 2, 4): 0.12}
    counted = resolve.choose_triplets(f, 0.2, "hardest")
    assert (counted.losses.sum(), counted.negatives.sum()) == (4, 3)
    assert resolve.choose_triplets(f[f.label == 0], 0.2, "all").empty


def test_unpack(spark):
    packed_script = "eval(function(p,a,c,k,e,d){while(c--){p=p.replace(c,k[c])}return p}('0 1=\\'2\\';3(1)',62,4,'var|x|hi|alert'.split('|'),0,{}))"
    assert unpack.unpacked(packed_script) == "var x='hi';alert(x)"
    assert unpack.unpacked("var%20a%3D1") == "var a=1"
    assert [unpack.unpacked(x) for x in (None, "", "plain", "eval(function(p,a,c,k,e,d){}('0',99,1,'a'.split('|'))")] == [None, "", "plain", "eval(function(p,a,c,k,e,d){}('0',99,1,'a'.split('|'))"]
    assert [unpack.number(x, b) for x, b in (("10", 36), ("Z", 62), ("Z", 36))] == [36, 61, None]
    d = spark.createDataFrame([(1, packed_script), (2, None)], "id int, s string")
    assert {r.id: tuple(r.s) for r in d.select("id", unpack.unpack(d.s).alias("s")).collect()} == {1: ("var x='hi';alert(x)", True), 2: (None, True)}
    assert [tuple(r.s) for r in d.where("id = 1").select(unpack.unpack(d.s, 0).alias("s")).collect()] == [(packed_script, False)]


def test_urls_in_scripts():
    from quillmesh.functions import scripts

    wide = lambda t: "".join(f"%u{ord(b):02x}{ord(a):02X}" for a, b in zip(t[::2], t[1::2]))
    fill, url = "%u9090" * 30, "https://a.org/x.exe?1"
    url += "" if len(url) % 2 == 0 else "2"
    assert scripts.found(f'var s = unescape("{fill}{wide(url)}"); t=unescape("{wide(url)}")') == [url]
    assert scripts.found(f"x='{fill}', y = \"{wide(url)}\"; s = unescape(x\n+ y); r=unescape(x+y)") == [url]
    assert scripts.found("a = a + b; s = unescape(a)") == scripts.found(None) == scripts.found("") == []
    assert scripts.plain_bytes("%41b%zz") == b"A\0b\0%\0z\0z\0" and scripts.plain_bytes("plain") == b"plain"


def test_rings_are_dealt(spark):
    v = spark.range(400).selectExpr("id", "array(cast(id as double)) AS v", "cast(id % 2 as int) AS label")
    old = resolve.RING
    try:
        resolve.RING = 40
        got = resolve.triplets(v).collect()
    finally:
        resolve.RING = old
    assert len(got) > 360 and all(r.id % 2 == r.positive % 2 != r.negative % 2 and r.id != r.positive for r in got)


def test_sinks(spark, tmp_path):
    from quillmesh.sources import sinks

    d = spark.range(5).selectExpr("id", "md5(cast(id AS string)) AS url_hash", "cast('x' AS binary) AS content")
    for _ in range(2):
        sinks.append(d, str(tmp_path / "added"))
        sinks.dated(d, str(tmp_path / "copies"), "2024-01-15")
    sinks.dated(d, str(tmp_path / "copies"), "2024-01-16")
    assert spark.read.parquet(str(tmp_path / "added")).count() == 10 and spark.read.parquet(str(tmp_path / "copies")).count() == 10
    sinks.bodies(d, str(tmp_path / "bodies"))
    sinks.bodies(d.limit(2), str(tmp_path / "bodies"), rescan=True)
    got = spark.read.parquet(str(tmp_path / "bodies"))
    assert got.where("rescan = 1").count() == 2 and got.where("rescan = 0 and path = concat_ws('/', substr(url_hash, 1, 2), substr(url_hash, 3, 2), substr(url_hash, 5, 2), substr(url_hash, 7, 2), '')").count() == 5
    objects = spark.createDataFrame([("a", 0, 1, [2, 3]), ("a", 1, 2, [])], "path string, version int, id int, refs array<int>")
    sinks.dump(objects, str(tmp_path / "dump"))
    assert sorted((r.version, r.src, r.dst) for r in spark.read.parquet(str(tmp_path / "dump" / "references")).collect()) == [(0, 1, 2), (0, 1, 3)]


def test_queue(spark, tmp_path):
    from quillmesh.sources import sinks

    q = sinks.Queue(spark, str(tmp_path / "queue"), "url string, first boolean", ["url"])
    items = spark.createDataFrame([("a", True), ("b", False), ("b", False), ("c", True)], "url string, first boolean")
    assert q.count() == 0
    q.push(items)
    q.push(items)
    assert q.count() == 3
    shares = [{r.url for r in q.take(2, k).collect()} for k in range(2)]
    assert shares[0] | shares[1] == {"a", "b", "c"} and not shares[0] & shares[1]
    q.done(items.where("url = 'b'"))
    assert {r.url for r in q.waiting().collect()} == {"a", "c"}
    q.clean()
    assert q.count() == 0


def test_saving_and_polling(spark, tmp_path):
    from quillmesh.sources import sinks

    d, calls = spark.range(3), []

    def broken(df, times):
        calls.append(1)
        if len(calls) <= times:
            raise OSError("no space")
        df.write.parquet(str(tmp_path / "good"))

    assert sinks.save(d, lambda df: broken(df, 2), str(tmp_path / "aside")) and len(calls) == 3
    calls.clear()
    assert not sinks.save(d, lambda df: broken(df, 9), str(tmp_path / "aside")) and len(calls) == 3
    assert {r.error for r in spark.read.parquet(str(tmp_path / "aside")).collect()} == {"no space"}
    found, waits = iter([2, 0, 0, 3, 0, 0, 0]), []
    assert sinks.poll(lambda: next(found), sleep=waits.append) == 5 and waits == [2, 4, 2, 4]


def test_two_passes(spark):
    from pyspark.sql import functions as F

    from quillmesh.sources import sinks

    direct = spark.createDataFrame([(1, "x"), (2, None), (3, None)], "k int, r string")
    again = spark.createDataFrame([(1, "no"), (2, "y")], "k int, r string")
    assert sorted(map(tuple, sinks.two_pass(direct, again, ["k"], F.col("r").isNotNull()).collect()), key=str) == [(1, "x"), (2, "y"), (3, None)]


def test_jdbc(spark, tmp_path):
    from quillmesh.sources import sinks

    url = f"jdbc:derby:{tmp_path}/base;create=true"
    d = spark.range(100).selectExpr("id AS k", "concat('v', id) AS v")
    sinks.write_jdbc(d, url, "things", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    sinks.write_jdbc(d.limit(1), url, "things", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    got = sinks.read_jdbc(spark, url, "things", "k", parts=4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert got.rdd.getNumPartitions() == 4 and got.count() == 101 and got.selectExpr("sum(k)").first()[0] == 4950
    assert sinks.read_jdbc(spark, url, "things", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").count() == 101
