"""Hosts, addresses and character references against the standard library."""

import html
import ipaddress

from pyspark.sql import functions as F

from quillmesh.functions import url as U
from quillmesh.operators import hosts as H
from quillmesh.operators import sizes


def column(spark, values, expression):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in d.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_addresses(spark):
    values = ["1.2.3.4", "256.1.1.1", "1.2.3", "01.2.3.4", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1::2::3", "fe80::1%eth0", ":1", "1:", "g::1", "12345::", "2001:DB8::a", "host", "", "::1.2.3.400", "1:2:3:4:5:6:7::"]

    def known(v):
        try:
            return bool(ipaddress.ip_address(v)) or True
        except ValueError:
            return False

    assert column(spark, values, U.is_ip) == [known(v) and "%" not in v for v in values]


def test_references(spark):
    values = ["a&amp;b", "&lt;p&gt; &quot;x&quot; &apos;y&apos;", "&#65;&#x42;&#X43;", "&#8364; &#x1F600;", "&amp;lt;", "&unknown; &", "plain", None, "", "a&nbsp;b", "&#55296;x", "&#38;amp;", "x&#228;y&#xe4;z"]
    got = column(spark, values, U.unescape)
    assert got[:10] == [v if v is None else html.unescape(v) for v in values[:10]]
    assert got[10] == "&#55296;x" and got[12] == "xäyäz"


def test_hrefs(spark):
    page = "<a href='/one'>1</a><A class=x HREF=/two?a=1&amp;b=2>2</A><a href = \"/three 3\">3</a><abbr href='no'><a name=x>"
    assert column(spark, [page, None, ""], U.hrefs) == [["/one", "/two?a=1&b=2", "/three 3"], None, []]


def test_punycode_hosts(spark):
    values = ["xn--mnchen-3ya.de", "a.xn--p1ai", "plain.org", None, "xn--\x80.de", "XN--MNCHEN-3YA.de", "münchen.de", "a.рф", ""]
    assert column(spark, values, H.unicode_host) == ["münchen.de", "a.рф", "plain.org", None, "xn--\x80.de", "MüNCHEN.de", "münchen.de", "a.рф", ""]
    assert column(spark, values[6:], H.ascii_host) == ["xn--mnchen-3ya.de", "a.xn--p1ai", ""]


def test_suffixes(spark):
    rules = spark.createDataFrame([("com", "exact"), ("ck", "wildcard"), ("www.ck", "exception"), ("co.uk", "exact"), ("xn--p1ai", "punycode"), ("", "exact"), (None, "exact")], "suffix string, kind string")
    hosts = spark.createDataFrame([(h, 1, "x") for h in ("a.b.com", "com", "a.b.ck", "b.ck", "ck", "www.ck", "a.www.ck", "x.co.uk", "uk", "a.xn--p1ai", "", None)], "h string, suffix_of int, _n string")
    got = {r.h: (r.suffix, r.registered) for r in H.with_suffix(hosts, "h", rules).collect()}
    assert got == {"a.b.com": ("com", "b.com"), "com": ("com", None), "a.b.ck": ("b.ck", "a.b.ck"), "b.ck": ("b.ck", None), "ck": (None, None), "www.ck": ("ck", "www.ck"), "a.www.ck": ("ck", "www.ck"), "x.co.uk": ("co.uk", "x.co.uk"), "uk": (None, None), "a.xn--p1ai": ("xn--p1ai", "a.xn--p1ai"), "": (None, None), None: (None, None)}
    assert H.with_suffix(hosts, "h", rules.limit(0)).where("suffix IS NOT NULL").count() == 0


def test_names_in_hosts(spark):
    d = spark.createDataFrame([(1, "a.free.host.org"), (2, "plain.net"), (3, None)], "i int, h string")
    names = spark.createDataFrame([(2, "free."), (1, "host.org")], "o int, n string")
    assert {r.i: r.p for r in H.first_contained(d, "h", names, "n", "o", "p").collect()} == {1: "host.org", 2: None, 3: None}
    assert {r.i for r in H.without_any(d, "h", names, "n").collect()} == {2, 3}
    assert {r.i for r in H.within_none(d, "h", names.withColumn("n", F.lit("x.plain.net")), "n").collect()} == {1, 3}
    assert {r.i for r in H.without_any(d, "h", names.limit(0), "n").collect()} == {1, 2, 3}
    assert {r.i for r in H.without_any(d, "h", spark.createDataFrame([("",)], "n string"), "n").collect()} == {3}


def test_occurrences_of_any_size(spark):
    import random

    r = random.Random(2)
    word = lambda a, b: "".join(r.choice("abcü.") for _ in range(r.randint(a, b)))
    texts = [(i, word(0, 40) if i % 7 else None) for i in range(300)] + [(1000, "hot.example.org")] * 50
    names = [(word(0, 12) if i % 9 else None,) for i in range(200)] + [("example",), ("example",), ("longer than any of the texts that are here",)]
    d, n = spark.createDataFrame(texts, "text int, piece string"), spark.createDataFrame(names, "size string")
    got = H.occurrences(d, "piece", n, "size")
    want = sorted({(t, x) for _, t in texts for (x,) in names if t is not None and x is not None and x in t})
    assert sorted(map(tuple, got.collect())) == want
    many = spark.range(200_000).select(F.concat(F.lit("provider"), F.col("id"), F.lit(".net")).alias("size"))  # over a megabyte
    hosts = spark.createDataFrame([(i, f"shop.provider{i}.net") for i in (5, 77_777, 199_999, 200_000)], "i int, h string")
    found = H.first_contained(hosts, "h", many, "size", "size", "p")
    assert {x.i: x.p for x in found.collect()} == {5: "provider5.net", 77_777: "provider77777.net", 199_999: "provider199999.net", 200_000: None}
    for plan in (found, got):
        assert "NestedLoop" not in (text := plan._jdf.queryExecution().toString()) and "Cartesian" not in text


def test_small_sides(spark):
    d = spark.range(10).select(F.col("id"), F.lit("x" * 100).alias("s"), F.array(F.lit(1)).alias("a"))
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(sizes.small(d)) and not hint(sizes.small(d, rows=9)) and not hint(sizes.small(d, size=1000))
    assert hint(sizes.small(d.limit(0)))


def test_endpoints(spark):
    rules = spark.createDataFrame([("editor", "e.js", ["", "js"], ["e.js"])], "component string, file string, entries array<string>, endpoints array<string>")
    got = H.endpoints(spark.createDataFrame([("https://a.org:1/x?y",)], "url string"), rules).collect()
    assert [(r.component, r.file, r.endpoint) for r in got] == [("editor", "e.js", "https://a.org:1/e.js"), ("editor", "e.js", "https://a.org:1/js/e.js")]
