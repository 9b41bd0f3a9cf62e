"""Reports, resolution, walks, retries and further state changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import reports as J
from quillmesh.functions.url import split
from quillmesh.operators import relational as R
from quillmesh.operators import resolve as C
from quillmesh.operators import sampling
from quillmesh.operators import search as S
from quillmesh.operators import vectors as V

from quillmesh.sources.files import suffix_kind

from .registry import query, table
from .url_queries import _PARTS, _SUFFIXES
from .vector_queries import EPS, MIN_POINTS

@query("""SELECT p_partkey, n, CASE WHEN p_partkey % 3 = 0 THEN 'cpe:2.3:a:x:' || replace(p_name, ' ', '_') || ':' || p_size || '.' || n END AS cpe, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_size END AS title, CASE WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN 'http://v/' || p_partkey END AS vendor, CASE WHEN p_partkey % 3 = 0 THEN 'CVE-' || p_size || ',CVE-' || n END AS cves
FROM part, (SELECT unnest([0, 1]) AS n) WHERE p_partkey % 3 = 0 OR n = 0""")
def nvd_cpe(spark, sf_dir):
    """Products of answers: two of them, none, or a body that is no JSON; without any, one row of nulls."""
    name, size, i = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey")
    titles = F.array(F.struct(F.lit("").alias("title"), F.lit("fr").alias("lang")), F.struct(F.concat_ws(" ", name, size).alias("title"), F.lit("en").alias("lang")))
    refs = F.array(F.struct(F.lit("r").alias("ref"), F.lit("Advisory").alias("type")), F.struct(F.concat(F.lit("http://v/"), i.cast("string")).alias("ref"), F.when(F.col("p_size") % 2 == 0, "Vendor").otherwise("Other").alias("type")))
    one = lambda n: F.struct(F.struct(F.concat(F.lit("cpe:2.3:a:x:"), F.replace(name, F.lit(" "), F.lit("_")), F.lit(":"), size, F.lit(f".{n}")).alias("cpeName"), F.lit("2021").alias("lastModified"), titles.alias("titles"), refs.alias("refs"), F.array(F.concat(F.lit("CVE-"), size), F.lit(f"CVE-{n}")).alias("cves")).alias("cpe"))
    full = F.to_json(F.struct(F.lit(2).alias("totalResults"), F.array(one(0), one(1)).alias("products")))
    body = F.when(i % 3 == 0, full).when(i % 3 == 1, '{"totalResults": 0, "products": []}').otherwise("broken")
    d = table(spark, sf_dir, "part").select("p_partkey", F.posexplode_outer(J.products(body)).alias("n", "p"))
    return d.select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"), "p.cpe", "p.title", "p.vendor", F.when(F.col("p.cves").isNotNull(), F.array_join("p.cves", ",")).alias("cves"))


@query("SELECT p_partkey, 'CVE-' || p_partkey AS cve_id, 'bad ' || p_name || CASE WHEN p_size % 2 = 0 THEN ',worse' ELSE '' END AS description, 'CWE-' || p_size || CASE WHEN p_size <> 7 THEN ',CWE-7' ELSE '' END AS cwes, 'http://r/' || p_partkey AS reference_data FROM part")
def nvd_cve(spark, sf_dir):
    """English descriptions, weaknesses of both levels without repeats, and references of flaws' reports."""
    i, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    say = lambda lang, value: F.struct(F.lit(lang).alias("lang"), value.alias("value"))
    worse = say("en", F.lit("worse"))
    told = F.array(say("es", F.lit("mal")), say("en", F.concat(F.lit("bad "), "p_name")))
    weak = lambda *x: F.struct(F.array(*[say("en", v) for v in x]).alias("description"))
    body = F.to_json(F.struct(F.concat(F.lit("CVE-"), i).alias("id"), F.when(F.col("p_size") % 2 == 0, F.concat(told, F.array(worse))).otherwise(told).alias("descriptions"), F.array(weak(F.concat(F.lit("CWE-"), size)), weak(F.concat(F.lit("CWE-"), size), F.lit("CWE-7"))).alias("weaknesses"), F.array(F.struct(F.concat(F.lit("http://r/"), i).alias("url"))).alias("references")))
    f = J.flaw(body)
    return table(spark, sf_dir, "part").select("p_partkey", f["cve_id"].alias("cve_id"), *[F.array_join(f[k], ",").alias(k) for k in ("description", "cwes", "reference_data")])


@query("SELECT p_partkey, 'cpe:2.3:a:*:' || replace(lower(p_name), ' ', '-') || ':' || p_size AS cpe FROM part")
def cpe_string(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", J.match_string(F.lit(None), J.slug(F.col("p_name")), F.col("p_size").cast("string")).alias("cpe"))


_STATUS = "CASE WHEN event_id % 11 > 0 THEN 150 + event_id % 300 END"
_KIND = "CASE event_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html' ELSE 'x-pdf; v=' || user_id END"
_HEAD = "CASE event_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'x-pdf; v=' || user_id END"


@query(f"WITH t AS (SELECT event_id, {_STATUS} AS s, {_KIND} AS k, {_HEAD} AS h FROM events) SELECT event_id, CASE WHEN s IS NULL THEN 'No answer' WHEN s < 200 OR s > 299 THEN 'Bad status code ' || s WHEN NOT contains(k, 'pdf') THEN 'Bad content type' WHEN h <> k THEN 'Inconsistent content type' END AS error FROM t")
def answer_outcome(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", J.outcome(F.expr(_STATUS).cast("int"), F.expr(_KIND), F.expr(_HEAD)).alias("error"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'x' END AS error FROM events")
def error_from_url(spark, sf_dir):
    url = F.concat(F.lit("/done?id="), F.col("event_id").cast("string"), F.when(F.col("event_id") % 7 == 0, "&error=x").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", J.error_of(url).alias("error"))


@query("SELECT page_id, coalesce(contains(url, 'amazonaws') OR contains(lower(html), 'bucket') OR (contains(lower(html), 'hostid') AND contains(lower(html), 'requestid')), false) AS storage FROM pages")
def storage_answers(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", J.storage_answer(F.col("url"), F.col("html")).alias("storage"))


_RECT = "CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE (o_orderkey % 40) || '.5 ' || (o_orderkey % 7) || '.25  -' || (o_orderkey % 30) || '.5 ' || (o_orderkey % 500) END"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE round_even(o_orderkey % 40 + 0.5, 0)::INT || ',' || (o_orderkey % 7) || ',' || round_even(-(o_orderkey % 30 + 0.5), 0)::INT || ',' || (o_orderkey % 500) END AS rect FROM orders")
def rect_rounding(spark, sf_dir):
    """Lists of coordinates, rounded half to even."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(J.rect(F.expr(_RECT)), ",").alias("rect"))


@query(f"""WITH x AS (SELECT page_id, html, list_transform([{', '.join(repr(p) for p in J.SCRIPT_PARTS)}], lambda p: ((length(html) - length(replace(html, p, ''))) / length(p))::INT) AS n FROM pages)
SELECT page_id, NOT regexp_matches(html, '[^\\x00\\t\\n\\f\\r\\x20-\\x7E]') AND contains(html, ';') AND contains(html, '(') AND contains(html, ')') AND ((list_sum(n) > 15 AND len(list_filter(n, lambda k: k > 0)) >= 4) OR (length(html) < 100 AND list_sum(n) * 100 > 10 * length(html))) AS script FROM x""")
def js_detect(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", J.looks_like_script(F.col("html")).alias("script"))


@query("""SELECT 'd' || user_id AS domain, coalesce(string_agg('v' || event_id % 5, ',' ORDER BY event_id % 5) FILTER (event_type = 'view'), '') AS a, coalesce(string_agg('v' || event_id % 5, ',' ORDER BY event_id % 5) FILTER (event_type = 'click'), '') AS mx,
  CASE WHEN bool_or(event_type = 'error') THEN 'The DNS operation timed out.' WHEN bool_or(event_type = 'signup') THEN 'Error while processing the DNS record.' END AS error FROM events GROUP BY 1""")
def name_answers(spark, sf_dir):
    """Record lists and errors of domains from single answers."""
    kind = F.col("event_type")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("domain"), F.when(kind == "view", "A").when(kind == "click", "MX").when(kind == "signup", "NS").otherwise("TXT").alias("rtype"), F.when(kind.isin("view", "click"), F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string"))).alias("value"), F.when(kind == "error", "Timeout").when(kind == "signup", "Strange").when(kind == "purchase", "NoAnswer").alias("failure"))
    return J.name_answers(e).select("domain", F.array_join("a", ",").alias("a"), F.array_join("mx", ",").alias("mx"), "error")


@query("""SELECT event_id, 'https://h' || user_id || '.example/a/b/c.pdf' AS url, sha256('https://h' || user_id || '.example/a/b/c.pdf') AS url_hash, 'https://h' || user_id || '.example/a/b' AS domain_path, CASE WHEN event_type = 'error' THEN 'timeout' END AS error_msg,
  'CMS ' || user_id AS cms, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS requests, (200 + event_id % 300)::INT AS status_code, 'text/' || event_type AS content_type, CASE WHEN event_id % 3 = 0 THEN 'TLS 1.' || event_id % 4 END AS tls_version FROM events""")
def visit_results(spark, sf_dir):
    """Jobs, pages and requests of browser visits from their JSON."""
    text = lambda c: F.col(c).cast("string")
    job = F.concat(F.lit('{"url": "https://h'), text("user_id"), F.lit('.example/a/b/c.pdf"}'))
    page = F.concat(F.lit('{"result": 0, "detected": {"CMS": "CMS '), text("user_id"), F.lit('"}}'))
    tls = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "tls_version": "TLS 1.'), (F.col("event_id") % 4).cast("string"), F.lit('"'))).otherwise("")
    request = F.concat(F.lit('{"url": "u", "method": "GET", "response_headers": ["HTTP/1.1 '), (200 + F.col("event_id") % 300).cast("string"), F.lit(' X", "content-type: text/'), "event_type", F.lit('"]'), tls, F.lit("}"))
    log = F.concat(F.lit("["), request, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(", "), request)).otherwise(""), F.lit("]"))
    posted = F.concat(F.lit("/done?id=1"), F.when(F.col("event_type") == "error", "&error=timeout").otherwise(""))
    v, r = J.visit(job, page, posted), F.col("r")
    e = table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in v.items()], J.requests(log).alias("r"))
    first = F.get(r, F.lit(0))
    return e.select("event_id", "url", "url_hash", "domain_path", "error_msg", F.col("detected")["CMS"].alias("cms"), F.size("r").alias("requests"), first["status_code"].alias("status_code"), first["response_headers"]["content-type"].alias("content_type"), first["tls_version"].alias("tls_version"))


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, vec_id // 64 AS batch FROM embeddings), p AS (SELECT a.id AS a, b.id AS b, a.v AS av, a.label, a.batch, list_distance(a.v, b.v) ** 2 AS d FROM e a JOIN e b ON a.batch = b.batch AND a.label = b.label AND a.id < b.id),
l AS (SELECT p.a, p.b, p.d - list_distance(p.av, n.v) ** 2 + 0.2 AS loss FROM p JOIN e n ON n.batch = p.batch AND n.label <> p.label), h AS (SELECT a, b, max(loss) AS top, count(*) AS n, count(*) FILTER (loss <= 0) AS bad FROM l GROUP BY 1, 2)
SELECT count(*) FILTER (top > 0) AS triplets, round(sum(top) FILTER (top > 0), 3) AS loss, sum(n)::BIGINT AS losses, round(sum(bad) / sum(n), 6) AS ratio FROM h""")
def hardest_triplets(spark, sf_dir):
    """Loss of the hardest negative of each pair in training batches, and how many negatives are far enough."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label", F.floor(F.col("vec_id") / 64).alias("batch"))
    t = C.mine_triplets(e, 0.2)
    return t.agg(F.count("negative").alias("triplets"), F.round(F.sum("loss"), 3).alias("loss"), F.sum("losses").alias("losses"), F.round(F.sum("negatives") / F.sum("losses"), 6).alias("ratio"))


_LINE = "CASE page_id % 4 WHEN 0 THEN '*.' || netloc WHEN 1 THEN '!' || netloc WHEN 2 THEN netloc ELSE '// ' || netloc END"


@query(f"WITH {_PARTS}, sl AS (SELECT DISTINCT {_LINE} AS line FROM p WHERE netloc <> ''),\nsk AS{_SUFFIXES.split('sk AS', 1)[1]} SELECT line, suffix, kind FROM sk")
def suffix_lines(spark, sf_dir):
    """Rules and comments of a list of suffixes that pages' hosts make, line by line."""
    p = table(spark, sf_dir, "pages").select("page_id", split(F.col("url"))["netloc"].alias("netloc")).where("netloc <> ''")
    lines = p.select(F.expr(_LINE).alias("line")).distinct()
    return lines.select("line", *[c.alias(n) for n, c in suffix_kind(F.col("line")).items()])


@query("SELECT p_partkey, p_name AS friendly_name, p_size::VARCHAR AS latest_version, p_size % 2 = 0 AS popular, 'flaw ' || p_brand AS title FROM part")
def advisories(spark, sf_dir):
    """Components and flaws of advisories written as JSON objects."""
    flaw = F.array(F.struct(F.col("p_size").cast("string").alias("id"), F.concat(F.lit("flaw "), "p_brand").alias("title")))
    body = F.to_json(F.create_map(F.lit("slug"), F.struct(F.col("p_name").alias("friendly_name"), F.col("p_size").cast("string").alias("latest_version"), (F.col("p_size") % 2 == 0).alias("popular"), flaw.alias("vulnerabilities"))))
    a = J.advisory(body)
    return table(spark, sf_dir, "part").select("p_partkey", a["friendly_name"].alias("friendly_name"), a["latest_version"].alias("latest_version"), a["popular"].alias("popular"), F.get(a["vulnerabilities"], F.lit(0))["title"].alias("title"))


@query("SELECT s_suppkey, 'n' || s_suppkey AS name, 2 AS files, s_suppkey * 2 + 1 AS bytes FROM supplier")
def storage_listings(spark, sf_dir):
    """Count and size of the files of storage listings written as XML."""
    file = lambda size: F.concat(F.lit("<Contents><Key>k</Key><LastModified>2018-03-02</LastModified><Size>"), size.cast("string"), F.lit("</Size></Contents>"))
    xml = F.concat(F.lit("<ListBucketResult><Name>n"), F.col("s_suppkey").cast("string"), F.lit("</Name><IsTruncated>false</IsTruncated>"), file(F.col("s_suppkey")), file(F.col("s_suppkey") + 1), F.lit("</ListBucketResult>"))
    x = table(spark, sf_dir, "supplier").select("s_suppkey", J.listing(xml).alias("x"))
    return x.select("s_suppkey", F.col("x.Name").alias("name"), F.size("x.Contents").alias("files"), F.aggregate("x.Contents", F.lit(0).cast("bigint"), lambda acc, c: acc + c["Size"]).alias("bytes"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lpad(hex(c_custkey % 256), 2, '0') || lpad(hex(c_custkey // 256), 2, '0') || lpad(hex(c_custkey % 128), 2, '0') || '00' || hex('k') || '00' WHEN 1 THEN hex(c_name) ELSE hex('%') || '00' || hex('z') || '00' || lpad(hex(c_custkey % 256), 2, '0') || '00' END AS bytes FROM customer""")
def script_unescape(spark, sf_dir):
    """Bytes of wide and narrow escapes, of texts without any, and of broken ones."""
    i = F.col("c_custkey")
    code = lambda c: F.lpad(F.hex(c), 2, "0")  # noqa: E731  of keys above 65535 the high byte has their first two digits, as in the SQL
    text = F.when(i % 3 == 0, F.concat(F.lit("%u"), code(F.floor(i / 256)), code(i % 256), F.lit("%"), code(i % 128), F.lit("k"))).when(i % 3 == 1, F.col("c_name")).otherwise(F.concat(F.lit("%z%"), code(i % 256)))
    return table(spark, sf_dir, "customer").select("c_custkey", F.hex(J.unescape(text)).alias("bytes"))


@query("SELECT page_id, 'eval(' || CASE WHEN page_id % 2 = 0 THEN 'function(){return ' || page_id || '}' ELSE 'unpack_' || page_id END || ');' AS call, CASE WHEN page_id % 2 = 0 THEN 'function(){return ' || page_id || '}' ELSE 'unpack_' || page_id END AS arguments, page_id % 2 = 0 AS returns, 'e' || page_id AS alias FROM pages")
def script_calls(spark, sf_dir):
    """Calls of a function that hides code, and the names it goes by."""
    i = F.col("page_id").cast("string")
    hidden = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("function(){return "), i, F.lit("}"))).otherwise(F.concat(F.lit("unpack_"), i))
    code = F.concat(F.lit("var e"), i, F.lit(" = eval; eval("), hidden, F.lit(");"))
    d = table(spark, sf_dir, "pages").select("page_id", F.get(J.calls(code, "eval"), F.lit(0)).alias("c"), F.get(J.aliases(code, "eval"), F.lit(0)).alias("alias"))
    return d.select("page_id", "c.call", "c.arguments", "c.returns", "alias")


@query(r"""WITH h AS (SELECT item_id, hex(encode(text)) AS x, item_id % 256 AS k FROM benchmark), d AS (SELECT item_id, k, x, unnest(range(0, length(x) // 2)) AS i FROM h),
b AS (SELECT item_id, k, i, ('0x' || substr(x, 2 * i + 1, 2))::INT AS c FROM d), n AS (SELECT *, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2 FROM b WINDOW w AS (PARTITION BY item_id ORDER BY i))
SELECT item_id, xor(k::INT, xor(c, 116)) AS key, i::BIGINT AS "offset" FROM n WHERE xor(c, 116) = xor(c1, 104) AND xor(c, 116) = xor(c2, 101)""")
def xor_search(spark, sf_dir):
    """Where whole texts, each hidden by its own key, have a string under any single-byte key."""
    code, k = F.hex(F.col("text").cast("binary")), F.col("item_id") % 256
    each = F.regexp_extract_all(code, F.lit("(..)"), F.lit(1))
    hidden = F.unhex(F.array_join(F.transform(each, lambda x: F.lpad(F.hex(F.conv(x, 16, 10).cast("long").bitwiseXOR(k)), 2, "0")), ""))
    return S.xor_search(table(spark, sf_dir, "benchmark").select("item_id", hidden.alias("content")), "item_id", "content", b"the")


@query(r"""WITH h AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id, x, unnest(range(0, length(x) // 2)) AS i FROM h), b AS (SELECT doc_id, i, ('0x' || substr(x, 2 * i + 1, 2))::INT AS c FROM d),
n AS (SELECT *, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3, lead(c, 4) OVER w AS c4 FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, xor(c, 116) AS key, i::BIGINT AS "offset" FROM n WHERE xor(c, 116) = xor(c1, 111) AND xor(c, 116) = xor(c2, 107) AND xor(c, 116) = xor(c3, 101) AND xor(c, 116) = xor(c4, 110)""")
def xor_documents(spark, sf_dir):
    """Where whole texts have a string under any of the 256 single-byte keys."""
    return S.xor_search(table(spark, sf_dir, "documents"), "doc_id", "text", b"token")


@query("""WITH a AS (SELECT user_id, event_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), t AS (SELECT * FROM a WHERE n <= 3)
SELECT user_id, coalesce(min(n) FILTER (NOT failed), max(n))::INT AS attempts, bool_or(NOT failed) AS reached FROM t GROUP BY 1""")
def visit_retry(spark, sf_dir):
    """Up to three attempts of each key: how many it took, and whether one succeeded."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("failed"))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    t = e.withColumn("n", n).where("n <= 3")  # a group limit: each task keeps three rows of a key before the shuffle
    return t.groupBy("user_id").agg(F.coalesce(F.min(F.when(~F.col("failed"), F.col("n"))), F.max("n")).alias("attempts"), F.bool_or(~F.col("failed")).alias("reached"))


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') AS times_on, count(*) FILTER (event_type = 'error') AS times_off, arg_max(value, (ts, event_id)) FILTER (event_type <> 'error' AND value IS NOT NULL) AS value_on, arg_max(value, (ts, event_id)) FILTER (event_type = 'error' AND value IS NOT NULL) AS value_off FROM events GROUP BY 1")
def scan_counters(spark, sf_dir):
    """Counters and last values of two column families, on and off."""
    on, at = F.col("event_type") != "error", F.struct("ts", "event_id")
    last = lambda c: F.max_by("value", F.when(c & F.col("value").isNotNull(), at))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(on).alias("times_on"), F.count_if(~on).alias("times_off"), last(on).alias("value_on"), last(~on).alias("value_off"))


@query("""WITH e AS (SELECT vec_id, label, label - 1 AS cluster, CASE WHEN label % 4 > 0 THEN label * 10 + vec_id % (label % 4) END AS known FROM embeddings),
a AS (SELECT cluster, known, CASE WHEN label % 4 = 3 THEN known ELSE label END AS campaign FROM e WHERE known IS NOT NULL QUALIFY row_number() OVER (PARTITION BY known ORDER BY md5(vec_id::VARCHAR || '|7')) <= 20),
k AS (SELECT cluster, count(DISTINCT known) AS n, count(DISTINCT campaign) AS m FROM a GROUP BY 1)
SELECT DISTINCT e.cluster::BIGINT AS cluster, CASE WHEN e.cluster = -1 THEN 'noise' WHEN n IS NULL THEN 'new' WHEN n = 1 THEN 'known' WHEN m = 1 THEN 'conflict' ELSE 'unresolved' END AS verdict FROM e LEFT JOIN k ON k.cluster = e.cluster""")
def cluster_resolve(spark, sf_dir):
    """Verdicts of the clusters of all embeddings from 20 seeded anchors of each known cluster."""
    e, anchors, campaigns = _clusters(spark, sf_dir)
    return C.resolve_clusters(e.select("id", "cluster"), anchors.select("id", "known"), campaigns).select("cluster", "verdict")


def _clusters(spark, sf_dir):
    """Embeddings with their cluster and known cluster, anchors, and the campaigns of known clusters."""
    label, parts = F.col("label").cast("long"), F.col("label") % 4
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), (label - 1).alias("cluster"), F.col("embedding").alias("v"), F.when(parts > 0, label * 10 + F.col("vec_id") % F.greatest(parts, F.lit(1))).alias("known"))
    anchors = R.first_per(e.where("known IS NOT NULL"), ["known"], [R.draw(F.col("id"))], 20)
    campaigns = anchors.select("known", F.when(F.col("label") % 4 == 3, F.col("known")).otherwise(F.col("label")).alias("campaign")).distinct()
    return e, anchors, campaigns


_SETTLED = """WITH e AS (SELECT vec_id, label, label - 1 AS cluster, embedding::DOUBLE[] AS v, CASE WHEN label % 4 > 0 THEN label * 10 + vec_id % (label % 4) END AS known FROM embeddings),
a AS (SELECT vec_id, label, cluster, v, known, CASE WHEN label % 4 = 3 THEN known ELSE label END AS campaign FROM e WHERE known IS NOT NULL QUALIFY row_number() OVER (PARTITION BY known ORDER BY md5(vec_id::VARCHAR || '|7')) <= 20),
c AS (SELECT known, list(x ORDER BY pos) AS centroid FROM (SELECT known, pos, avg(x) AS x FROM (SELECT known, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a) GROUP BY 1, 2) GROUP BY 1),
k AS (SELECT cluster, count(DISTINCT known) AS n, count(DISTINCT campaign) AS m, min(known) AS one FROM a GROUP BY 1),
w AS (SELECT e.vec_id, e.cluster, one, CASE WHEN e.cluster = -1 THEN 'noise' WHEN n IS NULL THEN 'new' WHEN n = 1 THEN 'known' WHEN m = 1 THEN 'conflict' ELSE 'unresolved' END AS verdict FROM e LEFT JOIN k ON k.cluster = e.cluster),
d AS (SELECT e.vec_id, arg_min(c.known, list_distance(e.v, c.centroid)) AS nearest FROM e JOIN (SELECT DISTINCT cluster, known FROM a) i ON i.cluster = e.cluster JOIN c ON c.known = i.known GROUP BY 1)
SELECT w.vec_id, w.cluster::BIGINT AS cluster, verdict, CASE verdict WHEN 'conflict' THEN nearest WHEN 'known' THEN one WHEN 'new' THEN NULL ELSE -1 END AS known FROM w LEFT JOIN d ON d.vec_id = w.vec_id"""


@query(_SETTLED)
def cluster_settle(spark, sf_dir):
    """Verdict and known cluster of every embedding of every label; 20 seeded anchors of each known cluster."""
    e, anchors, campaigns = _clusters(spark, sf_dir)
    settled = C.settle_clusters(e.select("id", "cluster", "v"), anchors.select("id", "known"), campaigns, V.centroids(anchors, "known", "v"))
    return settled.withColumnRenamed("id", "vec_id")


def _clusters_sql(name: str, eps: float) -> str:
    """CTE of density clusters at an eps."""
    return f"""p_{name} AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= {eps}),
core_{name} AS (SELECT a AS id FROM p_{name} GROUP BY a HAVING count(*) + 1 >= {MIN_POINTS}), cc_{name} AS (SELECT p.a, p.b FROM p_{name} p JOIN core_{name} x ON x.id = p.a JOIN core_{name} y ON y.id = p.b),
reach_{name}(id, r) AS (SELECT id, id FROM core_{name} UNION SELECT r.id, cc.b FROM reach_{name} r JOIN cc_{name} cc ON cc.a = r.r), l_{name} AS (SELECT id, min(r) AS cluster FROM reach_{name} GROUP BY id),
near_{name} AS (SELECT p.b AS id, min(p.a) AS c FROM p_{name} p JOIN core_{name} x ON x.id = p.a GROUP BY 1),
{name} AS (SELECT vec_id AS id, l.id IS NOT NULL AS core, coalesce(l.cluster, l2.cluster, -1) AS cluster FROM embeddings LEFT JOIN l_{name} l ON l.id = vec_id LEFT JOIN near_{name} n ON n.id = vec_id LEFT JOIN l_{name} l2 ON l2.id = n.c)"""


@query(f"WITH RECURSIVE {_clusters_sql('wide', EPS)}, {_clusters_sql('narrow', 1.1)}, several AS (SELECT count(DISTINCT cluster) > 1 AS yes FROM wide WHERE cluster >= 0) SELECT id, core, cluster FROM wide, several WHERE yes UNION ALL SELECT id, core, cluster FROM narrow, several WHERE NOT yes")
def eps_ladder(spark, sf_dir):
    """Clusters at the first eps of a falling ladder that has more than one."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return C.ladder(v, [EPS, 1.1], MIN_POINTS, lambda x: x.where("cluster >= 0").select("cluster").distinct().limit(2).count() > 1)


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, md5(vec_id::VARCHAR || '|7') AS o FROM embeddings WHERE label IS NOT NULL),
p AS (SELECT id, coalesce(lead(id) OVER w, first_value(id) OVER w) AS positive FROM e WINDOW w AS (PARTITION BY label ORDER BY o, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
n AS (SELECT a.id, coalesce(arg_min(b.id, (b.o, b.id)) FILTER ((b.o, b.id) > (a.o, a.id)), arg_min(b.id, (b.o, b.id))) AS negative FROM e a JOIN e b ON b.label <> a.label GROUP BY a.id),
l AS (SELECT greatest(list_distance(a.v, x.v) ** 2 - list_distance(a.v, y.v) ** 2 + 0.2, 0) AS loss FROM p JOIN n USING (id) JOIN e a USING (id) JOIN e x ON x.id = positive JOIN e y ON y.id = negative WHERE positive <> p.id)
SELECT count(*) AS n, round(sum(loss), 4) AS loss, round(count(*) FILTER (loss <= 0) / count(*), 6) AS ratio FROM l""")
def triplet_stats(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    loss = C.triplet_loss(C.triplets(v), v, 0.2)
    return loss.agg(F.count("*").alias("n"), F.round(F.sum("loss"), 4).alias("loss"), F.round(F.count_if(F.col("loss") <= 0) / F.count("*"), 6).alias("ratio"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, (l_suppkey * 7 + l_linenumber) % 100 + 1 AS dst FROM lineitem), r(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 100)
SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def graph_walk(spark, sf_dir):
    """Breadth-first depth from a root over all line items; they lead to 100 nodes, so no way is longer than SQL's 100 steps."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 100 + 1).alias("dst")).distinct()
    return C.reach(e, spark.range(1, 2).select(F.col("id").alias("node")))


@query("SELECT a.doc_id AS doc_id, b.doc_id AS twin FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) AND length(a.text) = length(b.text) AND b.doc_id = (SELECT min(doc_id) FROM documents c WHERE c.text = a.text) WHERE a.doc_id <> b.doc_id")
def hash_propagation(spark, sf_dir):
    """Rows that share two hashes take over from the least of them; a group's rows meet its least one, not each other."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h1"), F.length("text").alias("h2"))
    first = d.groupBy("h1", "h2").agg(F.min("doc_id").alias("twin"), F.count("*").alias("n")).where("n > 1").drop("n")
    return d.join(first, ["h1", "h2"]).where("doc_id <> twin").select("doc_id", "twin")


@query("SELECT p_type, p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_type, p_brand ORDER BY md5(p_partkey::VARCHAR || '|7')) <= 3")
def balanced_batch(spark, sf_dir):
    """The same number of rows of each subclass."""
    return R.first_per(table(spark, sf_dir, "part").select("p_type", "p_brand", "p_partkey"), ["p_type", "p_brand"], [R.draw(F.col("p_partkey"))], 3)


_DRAW = "('0x' || substr(md5({} || '|7'), 1, 13))::BIGINT"


@query(f"SELECT kind, item_id, price FROM items WHERE price > 0 AND item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind ORDER BY -ln(({_DRAW.format('item_id::VARCHAR')} + 0.5) / 4503599627370496.0) / price, item_id) <= 20")
def weighted_picks(spark, sf_dir):
    """Twenty items of each kind, the dearer the likelier."""
    return sampling.weighted_sample(table(spark, sf_dir, "items").select("kind", "item_id", "price"), ["kind"], "item_id", "price", 20)


#: Subclasses and rows in a batch of the epoch.
CLASSES, BATCH_ROWS = 8, 32


@query(f"""WITH r AS (SELECT brand, item_id, row_number() OVER (PARTITION BY brand ORDER BY md5(item_id || '|7'), item_id) - 1 AS i, count(*) OVER (PARTITION BY brand) AS n FROM items WHERE brand IS NOT NULL AND item_id IS NOT NULL),
s AS (SELECT brand, n, row_number() OVER (ORDER BY md5(brand || '|7'), brand) - 1 AS place, count(*) OVER () AS s FROM (SELECT DISTINCT brand, n FROM r)),
b AS (SELECT unnest(range(0, (SELECT count(*) FROM r) // {BATCH_ROWS})) AS batch), t AS (SELECT batch, stratum, any_value.s FROM b, range(0, {CLASSES}) x(stratum), (SELECT max(s) AS s FROM s) any_value),
p AS (SELECT batch, stratum, stratum * s // {CLASSES} AS low, (stratum + 1) * s // {CLASSES} AS high FROM t),
q AS (SELECT batch, stratum, low + {_DRAW.format("batch || '|' || stratum")} % (high - low) AS place FROM p),
f AS (SELECT batch, stratum, brand, n, {_DRAW.format("batch || '|' || stratum || '|row'")} % n AS first FROM q JOIN s USING (place))
SELECT batch, (stratum * {BATCH_ROWS // CLASSES} + j)::INT AS slot, f.brand AS label, item_id AS key FROM f, range(0, {BATCH_ROWS // CLASSES}) y(j) JOIN r ON r.brand = f.brand AND r.i = (first + j) % f.n""")
def epoch_batches(spark, sf_dir):
    """An epoch of batches, each with as many items of eight different brands."""
    return sampling.balanced_batches(table(spark, sf_dir, "items"), "brand", "item_id", CLASSES, BATCH_ROWS)


@query("SELECT DISTINCT r_name, n_name FROM region, nation WHERE n_regionkey = r_regionkey AND n_nationkey IN (SELECT s_nationkey FROM supplier) AND n_nationkey IN (SELECT c_nationkey FROM customer)")
def shared_nations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    n = n.join(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    return n.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").distinct()


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query(f"SELECT count(*) AS pairs, round(sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2), 3) AS total FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= {EPS}")
def close_pair_energy(spark, sf_dir):
    p = V.range_join(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", EPS)
    return p.agg(F.count("*").alias("pairs"), F.round(F.sum(F.col("distance") * F.col("distance")), 3).alias("total"))
