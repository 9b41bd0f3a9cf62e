"""Filters by date and label, updates, samples, conversions, requests and the remaining cluster operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import convert as K
from quillmesh.functions import predicates as P
from quillmesh.functions import reports as J
from quillmesh.functions import scripts as S
from quillmesh.functions import text as X
from quillmesh.functions import unpack
from quillmesh.functions import url as U
from quillmesh.operators import hosts as H
from quillmesh.operators import relational as R
from quillmesh.operators import resolve as C
from quillmesh.operators import vectors as V
from quillmesh.sources import files, pdf_filters, sinks

from .more_queries import _clusters
from .registry import query, table
from .url_queries import _HREFS, _PARTS, _links

RUN = "2024-01-15"


@query("SELECT doc_id, source = 'src2' OR source = 'src3' AS chosen FROM documents WHERE source <> 'src1'")
def provider_filter(spark, sf_dir):
    """Rows of all providers but one, and which are of two that are asked for."""
    return table(spark, sf_dir, "documents").where(F.col("source") != "src1").select("doc_id", F.col("source").isin("src2", "src3").alias("chosen"))


@query(f"""SELECT event_id, ts >= DATE '{RUN}' - 1 AND ts < DATE '{RUN}' AS yesterday, ts >= DATE '2024-01-20' AS later, ts >= DATE '2024-01-03' AND ts < DATE '2024-01-06' AS within, ts > TIMESTAMP '{RUN} 14:30' - INTERVAL 1 DAY AS since FROM events
WHERE (ts >= DATE '{RUN}' - 1 AND ts < DATE '{RUN}') OR ts >= DATE '2024-01-20' OR (ts >= DATE '2024-01-03' AND ts < DATE '2024-01-06') OR ts > TIMESTAMP '{RUN} 14:30' - INTERVAL 1 DAY""")
def by_day(spark, sf_dir):
    """Rows of the day before a run, after a day, between two days, and since a time of day."""
    ts = F.col("ts")
    c = {"yesterday": P.on_day(ts, RUN), "later": P.after_day(ts, "2024-01-19"), "within": P.between_days(ts, "2024-01-03", "2024-01-05"), "since": P.since_clock(ts, RUN, "14:30")}
    e = table(spark, sf_dir, "events").select("event_id", "ts").where(c["yesterday"] | c["later"] | c["within"] | c["since"])
    return e.select("event_id", *[v.alias(n) for n, v in c.items()])


_STATE = """v AS (SELECT user_id, event_type = 'error' AS failed, ts, event_id, max(CASE WHEN event_type <> 'error' THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS ok FROM events),
s AS (SELECT user_id, count(*) FILTER (failed AND (ok IS NULL OR (ts, event_id) > ok)) AS offline_count, min(ts) FILTER (NOT failed) AS first_online, max(ts) AS last_updated FROM v GROUP BY user_id)"""


@query(f"WITH {_STATE} SELECT user_id, offline_count >= 2 AND first_online IS NOT NULL AND last_updated >= DATE '{RUN}' - 4 AS given_up, last_updated < DATE '{RUN}' AS due FROM s")
def visit_candidates(spark, sf_dir):
    """Which keys have failed too often of late, and which haven't been visited on a run's day."""
    s = R.fold_visits(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return s.select("user_id", P.given_up(F.col("offline_count"), F.col("first_online"), F.col("last_updated"), RUN, failures=2).alias("given_up"), P.not_yet_on(F.col("last_updated"), RUN).alias("due"))


@query(f"WITH {_PARTS} SELECT page_id FROM p WHERE list_has_any(string_split(path, '/'), ['fr', 'en'])")
def path_members(spark, sf_dir):
    """Pages whose path has one of the names as a folder."""
    parts = U.path_parts(U.split(F.col("url"))["path"])
    return table(spark, sf_dir, "pages").where(P.has_any(parts, "fr", "en")).select("page_id")


@query("SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'PROMO') OR p_name = 'red widget'")
def label_choice(spark, sf_dir):
    """Rows of some labels, or of one name."""
    return table(spark, sf_dir, "part").where(F.col("p_type").isin("ECONOMY", "SMALL", "PROMO") | (F.col("p_name") == "red widget")).select("p_partkey")


@query("WITH w AS (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 80), d AS (SELECT p_partkey, p_brand, ['yes', 'No', '--', NULL][p_size % 4 + 1] AS polarity FROM part) SELECT p_partkey, polarity IN ('yes', '--') AS malicious FROM d WHERE p_brand IN (SELECT p_brand FROM w) AND (polarity IN ('yes', '--') OR (polarity = 'No' AND p_brand <> 'Brand#2'))")
def category_whitelist(spark, sf_dir):
    """Rows of listed categories whose hand-made label says yes, or no outside one category."""
    p = table(spark, sf_dir, "part")
    listed = p.groupBy("p_brand").agg(F.count("*").alias("n")).where("n >= 80").select("p_brand")
    label = F.get(F.array(F.lit("yes"), F.lit("No"), F.lit("--"), F.lit(None)), F.col("p_size") % 4)
    d = p.select("p_partkey", "p_brand", label.alias("polarity")).join(listed, "p_brand", "left_semi")
    bad = P.is_malicious(F.col("polarity"))
    return d.where(bad | ((F.col("polarity") == "No") & (F.col("p_brand") != "Brand#2"))).select("p_partkey", bad.alias("malicious"))


@query(f"WITH {_HREFS}, x AS (SELECT page_id, pos, CASE pos % 3 WHEN 0 THEN 'file://' || href WHEN 1 THEN '/C:' || href ELSE href END AS uri FROM h) SELECT page_id, pos, uri FROM x WHERE NOT contains(uri, 'file://') AND NOT contains(uri, '/C:')")
def remote_uris(spark, sf_dir):
    """URIs that name no local file."""
    k, href = F.col("pos") % 3, F.col("href")
    d = _links(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), F.when(k == 0, F.concat(F.lit("file://"), href)).when(k == 1, F.concat(F.lit("/C:"), href)).otherwise(href).alias("uri"))
    return d.where(P.not_a_local_file(F.col("uri")))


@query("SELECT DISTINCT p_name, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_name = a.p_name AND b.p_brand = 'Brand#3' AND b.p_size < 5)")
def unmatched_components(spark, sf_dir):
    """Components and versions whose component matches none of those known, whatever their versions."""
    p = table(spark, sf_dir, "part")
    known = p.where((F.col("p_brand") == "Brand#3") & (F.col("p_size") < 5)).select("p_name")
    return p.select("p_name", "p_size").distinct().join(known, "p_name", "left_anti").select("p_name", "p_size")


@query("SELECT doc_id FROM documents a WHERE source <> 'src1' AND EXISTS (SELECT 1 FROM documents b WHERE b.source = 'src1' AND md5(b.text) = md5(a.text))")
def also_seen(spark, sf_dir):
    """Rows whose content one provider has, too."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"))
    return d.where(F.col("source") != "src1").join(d.where(F.col("source") == "src1").select("digest"), "digest", "left_semi").select("doc_id")


_RULES = [("editor", "editor.js", ("", "js"), ("editor.js", "editor/editor.js")), ("editor", "CHANGES", ("/docs",), ("CHANGES.md",)), ("finder", "config.js", ("", "admin", "public"), ("finder/config.js",))]


@query(f"""WITH r AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{f}', {list(a)!r}, {list(b)!r})" for c, f, a, b in _RULES)}) t(component, file, entries, endpoints)), x AS (SELECT component, file, unnest(entries) AS a, endpoints FROM r), y AS (SELECT component, file, a || '/' || unnest(endpoints) AS path FROM x), {_PARTS}
SELECT page_id, component, file, scheme || '://' || netloc || CASE WHEN starts_with(path, '/') THEN '' ELSE '/' END || path AS endpoint FROM (SELECT page_id, scheme, netloc FROM p), y""")
def endpoint_urls(spark, sf_dir):
    """Each site's URLs of a table of rules: every entry point with every endpoint, as text."""
    array = lambda x: "array(" + ", ".join(f"'{v}'" for v in x) + ")"
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{c}', '{f}', {array(a)}, {array(b)})" for c, f, a, b in _RULES) + " AS t(component, file, entries, endpoints)")
    return H.endpoints(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


@query("""WITH t AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS segment, c_acctbal AS balance FROM customer), v AS (SELECT c_custkey, 'new' || c_nationkey AS segment FROM customer WHERE c_custkey % 2 = 0)
SELECT t.c_custkey, coalesce(t.segment, v.segment) AS segment, balance FROM t LEFT JOIN v USING (c_custkey)""")
def update_from_values(spark, sf_dir):
    """Columns that are null are taken from a table of values with equal keys."""
    c = table(spark, sf_dir, "customer")
    target = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("segment"), F.col("c_acctbal").alias("balance"))
    return R.update_from(target, c.where(F.col("c_custkey") % 2 == 0).select("c_custkey", F.concat(F.lit("new"), "c_nationkey").alias("segment")), ["c_custkey"], ["segment"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'again' WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status FROM orders")
def upsert_overwrite(spark, sf_dir):
    """Rows with a new value take it, whatever they had."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("status"))
    return R.update_from(o, o.where(F.col("o_orderkey") % 5 == 0).select("o_orderkey", F.lit("again").alias("status")), ["o_orderkey"], ["status"], only_null=False)


@query(f"WITH {_PARTS}, g AS (SELECT page_id, netloc, path, page_id % 4 = 0 AS known FROM p) SELECT page_id, CASE WHEN known THEN 'old' WHEN contains(path, '/fr/') AND netloc IN (SELECT netloc FROM g WHERE known) THEN 'slims' END AS guess FROM g")
def guess_where_null(spark, sf_dir):
    """A guess is filled in where there is none, the path has a mark, and the host is known to have one elsewhere."""
    p = U.split(F.col("url"))
    d = table(spark, sf_dir, "pages").select("page_id", p["netloc"].alias("netloc"), p["path"].alias("path"), F.when(F.col("page_id") % 4 == 0, "old").alias("guess"))
    known = d.where("guess IS NOT NULL").select("netloc").distinct().withColumn("known", F.lit(True))
    fill = F.when(F.col("path").contains("/fr/") & F.col("known"), F.lit("slims"))
    return d.join(known, "netloc", "left").select("page_id", F.coalesce("guess", fill).alias("guess"))


@query(f"WITH {_PARTS}, x AS (SELECT page_id, scheme || '://' || netloc AS origin, CASE WHEN page_id % 3 <> 0 THEN sha256(scheme || '://' || netloc) ELSE 'lost' END AS domain_hash FROM p), known AS (SELECT DISTINCT sha256(scheme || '://' || netloc) AS k FROM p) SELECT page_id, CASE WHEN domain_hash IN (SELECT k FROM known) THEN domain_hash ELSE sha256(origin) END AS domain_hash FROM x")
def orphan_hashes(spark, sf_dir):
    """Hashes that name no domain are made again from the row's own URL."""
    o = U.origin(F.col("url"))
    d = table(spark, sf_dir, "pages").select("page_id", o.alias("origin"), F.when(F.col("page_id") % 3 != 0, F.sha2(o, 256)).otherwise("lost").alias("domain_hash"))
    domains = table(spark, sf_dir, "pages").select(F.sha2(o, 256).alias("domain_hash")).distinct().withColumn("known", F.lit(True))
    return d.join(domains, "domain_hash", "left").select("page_id", F.when(F.col("known"), F.col("domain_hash")).otherwise(F.sha2("origin", 256)).alias("domain_hash"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '|7') LIMIT 100")
def random_hundred(spark, sf_dir):
    """A seeded sample of a fixed size: each task keeps its first hundred."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(R.draw(F.col("doc_id"))).limit(100)


@query("SELECT p_brand, count(*) AS n, max(p_partkey) AS latest FROM part GROUP BY 1 ORDER BY n DESC, latest DESC, p_brand LIMIT 10")
def largest_groups(spark, sf_dir):
    """The ten largest groups, the latest first among equals."""
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_partkey").alias("latest"))
    return g.orderBy(F.desc("n"), F.desc("latest"), "p_brand").limit(10)


@query(f"WITH {_PARTS}, x AS (SELECT netloc, string_split(path, '/')[2] AS folder, page_id FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY md5(page_id::VARCHAR || '|7'), page_id) AS n FROM x) SELECT DISTINCT netloc FROM r WHERE n <= 10")
def hosts_of_folders(spark, sf_dir):
    """The hosts of ten seeded pages of each folder."""
    p = U.split(F.col("url"))
    d = table(spark, sf_dir, "pages").select("page_id", p["netloc"].alias("netloc"), F.get(F.split(p["path"], "/"), F.lit(1)).alias("folder"))
    return R.first_per(d, ["folder"], [R.draw(F.col("page_id")), F.col("page_id")], 10).select("netloc").distinct()


@query("SELECT 'lang' AS class, doc_id FROM documents WHERE lang NOT IN ('de', 'fr') UNION ALL SELECT 'label', vec_id FROM embeddings WHERE label NOT IN (1, 2)")
def combined_classes(spark, sf_dir):
    """Two sets of samples as one, without some of their classes."""
    a = table(spark, sf_dir, "documents").where(~F.col("lang").isin("de", "fr")).select(F.lit("lang").alias("class"), "doc_id")
    return a.unionByName(table(spark, sf_dir, "embeddings").where(~F.col("label").isin(1, 2)).select(F.lit("label").alias("class"), F.col("vec_id").alias("doc_id")))


@query("SELECT n_regionkey, to_json(list({'n_nationkey': n_nationkey, 'n_name': n_name} ORDER BY n_nationkey))::VARCHAR AS nations FROM nation GROUP BY 1")
def json_groups(spark, sf_dir):
    """Each group's rows as a JSON array of objects."""
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("nations"))


@query("SELECT label, vec_id % 7 AS anchor, count(*) AS n FROM embeddings GROUP BY 1, 2")
def anchor_counts(spark, sf_dir):
    """How many anchors of each known label a predicted cluster has."""
    return table(spark, sf_dir, "embeddings").groupBy("label", (F.col("vec_id") % 7).alias("anchor")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, 999 + row_number() OVER (ORDER BY s_name DESC) + (SELECT max(c_custkey) FROM customer) - 999 AS id FROM supplier")
def next_ids(spark, sf_dir):
    """Ids for new rows: the numbers after the greatest there is."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name")).withColumn("back", -F.regexp_extract("name", r"(\d+)", 1).cast("long"))
    existing = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return R.new_ids(s, existing, "id", ["back"]).select("s_suppkey", "id")


@query("WITH x AS (SELECT unnest(['CVE-' || p_size, '', 'CVE-' || p_size + p_partkey % 3]) AS cve FROM part) SELECT DISTINCT cve FROM x WHERE cve <> '' AND cve NOT IN (SELECT 'CVE-' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)")
def open_flaws(spark, sf_dir):
    """Distinct flaws of arrays that aren't known yet."""
    name = lambda c: F.concat(F.lit("CVE-"), c.cast("string"))
    arrays = F.array(name(F.col("p_size")), F.lit(""), name(F.col("p_size") + F.col("p_partkey") % 3))
    x = table(spark, sf_dir, "part").select(F.explode(F.array_remove(arrays, "")).alias("cve")).distinct()
    return x.join(table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(name(F.col("s_suppkey")).alias("cve")), "cve", "left_anti")


@query("SELECT c_custkey, 'mün' || c_custkey || '.exämple.org' AS host, true AS coded FROM customer")
def unicode_hosts(spark, sf_dir):
    """Hosts written in punycode, read again."""
    made = F.concat(F.lit("mün"), F.col("c_custkey").cast("string"), F.lit(".exämple.org"))
    d = table(spark, sf_dir, "customer").select("c_custkey", H.ascii_host(made).alias("coded"))
    return d.select("c_custkey", H.unicode_host(F.col("coded")).alias("host"), F.col("coded").rlike(r"^xn--mn[0-9]+-[0-9a-z]+\.xn--exmple-[0-9a-z]+\.org$").alias("coded"))


_IPS = "CASE c_custkey % 8 WHEN 0 THEN '10.0.' || c_custkey % 256 || '.1' WHEN 1 THEN '10.0.' || (c_custkey % 256 + 256) || '.1' WHEN 2 THEN '2001:db8::' || c_custkey % 10000 WHEN 3 THEN '::ffff:1.2.3.' || c_custkey % 200 WHEN 4 THEN '1:2:3:4:5:6:7:' || c_custkey % 10 WHEN 5 THEN '1:2:3:4:5:6:7' WHEN 6 THEN 'h' || c_custkey || '.org' ELSE '1::2::' || c_custkey % 10 END"


@query(f"SELECT c_custkey, c_custkey % 8 IN (0, 2, 3, 4) AS is_ip FROM customer")
def address_hosts(spark, sf_dir):
    """Which hosts are addresses of either kind."""
    return table(spark, sf_dir, "customer").select("c_custkey", U.is_ip(F.expr(_IPS)).alias("is_ip"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 AND event_id % 3 <> 0 THEN CASE WHEN event_type = 'view' THEN '200' ELSE '404' END END AS status FROM events")
def job_headers(spark, sf_dir):
    """The status among a visit's requests of the one whose URL is the job's, but for a slash at the end."""
    e = table(spark, sf_dir, "events")
    job = F.concat(F.lit("https://h"), F.col("user_id").cast("string"), F.lit(".example"))
    lines = F.array(F.concat(F.lit("HTTP/1.1 "), F.when(F.col("event_type") == "view", "200 OK").otherwise("404 Not Found")), F.lit("x: y"))
    own = F.concat(job, F.when(F.col("user_id") % 2 == 0, "/").otherwise("/a"))
    requests = F.when(F.col("event_id") % 3 != 0, F.array(F.struct(F.lit("https://other/").alias("url"), F.array(F.lit("HTTP/1.1 500 No")).alias("headers")), F.struct(own.alias("url"), lines.alias("headers"))))
    found = X.headers_of_job(requests, job)
    return e.select("event_id", X.headers(F.get(found, F.lit(0)))["status"].alias("status"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'Timeout error' WHEN 'click' THEN 'Too many redirects' WHEN 'view' THEN 'SSLError' WHEN 'signup' THEN 'odd ' || user_id END AS error FROM events")
def failure_texts(spark, sf_dir):
    """What is written for requests that failed in different ways."""
    kind = F.col("event_type")
    cls = F.when(kind == "error", "Timeout").when(kind == "click", "TooManyRedirects").when(kind == "view", "SSLError").when(kind == "signup", "ValueError")
    return table(spark, sf_dir, "events").select("event_id", K.failure_text(cls, F.concat(F.lit("odd "), F.col("user_id").cast("string"))).alias("error"))


@query("SELECT page_id, url || ' <b>&</b> ' || chr((33 + page_id % 90)::INT) || chr((8364 + page_id % 50)::INT) AS text FROM pages")
def unescaped(spark, sf_dir):
    """Texts with named, decimal and hexadecimal references, decoded."""
    coded = F.concat(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" &lt;b&gt;&amp;&lt;/b&gt; &#"), (33 + F.col("page_id") % 90).cast("string"), F.lit(";&#x"), F.hex(8364 + F.col("page_id") % 50), F.lit(";"))
    return table(spark, sf_dir, "pages").select("page_id", U.unescape(coded).alias("text"))


@query(r"""SELECT item_id, regexp_replace(text, '([\\().|^$*+?\[\]])', '\\\1', 'g') AS escaped, length(regexp_replace(text, '[\x20-\x7F]', '', 'g')) AS odd, lpad(bin(item_id), 8, '0') AS bits, hex(encode(text)) AS again, substr(lpad(item_id::VARCHAR, 6, '0'), 1) AS digits, lpad(hex(item_id), 4, '0') AS code,
'(' || item_id || ')\n' AS plain, '\(' || item_id || '\)' || '\n' AS string FROM benchmark""")
def conversions(spark, sf_dir):
    """Escapes, counts and conversions of texts and numbers."""
    text, i = F.col("text"), F.col("item_id")
    raw = F.concat(F.lit("("), i.cast("string"), F.lit(")\n"))
    again = K.bytes_of(K.bits_of(text.cast("binary")))
    return table(spark, sf_dir, "benchmark").select("item_id", K.regex_escape(text).alias("escaped"), K.non_printable(text).cast("long").alias("odd"), K.bits(i).alias("bits"), F.hex(again).alias("again"), K.number_text(i, 6).alias("digits"), F.hex(K.number_hex(i, 2)).alias("code"), F.replace(raw, F.lit("\n"), F.lit("\\n")).alias("plain"), K.string_escape(raw).alias("string"))


@query("SELECT s_suppkey, 'a:' || s_nationkey || ',b:' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ',c:2' ELSE '' END AS merged FROM supplier")
def merged_maps(spark, sf_dir):
    """Maps of maps as one; equal keys have equal values."""
    one = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in kv])
    a = F.create_map(F.lit("k"), one("a", F.col("s_nationkey")))
    b = F.create_map(F.lit("k"), F.map_concat(one("b", F.col("s_suppkey"), "a", F.col("s_nationkey")), F.when(F.col("s_suppkey") % 2 == 0, one("c", "2")).otherwise(F.create_map().cast("map<string,string>"))))
    inner = F.map_entries(K.merge_maps(a, b, 2)["k"])
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.transform(F.array_sort(inner), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("merged"))


@query("SELECT doc_id, filter, md5(text) AS md5 FROM documents, (SELECT unnest(['ASCIIHexDecode', 'ASCII85Decode', 'FlateDecode', 'RunLengthDecode', 'LZWDecode']) AS filter) WHERE text IS NOT NULL")
def stream_filters(spark, sf_dir):
    """Texts encoded and decoded by each stream filter of PDF files."""
    import hashlib

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names = list(pdf_filters.ENCODERS)
                digests = [hashlib.md5(pdf_filters.decode(pdf_filters.encode(text, [n]), [n], [])[0]).hexdigest() for n in names]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i] * len(names), pa.int64()), "filter": names, "md5": digests})

    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, filter string, md5 string")


@query("""WITH e AS (SELECT vec_id, label, label - 1 AS cluster, CASE WHEN label % 4 > 0 THEN label * 10 + vec_id % (label % 4) END AS known FROM embeddings),
a AS (SELECT cluster, known, CASE WHEN label % 4 = 3 THEN known ELSE label END AS campaign FROM e WHERE known IS NOT NULL QUALIFY row_number() OVER (PARTITION BY known ORDER BY md5(vec_id::VARCHAR || '|7')) <= 20)
SELECT DISTINCT x.known AS first, y.known AS second FROM a x JOIN a y ON x.cluster = y.cluster AND x.known < y.known AND x.campaign <> y.campaign""")
def cluster_conflicts(spark, sf_dir):
    """Pairs of known clusters of different campaigns that meet in one cluster."""
    e, anchors, campaigns = _clusters(spark, sf_dir)
    return C.conflict_log(e.select("id", "cluster"), anchors.select("id", "known"), campaigns)


@query("SELECT 'A new cluster has been created: ' || chr(10) || string_agg('New cluster with id:' || o_orderkey, ' ' || chr(10) ORDER BY o_orderkey) AS text FROM orders WHERE o_orderdate::DATE = DATE '1998-01-05' HAVING count(*) > 0")
def cluster_notice(spark, sf_dir):
    """The message about a day's new rows."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("made_on"))
    return C.new_cluster_notice(o, "1998-01-05")


@query()
def plane_projection(spark, sf_dir):
    """Embeddings along their two principal axes."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return V.projected(e, "embedding", *V.principal_axes(e, "embedding")).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""WITH a AS (SELECT user_id, ts, event_type = 'error' AS failed FROM events), f AS (SELECT user_id, min((ts, failed)) AS l FROM a GROUP BY 1),
s AS (SELECT a.user_id, min((ts, failed)) AS l FROM a JOIN f ON f.user_id = a.user_id AND f.l[2] AND a.ts >= f.l[1] + INTERVAL 5 HOUR GROUP BY 1), t AS (SELECT a.user_id, min((ts, failed)) AS l FROM a JOIN s ON s.user_id = a.user_id AND s.l[2] AND a.ts >= s.l[1] + INTERVAL 5 HOUR GROUP BY 1)
SELECT f.user_id, (1 + (s.l IS NOT NULL)::INT + (t.l IS NOT NULL)::INT) AS attempts, NOT coalesce(t.l, s.l, f.l)[2] AS reached FROM f LEFT JOIN s USING (user_id) LEFT JOIN t USING (user_id)""")
def spaced_retries(spark, sf_dir):
    """Up to two further attempts, each at least five hours after a failure."""
    return R.spaced_attempts(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "error", wait="5 hours")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'direct' ELSE 'rescan' END AS found FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0")
def two_pass_scan(spark, sf_dir):
    """Results of a first scan, and of a second one where the first missed."""
    k = table(spark, sf_dir, "orders").select("o_orderkey")
    direct = k.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "direct").alias("found"))
    return sinks.two_pass(direct, k.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("rescan").alias("found")), ["o_orderkey"], F.col("found").isNotNull())


@query("SELECT user_id, event_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS waited FROM events")
def request_log(spark, sf_dir):
    """How long after the one before each request of a key was made, in microseconds."""
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", (micros(F.col("ts")) - micros(before)).alias("waited"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def valid_samples(spark, sf_dir):
    """Samples that a capture exists for."""
    captured = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(captured, "l_orderkey", "left_semi")


@query(f"SELECT c_custkey, campaigns >= 2 AS covered FROM (SELECT c_custkey, (c_nationkey % 2 = 0)::INT + (c_nationkey % 3 = 0)::INT + (c_nationkey % 5 = 0)::INT AS campaigns FROM customer)")
def array_superset(spark, sf_dir):
    """Whether an array of clusters has all of two that are asked for, among those it may have."""
    has = F.array_compact(F.array(*[F.when(F.col("c_nationkey") % n == 0, F.lit(n)) for n in (2, 3, 5)]))
    pairs = [F.array(F.lit(a), F.lit(b)) for a, b in ((2, 3), (2, 5), (3, 5))]
    every = [F.size(F.array_except(p, has)) == 0 for p in pairs]
    return table(spark, sf_dir, "customer").select("c_custkey", (every[0] | every[1] | every[2]).alias("covered"))




def _escaped_script(i, url):
    """A script that hides a URL in wide escapes behind many others, in one string or in two variables."""
    pairs = F.regexp_extract_all(F.hex(url.cast("binary")), F.lit("(..)(..)"), F.lit(0))
    wide = F.array_join(F.transform(pairs, lambda x: F.concat(F.lit("%u"), F.substring(x, 3, 2), F.substring(x, 1, 2))), "")
    whole = F.concat(F.lit('var s = unescape("'), F.lit("%u9090" * 40), wide, F.lit('");'))
    split = F.concat(F.lit("var a = '" + "%u9090" * 40 + "'; var b = '"), wide, F.lit("'; var s = unescape(a + b);"))
    return F.when(i % 3 == 0, whole).when(i % 3 == 1, split).otherwise('var s = unescape("%u7468%u7074");')


@query("SELECT page_id, url || repeat('/', (length(url) % 2)::INT) AS url FROM pages WHERE page_id % 3 <> 2")
def script_urls(spark, sf_dir):
    """URLs in long escaped strings of scripts, whose variables are followed."""
    even = F.concat("url", F.when(F.length("url") % 2 == 1, "/").otherwise(""))
    d = table(spark, sf_dir, "pages").select("page_id", _escaped_script(F.col("page_id"), even).alias("code"))
    return d.select("page_id", F.explode(S.hidden_urls(F.col("code"))).alias("url"))


@query("SELECT c_custkey, 'var x=' || chr(39) || c_name || chr(39) || ';alert(x)' AS script, true AS whole FROM customer")
def unpacked_scripts(spark, sf_dir):
    """Packed scripts made readable: a template in base 62, and percent encoding around it in every second one."""
    packed = F.concat(F.lit("eval(function(p,a,c,k,e,d){while(c--){p=p.replace(c,k[c])}return p}('0 1=\\'2\\';3(1)',62,4,'var|x|"), F.col("c_name"), F.lit("|alert'.split('|'),0,{}))"))
    coded = F.url_encode(packed)
    coded = F.replace(coded, F.lit("+"), F.lit("%20"))
    d = table(spark, sf_dir, "customer").select("c_custkey", unpack.unpack(F.when(F.col("c_custkey") % 2 == 0, packed).otherwise(coded)).alias("u"))
    return d.select("c_custkey", "u.script", "u.whole")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 3) ** 2)) ** 0.5 / 3, 4) AS length, 1.0::DOUBLE AS unit FROM embeddings")
def unit_vectors(spark, sf_dir):
    """Lengths of vectors, and of the same three times as long brought to unit length."""
    long = F.transform("embedding", lambda x: x.cast("double") * 3)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(size(F.col("embedding")), 4).alias("length"), F.round(size(V.normalise(long)), 6).alias("unit"))


_LOSSES = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, vec_id // 64 AS batch FROM embeddings), p AS (SELECT a.id AS a, b.id AS b, a.v AS av, a.label, a.batch, list_distance(a.v, b.v) ** 2 AS d FROM e a JOIN e b ON a.batch = b.batch AND a.label = b.label AND a.id < b.id),
l AS (SELECT p.a, p.b, n.id, p.d - list_distance(p.av, n.v) ** 2 + 0.2 AS loss FROM p JOIN e n ON n.batch = p.batch AND n.label <> p.label)"""


@query(f"""{_LOSSES}
SELECT count(*) AS triplets, round(sum(loss), 3) AS loss FROM l WHERE loss > 0""")
def all_triplets(spark, sf_dir):
    """Every triplet of a training batch whose loss is above zero."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label", F.floor(F.col("vec_id") / 64).alias("batch"))
    return C.mine_triplets(e, 0.2, "all").where("negative IS NOT NULL").agg(F.count("*").alias("triplets"), F.round(F.sum("loss"), 3).alias("loss"))


def _mined(spark, sf_dir, rule, within):
    """How many pairs of training batches get a triplet by a rule, that each has one, and that its loss is of the rule's kind."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label", F.floor(F.col("vec_id") / 64).alias("batch"))
    t = C.mine_triplets(e, 0.2, rule).where("negative IS NOT NULL")
    return t.groupBy("anchor", "positive").agg(F.count("*").alias("picked"), F.bool_and(within(F.col("loss"))).alias("fits"))


@query(f"{_LOSSES} SELECT a AS anchor, b AS positive, 1::BIGINT AS picked, true AS fits FROM l WHERE loss > 0 GROUP BY ALL")
def random_triplets(spark, sf_dir):
    """One triplet for each pair that has any with a loss above zero, drawn among them."""
    return _mined(spark, sf_dir, "random", lambda loss: loss > 0)


@query(f"{_LOSSES} SELECT a AS anchor, b AS positive, 1::BIGINT AS picked, true AS fits FROM l WHERE loss > 0 AND loss < 0.2 GROUP BY ALL")
def semihard_triplets(spark, sf_dir):
    """One triplet for each pair that has any whose negative is farther than the positive, by less than the margin."""
    return _mined(spark, sf_dir, "semihard", lambda loss: (loss > 0) & (loss < 0.2))


@query("""WITH k AS (SELECT client_id, list_sort(list(DISTINCT kind)) AS kinds FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL GROUP BY 1)
SELECT c.client_id, array_to_string(list_sort(list_intersect(a.kinds, b.kinds)), ',') AS both_kinds, list_has_all(a.kinds, b.kinds) AS has_all FROM clients c JOIN k a ON a.client_id = c.client_id JOIN k b ON b.client_id = c.master_id""")
def kind_sets(spark, sf_dir):
    """Kinds of clicks that a client and its master share, and whether the client has all of the master's."""
    k = table(spark, sf_dir, "clicks").where("client_id IS NOT NULL AND kind IS NOT NULL").groupBy("client_id").agg(F.collect_set("kind").alias("kinds"))
    c = table(spark, sf_dir, "clients").select("client_id", "master_id")
    met = c.join(k, "client_id").join(k.select(F.col("client_id").alias("master_id"), F.col("kinds").alias("theirs")), "master_id")
    return met.select("client_id", F.array_join(F.array_sort(F.array_intersect("kinds", "theirs")), ",").alias("both_kinds"), (F.size(F.array_except("theirs", "kinds")) == 0).alias("has_all"))


@query("SELECT page_id, member, md5(url || '|' || member) AS body FROM pages, (SELECT unnest(['job.json', 'bodies.zip/body.txt', 'log.json']) AS member)")
def archive_members(spark, sf_dir):
    """Members of zip archives made of pages, one of them an archive itself and one packed by gzip."""
    import gzip
    import io
    import zipfile

    import pyarrow as pa

    def made(url, i):
        text = lambda member: f"{url}|{member}".encode()
        inner, outer = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(inner, "w") as z:
            z.writestr("body.txt", text("bodies.zip/body.txt"))
        with zipfile.ZipFile(outer, "w") as z:
            z.writestr("job.json", text("job.json"))
            z.writestr("bodies.zip", inner.getvalue())
            z.writestr("log.json.gz", gzip.compress(text("log.json")))
        return {"path": str(i), "content": outer.getvalue()}

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([made(u, i) for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    zips = table(spark, sf_dir, "pages").select("page_id", "url").mapInArrow(run, "path string, content binary")
    found = files.archive_members(zips).where("error IS NULL")
    return found.select(F.col("path").cast("long").alias("page_id"), "member", F.md5(F.col("body").cast("binary")).alias("body"))


@query("SELECT n_nationkey, upper(n_name) AS line, 2 AS copies FROM nation")
def files_round_trip(spark, sf_dir):
    """Lines and dated copies, written to the shared folder and read again."""
    import uuid

    from quillmesh.operators.storage import shared_root

    root = f"{shared_root(spark)}/quillmesh/files-{uuid.uuid4().hex}"
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    n.select(F.concat_ws(" ", F.lit(""), F.col("n_nationkey").cast("string"), F.upper("n_name"), F.lit("")).alias("value")).write.text(f"{root}/lines")
    for day in ("2024-01-14", "2024-01-15", "2024-01-15"):
        sinks.dated(n, f"{root}/copies", day)
    parts = F.split("line", " ", 2)
    lines = files.lines(spark, f"{root}/lines").select(parts[0].cast("int").alias("n_nationkey"), parts[1].alias("line"))
    copies = spark.read.parquet(f"{root}/copies").groupBy("n_nationkey").agg(F.count("*").cast("int").alias("copies"))
    return lines.join(copies, "n_nationkey")


@query("SELECT s_suppkey, '{\"Name\":\"n&' || s_suppkey || '\",\"Contents\":' || CASE WHEN s_suppkey % 2 = 0 THEN '[{\"Key\":\"a\",\"Size\":\"' || s_nationkey || '\"},{\"Key\":\"b\",\"Size\":\"\"}]' ELSE '{\"Key\":\"a\",\"Size\":\"' || s_nationkey || '\"}' END || '}' AS json FROM supplier")
def xml_objects(spark, sf_dir):
    """XML without a schema as JSON, repeated tags as lists."""
    one = lambda key, size: F.concat(F.lit(f"<Contents><Key>{key}</Key><Size>"), size, F.lit("</Size></Contents>"))
    xml = F.concat(F.lit("<r><Name>n&amp;"), F.col("s_suppkey").cast("string"), F.lit("</Name>"), one("a", F.col("s_nationkey").cast("string")), F.when(F.col("s_suppkey") % 2 == 0, one("b", F.lit(""))).otherwise(""), F.lit("</r>"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", J.xml_as_json(xml).alias("json"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'UNKNOWN' ELSE 'DENIED' END WHEN event_type = 'purchase' OR event_id % 5 = 0 THEN 'UNKNOWN' ELSE 'DENIED' END AS all_acl, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'DENIED' ELSE 'UNKNOWN' END WHEN event_type = 'purchase' OR event_id % 5 = 0 THEN 'UNKNOWN' WHEN event_id % 3 = 0 THEN 'ALLOWED' ELSE 'DENIED' END AS auth_acl,
CASE WHEN event_type IN ('error', 'purchase') OR event_id % 5 = 0 THEN 'UNKNOWN' WHEN event_id % 3 <> 0 THEN 'ALLOWED' ELSE 'DENIED' END AS all_write FROM events""")
def access_list_rights(spark, sf_dir):
    """What attempts to read access lists say: the list's own grants, a denial for the group that asked, or nothing."""
    i = F.col("event_id")
    code = F.when(F.col("event_type") == "error", "AllAccessDisabled").when(F.col("event_type") == "purchase", "SlowDown")
    grant = F.when(i % 3 == 0, F.struct(F.lit(X.AUTH_USERS).alias("uri"), F.lit("READ_ACP").alias("permission"))).otherwise(F.struct(F.lit(X.ALL_USERS).alias("uri"), F.lit("WRITE").alias("permission")))
    r = X.access_list_right(code, i % 2 == 0, F.when(i % 5 != 0, F.array(grant)))
    return table(spark, sf_dir, "events").select("event_id", r["AllUsersReadACP"].alias("all_acl"), r["AuthUsersReadACP"].alias("auth_acl"), r["AllUsersWrite"].alias("all_write"))
