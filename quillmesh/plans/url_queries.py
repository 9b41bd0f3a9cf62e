"""URLs and links of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import url as U
from quillmesh.operators import hosts as H
from quillmesh.operators import relational as R

from quillmesh.sources.files import suffix_kind

from .registry import literal, query, table, values_sql

#: Lines that a made-up suffix list begins with; thousands of numbered ones follow.
SUFFIX_LINES = ("// example", "com", "org", "net", "co.uk", "example.net", "*.example.org", "!m.example.org", "*.ck", "!www.ck", '// xn--p1ai ("rf", Russian-Cyrillic) : RU')
SUFFIXES = 6000


def suffix_lines_table(spark):
    """line: a list as the public one is written, with SUFFIXES numbered rules of all kinds."""
    n = F.col("id").cast("string")
    made = F.when(F.col("id") % 5 == 0, F.concat(F.lit("*.w"), n, F.lit(".zone"))).when(F.col("id") % 5 == 1, F.concat(F.lit("!x.w"), (F.col("id") - 1).cast("string"), F.lit(".zone"))).when(F.col("id") % 5 == 2, F.concat(F.lit("// xn--"), n, F.lit(' ("made") : XX'))).otherwise(F.concat(F.lit("s"), n, F.lit(".b.co")))
    return spark.range(SUFFIXES).select(made.alias("line")).union(literal(spark, "line string", [(x,) for x in SUFFIX_LINES]))


def suffixes(spark):
    k = suffix_kind(F.col("line"))
    return suffix_lines_table(spark).select(*[c.alias(n) for n, c in k.items()]).where("kind IS NOT NULL").distinct()


_SUFFIXES = rf"""sl AS (SELECT CASE id % 5 WHEN 0 THEN '*.w' || id || '.zone' WHEN 1 THEN '!x.w' || (id - 1) || '.zone' WHEN 2 THEN '// xn--' || id || ' ("made") : XX' ELSE 's' || id || '.b.co' END AS line FROM range({SUFFIXES}) t(id) UNION ALL SELECT * FROM (VALUES {', '.join("('" + x.replace("'", "''") + "')" for x in SUFFIX_LINES)}) v(line)),
sk AS (SELECT line, CASE WHEN line LIKE '// xn--%' THEN regexp_extract(line, '^// (\S+)', 1) WHEN line LIKE '//%' THEN NULL WHEN line LIKE '*.%' THEN substr(line, 3) WHEN line LIKE '!%' THEN substr(line, 2) ELSE line END AS suffix,
  CASE WHEN line LIKE '// xn--%' THEN 'punycode' WHEN line LIKE '//%' THEN NULL WHEN line LIKE '*.%' THEN 'wildcard' WHEN line LIKE '!%' THEN 'exception' ELSE 'exact' END AS kind FROM sl)"""


def _suffix_sql(source: str, key: str) -> str:
    """CTE sx (key, l, suffix, registered) for hosts in column host of a source with a unique key."""
    return f"""{_SUFFIXES}, sh AS (SELECT {key}, string_split(host, '.') AS l FROM {source}), st AS (SELECT {key}, l, len(l) AS n, unnest(range(1, len(l) + 1))::INT AS k FROM sh),
sm AS (SELECT st.{key}, l, n, k, kind FROM st JOIN sk ON sk.suffix = array_to_string(l[n - k + 1:], '.')),
sx AS (SELECT {key}, any_value(l) AS l, coalesce(max(k - 1) FILTER (kind = 'exception'), max(CASE WHEN kind = 'wildcard' AND n > k THEN k + 1 WHEN kind IN ('exact', 'punycode') THEN k END)) AS m FROM sm GROUP BY 1),
sr AS (SELECT {key}, array_to_string(l[len(l) - m + 1:], '.') AS suffix, CASE WHEN len(l) > m THEN array_to_string(l[len(l) - m:], '.') END AS registered FROM sx WHERE m IS NOT NULL)"""


_S = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_PARTS = rf"""
p0 AS (SELECT *, regexp_replace(url, '{_S}', '') AS rest FROM pages),
p1 AS (SELECT *, regexp_replace(rest, '^//[^/?#]*', '') AS after FROM p0),
p AS (SELECT *, lower(regexp_extract(url, '{_S}', 1)) AS scheme, regexp_extract(rest, '^//([^/?#]*)', 1) AS netloc,
  regexp_replace(regexp_extract(after, '^([^?#]*)', 1), ';[^/]*$', '') AS path, regexp_extract(regexp_extract(after, '^([^?#]*)', 1), ';([^/]*)$', 1) AS params,
  regexp_extract(after, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(after, '#(.*)$', 1) AS fragment FROM p1)"""
_HOST = r"lower(regexp_replace(regexp_replace(netloc, '^.*@', ''), ':\d*$', ''))"
_FLAGS = rf"""
hh AS (SELECT *, {_HOST} AS host FROM p), {_suffix_sql('hh', 'page_id')},
f AS (SELECT hh.*, regexp_matches(url, '^[/#]') AS is_relative_url, regexp_full_match(url, 'http(s)?(://)?') AS is_empty,
  scheme = '' AND netloc = '' AND regexp_matches(url, '^[^@]+@[^@]+\.[^@]+') AS is_email, scheme LIKE 'http%' AS has_http_scheme,
  netloc LIKE '%127.0.0%' OR netloc LIKE '%192.168.%' OR netloc = 'localhost' AS is_local,
  regexp_matches(netloc, '[^(*?:@)+\w.~ \-]') AS has_invalid_char, suffix IS NOT NULL OR regexp_matches(netloc, '^([^@]*@)?\d+\.\d+\.\d+\.\d+') AS has_valid_tld,
  contains(substr(url, length(scheme) + 4 + length(netloc)), '.pdf') AS is_pdf FROM hh LEFT JOIN sr ON sr.page_id = hh.page_id)"""


def _with_suffix(spark, pages):
    """pages (page_id, url) with host, suffix and registered."""
    return H.with_suffix(pages.withColumn("host", H.host_of(U.split(F.col("url"))["netloc"])), "host", suffixes(spark))


@query(f"WITH {_PARTS} SELECT page_id, scheme, netloc, path, params, query, fragment, array_to_string(list_filter(list_transform(string_split(path, '/'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM p")
def url_split(spark, sf_dir):
    p = U.split(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in p.items()], F.array_join(U.path_parts(p["path"]), "|").alias("parts"))


@query("SELECT page_id, url AS again FROM pages")
def url_unsplit(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.unsplit(U.split(F.col("url"))).alias("again"))


@query(f"WITH {_PARTS}, {_FLAGS} SELECT page_id, is_relative_url, is_empty, is_email, has_http_scheme, is_local, has_invalid_char, has_valid_tld, is_pdf FROM f")
def url_flags(spark, sf_dir):
    f = U.flags(F.col("url"), F.col("suffix"))
    return _with_suffix(spark, table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", *[c.alias(n) for n, c in f.items()])


@query(f"WITH {_PARTS}, a AS (SELECT page_id, scheme, netloc, list_filter(list_transform(string_split(path, '/'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM p) SELECT page_id, scheme || '://' || netloc AS origin, array_to_string(parts[1:greatest(len(parts) - 1, 0)], '/') AS directory FROM a")
def url_netloc_path(spark, sf_dir):
    p = U.split(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", U.origin(F.col("url")).alias("origin"), F.array_join(U.directory(U.path_parts(p["path"])), "/").alias("directory"))


@query(f"""WITH {_PARTS}, {_FLAGS},
v AS (SELECT user_id, event_type = 'error' AS failed, ts, event_id, max(CASE WHEN event_type <> 'error' THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS ok FROM events),
s AS (SELECT user_id, count(*) FILTER (failed AND (ok IS NULL OR (ts, event_id) > ok)) AS offline_count FROM v GROUP BY user_id)
SELECT DISTINCT url, s.user_id IS NULL AS first_visit FROM f LEFT JOIN s ON page_id = user_id
WHERE has_http_scheme AND NOT is_email AND NOT is_empty AND NOT is_relative_url AND NOT is_local AND NOT has_invalid_char AND has_valid_tld
  AND NOT contains(netloc, 'casino-win') AND coalesce(offline_count, 0) < 3""")
def clean_urls_to_visit(spark, sf_dir):
    """Live, clean URLs to visit, and whether each is visited for the first time."""
    pages, events = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "events")
    state = R.fold_visits(events.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    url = F.col("url")
    wanted = _with_suffix(spark, pages).where(U.clean(U.flags(url, F.col("suffix")), pdf=False) & ~U.split(url)["netloc"].contains("casino-win"))
    joined = wanted.join(state, F.col("page_id") == F.col("user_id"), "left").where(F.coalesce("offline_count", F.lit(0)) < 3)
    return joined.select("url", F.col("user_id").isNull().alias("first_visit")).distinct()


_FOLDERS = ("ckfinder", "FCKeditor/ckfinder", "ckeditor/kcfinder", "super-forms", "f?p=formidable#x", "plain", "sites/webform", "ckeditor", "FormCraft", "fckeditor", "CKimage")
_HOSTS = ("a.com", "b.s3.amazonaws.com", "storage.googleapis.com", "x.oss-cn.aliyuncs.com", "n.nyc3.digitaloceanspaces.com", "ckeditor.com")
_PLUGIN = f"'https://' || CASE c_custkey % 6 {' '.join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HOSTS))} END || '/up/' || CASE c_custkey % 11 {' '.join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FOLDERS))} END || '/' || c_custkey || '.pdf'"


@query(f"""WITH t AS (SELECT c_custkey, {_PLUGIN} AS url FROM customer), x AS (SELECT c_custkey, url, lower(regexp_replace(url, '^[a-z]+://[^/?#]*', '')) AS s FROM t)
SELECT c_custkey, CASE WHEN s LIKE '%ckfinder%' OR s LIKE '%ckimage%' THEN 'ckfinder' WHEN s LIKE '%kcfinder%' THEN 'kcfinder' WHEN s LIKE '%fckeditor%' THEN 'fckeditor' WHEN s LIKE '%ckeditor%' THEN 'ckeditor'
  WHEN s LIKE '%formcraft%' THEN 'formcraft' WHEN s LIKE '%webform%' OR s LIKE '%super-forms%' THEN 'webform' WHEN s LIKE '%formidable%' THEN 'formidable' END AS component,
  CASE WHEN url LIKE '%aliyuncs.com%' THEN 'aliyun' WHEN url LIKE '%storage.googleapis.com%' THEN 'gcp' WHEN url LIKE '%amazonaws%' THEN 'aws' WHEN url LIKE '%digitaloceanspaces.com%' THEN 'digitalocean' END AS service FROM x""")
def guessed_component(spark, sf_dir):
    """The component that a URL's path suggests, the first rule of several, and the storage service of its host."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(_PLUGIN).alias("url")).select("c_custkey", U.component(F.col("url")).alias("component"), U.service(F.col("url")).alias("service"))


@query(f"WITH {_PARTS}, hh AS (SELECT *, {_HOST} AS host FROM p), {_suffix_sql('hh', 'page_id')} SELECT hh.page_id, suffix, registered FROM hh LEFT JOIN sr ON sr.page_id = hh.page_id")
def registered_domain(spark, sf_dir):
    """The longest public suffix of a page's host and the domain registered under it, by a list of thousands of rules."""
    return _with_suffix(spark, table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "suffix", "registered")


_MADE = "CASE c_custkey % 9 WHEN 0 THEN 'a.b.w' || c_custkey % 6000 || '.zone' WHEN 1 THEN 'a.x.w' || (c_custkey % 6000 - 1) || '.zone' WHEN 2 THEN 'host.xn--' || c_custkey % 6000 WHEN 3 THEN 'a.s' || c_custkey % 6000 || '.b.co' WHEN 4 THEN 's' || c_custkey % 6000 || '.b.co' WHEN 5 THEN 'no.suffix' || c_custkey WHEN 6 THEN 'a.www.ck' WHEN 7 THEN 'ck' ELSE 'x.y.xn--p1ai' END"


@query(f"WITH hh AS (SELECT c_custkey, {_MADE} AS host FROM customer), {_suffix_sql('hh', 'c_custkey')} SELECT hh.c_custkey, host, suffix, registered FROM hh LEFT JOIN sr ON sr.c_custkey = hh.c_custkey")
def suffix_kinds(spark, sf_dir):
    """Suffixes by rules of all kinds: exact, wildcard, exception and punycode, and hosts that no rule fits."""
    d = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_MADE).alias("host"))
    return H.with_suffix(d, "host", suffixes(spark))


@query(f"""WITH {_PARTS.replace('FROM pages)', "FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN split_part(split_part(url, '?', 1), '#', 1) || '/file' || page_id || '.pdf' WHEN 2 THEN replace(url, 'example', 'exa_mple€') || '.pdf' ELSE 'http://192.168.0.' || page_id % 200 || '/x.pdf' END AS url FROM pages))")}, {_FLAGS}
SELECT page_id, url FROM f WHERE has_http_scheme AND NOT is_email AND NOT is_empty AND NOT is_relative_url AND NOT is_local AND NOT has_invalid_char AND has_valid_tld AND is_pdf""")
def clean_pdf_urls(spark, sf_dir):
    """Clean URLs of PDF files, among URLs of other kinds, local addresses and hosts that can't be."""
    i, url = F.col("page_id"), F.col("url")
    plain = F.substring_index(F.substring_index(url, "?", 1), "#", 1)
    made = F.when(i % 4 == 0, url).when(i % 4 == 1, F.concat(plain, F.lit("/file"), i.cast("string"), F.lit(".pdf"))).when(i % 4 == 2, F.concat(F.replace(url, F.lit("example"), F.lit("exa_mple€")), F.lit(".pdf"))).otherwise(F.concat(F.lit("http://192.168.0."), (i % 200).cast("string"), F.lit("/x.pdf")))
    d = _with_suffix(spark, table(spark, sf_dir, "pages").select("page_id", made.alias("url")))
    return d.where(U.clean(U.flags(url, F.col("suffix")))).select("page_id", "url")


_HREFS = r"""h AS (SELECT page_id, url AS site, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1), 1) - 1 AS pos FROM pages)"""


def _links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("site"), F.posexplode(U.hrefs(F.col("html"))).alias("pos", "href"))


@query(f"WITH {_HREFS} SELECT page_id, pos::INT AS pos, href FROM h")
def href_extract(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "pos", "href")


@query(rf"""WITH {_HREFS}, s AS (SELECT page_id, pos, href, regexp_extract(site, '^([a-z]+://[^/?#]*)', 1) AS base FROM h)
SELECT page_id, pos::INT AS pos, CASE WHEN regexp_matches(href, '^([a-z]+:)?//') THEN CASE WHEN regexp_extract(href, '^(?:[a-z]+:)?//([^/?#]*)', 1) = regexp_extract(base, '//(.*)$', 1) THEN base || regexp_replace(href, '^([a-z]+:)?//[^/?#]*', '') END
  WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL WHEN href = '' OR regexp_matches(href, '^[?#/]') THEN base || href ELSE base || '/' || href END AS target FROM s""")
def href_resolve(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "pos", U.resolve(F.col("site"), F.col("href")).alias("target"))


@query(f"""WITH {_HREFS}, d AS (SELECT DISTINCT page_id, href FROM h WHERE NOT regexp_matches(href, '\\.(png|jpg|jpeg|svg|json|js|txt|xml)$')),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY md5(page_id::VARCHAR || '|' || href || '|7'), href) AS n FROM d) SELECT page_id, href FROM r WHERE n <= 20""")
def href_sample20(spark, sf_dir):
    """At most 20 distinct links of each page, by a seeded order; links to static files don't count."""
    links = _links(spark, sf_dir).where(~F.col("href").rlike(r"\.(png|jpg|jpeg|svg|json|js|txt|xml)$")).select("page_id", "href").distinct()
    return R.first_per(links, ["page_id"], [R.draw(F.col("page_id"), F.col("href")), F.col("href")], 20)


@query(f"""WITH {_HREFS}, c AS (SELECT page_id, href, count(*) AS n FROM h GROUP BY 1, 2), m AS (SELECT page_id, max(n) AS m FROM c GROUP BY 1) SELECT page_id, href, CASE WHEN m > 1 THEN n END AS occurrences FROM c JOIN m USING (page_id)""")
def uri_occurrences(spark, sf_dir):
    """How often each link occurs on its page; null where nothing repeats."""
    n = _links(spark, sf_dir).groupBy("page_id", "href").agg(F.count("*").alias("n"))
    most = n.groupBy("page_id").agg(F.max("n").alias("m"))
    return n.join(most, "page_id").select("page_id", "href", F.when(F.col("m") > 1, F.col("n")).alias("occurrences"))


@query(f"""WITH {_HREFS}, a AS (SELECT DISTINCT page_id, href AS uri FROM h WHERE pos < 4), b AS (SELECT DISTINCT page_id, href AS uri FROM h WHERE pos >= 2)
SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.uri, b.uri) AS uri, a.uri IS NOT NULL AS in_bytes, b.uri IS NOT NULL AS in_tree FROM a FULL JOIN b ON a.page_id = b.page_id AND a.uri = b.uri""")
def full_outer_uri_merge(spark, sf_dir):
    """Links of two extractions side by side."""
    links = _links(spark, sf_dir)
    side = lambda cond, name: links.where(cond).select("page_id", F.col("href").alias("uri")).distinct().withColumn(name, F.lit(True))
    both = side(F.col("pos") < 4, "in_bytes").join(side(F.col("pos") >= 2, "in_tree"), ["page_id", "uri"], "full")
    return both.select("page_id", "uri", F.coalesce("in_bytes", F.lit(False)).alias("in_bytes"), F.coalesce("in_tree", F.lit(False)).alias("in_tree"))


_PROVIDERS = [(1, "casino-win.example.org"), (2, "example.org"), (3, "example.com"), (4, "blog.")]


_PROVIDER_SQL = f"pr AS (SELECT * FROM {values_sql('v(n, provider)', _PROVIDERS)} UNION ALL SELECT 10 + s_suppkey, lower(replace(s_name, '#', '-')) || '.example' FROM supplier)"


def _providers(spark, sf_dir):
    """n and provider: names of hosting providers, some of which page hosts contain."""
    s = table(spark, sf_dir, "supplier").select((10 + F.col("s_suppkey")).alias("n"), F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(".example")).alias("provider"))
    return literal(spark, "n int, provider string", _PROVIDERS).select(F.col("n").cast("long").alias("n"), "provider").union(s)


@query(f"""WITH {_PARTS}, {_PROVIDER_SQL}, m AS (SELECT page_id, min(n) AS n FROM p JOIN pr ON contains(netloc, provider) GROUP BY page_id)
SELECT page_id, coalesce(provider, netloc) AS domain_remapped FROM p LEFT JOIN m USING (page_id) LEFT JOIN pr USING (n)""")
def provider_remap(spark, sf_dir):
    """A page's hosting provider: the first in a table that its host contains, else the host."""
    d = table(spark, sf_dir, "pages").select("page_id", U.split(F.col("url"))["netloc"].alias("netloc"))
    found = H.first_contained(d, "netloc", _providers(spark, sf_dir), "provider", "n", "provider")
    return found.select("page_id", F.coalesce("provider", "netloc").alias("domain_remapped"))


@query(f"WITH {_PARTS}, ex AS (SELECT lower(n_name) AS name FROM nation UNION ALL SELECT 'casino' UNION ALL SELECT 'blog.') SELECT DISTINCT netloc FROM p WHERE NOT EXISTS (SELECT 1 FROM ex WHERE contains(netloc, name))")
def exclusion_filter(spark, sf_dir):
    """Hosts that contain no excluded string, by a table of them."""
    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name")).union(literal(spark, "name string", [("casino",), ("blog.",)]))
    hosts = table(spark, sf_dir, "pages").select(U.split(F.col("url"))["netloc"].alias("netloc")).distinct()
    return H.without_any(hosts, "netloc", names, "name")


@query(rf"WITH {_PARTS}, {_PROVIDER_SQL}, hh AS (SELECT DISTINCT regexp_extract(netloc, '([^.]+\.[^.]+)$', 1) AS domain FROM p UNION SELECT lower(replace(c_name, '#', '-')) FROM customer UNION SELECT lower(replace(s_name, '#', '-')) FROM supplier) SELECT domain FROM hh WHERE NOT EXISTS (SELECT 1 FROM pr WHERE contains(provider, domain))")
def reverse_substring_anti(spark, sf_dir):
    """Domains that occur in no provider's name."""
    domains = table(spark, sf_dir, "pages").select(F.regexp_extract(U.split(F.col("url"))["netloc"], r"([^.]+\.[^.]+)$", 1).alias("domain"))
    for t, c in (("customer", "c_name"), ("supplier", "s_name")):
        domains = domains.union(table(spark, sf_dir, t).select(F.lower(F.replace(c, F.lit("#"), F.lit("-")))))
    return H.within_none(domains.distinct(), "domain", _providers(spark, sf_dir), "provider")


_BUCKET = "CASE c_custkey % 9 WHEN 0 THEN 'x,;0()' || c_custkey WHEN 1 THEN 'files' || c_custkey || '.s3.amazonaws.com' WHEN 2 THEN 'files' || c_custkey || ':us-west-1' WHEN 3 THEN 'my-files' || c_custkey || '.s3-eu-west-1.amazonaws.com' WHEN 4 THEN '' || c_custkey % 100 WHEN 5 THEN '1.2.3.' || c_custkey % 256 WHEN 6 THEN 'a..b' || c_custkey WHEN 7 THEN 'Upper' || c_custkey ELSE 'a.b-c.' || c_custkey || '-' END"


#: Two expressions for what one with look-ahead says in Spark.
_VALID = r"length({0}) BETWEEN 3 AND 63 AND NOT regexp_matches({0}, '^(\d+\.)+\d+$') AND regexp_matches({0}, '^(([a-z0-9]|[a-z0-9][a-z0-9\-]*[a-z0-9])\.)*([a-z0-9]|[a-z0-9][a-z0-9\-]*[a-z0-9])$')"


@query(rf"""WITH t AS (SELECT c_custkey, {_BUCKET} AS raw FROM customer), x AS (SELECT c_custkey, CASE WHEN contains(raw, '.amazonaws.com') THEN regexp_extract(raw, '^(.*)\.s3', 1) ELSE regexp_extract(raw, '^([^:]*)', 1) END AS name FROM t)
SELECT c_custkey, name, {_VALID.format('name')} AS valid FROM x""")
def bucket_name(spark, sf_dir):
    """Names of buckets written as hosts, with regions, or plainly, and whether they can be names."""
    return table(spark, sf_dir, "customer").select("c_custkey", *[c.alias(n) for n, c in U.bucket(F.expr(_BUCKET)).items()])


_FORMS = ("https://b{0}.s3-eu-west-1.amazonaws.com/x.pdf", "https://b{0}.s3.amazonaws.com/x.pdf", "https://s3.eu-north-1.amazonaws.com:443/y", "https://b{0}.NYC3.digitaloceanspaces.com/x", "https://ams3.digitaloceanspaces.com/b{0}/x", "https://b{0}.oss-cn.aliyuncs.com/x", "https://storage.googleapis.com/b{0}/x.pdf", "https://other.example/b{0}")


@query("""SELECT c_custkey, ['aws', 'aws', 'aws', 'digitalocean', 'digitalocean', 'aliyun', 'gcp', NULL][k + 1] AS service, CASE WHEN k = 2 THEN 's3.eu-north-1.amazonaws.com' WHEN k < 7 AND (length(b) > 2 OR k NOT IN (0, 1, 6)) THEN b END AS bucket, ['eu-west-1', 'us-east-1', 'eu-north-1', 'nyc3', 'ams3', 'oss-cn', NULL, NULL][k + 1] AS region
FROM (SELECT c_custkey, c_custkey % 8 AS k, 'b' || c_custkey AS b FROM customer)""")
def storage_places(spark, sf_dir):
    """Service, bucket and region of stored files' URLs of each form."""
    head = [F.concat(F.lit(a), F.col("c_custkey").cast("string") if "{0}" in f else F.lit(""), F.lit(b)) for f in _FORMS for a, _, b in [f.partition("{0}")]]
    url = F.get(F.array(*head), (F.col("c_custkey") % 8).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", *[c.alias(n) for n, c in U.storage_place(url).items()])


_UP = ("f{0}.txt", "../f{0}.txt", "a/../b{0}", "a/../../b{0}", "/f{0}", "./data/../data/./f{0}", "../data/{0}", "/data/{0}")
_KEY = f"CASE p_partkey % 8 {' '.join(f"WHEN {i} THEN '{k.split('{0}')[0]}' || p_partkey || '{k.split('{0}')[1]}'" for i, k in enumerate(_UP))} END"


@query(f"""WITH t AS (SELECT p_partkey, {_KEY} AS k, CASE WHEN p_size % 2 = 0 THEN '/data' ELSE './data/' END AS folder FROM part),
w AS (SELECT p_partkey, CASE WHEN starts_with(k, '/') THEN k ELSE '/' || CASE folder WHEN '/data' THEN 'data' ELSE 'w/data' END || '/' || k END AS whole, CASE folder WHEN '/data' THEN '/data' ELSE '/w/data' END AS top FROM t),
n AS (SELECT p_partkey, top, '/' || array_to_string(list_filter(string_split(whole, '/'), lambda x: x NOT IN ('', '.')), '/') AS whole FROM w), r AS (SELECT p_partkey, top, regexp_replace(whole, '/[^/.]+/\\.\\.', '') AS whole FROM n), s AS (SELECT p_partkey, top, regexp_replace(whole, '/[^/.]+/\\.\\.', '') AS whole FROM r)
SELECT p_partkey, starts_with(whole || '/', top || '/') AS safe FROM s""")
def safe_keys(spark, sf_dir):
    """Whether keys stay below their folder, absolute or relative to where one works."""
    folder = F.when(F.col("p_size") % 2 == 0, "/data").otherwise("./data/")
    return table(spark, sf_dir, "part").select("p_partkey", U.safe_key(F.expr(_KEY), folder).alias("safe"))


_AT = "CASE c_custkey % 4 WHEN 0 THEN 'x.sch.id' WHEN 1 THEN 'y.ac.id' WHEN 2 THEN 'x.com' ELSE 'z.ac.id.org' END"
_PATHS = ("/repository/{0}.pdf", "/slims7/a/{0}", "/__statics/gudangsoal/files/{0}.pdf", "/repository/a/{0}", "/", "//repository// {0}/")
_PLACE = f"CASE c_custkey % 6 {' '.join(f"WHEN {i} THEN '{k.split('{0}')[0]}' || c_custkey || '{k.split('{0}')[1]}'" if '{0}' in k else f"WHEN {i} THEN '{k}'" for i, k in enumerate(_PATHS))} END"


@query(f"""WITH t AS (SELECT c_custkey, {_AT} AS host, list_filter(string_split({_PLACE}, '/'), lambda x: trim(x) <> '') AS p FROM customer)
SELECT c_custkey, coalesce((host LIKE '%ac.id' OR host LIKE '%sch.id') AND ((len(p) = 2 AND p[1] = 'repository') OR p[1] = 'slims7'), false) OR coalesce(len(p) = 4 AND p[1] = '__statics' AND p[2] = 'gudangsoal' AND p[3] = 'files', false) AS upload FROM t""")
def library_paths(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", U.library_path(F.expr(_AT), F.expr(_PLACE)).alias("upload"))


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, substr(md5(text), 1, 2) || '/' || substr(md5(text), 3, 2) || '/' || substr(md5(text), 5, 2) || '/' || substr(md5(text), 7, 2) || '/' AS path FROM documents")
def hash_path(spark, sf_dir):
    digest = F.md5(F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), digest.alias("md5"), U.shard_path(digest).alias("path"))
