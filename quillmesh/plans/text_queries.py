"""Captured text: versions, marks, headers, registry lines, access lists, keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text as X

from .registry import query, table, values_sql

# Inputs are written by one expression that both engines evaluate, so they differ from row to row.
_COMPONENT = "CASE p_partkey % 5 WHEN 0 THEN p_name || ' ' || p_size || '.' || p_partkey % 9 || '.1' WHEN 1 THEN ' ' || p_name || ' ' WHEN 2 THEN p_name || ' ' || p_size || ' ' WHEN 3 THEN p_brand || '.js' END"
_CODE = "CASE event_id % 5 WHEN 0 THEN '' || (200 + event_id % 300) WHEN 1 THEN (100 + event_id % 400) || ' ' || event_type WHEN 2 THEN event_type WHEN 3 THEN ' ' || (300 + event_id % 9) || 'x' END"
_LINE = "(1000 + c_custkey) || ' | ' || CASE WHEN c_custkey % 4 <> 3 THEN '8.8.' || c_custkey % 256 || '.1' ELSE 'none' END || ' | 8.' || c_custkey % 256 || '.0.0/' || (7 + c_custkey % 10) || ' | ' || CASE c_custkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'FR' ELSE 'DEU' END || ' | ' || CASE c_custkey % 2 WHEN 0 THEN 'arin' ELSE 'ripencc' END || ' | ' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '19' || (80 + c_custkey % 20) || '-1-0' || (1 + c_custkey % 9) END || ' | ' || c_mktsegment || ', US'"
_SIZE = "c_custkey * CASE c_custkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 WHEN 3 THEN 1000000000 WHEN 4 THEN 1000000000000 ELSE 7 END"


@query(rf"""WITH t AS (SELECT p_partkey, {_COMPONENT} AS raw FROM part) SELECT p_partkey, CASE WHEN regexp_matches(raw, '^(.*?) ((\d+[. ]?)+)') THEN regexp_extract(raw, '^(.*?) ((\d+[. ]?)+)', 1) ELSE trim(raw) END AS what, nullif(trim(regexp_extract(raw, '^(.*?) ((\d+[. ]?)+)', 2)), '') AS version FROM t""")
def component_versions(spark, sf_dir):
    v = X.component_version(F.col("raw"))
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_COMPONENT).alias("raw")).select("p_partkey", *[c.alias(n) for n, c in v.items()])


@query(f"WITH t AS (SELECT event_id, {_CODE} AS raw FROM events) SELECT event_id, coalesce(try_cast(raw AS INT), try_cast(substr(trim(raw), 1, 3) AS INT)) AS code FROM t")
def status_code(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.status_code(F.expr(_CODE)).alias("code"))


@query(f"WITH t AS (SELECT c_custkey, ({_SIZE})::BIGINT AS n FROM customer) SELECT c_custkey, CASE WHEN n < 1024 THEN format('{{:.1f}}B', n::DOUBLE) WHEN n < 1048576 THEN format('{{:.1f}}KB', n / 1024) WHEN n < 1073741824 THEN format('{{:.1f}}MB', n / 1048576) WHEN n < 1099511627776 THEN format('{{:.1f}}GB', n / 1073741824) WHEN n < 1125899906842624 THEN format('{{:.1f}}TB', n / 1099511627776) ELSE format('{{:.1f}}PB', n / 1125899906842624) END AS size FROM t")
def human_size(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.human_size(F.expr(_SIZE).cast("double")).alias("size"))


@query(rf"""WITH t AS (SELECT c_custkey, list_transform(string_split({_LINE}, '|'), lambda x: trim(x)) AS a FROM customer), u AS (SELECT c_custkey, a, a[:len(a) - 1] AS k FROM t)
SELECT c_custkey, list_filter(k, lambda x: regexp_matches(x, '^\d+\.\d+\.\d+\.\d+$'))[-1] AS ip, list_filter(k, lambda x: regexp_matches(x, '^\d+\.\d+\.\d+\.\d+/\d\d$'))[-1] AS bgp_prefix, list_filter(k, lambda x: regexp_matches(x, '^[A-Z][A-Z]$'))[-1] AS cc, list_filter(k, lambda x: regexp_matches(x, '^[a-z]+$'))[-1] AS registry,
  list_filter(k, lambda x: regexp_matches(x, '^\d{{4}}-\d\d?-\d\d?$'))[-1] AS allocated, list_filter(k, lambda x: regexp_matches(x, '^\d+$'))[-1] AS autonomous_sys, a[-1] AS as_name FROM u""")
def registry_lines(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", *[c.alias(n) for n, c in X.registry_line(F.expr(_LINE)).items()])


@query("""SELECT event_id, 'HTTP/1.1 ' || (200 + event_id % 300) || ' OK' AS line, '' || (200 + event_id % 300) AS status, 'text/' || event_type AS content_type, CASE WHEN event_id % 2 = 0 THEN 'b c' || event_id ELSE 'z' || event_id END AS x, 'a' || user_id AS capital, '' AS bare, 6 AS n FROM events""")
def header_map(spark, sf_dir):
    """Header lines as a map: repeated names, values with colons, a status line, and a name without a value."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    i, kind = F.col("event_id"), F.col("event_type")
    lines = F.array(text("HTTP/1.1 ", 200 + i % 300, " OK"), text("content-type: text/", kind), text("x: z", i), text("X: a", F.col("user_id")), F.when(i % 2 == 0, text("x: b : c", i)).otherwise(text("x: z", i)), F.lit("empty:"))
    m = table(spark, sf_dir, "events").select("event_id", X.headers(lines).alias("m"))
    at = lambda k, n: F.col("m")[k].alias(n)
    return m.select("event_id", at("custom_codphish", "line"), at("status", "status"), at("content-type", "content_type"), at("x", "x"), at("X", "capital"), at("empty", "bare"), F.size("m").alias("n"))


_V = "(1 + event_id % 9) || '.' || event_id % 7"
_MARKED = f"""CASE event_id % 13 WHEN 0 THEN '/* Copyright (c) 2003-20' || (10 + event_id % 10) || ', CKSource - Frederico Knabben. All rights reserved */' WHEN 1 THEN 'Copyright (C) 2003 - 20' || (10 + event_id % 10) || ' Frederico Caldeira Knabben. All' WHEN 2 THEN 'version:\"' || {_V} || '\",revision:\"r' || user_id || '\"' WHEN 3 THEN '## CKEditor ' || {_V}
WHEN 4 THEN 'CKFinder.version = \"' || {_V} || '\";CKFinder.revision = \"3\"' WHEN 5 THEN '<title> CKFinder ' || {_V} || ' </title>' WHEN 6 THEN '### Version ' || {_V} WHEN 7 THEN '<h2 id=\"version1\">Version ' || {_V} || '</h2>' WHEN 8 THEN '@version ' || {_V} || ' @package Fck @copyright 2003, 20' || (10 + event_id % 10)
WHEN 9 THEN 'window.FCKeditorAPI = {{ Version : \"' || {_V} || '\", VersionBuild : \"' || user_id || '\"' WHEN 10 THEN 'FCKeditorAPI.Version=' || {_V} WHEN 11 THEN event_type END""".replace("\n", " ")
_BODY_MARKS = ", ".join("nullif(regexp_extract(replace(body, '\\', ''), '" + p.replace("'", "''") + f"', 0, 's'), '') AS {k}" for k, p in X.MARKS.items())


@query(f"WITH t AS (SELECT event_id, {_MARKED} AS body FROM events) SELECT event_id, {_BODY_MARKS} FROM t")
def release_marks(spark, sf_dir):
    """Marks of releases in bodies of thirteen kinds, with their own versions and years."""
    return table(spark, sf_dir, "events").select("event_id", F.expr(_MARKED).alias("body")).select("event_id", *[c.alias(k) for k, c in X.marks(F.col("body")).items()])


@query("SELECT page_id, contains(lower(html), '&copy;') AS copyright, contains(lower(html), 'track(') AS tracked, contains(lower(html), '<form') AND contains(lower(html), 'password') AS asks, contains(lower(html), 'slims') AND (contains(lower(html), '<meta name=\"description\" content=\"') OR contains(lower(html), '<meta name=\"generator\" content=\"')) AS slims, contains(lower(html), '<title>e-learning madrasah') AS elearning FROM pages")
def ioc_flags(spark, sf_dir):
    """Marks of captured bodies: one pass, all built-in."""
    low, system = F.lower("html"), X.library_system(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", low.contains("&copy;").alias("copyright"), low.contains("track(").alias("tracked"), (low.contains("<form") & low.contains("password")).alias("asks"), *[c.alias(n) for n, c in system.items()])


_RIGHT = "CASE {0} % 5 WHEN 0 THEN 'READ' WHEN 1 THEN 'WRITE' WHEN 2 THEN 'READ_ACP' WHEN 3 THEN 'WRITE_ACP' ELSE 'FULL_CONTROL' END"
_GROUP = "CASE {0} % 3 WHEN 0 THEN 'AllUsers' WHEN 1 THEN 'AuthenticatedUsers' ELSE 'other' END"
_GRANTS = f"CASE WHEN c_custkey % 17 <> 0 THEN {_GROUP.format('c_custkey')} || ':' || {_RIGHT.format('(c_custkey // 3)')} || ',' || {_GROUP.format('(c_custkey // 15)')} || ':' || {_RIGHT.format('(c_custkey // 45)')} END"
_NAMES = "[['READ', 'Read'], ['WRITE', 'Write'], ['READ_ACP', 'ReadACP'], ['WRITE_ACP', 'WriteACP']]"
_GIVEN = f"""t AS (SELECT c_custkey, {_GRANTS} AS g FROM customer), u AS (SELECT c_custkey, g, string_split(coalesce(g, ''), ',') AS l FROM t), v AS (SELECT c_custkey, g,
CASE WHEN list_contains(l, 'AuthenticatedUsers:FULL_CONTROL') THEN ['FullControl'] ELSE list_transform(list_filter({_NAMES}, lambda n: list_contains(l, 'AuthenticatedUsers:' || n[1])), lambda n: n[2]) END AS auth,
CASE WHEN list_contains(l, 'AllUsers:FULL_CONTROL') THEN ['FullControl'] ELSE list_transform(list_filter({_NAMES}, lambda n: list_contains(l, 'AllUsers:' || n[1])), lambda n: n[2]) END AS every FROM u)"""


def _granted(spark, sf_dir):
    """c_custkey and permissions of access lists of up to two grants; some have no list."""
    entry = lambda x: F.struct(F.concat(F.lit("http://acs.amazonaws.com/groups/global/"), F.substring_index(x, ":", 1)).alias("uri"), F.substring_index(x, ":", -1).alias("permission"))
    d = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_GRANTS.replace("//", "div")).alias("g"))
    return d, X.permissions(F.transform(F.split("g", ","), entry))


@query(f"""WITH {_GIVEN}, j AS (SELECT c_custkey, auth, every, '["' || array_to_string(auth, '","') || '"]' AS a, '["' || array_to_string(every, '","') || '"]' AS e FROM v)
SELECT c_custkey, '{{' || CASE WHEN len(auth) > 0 THEN '"authUsersPermissions":' || a ELSE '' END || CASE WHEN len(auth) > 0 AND len(every) > 0 THEN ',' ELSE '' END || CASE WHEN len(every) > 0 THEN '"allUsersPermissions":' || e ELSE '' END || '}}' AS report, 'AuthUsers: [' || array_to_string(auth, ', ') || '], AllUsers: [' || array_to_string(every, ', ') || ']' AS line FROM j""")
def permission_reports(spark, sf_dir):
    d, p = _granted(spark, sf_dir)
    return d.select("c_custkey", X.permission_report(p).alias("report"), X.permission_line(p).alias("line"))


@query(f"""WITH {_GIVEN}, s AS (SELECT c_custkey, g IS NULL AS unknown, auth, every FROM v) SELECT c_custkey, {', '.join(f"CASE WHEN unknown THEN 'UNKNOWN' WHEN list_contains({side}, '{n}') OR list_contains({side}, 'FullControl') THEN 'ALLOWED' ELSE 'DENIED' END AS {group}_{n}" for side, group in (("every", "all"), ("auth", "auth")) for n in ("Read", "Write", "ReadACP", "WriteACP", "FullControl"))} FROM s""")
def acl_permissions(spark, sf_dir):
    """The ten flags of access lists: full control implies the rest, other groups give nothing, no list is unknown."""
    d, p = _granted(spark, sf_dir)
    return d.select("c_custkey", *[p[f"{group}{n}"].alias(f"{short}_{n}") for group, short in (("AllUsers", "all"), ("AuthUsers", "auth")) for n, _ in X.RIGHTS])


@query("""SELECT event_id, CASE WHEN signed THEN 'UNKNOWN' ELSE v END AS all_read, CASE WHEN signed THEN v ELSE 'UNKNOWN' END AS auth_read FROM
(SELECT event_id, event_id % 2 = 0 AS signed, CASE event_type WHEN 'error' THEN 'DENIED' WHEN 'purchase' THEN 'UNKNOWN' ELSE 'ALLOWED' END AS v FROM events)""")
def read_rights(spark, sf_dir):
    code = F.when(F.col("event_type") == "error", "AccessDenied").when(F.col("event_type") == "purchase", "SlowDown")
    r = X.read_right(code, F.col("event_id") % 2 == 0, F.lit(None).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", r["AllUsersRead"].alias("all_read"), r["AuthUsersRead"].alias("auth_read"))


_KEYWORDS = [("script",), ("footer",), ("iframe",), ("token",), ("password",)]


@query(f"SELECT keyword, count(*) AS pages, min(page_id) AS first_page FROM pages, {values_sql('k(keyword)', _KEYWORDS)} WHERE regexp_matches(lower(html), '\\b' || keyword || '\\b') GROUP BY 1")
def keyword_scan(spark, sf_dir):
    """How many pages have each keyword as a word: one array of hits a page, no join."""
    hits = F.array_compact(F.array(*[F.when(F.lower("html").rlike(rf"\b{k}\b"), F.lit(k)) for (k,) in _KEYWORDS]))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(hits).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


_LABELS = """'{"CMS": "Press ' || user_id || '.' || event_id % 5 || ',Other", "' || event_type || '": "' || CASE WHEN event_id % 3 = 0 THEN 'lib 1.' || event_id % 4 ELSE 'plain' END || '"}'"""


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, event_id % 7 <> 0 AS named FROM events), x AS (SELECT event_id, 'CMS' AS label, 'Press ' || user_id || '.' || event_id % 5 AS raw FROM e WHERE named UNION ALL SELECT event_id, 'CMS', 'Other' FROM e WHERE named UNION ALL SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN 'lib 1.' || event_id % 4 ELSE 'plain' END FROM e WHERE named UNION ALL SELECT event_id, NULL, NULL FROM e WHERE NOT named)
SELECT event_id, label, CASE WHEN regexp_matches(raw, '^(.*?) ((\\d+[. ]?)+)') THEN regexp_extract(raw, '^(.*?) ((\\d+[. ]?)+)', 1) ELSE trim(raw) END AS what, nullif(trim(regexp_extract(raw, '^(.*?) ((\\d+[. ]?)+)', 2)), '') AS version FROM x""")
def props_unfold(spark, sf_dir):
    """Labels of detected maps, the components listed under each, and their versions; a page without labels has one row of nulls."""
    body = F.when(F.col("event_id") % 7 != 0, F.expr(_LABELS)).otherwise("{}")
    return X.unfold(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "body")


@query("SELECT regexp_extract(props, '\"k\":\\s*(\\d+)', 1)::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def props_counts(spark, sf_dir):
    """How often each value of a JSON map's key occurs."""
    m = F.from_json("props", "map<string,bigint>")
    return table(spark, sf_dir, "events").groupBy(m["k"].alias("k")).agg(F.count("*").alias("n"))


@query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def hash_group(spark, sf_dir):
    """Groups of equal texts by digest; texts stay where they are."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")
