"""Captured JSON and probe reports as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as texts
from . import url as urls

PRODUCTS = "struct<totalResults:int,products:array<struct<cpe:struct<cpeName:string,lastModified:string,titles:array<struct<title:string,lang:string>>,refs:array<struct<ref:string,type:string>>,cves:array<string>>>>>"
FLAWS = "struct<id:string,descriptions:array<struct<lang:string,value:string>>,weaknesses:array<struct<description:array<struct<lang:string,value:string>>>>,references:array<struct<url:string>>>"


def products(text: Column) -> Column:
    """An array of name, last_modified, title (first non-empty), vendor (first reference of that type) and cves; one row of nulls where there is none."""
    got = F.coalesce(F.from_json(text, PRODUCTS)["products"], F.array().cast("array<struct<cpe:struct<cpeName:string,lastModified:string,titles:array<struct<title:string,lang:string>>,refs:array<struct<ref:string,type:string>>,cves:array<string>>>>"))
    title = lambda p: F.get(F.filter(p["cpe"]["titles"], lambda t: t["title"] != ""), F.lit(0))["title"]
    vendor = lambda p: F.get(F.filter(p["cpe"]["refs"], lambda r: r["type"] == "Vendor"), F.lit(0))["ref"]
    return F.transform(got, lambda p: F.struct(p["cpe"]["cpeName"].alias("cpe"), p["cpe"]["lastModified"].alias("last_modified"), title(p).alias("title"), vendor(p).alias("vendor"), p["cpe"]["cves"].alias("cves")))


def flaw(text: Column) -> dict[str, Column]:
    """id, English descriptions, weaknesses of both levels, and reference URLs of a flaw's report."""
    j = F.from_json(text, FLAWS)
    return {
        "cve_id": j["id"],
        "description": F.transform(F.filter(j["descriptions"], lambda d: d["lang"] == "en"), lambda d: d["value"]),
        "cwes": F.array_distinct(F.flatten(F.transform(j["weaknesses"], lambda w: F.transform(w["description"], lambda d: d["value"])))),
        "reference_data": F.transform(j["references"], lambda r: r["url"]),
    }


def match_string(vendor: Column, product: Column, version: Column) -> Column:
    """cpe:2.3:a:vendor:product:version, with * for what is absent."""
    star = lambda c: F.coalesce(c, F.lit("*"))
    return F.concat_ws(":", F.lit("cpe:2.3:a"), star(vendor), star(product), star(version))


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("-"))


def outcome(status: Column, kind: Column, head_kind: Column) -> Column:
    """What went wrong with a captured answer, or null: its status, its type, or a type that isn't the announced one."""
    return F.when(status.isNull(), "No answer").when(~status.between(200, 299), F.concat(F.lit("Bad status code "), status.cast("string"))).when(~kind.contains("pdf"), F.lit("Bad content type")).when(head_kind.isNotNull() & (head_kind != kind), F.lit("Inconsistent content type"))


def error_of(query: Column) -> Column:
    """The error that a report's URL carries, or null."""
    return F.nullif(F.regexp_extract(query, r"&error=(.*)$", 1), F.lit(""))


def storage_answer(url: Column, body: Column) -> Column:
    """Whether an answer looks like object storage."""
    low = F.lower(body)
    return F.coalesce(url.contains("amazonaws") | low.contains("bucket") | (low.contains("hostid") & low.contains("requestid")), F.lit(False))


def rect(text: Column) -> Column:
    """`x y w h` as rounded numbers, half to even."""
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), lambda x: F.bround(x.cast("double")).cast("int"))


#: What scripts are made of; those without which there is none; and the tag of an embedded one.
SCRIPT_PARTS = ("var ", ";", ")", "(", "function ", "=", "{", "}", "if ", "else", "return", "while ", "for ", ",", "eval")
SCRIPT_KEYS = (";", "(", ")")
SCRIPT_TAG = r"(?is)<script[^>]*?contentType\s*?=\s*?['\"]application/x-javascript['\"][^>]*?>(.*?)</script>"


def looks_like_script(text: Column) -> Column:
    """Whether a text has the tag, or is plain ASCII with every key part and many parts for its length."""
    times = lambda p: ((F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p)).cast("int")
    counts = F.transform(F.array(*[F.struct(times(p).alias("n")) for p in SCRIPT_PARTS]), lambda x: x["n"])
    total = F.aggregate(counts, F.lit(0), lambda acc, x: acc + x)
    kinds = F.size(F.filter(counts, lambda x: x > 0))
    keys = text.contains(SCRIPT_KEYS[0]) & text.contains(SCRIPT_KEYS[1]) & text.contains(SCRIPT_KEYS[2])
    dense = ((total > 15) & (kinds >= 4)) | ((F.length(text) < 100) & (total * 100 > 10 * F.length(text)))
    return text.rlike(SCRIPT_TAG) | (~text.rlike(r"[^\x00\t\n\f\r\x20-\x7E]") & keys & dense)


#: Record types of name answers, in the order asked, and how each failure is written.
RECORD_TYPES = ("A", "NS", "CNAME", "SOA", "MX", "TXT", "AAAA", "CERT", "A6", "DNAME", "CAA")
NAME_ERRORS = {
    "NXDOMAIN": "DNS query name does not exist.",
    "Timeout": "The DNS operation timed out.",
    "NoNameservers": "Server 8.8.8.8 UDP port 53 answered SERVFAIL.",
    "LabelTooLong": "A DNS label is > 63 octets long.",
}
#: Failures that are no error, and what is written for any other.
NO_ERROR, OTHER_ERROR = ("NoAnswer",), "Error while processing the DNS record."


def name_answers(answers: DataFrame, domain: str = "domain") -> DataFrame:
    """A row a domain with a sorted list of each record type and the last asked type's error.

    answers: domain, rtype, value, failure (a class of failures, or null). One aggregate, combined before the shuffle.
    """
    of = lambda t: F.array_sort(F.collect_list(F.when((F.col("rtype") == t) & F.col("value").isNotNull(), F.col("value"))))
    text = F.coalesce(*[F.when(F.col("failure") == k, F.lit(v)) for k, v in NAME_ERRORS.items()], F.when(~F.col("failure").isin(*NO_ERROR), F.lit(OTHER_ERROR)))
    asked = F.array_position(F.array(*map(F.lit, RECORD_TYPES)), F.col("rtype"))
    return answers.groupBy(domain).agg(*[of(t).alias(t.lower()) for t in RECORD_TYPES], F.max_by(text, F.when(text.isNotNull(), F.struct(asked, text))).alias("error"))


JOB = "url string, addCmdLine string"
PAGE = "result int, detected map<string,string>, detected_apps map<string,string>"
REQUESTS = "array<struct<url:string,request_headers:array<string>,response_headers:array<string>,method:string,server_address:string,tls_version:string>>"


def visit(job: Column, page: Column, posted: Column) -> dict[str, Column]:
    """A browser visit's job and page from their JSON, and the error that the result's posting carries; absent fields are null."""
    j, d = F.from_json(job, JOB), F.from_json(page, PAGE)
    p = urls.split(j["url"])
    folder = F.array_join(urls.directory(urls.path_parts(p["path"])), "/")
    return {
        "url": j["url"],
        "url_hash": F.sha2(j["url"], 256),
        "domain_path": F.concat(p["scheme"], F.lit("://"), p["netloc"], F.lit("/"), folder),
        "cmdline": j["addCmdLine"],
        "error_msg": error_of(posted),
        "result": d["result"],
        "detected": d["detected"],
        "detected_apps": d["detected_apps"],
    }


def requests(netlog: Column) -> Column:
    """One struct for each request of a visit's network log, with header maps and the status code."""
    def one(r: Column) -> Column:
        answer = texts.headers(r["response_headers"])
        return F.struct(r["url"].alias("url"), r["method"].alias("method"), r["server_address"].alias("server_address"), r["tls_version"].alias("tls_version"), texts.headers(r["request_headers"]).alias("request_headers"), answer.alias("response_headers"), texts.status_code(answer["status"]).alias("status_code"))

    return F.transform(F.from_json(netlog, REQUESTS), one)


ADVISORY = "map<string,struct<friendly_name:string,latest_version:string,last_updated:string,popular:boolean,vulnerabilities:array<struct<id:string,title:string,fixed_in:string>>>>"


def advisory(text: Column) -> dict[str, Column]:
    """The last component of an advisory's JSON object and its vulnerabilities."""
    j = F.try_element_at(F.map_values(F.from_json(text, ADVISORY)), F.lit(-1))
    return {n: j[n] for n in ("friendly_name", "latest_version", "last_updated", "popular", "vulnerabilities")}


LISTING = "Name string, IsTruncated boolean, Contents array<struct<Key:string,LastModified:string,Size:bigint>>"


def listing(xml: Column) -> Column:
    """name and files of a storage listing; every repeated tag is kept."""
    return F.from_xml(xml, LISTING)


def xml_as_json(xml: Column) -> Column:
    """XML of any schema as a JSON object: children by tag, texts as strings, repeated tags as lists of all of them.

    Broken XML is null. Python over Arrow batches, since no schema is known.
    """
    import json
    import xml.etree.ElementTree as tree

    import pandas as pd

    def held(node):
        out: dict = {}
        for child in node:
            value = held(child) if len(child) else child.text or ""
            if child.tag not in out:
                out[child.tag] = [value]
            else:
                out[child.tag].append(value)
        return {k: v[0] if len(v) == 1 else v for k, v in out.items()}

    def one(text):
        try:
            return None if text is None or "<!DOCTYPE" in text else json.dumps(held(tree.fromstring(text)), ensure_ascii=False, separators=(",", ":"))
        except (tree.ParseError, RecursionError):
            return None

    return F.pandas_udf(lambda s: pd.Series([one(x) for x in s], index=s.index, dtype=object), "string")(xml)


def unescape(text: Column) -> Column:
    """Bytes of %uXXXX (low byte first) and %XX escapes, as a binary; other characters as one byte and a zero, as scripts hold them.

    Text without an escape stays as it is.
    """
    units = F.regexp_extract_all(text, F.lit(r"(?is)%u[0-9a-f]{4}|%[0-9a-f]{2}|."), F.lit(0))

    def code(x: Column) -> Column:
        wide, narrow = x.rlike(r"(?i)^%u[0-9a-f]{4}$"), x.rlike(r"(?i)^%[0-9a-f]{2}$")
        own = F.lpad(F.hex(F.ascii(x) % 256), 2, "0")
        return F.when(wide, F.concat(F.substring(x, 5, 2), F.substring(x, 3, 2))).otherwise(F.concat(F.when(narrow, F.substring(x, 2, 2)).otherwise(own), F.lit("00")))

    return F.when(text.contains("%"), F.unhex(F.array_join(F.transform(units, code), ""))).otherwise(text.cast("binary"))


def calls(code: Column, name: str) -> Column:
    """Statements that call a function: the whole call, its arguments, and whether these return anything."""
    found = F.regexp_extract_all(code, F.lit(rf"(?s)\W({name}\s{{0,5}}?\(.*?\)\s{{0,5}}?;)"), F.lit(1))
    inner = lambda x: F.regexp_extract(x, r"(?s)^\w+\s*\((.*)\)\s*;$", 1)
    return F.transform(found, lambda x: F.struct(x.alias("call"), inner(x).alias("arguments"), F.lower(inner(x)).contains("return").alias("returns")))


def aliases(code: Column, name: str) -> Column:
    """Names that a function is assigned to."""
    return F.regexp_extract_all(code, F.lit(rf"(\w+)\s*?=\s*?{name}\s*?;"), F.lit(1))
