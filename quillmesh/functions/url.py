"""URL and host expressions; all are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def split(url: Column) -> dict[str, Column]:
    """scheme (lower case), netloc, path, params, query and fragment; a part that is absent is empty."""
    rest = F.regexp_replace(url, SCHEME, "")
    after = F.regexp_replace(rest, r"^//[^/?#]*", "")
    whole = F.regexp_extract(after, r"^([^?#]*)", 1)
    return {
        "scheme": F.lower(F.regexp_extract(url, SCHEME, 1)),
        "netloc": F.regexp_extract(rest, r"^//([^/?#]*)", 1),
        "path": F.regexp_replace(whole, r";[^/]*$", ""),
        "params": F.regexp_extract(whole, r";([^/]*)$", 1),
        "query": F.regexp_extract(after, r"^[^?#]*\?([^#]*)", 1),
        "fragment": F.regexp_extract(after, r"(?s)#(.*)$", 1),
    }


def unsplit(parts: dict[str, Column]) -> Column:
    """The URL of split()'s parts."""
    lead = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c)).otherwise("")
    return F.concat(F.when(parts["scheme"] != "", F.concat(parts["scheme"], F.lit(":"))).otherwise(""), lead("//", parts["netloc"]), parts["path"], lead(";", parts["params"]), lead("?", parts["query"]), lead("#", parts["fragment"]))


def path_parts(path: Column) -> Column:
    """The trimmed, non-empty segments of a path."""
    return F.filter(F.transform(F.split(path, "/"), lambda x: F.trim(x)), lambda x: x != "")


def directory(parts: Column) -> Column:
    """All segments but the last."""
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def origin(url: Column) -> Column:
    p = split(url)
    return F.concat(p["scheme"], F.lit("://"), p["netloc"])


#: A host is local if it contains one of the first two or is the third.
LOCAL_PARTS, LOCAL_NAME = ("127.0.0", "192.168."), "localhost"
#: Fixed value: the characters that a host and its port and user may have.
INVALID_HOST = r"(?U)[^(*?:*?@)+(\w\-\.\~ )(:\d)+]"


def flags(url: Column, suffix: Column) -> dict[str, Column]:
    """The properties that clean() asks about. suffix: the host's public suffix, or null (operators.hosts.with_suffix)."""
    p = split(url)
    return {
        "is_relative_url": url.rlike(r"^[/#]"),
        "is_empty": url.rlike(r"^http(s)?(://)?\z"),
        "is_email": (p["scheme"] == "") & (p["netloc"] == "") & url.rlike(r"^[^@]+@[^@]+\.[^@]+"),
        "has_http_scheme": p["scheme"].startswith("http"),
        "is_local": p["netloc"].contains(LOCAL_PARTS[0]) | p["netloc"].contains(LOCAL_PARTS[1]) | (p["netloc"] == LOCAL_NAME),
        "has_invalid_char": p["netloc"].rlike(INVALID_HOST),
        "has_valid_tld": suffix.isNotNull() | p["netloc"].rlike(r"^([^@]*@)?\d+\.\d+\.\d+\.\d+"),
        "is_pdf": F.substring(url, F.length(p["scheme"]) + 4 + F.length(p["netloc"]), F.length(url)).contains(".pdf"),
    }


def clean(f: dict[str, Column], pdf: bool = True) -> Column:
    """Whether a URL can be visited: absolute, http, a public host, no e-mail address, and a PDF unless pdf is False."""
    ok = f["has_http_scheme"] & ~f["is_email"] & ~f["is_empty"] & ~f["is_relative_url"] & ~f["is_local"] & ~f["has_invalid_char"] & f["has_valid_tld"]
    return ok & f["is_pdf"] if pdf else ok


#: What a path must contain, first match wins, and the upload component that it suggests.
COMPONENTS = (("ckfinder", "ckfinder"), ("ckimage", "ckfinder"), ("kcfinder", "kcfinder"), ("fckeditor", "fckeditor"), ("ckeditor", "ckeditor"), ("formcraft", "formcraft"), ("webform", "webform"), ("super-forms", "webform"), ("formidable", "formidable"))


def component(url: Column) -> Column:
    """The upload component that a URL's path, params, query or fragment suggests, or null."""
    p = split(url)
    text = F.lower(F.concat(p["path"], p["params"], p["query"], p["fragment"]))
    return F.coalesce(*[F.when(text.contains(part), F.lit(name)) for part, name in COMPONENTS])


#: A host's part and the storage service it belongs to.
SERVICES = (("aliyuncs.com", "aliyun"), ("storage.googleapis.com", "gcp"), ("amazonaws", "aws"), ("digitaloceanspaces.com", "digitalocean"))


def service(url: Column) -> Column:
    return F.coalesce(*[F.when(url.contains(part), F.lit(name)) for part, name in SERVICES])


HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
#: Character references that are decoded by name; numbered ones are decoded whatever their number.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def hrefs(html: Column) -> Column:
    """The href values of a page's links in order, quoted or bare, with references decoded."""
    bare = lambda x: F.when(x.rlike("^[\"']"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)
    return F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), lambda x: unescape(bare(x)))


def unescape(text: Column) -> Column:
    """text with character references decoded, numbered ones first and &amp; last; unknown ones stay."""
    number = r"&#(?:([0-9]{1,7})|[xX]([0-9A-Fa-f]{1,6}));"

    def one(x: Column) -> Column:
        ten, hexa = F.regexp_extract(x, rf"^{number}", 1), F.regexp_extract(x, rf"^{number}", 2)
        code = F.when(ten != "", ten.try_cast("int")).when(hexa != "", F.conv(hexa, 16, 10).try_cast("int"))
        known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(known, F.concat(wide, F.regexp_replace(x, rf"^{number}", ""))).otherwise(x)

    # pieces begin at each reference, so each has one at most
    pieces = F.split(text, r"(?=&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});)")
    out = F.when(text.contains("&#"), F.array_join(F.transform(pieces, one), "")).otherwise(text)
    for mark, plain in REFERENCES:
        out = F.replace(out, F.lit(mark), F.lit(plain))
    return F.when(text.contains("&"), out).otherwise(text)


def resolve(site: Column, href: Column) -> Column:
    """A link's URL on its own site: the same host under the site's scheme, query, fragment or path; null for other sites."""
    s, h = split(site), split(href)
    base = F.concat(s["scheme"], F.lit("://"), s["netloc"])
    same = (h["netloc"] == s["netloc"]) | ((~href.startswith("http") | (h["scheme"] != s["scheme"])) & href.startswith(s["netloc"]))
    own = F.when(same, unsplit(h | {"scheme": s["scheme"]}))
    return F.when((h["scheme"] != "") | (h["netloc"] != ""), own).when((href == "") | href.rlike(r"^[?#/]"), F.concat(base, F.regexp_replace(href, r"^[?#]$", ""))).otherwise(F.concat(base, F.lit("/"), href))


OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
GROUP = r"[0-9A-Fa-f]{1,4}"


def is_ip(host: Column) -> Column:
    """Whether a host is an IPv4 address, or an IPv6 address with or without :: and a final IPv4 address."""
    full = host.rlike(rf"^(?:{GROUP}:){{7}}{GROUP}\z") | host.rlike(rf"^(?:{GROUP}:){{6}}{IPV4}\z")
    short = host.rlike(rf"^(?:{GROUP}(?::{GROUP})*)?::(?:(?:{GROUP}:)*(?:{GROUP}|{IPV4}))?\z")
    groups = F.size(F.filter(F.split(host, ":"), lambda x: x != "")) + F.when(host.rlike(rf"{IPV4}\z"), 1).otherwise(0)
    return host.rlike(rf"^{IPV4}\z") | full | (short & (groups <= 7))


#: Fixed value: names of buckets: 3 to 63 characters, labels of lower-case letters, digits and inner hyphens, no address.
BUCKET = r"(?=^.{3,63}$)(?!^(\d+\.)+\d+$)(^(([a-z0-9]|[a-z0-9][a-z0-9\-]*[a-z0-9])\.)*([a-z0-9]|[a-z0-9][a-z0-9\-]*[a-z0-9])$)"


def bucket_valid(name: Column) -> Column:
    return name.rlike(BUCKET)


def bucket(raw: Column) -> dict[str, Column]:
    """name and validity of a bucket written as a host (up to the last `.s3`), `name:region`, or a name."""
    name = F.when(raw.contains(".amazonaws.com"), F.regexp_extract(raw, r"^(.*)\.s3", 1)).otherwise(F.substring_index(raw, ":", 1))
    return {"name": name, "valid": bucket_valid(name)}


def storage_place(url: Column) -> dict[str, Column]:
    """service, bucket and region of a stored file's URL; null where a service's URL doesn't tell."""
    p, kind = split(url), service(url)
    host = p["netloc"]
    labels, first = F.split(host, r"\."), F.get(F.split(p["path"], "/"), F.lit(1))
    by_host = F.when(host.contains(".amazonaws.com") & host.contains(".s3"), F.regexp_extract(host, r"^(.*)\.s3", 1)).when(host.contains(":"), F.substring_index(host, ":", 1)).otherwise(first)
    valid = F.when(bucket_valid(by_host), by_host)
    four = F.size(labels) == 4
    whole = four & (F.get(labels, F.lit(2)) == "aliyuncs") & (F.get(labels, F.lit(3)) == "com")
    aws_region = F.coalesce(F.nullif(F.regexp_extract(host, r"(?:^|\.)s3.(.*?)\.amazonaws", 1), F.lit("")), F.lit("us-east-1"))
    return {
        "service": kind,
        "bucket": F.when(kind.isin("aws", "gcp"), valid).when(kind == "digitalocean", F.when(four, F.get(labels, F.lit(0))).otherwise(first)).when((kind == "aliyun") & whole, F.get(labels, F.lit(0))),
        "region": F.when(kind == "aws", aws_region).when(kind == "digitalocean", F.lower(F.try_element_at(labels, F.lit(-3)))).when((kind == "aliyun") & whole, F.get(labels, F.lit(1))),
    }


def safe_key(key: Column, folder: Column, working: str = "/w") -> Column:
    """Whether a key, joined to a folder, stays below it. working: where relative folders begin."""
    whole = lambda base, x: F.when(x.startswith("/"), x).otherwise(F.concat(base, F.lit("/"), x))
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    parts = lambda x: F.aggregate(F.filter(F.split(x, "/"), lambda y: ~y.isin("", ".")), F.array().cast("array<string>"), step)
    top = whole(F.lit(working), folder)
    return F.slice(parts(whole(top, key)), 1, F.size(parts(top))) == parts(top)


#: Ends of schools' hosts, the folder of a path of two parts, the first part of any path, and the first three of a path of four.
SCHOOLS, SCHOOL_FOLDER, SCHOOL_SYSTEM, SHARED_FOLDERS = ("ac.id", "sch.id"), "repository", "slims7", ("__statics", "gudangsoal", "files")


def library_path(host: Column, path: Column) -> Column:
    """Whether a path is one that a library system uploads to."""
    parts = F.filter(F.split(path, "/"), lambda x: F.trim(x) != "")
    n, at = F.size(parts), lambda i: F.get(parts, F.lit(i))
    school = host.endswith(SCHOOLS[0]) | host.endswith(SCHOOLS[1])
    known = school & (((n == 2) & (at(0) == SCHOOL_FOLDER)) | (at(0) == SCHOOL_SYSTEM))
    shared = (n == 4) & (at(0) == SHARED_FOLDERS[0]) & (at(1) == SHARED_FOLDERS[1]) & (at(2) == SHARED_FOLDERS[2])
    return F.coalesce(known, F.lit(False)) | F.coalesce(shared, F.lit(False))


def shard_path(digest: Column, depth: int = 4) -> Column:
    """ab/cd/ef/gh/ of a digest; shorter digests are an error."""
    parts = F.concat_ws("/", *[F.substring(digest, 2 * i + 1, 2) for i in range(depth)])
    return F.when(F.length(digest) < 2 * depth, F.raise_error(F.lit("digest too short"))).otherwise(F.concat(parts, F.lit("/")))
