"""Expressions over captured text: versions, headers, registry lines, sizes, access lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = r"^(.*?) ((\d+[. ]?)+)"


def component_version(text: Column) -> dict[str, Column]:
    """`name 1.2.3` as name and version; without a version the trimmed text and null."""
    what, version = F.regexp_extract(text, VERSION, 1), F.regexp_extract(text, VERSION, 2)
    return {"what": F.when(version != "", what).otherwise(F.trim(text)), "version": F.nullif(F.trim(version), F.lit(""))}


def unfold(df: DataFrame, detected: str) -> DataFrame:
    """df without column `detected` (a JSON map of labels to comma-separated components), with label, what and version.

    A row for each component; a map without labels, or none, gives one row of nulls.
    """
    rest = [c for c in df.columns if c != detected]
    named = df.select(*rest, F.explode_outer(F.from_json(detected, "map<string,string>")).alias("label", "_list"))
    one = named.select(*rest, "label", F.explode_outer(F.split("_list", ",")).alias("_raw"))
    return one.select(*rest, "label", *[c.alias(n) for n, c in component_version(F.col("_raw")).items()])


def status_code(raw: Column) -> Column:
    """The number, or that of the first three characters, or null."""
    return F.coalesce(raw.try_cast("int"), F.substring(F.trim(raw), 1, 3).try_cast("int"))


def human_size(n: Column) -> Column:
    """7.9KB for 8096. Rounded by the exact value, halves to the even digit, as Python and C do: 2.2KB for 2304, which is 2.25."""
    shown = lambda k, unit: F.concat(F.call_function("format_number", n / float(1024**k), F.lit("0.0")), F.lit(f"{unit}B"))
    out = shown(5, "P")
    for k, unit in reversed(list(enumerate(["", "K", "M", "G", "T"]))):
        out = F.when(F.abs(n) < 1024 ** (k + 1), shown(k, unit)).otherwise(out)
    return out


def headers(lines: Column) -> Column:
    """A map of header lines; the last of equal names wins.

    Pieces between colons are trimmed, empty ones drop out, and what follows the name is joined by blanks. A line without
    a colon is the status line: whole under `custom_codphish`, its second word under `status`.
    """
    pieces = lambda x: F.filter(F.transform(F.split(x, ":"), lambda y: F.trim(y)), lambda y: y != "")
    entry = lambda k, v: F.struct(k.alias("k"), v.alias("v"))

    def entries(x: Column) -> Column:
        p, words = pieces(x), F.split(F.trim(x), " ")
        status = F.array(entry(F.lit("custom_codphish"), F.trim(x)), entry(F.lit("status"), F.get(words, F.lit(1))))
        named = F.array(entry(F.get(p, F.lit(0)), F.array_join(F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), " ")))
        return F.filter(F.when(x.contains(":"), named).otherwise(status), lambda e: e["k"].isNotNull() & e["v"].isNotNull())

    pairs = F.flatten(F.transform(lines, entries))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, v: k != x["k"]), F.create_map(x["k"], x["v"])))


def headers_of_job(requests: Column, job: Column) -> Column:
    """The header lists of the requests (url, headers) whose URL is the job's; a slash at a request's end doesn't count."""
    return F.transform(F.filter(requests, lambda r: F.regexp_replace(r["url"], "/$", "") == job), lambda r: r["headers"])


#: What a token of a registry line looks like, in this order; prefixes have two digits.
REGISTRY_KINDS = (("ip", r"^\d+\.\d+\.\d+\.\d+$"), ("bgp_prefix", r"^\d+\.\d+\.\d+\.\d+/\d{2}$"), ("cc", r"^[A-Z]{2}$"), ("registry", r"^[a-z]+$"), ("allocated", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("autonomous_sys", r"^\d+$"))


def registry_line(line: Column) -> dict[str, Column]:
    """asn | ip | prefix | country | registry | date | name: a token goes to the kind that it looks like, the last of a kind stays.

    The name is the last token and counts for no other kind.
    """
    tokens = F.transform(F.split(line, r"\|"), lambda x: F.trim(x))
    inner = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(1)))
    like = lambda p: F.try_element_at(F.filter(inner, lambda x: x.rlike(p)), F.lit(-1))
    return {n: like(p) for n, p in REGISTRY_KINDS} | {"as_name": F.element_at(tokens, -1)}


#: The groups that grants name, and the rights that they give.
ALL_USERS = "http://acs.amazonaws.com/groups/global/AllUsers"
AUTH_USERS = "http://acs.amazonaws.com/groups/global/AuthenticatedUsers"
RIGHTS = (("Read", "READ"), ("Write", "WRITE"), ("ReadACP", "READ_ACP"), ("WriteACP", "WRITE_ACP"), ("FullControl", "FULL_CONTROL"))


def permissions(grants: Column) -> dict[str, Column]:
    """ALLOWED or DENIED for each group and right of array<struct<uri, permission>>; full control implies the rest; UNKNOWN for null."""
    has = lambda uri, right: F.exists(grants, lambda g: (g["uri"] == uri) & g["permission"].isin(right, "FULL_CONTROL"))
    out = {}
    for group, uri in (("AllUsers", ALL_USERS), ("AuthUsers", AUTH_USERS)):
        for name, right in RIGHTS:
            ok = has(uri, right)
            out[group + name] = F.when(grants.isNull(), F.lit("UNKNOWN")).when(ok, F.lit("ALLOWED")).otherwise(F.lit("DENIED"))
    return out


def allowed(p: dict[str, Column], group: str) -> Column:
    """The rights of permissions() that a group has; full control stands alone."""
    some = F.array_compact(F.array(*[F.when(p[group + name] == "ALLOWED", F.lit(name)) for name, _ in RIGHTS[:-1]]))
    return F.when(p[group + "FullControl"] == "ALLOWED", F.array(F.lit("FullControl"))).otherwise(some)


def permission_report(p: dict[str, Column]) -> Column:
    """permissions() as JSON; a group without rights is left out."""
    given = lambda group: F.when(F.size(allowed(p, group)) > 0, allowed(p, group))
    return F.to_json(F.struct(given("AuthUsers").alias("authUsersPermissions"), given("AllUsers").alias("allUsersPermissions")))


def permission_line(p: dict[str, Column]) -> Column:
    """permissions() as one readable line."""
    return F.concat(*[x for g, sep in (("AuthUsers", ""), ("AllUsers", ", ")) for x in (F.lit(f"{sep}{g}: ["), F.array_join(allowed(p, g), ", "), F.lit("]"))])


#: Error codes of an answer that mean that a right is denied.
DENIALS = ("AccessDenied", "AllAccessDisabled")


def access_list_right(code: Column, signed: Column, grants: Column) -> dict[str, Column]:
    """What a recorded attempt to read a bucket's access list says: where it succeeded, the list itself tells all rights;
    where it was denied, the group that asked may not read it; other errors leave all UNKNOWN.
    """
    denied = code.isin(*DENIALS)
    own = permissions(F.when(code.isNull(), grants))
    asked = {"AllUsersReadACP": ~signed, "AuthUsersReadACP": signed}
    return {k: F.when(denied & asked[k], "DENIED").otherwise(v) if k in asked else v for k, v in own.items()}


def read_right(code: Column, signed: Column, all_users: Column) -> dict[str, Column]:
    """What a recorded attempt to list a bucket says: code is its error or null, signed whether it used an account.

    A signed attempt says nothing of AuthUsers where AllUsers may read anyway; other errors leave all UNKNOWN.
    """
    verdict = F.when(code.isNull(), "ALLOWED").when(code.isin(*DENIALS), "DENIED").otherwise("UNKNOWN")
    return {
        "AllUsersRead": F.when(signed, F.coalesce(all_users, F.lit("UNKNOWN"))).otherwise(verdict),
        "AuthUsersRead": F.when(signed & ~F.coalesce(all_users == "ALLOWED", F.lit(False)), verdict).otherwise("UNKNOWN"),
    }


#: Marks of an upload component's release in a captured body.
MARKS = {
    "copyright": r"Copyright \([C|c]\) (\d{4}\s*-\s*\d{4}).*?Frederico (?:Caldeira )?Knabben.(?: All rights reserved)?",
    "version_1": r"version\s*:\s*[\"|']{1}(\d(\.\d+)*)[\"|']{1}\s*,\s*revision\s*:\s*[\"|']{1}(\w+)*[\"|']{1}",
    "changes": r"(###)?\s*CKEditor\s*(\d(\.\d+)*)",
    "changelog_1": r"CKFinder\.version\s*=\s*[\"|']{1}(\d(\.\d+)*)[\"|']{1}\s*;\s*CKFinder\.revision\s*=\s*[\"|']{1}(\d+)*[\"|']{1}",
    "title": r"<title>\s*(CKFinder \d(\.\d*)*)\s*</title>",
    "changelog_2": r"###\s*Version\s*(\d(\.\d+)*)",
    "changelog_3": r"<h2 id=[\"|']{1}version(.*?)[\"|']{1}>Version\s*(\d(\.\d+)*)</h2>",
    "version_3a": r"@version\s*(\d(\.\d+)*)",
    "version_3b": r"@package\s*[a-zA-Z]+",
    "version_3c": r"@copyright\s*(\d{4}\s*,\s*\d{4})",
    "version_4": r"(window\.)?FCKeditorAPI\s*=\s*\{\s*Version\s*:\s*[\"|']{1}(\d(\.\d+)*)[\"|']{1},\s*VersionBuild\s*:\s*[\"|']{1}(\d+)[\"|']{1}",
    "version_5": r"FCKeditorAPI\.Version=.*?(\d(\.\d+)*)",
    "version_6": r"FCKeditorAPI\.Versions*=\s*[\"|']{1}(\d(\.\d+)*)[\"|']{1}",
}


def marks(body: Column) -> dict[str, Column]:
    """The first match of each mark, or null; backslashes are taken out first."""
    bare = F.replace(body, F.lit("\\"), F.lit(""))
    return {k: F.nullif(F.regexp_extract(bare, f"(?s){p}", 0), F.lit("")) for k, p in MARKS.items()}


#: Marks of two library systems, sought in lower-cased bodies; the capital of the last is as it must be, and never matches.
SLIMS = ('<meta name="description" content="', '<meta name="generator" content="')
ELEARN = ("<title>e-learning madrasah", "hak cipta kementerian Agama republik indonesia")


def library_system(body: Column) -> dict[str, Column]:
    """Whether a body has a system's name and one of its marks."""
    low = F.lower(body)
    some = lambda marks, name: low.contains(name) & (low.contains(marks[0]) | low.contains(marks[1]))
    return {"slims": some(SLIMS, "slims"), "elearning": some(ELEARN, "e-learning madrasah")}
