"""Hosts against tables: public suffixes, hosting providers, excluded names."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sizes import BYTES, ROWS, small
from .storage import cut


def host_of(netloc: Column) -> Column:
    """The host of a network location: without user and port, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":\d*$", ""))


def with_suffix(df: DataFrame, host: str, suffixes: DataFrame) -> DataFrame:
    """df with `suffix`, the public suffix of column host, and `registered`, the domain below it; null where there is none.

    suffixes: suffix and kind (exact, wildcard, punycode, exception) of a list's rules, of any number. An exception's suffix
    is one label shorter than it is; else the longest rule holds, where a wildcard stands for one label more. There is one
    join for each number of labels that a rule has, by broadcast if the list is small; hosts are not dealt anew for it.
    """
    rules = suffixes.where("suffix IS NOT NULL AND suffix <> ''").select("suffix", F.size(F.split("suffix", r"\.")).alias("n"), "kind")
    by = rules.groupBy("suffix", "n").agg(*[F.bool_or(F.col("kind").isin(*kinds)).alias(name) for name, kinds in (("_plain", ("exact", "punycode")), ("_wild", ("wildcard",)), ("_not", ("exception",)))])
    count, size, depth = by.agg(F.count("*"), F.sum(F.octet_length("suffix") + 32), F.max("n")).first()
    depth = depth or 0  # labels of the longest rule, a handful
    hint = F.broadcast if count <= ROWS and (size or 0) <= BYTES else lambda side: side
    out = df.withColumn("_labels", F.split(F.col(host), r"\."))
    n = F.size("_labels")
    found, exceptions = [], []
    for k in range(1, depth + 1):
        side = hint(by.where(F.col("n") == k).select(F.col("suffix").alias(f"_s{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("_plain", "_wild", "_not")]))
        tail = F.when(n >= k, F.array_join(F.slice("_labels", -k, k), "."))
        out = out.join(side, tail == F.col(f"_s{k}"), "left")
        exceptions.append(F.when(F.col(f"_not{k}"), F.lit(k - 1)))
        found.append(F.when(F.col(f"_wild{k}") & (n > k), F.lit(k + 1)).when(F.col(f"_plain{k}"), F.lit(k)))
    none = F.lit(None).cast("int")
    length = F.coalesce(F.greatest(*exceptions, none, none), F.greatest(*found, none, none)) if depth else none
    last = lambda m: F.array_join(F.slice("_labels", -m, m), ".")
    out = out.withColumn("_length", length)
    labels = F.coalesce("_length", F.lit(1))
    out = out.withColumn("suffix", F.when(F.col("_length").isNotNull(), last(labels)))
    out = out.withColumn("registered", F.when(F.col("_length").isNotNull() & (n > F.col("_length")), last(F.least(labels + 1, n))))
    return out.select(*df.columns, "suffix", "registered")


#: Characters of the pieces by which names are found in texts; shorter names are their own piece.
GRAM = 8


def _grams(text: Column, size: int | Column) -> Column:
    """The distinct pieces of a text with so many characters."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: text.substr(i, F.lit(size) if isinstance(size, int) else size))
    return F.when(F.length(text) >= size, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def occurrences(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """text and name of every pair in which the text contains the name, each pair once; both tables may be of any size.

    Of a name's pieces, the one that the fewest texts have is its anchor. Texts meet the anchors by equality, and what meets
    is verified as strings, so no text is held against every name. A piece that no text has rules its name out. Nulls are in
    no pair; an empty name is in every text.
    """
    t = texts.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    n = cut(names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct().withColumn("size", F.least(F.length("name"), F.lit(GRAM))), "names")
    sizes = [r[0] for r in n.select("size").distinct().collect()]  # GRAM + 1 at most
    pieces = t.select("text", F.explode(F.flatten(F.array(*[_grams(F.col("text"), s) for s in sizes if s], F.array().cast("array<string>")))).alias("piece"))
    # texts have pieces of several sizes, and a piece of a name is one of its own size, so sizes need no comparing
    named = n.where("size > 0").select("name", F.explode(_grams(F.col("name"), F.col("size"))).alias("piece"))
    common = pieces.join(small(cut(named.select("piece").distinct(), "pieces")), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    anchors = named.join(common, "piece", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("a")).where("a.n > 0")
    anchors = small(cut(anchors.select("name", F.col("a.piece").alias("piece")), "anchors"))
    found = pieces.join(anchors, "piece").where(F.col("text").contains(F.col("name"))).select("text", "name")
    return found.unionByName(t.withColumn("name", F.lit(""))) if 0 in sizes else found


def first_contained(df: DataFrame, text: str, names: DataFrame, name: str, order: str, out: str) -> DataFrame:
    """df with column out: the first of names, by order, that column text contains, or null. Tables of any size."""
    first = names.groupBy(F.col(name).alias("name")).agg(F.min(order).alias("o"))
    found = occurrences(df, text, names, name).join(first, "name").groupBy("text").agg(F.min(F.struct("o", "name")).alias("r"))
    best = small(cut(found.select(F.col("text").alias("_text"), F.col("r.name").alias("_first")), "contained"))
    return df.join(best, F.col(text) == F.col("_text"), "left").drop("_text").withColumnRenamed("_first", out)


def without_any(df: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """The rows of df whose column text contains none of names; null texts stay. Tables of any size."""
    hit = small(cut(occurrences(df, text, names, name).select(F.col("text").alias("_text")).distinct(), "contained"))
    return df.join(hit, F.col(text) == F.col("_text"), "left_anti")


def within_none(df: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """The rows of df whose column text occurs in none of names; null texts stay. Tables of any size."""
    hit = small(cut(occurrences(names, name, df, text).select(F.col("name").alias("_text")).distinct(), "contained"))
    return df.join(hit, F.col(text) == F.col("_text"), "left_anti")


def decoded(host: str | None) -> str | None:
    """A host with its punycode labels decoded; one that can't be decoded stays."""
    if host is None or "xn--" not in host.lower():
        return host
    try:
        return ".".join(x[4:].encode("ascii").decode("punycode") if x.lower().startswith("xn--") else x for x in host.split("."))
    except UnicodeError:
        return host


def encoded(host: str | None) -> str | None:
    """A host with labels other than ASCII in punycode, in lower case."""
    if host is None or host.isascii():
        return host
    return ".".join(x if x.isascii() else "xn--" + x.lower().encode("punycode").decode("ascii") for x in host.split("."))


def _by_batch(one):
    return F.pandas_udf(lambda s: pd.Series([one(x) for x in s], index=s.index, dtype=object), T.StringType())


def unicode_host(host: Column) -> Column:
    """decoded() over Arrow batches."""
    return _by_batch(decoded)(host)


def ascii_host(host: Column) -> Column:
    """encoded() over Arrow batches."""
    return _by_batch(encoded)(host)


def endpoints(domains: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Each domain's URL with the component, file and endpoint of each rule (component, file, entries, endpoints, arrays).

    Every entry point meets every endpoint; only text is made. Rules are a small table, which is checked.
    """
    path = F.explode(F.flatten(F.transform("entries", lambda a: F.transform("endpoints", lambda b: F.concat(a, F.lit("/"), b)))))
    each = small(rules.select("component", "file", path.alias("_path")))
    at = F.regexp_extract(F.col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    lead = F.when(F.col("_path").startswith("/"), "").otherwise("/")
    return domains.join(each).select(*[F.col(c) for c in domains.columns], "component", "file", F.concat(at, lead, F.col("_path")).alias("endpoint"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
