"""Removal of boilerplate lines by how many sites they spread over.

HyperLogLog sketches of a line's sites merge by aggregation. Lines whose estimate is within the sketches' error of the
threshold get an exact distinct count; only lines surely below are left out of it. A boilerplate line stays where it
occurs first (least doc_id, then position), so its content is not lost.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise, maybe_broadcast

#: A line on this many distinct sites is boilerplate.
SITES = 4
LG_K = 8


def lines_of(docs: DataFrame, site: str = "source") -> DataFrame:
    """doc_id, _text, site, pos, and the key (hash and length) of each line with a word."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.col(site).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return lines.select("doc_id", "_text", "site", "pos", F.xxhash64("line").alias("h"), F.length("line").alias("n"))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """Keys of lines on at least `sites` distinct sites, with the first occurrence of each.

    The error bound is four standard errors of the sketch, and one more for its rounding. A null site counts for none.
    """
    error = 4 * 1.04 / math.sqrt(1 << LG_K)
    low, high = math.floor(sites * (1 - error)) - 1, math.ceil(sites * (1 + error)) + 1
    first = F.min(F.struct(F.col("doc_id"), F.col("pos"))).alias("first")
    sketched = lines.groupBy("h", "n").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("about"), F.count("*").alias("seen"), first)
    # a line cannot be on more sites than it has occurrences
    sketched = materialise(sketched.where((F.col("about") >= low) & (F.col("seen") >= sites)), "lines")
    near = sketched.where(F.col("about") <= high).select(F.col("h").alias("_h"), F.col("n").alias("_n"))
    exact = lines.join(maybe_broadcast(near), (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n")), "left_semi")
    exact = exact.where(F.col("site").isNotNull()).groupBy("h", "n", "site").agg(F.lit(1).alias("one")).groupBy("h", "n").agg(F.count("*").alias("exact"))
    counted = sketched.join(exact, ["h", "n"], "left")
    spread = F.when(F.col("about") <= high, F.coalesce("exact", F.lit(0))).otherwise(F.col("about"))
    return counted.where(spread >= sites).select("h", "n", "first", spread.alias("sites"))


def remove_lines(docs: DataFrame, sites: int = SITES, site: str = "source", gone: str = "lines_removed") -> DataFrame:
    """docs with `text` less its boilerplate lines, and the positions that went in column `gone` (which it replaces).

    Null and empty texts stay as they are. Rows that repeat doc_id and text are treated alike. Blank lines stay. Other
    columns stay, but for names that begin with _qm_.
    """
    lines = lines_of(docs, site)
    known = materialise(boilerplate(lines, sites), "boilerplate").select(F.col("h").alias("_h"), F.col("n").alias("_n"), "first")
    out = lines.join(maybe_broadcast(known), (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n")))
    out = out.where(~F.struct(F.col("doc_id"), F.col("pos")).eqNullSafe(F.col("first")))
    out = out.groupBy(F.col("doc_id").alias("_qm_d"), F.col("_text").alias("_qm_t")).agg(F.sort_array(F.collect_set("pos")).alias("_qm_gone"))
    joined = docs.join(out, F.col("doc_id").eqNullSafe(F.col("_qm_d")) & (F.xxhash64("text") == F.col("_qm_t")), "left")
    parts = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_qm_gone"))
    text = F.when(F.col("_qm_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    return joined.withColumn("text", text).withColumn(gone, F.coalesce("_qm_gone", F.array().cast("array<int>"))).drop("_qm_d", "_qm_t", *([] if gone == "_qm_gone" else ["_qm_gone"]))


def line_digest(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """doc_id, how many lines a text has and loses, and what is left: its characters and md5."""
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1)))
    got = remove_lines(docs.select("doc_id", "text", "source", n.cast("long").alias("n_lines")), sites)
    return got.select("doc_id", "n_lines", F.size("lines_removed").cast("long").alias("n_removed"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars_left"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("left_md5"))


def filter_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs with their columns less boilerplate lines; a document that has lost all its lines with words goes.

    n_chars, where there is such a column, follows the text.
    """
    out = remove_lines(docs, sites, gone="_qm_gone")
    cut = F.size("_qm_gone") > 0
    out = out.where(~(cut & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
