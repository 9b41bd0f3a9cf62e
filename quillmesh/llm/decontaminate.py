"""Benchmark decontamination by word windows, in DataFrame functions only.

An item's windows of ten words are the test n-grams. Each covers exactly one run of five words that begins at a multiple of
six in the document, its anchor: a document looks up one hash in six positions in a broadcast set of all runs of five words
of the windows, and the six windows around each find are verified as strings. So no occurrence is missed, every hit is
exact, and a document's words are not hashed ten times over. Items of fewer words have anchors of half their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import is_small, materialise, maybe_broadcast
from .words import item_words, run_hash, word_hashes

WINDOW = 10


def anchor_of(k: int) -> tuple[int, int]:
    """Words in the anchor of windows of k words, and the distance of anchors: any window has one that lies within it."""
    size = (k + 1) // 2
    return size, k - size + 1


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """win, len and set_key of all distinct windows, with items, the sorted ids of the items that have it.

    An item of fewer words is one window; without words it has none. set_key tells lists of items apart.
    """
    w = benchmark.select("item_id", item_words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    at = F.sequence(F.lit(0), F.greatest(F.size("_w") - window, F.lit(0)))
    wins = F.transform(at, lambda i: F.slice(F.col("_w"), i + 1, F.lit(window)))
    each = w.select("item_id", F.explode(wins).alias("words"))
    items = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    by = each.groupBy("words").agg(items.alias("items"))
    return by.select("words", F.concat_ws(" ", "words").alias("win"), F.size("words").alias("len"), F.md5(F.concat_ws(",", "items").cast("binary")).alias("set_key"), "items")


def anchors(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """The distinct hashes of the anchors that windows can have."""
    hashed = windows.select("len", word_hashes(F.col("words")).alias("h"))
    of = None
    for k in sizes:
        size, step = anchor_of(k)
        runs = F.transform(F.sequence(F.lit(0), F.lit(step - 1)), lambda i: run_hash(F.col("h"), i, size, k))  # noqa: B023
        one = hashed.where(F.col("len") == k).select(F.explode(runs).alias("anchor"))
        of = one if of is None else of.unionByName(one)
    return of.distinct()


def positions(h: Column, sizes: list[int]) -> Column:
    """Structs of pos, len and anchor: a first one without an anchor, then the anchors of each size in a document."""
    blank = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("long").alias("anchor")))
    out = [blank]
    for k in sizes:
        size, step = anchor_of(k)
        at = F.when(F.size(h) >= k, F.sequence(F.lit(0), F.size(h) - size, F.lit(step))).otherwise(F.array().cast("array<int>"))
        out.append(F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(k).alias("len"), run_hash(h, i, size, k).alias("anchor"))))  # noqa: B023
    return F.concat(*out)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, _text (a hash that tells rows of one doc_id apart), n_words, n_hit, n_items and items for each document.

    items: the sorted ids of items with a window in the document. Null and empty texts have no words. Each row of docs
    gives a row, repeated ones too; rows that share a doc_id with other texts stay apart. An empty benchmark hits nothing.
    Further columns are ignored.
    """
    windows = materialise(item_windows(benchmark, window), "windows")
    sizes = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most `window` numbers
    base = docs.select("doc_id", F.xxhash64("text").alias("_text"), item_words(F.col("text")).alias("w"))
    hashed = base.select("doc_id", "_text", "w", F.size("w").alias("n"), word_hashes(F.col("w")).alias("h"))
    rows = hashed.select("doc_id", "_text", "w", "n", F.inline(positions(F.col("h"), sizes)))
    known = (anchors(windows, sizes) if sizes else windows.select(F.lit(0).cast("long").alias("anchor")).limit(0)).withColumnRenamed("anchor", "_anchor")
    known = materialise(known, "anchors")
    # windows that an anchor at pos lies in begin at most `reach` words before it
    size, step = F.floor((F.col("len") + 1) / 2).cast("int"), (F.col("len") - F.floor((F.col("len") + 1) / 2)).cast("int")
    low = F.greatest(F.col("pos") - step, F.lit(0))
    high = F.least(F.col("pos"), F.col("n") - F.col("len"))
    near = F.when(F.col("pos") >= 0, F.slice(F.col("w"), low + 1, high - low + F.col("len")))
    keep = F.col("_anchor").isNotNull() | (F.col("pos") < 0)
    if is_small(known):  # words are cut out for the few rows that are left
        found = rows.join(F.broadcast(known), F.col("anchor") == F.col("_anchor"), "left").where(keep).withColumn("near", near).drop("w")
    else:  # rows are dealt by anchor, with the words around it only
        found = rows.withColumn("near", near).drop("w").join(known, F.col("anchor") == F.col("_anchor"), "left").where(keep)
    starts = F.transform(F.sequence(low, high), lambda i: F.struct(i.alias("from"), F.concat_ws(" ", F.slice(F.col("near"), i - low + 1, F.col("len"))).alias("text")))
    blank = F.array(F.struct(F.lit(-1).alias("from"), F.lit(None).cast("string").alias("text")))
    tried = found.select("doc_id", "_text", "n", "len", F.explode(F.when(F.col("pos") >= 0, starts).otherwise(blank)).alias("s"))
    tried = tried.select("doc_id", "_text", "n", "len", "s.from", "s.text")
    exact = windows.select(F.col("win"), F.col("len").alias("_len"), "set_key")
    hits = tried.join(maybe_broadcast(exact), (F.col("text") == F.col("win")) & (F.col("len") == F.col("_len")), "left").where(F.col("win").isNotNull() | (F.col("from") < 0))
    by = hits.groupBy("doc_id", "_text").agg(
        F.max("n").cast("long").alias("n_words"),
        F.count_if(F.col("from") < 0).alias("copies"),
        F.collect_set(F.when(F.col("from") >= 0, F.struct("from", "len"))).alias("spans"),
        F.collect_set("set_key").alias("sets"),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))

    def cover(acc, x):
        to = x["from"] + x["len"]
        return F.struct(F.greatest(acc["end"], to).alias("end"), (acc["hit"] + F.greatest(to - F.greatest(acc["end"], x["from"]), F.lit(0))).alias("hit"))

    by = by.select("doc_id", "_text", "n_words", "copies", F.aggregate(F.array_sort("spans"), start, cover)["hit"].alias("n_hit"), "sets")
    by = materialise(by, "decontaminate")  # a row a document, read twice below
    lists = windows.groupBy("set_key").agg(F.first("items").alias("items"))
    pairs = by.where(F.size("sets") > 0).select("doc_id", "_text", F.explode("sets").alias("set_key")).join(maybe_broadcast(lists), "set_key")
    listed = pairs.groupBy(F.col("doc_id").alias("_d"), F.col("_text").alias("_t")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = by.drop("sets").join(listed, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")), "left").drop("_d", "_t")
    out = out.withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).withColumn("n_items", F.size("items").cast("long"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return out.select("*", each.alias("_copy")).drop("copies", "_copy")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest of scan(): items as a checksum, and whether anything is hit."""
    got = scan(docs, benchmark, window)
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that no benchmark window occurs in, with their columns.

    Null and empty texts stay; repeated rows stay or go alike. Names that begin with _qm_ are taken.
    """
    bad = scan(docs, benchmark, window).where(F.col("n_hit") > 0).select(F.col("doc_id").alias("_qm_d"), F.col("_text").alias("_qm_t")).distinct()
    return docs.join(maybe_broadcast(materialise(bad, "contaminated")), F.col("doc_id").eqNullSafe(F.col("_qm_d")) & (F.xxhash64("text") == F.col("_qm_t")), "left_anti")
