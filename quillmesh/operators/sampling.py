"""Seeded draws: weighted samples without replacement, and epochs of batches that are balanced over subclasses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import draw, numbered
from .sizes import small
from .storage import cut

#: Bits of a draw that count as a number.
BITS = 52


def drawn(*key: Column, seed: str = "7") -> Column:
    """A whole number of 52 bits from the key and the seed, the same on each engine."""
    return F.conv(F.substring(draw(*key, seed=seed), 1, BITS // 4), 16, 10).cast("long")


def weighted_sample(df: DataFrame, groups: list[str], key: str, weight: str, n: int, seed: str = "7") -> DataFrame:
    """n rows of each group (all of fewer), drawn without replacement with chances in proportion to their weight.

    Each row waits for an exponential time with its weight as the rate, and the first n stay. A task keeps n rows of a group
    before they meet, so a hot group is no load. Rows whose weight is null or not over 0, or whose key is null, are never drawn.
    """
    w = F.col(weight).cast("double")
    wait = -F.ln((drawn(F.col(key), seed=seed) + F.lit(0.5)) / float(1 << BITS)) / w
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy("_wait", key))
    return df.where((w > 0) & F.col(key).isNotNull()).withColumn("_wait", wait).withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_wait", "_rank")


def balanced_batches(df: DataFrame, label: str, key: str, classes: int, size: int, seed: str = "7") -> DataFrame:
    """batch, slot, label and key of an epoch: as many batches as df has whole ones of `size` rows, and in each of them
    size / classes rows of `classes` different subclasses.

    Subclasses stand in a seeded order that is cut into as many near-equal strata as a batch has classes; a batch draws one
    from each, so all are different and about equally likely, however large. Of a subclass a batch takes neighbours in a
    seeded order, from a drawn place on and around the end, so rows repeat within a batch only where there are too few. Rows
    without label or key are left out; there must be `classes` subclasses. Another seed is another epoch.
    """
    per = size // classes
    rows = df.select(F.col(label).alias("label"), F.col(key).alias("key")).where("label IS NOT NULL AND key IS NOT NULL")
    rows, total = numbered(rows.withColumn("_draw", draw(F.col("key"), seed=seed)), ["label", "_draw", "key"], "row")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.min("row").alias("start"))
    sizes, s = numbered(sizes.withColumn("_draw", draw(F.col("label"), seed=seed)), ["_draw", "label"], "place")
    if s < classes:
        raise ValueError(f"{s} subclasses are fewer than {classes}")
    batches = df.sparkSession.range(total // size).select(F.col("id").alias("batch"), F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("stratum"))
    low, high = F.floor(F.col("stratum") * s / classes), F.floor((F.col("stratum") + 1) * s / classes)
    picked = batches.withColumn("place", low + drawn(F.col("batch"), F.col("stratum"), seed=seed) % (high - low))
    picked = picked.join(small(cut(sizes, "subclasses")), "place").withColumn("first", drawn(F.col("batch"), F.col("stratum"), F.lit("row"), seed=seed) % F.col("n"))
    slots = picked.select("batch", "stratum", "start", "n", "first", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("j"))
    slots = slots.select("batch", (F.col("stratum") * per + F.col("j")).cast("int").alias("slot"), (F.col("start") + (F.col("first") + F.col("j")) % F.col("n")).alias("row"))
    return slots.join(rows, "row").select("batch", "slot", "label", "key")
