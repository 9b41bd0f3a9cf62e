"""Relational operators that recur: latest rows, upserts, symmetric differences, seeded picks, state folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*key: Column, seed: str = "7") -> Column:
    """A pseudo-random order that is the same on each run and engine: md5 of key|seed."""
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in key], F.lit(seed)).cast("binary"))


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest(df: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """Each key's row with the greatest `at`, by partial aggregation: no group is sorted or held in one task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_r"))
    return best.select(*keys, "_r.*")


def last_known(df: DataFrame, key: str, at: list[str], columns: list[str]) -> DataFrame:
    """Each column's last value that isn't null."""
    return df.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*at))).alias(c) for c in columns])


def symmetric_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys, "left_anti").unionByName(b.join(a, keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], prefer_new: bool = True) -> DataFrame:
    """Rows of either side; where both have a key, each column is the preferred side's unless that is null."""
    rest = [c for c in old.columns if c not in keys]
    joined = old.alias("o").join(new.alias("n"), keys, "full")
    first, second = ("n", "o") if prefer_new else ("o", "n")
    return joined.select(*keys, *[F.coalesce(F.col(f"{first}.{c}"), F.col(f"{second}.{c}")).alias(c) for c in rest])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose key it lacks; the least row wins among equal keys of new."""
    fresh = new.join(old, keys, "left_anti")
    rest = [c for c in old.columns if c not in keys]
    return old.unionByName(fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*"))


def fold_visits(visits: DataFrame, key: str, at: list[str], failed: Column) -> DataFrame:
    """State of each key after its visits in order: failures in a row at the end, and when the first success and failure of
    the current run were. A success resets the failures.
    """
    ok = visits.groupBy(key).agg(F.max(F.when(~failed, F.struct(*at))).alias("_ok"))  # a join, not a window: a hot key is split
    marked = visits.join(ok, key)
    after = failed & (F.col("_ok").isNull() | (F.struct(*at) > F.col("_ok")))
    return marked.groupBy(key).agg(
        F.count(F.when(after, 1)).alias("offline_count"),
        F.min(F.when(~failed, F.col(at[0]))).alias("first_online"),
        F.min(F.when(after, F.col(at[0]))).alias("first_offline"),
        F.max(F.col(at[0])).alias("last_updated"),
    )


def fold_states(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """States as of fold_visits() of all visits, from those of earlier visits and those of later ones."""
    o, n = lambda c: F.col(f"o.{c}"), lambda c: F.col(f"n.{c}")
    reached = n("first_online").isNotNull()
    return old.alias("o").join(new.alias("n"), key, "full").select(
        key,
        F.when(reached, n("offline_count")).otherwise(F.coalesce(o("offline_count"), F.lit(0)) + F.coalesce(n("offline_count"), F.lit(0))).alias("offline_count"),
        F.coalesce(o("first_online"), n("first_online")).alias("first_online"),
        F.when(reached, n("first_offline")).otherwise(F.coalesce(o("first_offline"), n("first_offline"))).alias("first_offline"),
        F.coalesce(n("last_updated"), o("last_updated")).alias("last_updated"),
    )


def update_from(target: DataFrame, values: DataFrame, keys: list[str], columns: list[str], only_null: bool = True) -> DataFrame:
    """target with columns taken from the row of values with equal keys, where they are null (or wherever there is such a row).

    values must have at most one row for each key; the least is taken where it has more.
    """
    one = values.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_new"))
    joined = target.join(one, keys, "left")
    new = lambda c: F.coalesce(F.col(c), F.col("_new")[c]) if only_null else F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c))
    return joined.select(*[new(c).alias(c) if c in columns else F.col(c) for c in target.columns])


def numbered(df: DataFrame, order: list[str], out: str = "row", parts: int | None = None) -> tuple[DataFrame, int]:
    """df with its rows numbered from 0 in an order, and how many there are; no task holds more than a range of the order.

    Rows are dealt by ranges and sorted there; numbers follow from each range's own count and those before it. Rows equal
    in all of order are numbered in any way. The result is written, so numbers stay.
    """
    from .storage import cut

    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    at = cut(ranged.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    counts = at.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    # a row for each range, as many as there are tasks
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return at.join(F.broadcast(starts), part == F.col("_part")).select(*df.columns, (F.col("_before") + place).alias(out)), total


def near_equal(row: Column, total: int, parts: int) -> Column:
    """The part, from 1, of a row numbered from 0, if `total` rows are cut into contiguous parts whose sizes differ by one at most."""
    base, more = divmod(total, parts)
    head = more * (base + 1)
    return (F.when(row < head, F.floor(row / (base + 1))).otherwise(more + F.floor((row - head) / max(base, 1))) + 1).cast("int")


def new_ids(df: DataFrame, existing: DataFrame, id: str, order: list[str]) -> DataFrame:
    """df with an id for each row: the numbers after the greatest of existing, in an order."""
    most = existing.agg(F.coalesce(F.max(id), F.lit(0))).first()[0]
    return numbered(df, order, id)[0].withColumn(id, F.col(id) + most + 1)


def split_by_class(df: DataFrame, label: str, order: list[Column], train: int, val: int, least: int) -> DataFrame:
    """df with `split`: the first rows of each class in an order for training, the next for validation, the rest for the test.

    Classes of fewer than `least` rows are for the test. Only the first rows of a class are sorted, each task its own before
    they meet; the rest are never dealt by class.
    """
    from .sizes import small

    key = [c for c in df.columns]
    sizes = df.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(label)
    first = df.withColumn("_rn", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("_rn") <= train + val)
    first = first.join(small(sizes), label, "left_semi").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.when(F.col("_rn") <= train, "train").otherwise("val").alias("split"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return df.join(small(first), cond, "left").select(*key, F.coalesce("split", F.lit("test")).alias("split"))


def spaced_attempts(visits: DataFrame, key: str, at: str, failed: Column, retries: int = 2, wait: str = "5 minutes") -> DataFrame:
    """key, attempts, and whether one reached: a first visit and up to `retries` more, each at least `wait` after a failure.

    One aggregate for each attempt, combined before it is dealt; keys are never sorted.
    """
    v = visits.select(F.col(key), F.col(at).alias("_at"), failed.alias("_failed"))
    state = v.groupBy(key).agg(F.min(F.struct("_at", "_failed")).alias("_last")).select(key, "_last", F.lit(1).alias("attempts"))
    for _ in range(retries):
        due = v.join(state, key).where(F.col("_last")["_failed"] & (F.col("_at") >= F.col("_last")["_at"] + F.expr(f"INTERVAL {wait}")))
        nxt = due.groupBy(key).agg(F.min(F.struct("_at", "_failed")).alias("_next"))
        state = state.join(nxt, key, "left").select(key, F.coalesce("_next", "_last").alias("_last"), (F.col("attempts") + F.when(F.col("_next").isNotNull(), 1).otherwise(0)).alias("attempts"))
    return state.select(key, "attempts", (~F.col("_last")["_failed"]).alias("reached"))
