"""Mergeable quantile summaries by simultaneous bisection.

Every cut of every group is searched at once, by exact counting passes and without sorting: an open interval of a group's
values holds at least one cut; a pass counts the 2 ** STEP parts of each open interval, which decides STEP halvings for all
cuts in it, and the parts that still hold a cut are the next pass's intervals. A part with a single value is a cut value
whose rank is known exactly. Rows outside the open intervals leave, so passes shrink.

A summary is a table of points (keys, x, least, most, n, full): of the group's n rows at least `least` are <= x, and at most
`most` are < x; full says that every value of the group is a point. Fresh summaries have exact numbers, and so have those
merged from full ones; summaries are combined by summing their bounds at every point, so a merge needs no rows. Nothing is collected or broadcast; a hot group is split by its values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

#: Halvings of each open interval that a pass decides.
STEP = 5
#: Cuts of a fresh summary by rank, and by rank among distinct values (so that heavy values don't leave too few points).
CUTS, SPREAD = 40, 8
#: Groups of at most so many distinct values keep each of them.
KEEP = 40
#: Parts into which a group's rows are dealt where they meet its answers.
SALTS = 16


def counted(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x and its rows w, without rows in which a key or x is null; combined before they are dealt."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, "x"]])
    return values.where(whole).groupBy(*keys, "x").agg(F.count("*").alias("w"))


def multiselect(counts: DataFrame, keys: list[str], cuts: int = CUTS, spread: int = SPREAD, keep: int = KEEP) -> DataFrame:
    """Points of each group of counts (keys, x, w; one row a value): its least value, the value of rank ceil(k n / cuts) for
    k in 1..cuts, the value of rank ceil(k d / spread) among its d distinct ones, or all of at most `keep`.

    x are integers less than 2 ** 57 apart. Keys are any columns but x, w, least, most, n, full and names that begin with _. No rows
    give no points.
    """
    groups = counts.groupBy(*keys).agg(F.sum("w").alias("n"), F.count("*").alias("_d"), F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    groups = materialise(groups, "groups")  # so that the join below deals both its sides, and can split a hot group
    zero = F.lit(0).cast("long")
    # a group is one row, so its side makes a small table of each part, and the many rows need no order
    rows = materialise(counts.join(groups.hint("shuffle_hash"), keys).select(*keys, "x", "w", "n", "_d", "_lo", "_hi", zero.alias("_below"), zero.alias("_d_below")), "intervals")
    ranked = F.sum("w").over(Window.partitionBy(*keys).orderBy("x"))  # of at most `keep` rows
    points = [rows.where(F.col("_d") <= keep).select(*keys, "x", ranked.alias("least"), (ranked - F.col("w")).alias("most"), "n", F.lit(True).alias("full"))]
    rows = rows.where(F.col("_d") > keep)
    while True:
        rows = rows.withColumn("_part", F.expr(f"((x - _lo) * {1 << STEP}L) div (_hi - _lo + 1)"))
        inside = rows.groupBy(*keys, "_lo", "_part").agg(F.sum("w").alias("w"), F.count("*").alias("_k"), F.min("x").alias("_a"), F.max("x").alias("_b"), *[F.max(c).alias(c) for c in ("n", "_d", "_below", "_d_below")])
        order = Window.partitionBy(*keys, "_lo").orderBy("_part")  # at most 2 ** STEP rows
        upto, d_upto = F.col("_below") + F.sum("w").over(order), F.col("_d_below") + F.sum("_k").over(order)
        inside = inside.select(*keys, "_lo", "_part", "_a", "_b", "n", "_d", upto.alias("_upto"), d_upto.alias("_d_upto"), (upto - F.col("w")).alias("_below"), (d_upto - F.col("_k")).alias("_d_below"))
        holds = (F.col("_below") == 0) | F.expr(f"_upto * {cuts} div n > _below * {cuts} div n")
        if spread:
            holds = holds | F.expr(f"_d_upto * {spread} div _d > _d_below * {spread} div _d")
        held = materialise(inside.where(holds), "parts")
        points.append(held.where("_a = _b").select(*keys, F.col("_a").alias("x"), F.col("_upto").alias("least"), F.col("_below").alias("most"), "n", F.lit(False).alias("full")))
        held = held.where("_a < _b")
        if not held.limit(1).count():
            break
        inner = held.select(*keys, "_lo", "_part", "_a", "_b", F.col("_below").alias("_now"), F.col("_d_below").alias("_d_now"))
        rows = rows.join(inner.hint("shuffle_hash"), [*keys, "_lo", "_part"])
        rows = materialise(rows.select(*keys, "x", "w", "n", "_d", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.col("_now").alias("_below"), F.col("_d_now").alias("_d_below")), "intervals")
    return reduce(DataFrame.unionByName, points)


def summarise(values: DataFrame, keys: list[str], cuts: int = CUTS) -> DataFrame:
    """A summary of at most max(KEEP, cuts + SPREAD + 1) points for each group of values (keys, x)."""
    return multiselect(counted(values, keys), keys, cuts)


def merge(points: DataFrame, keys: list[str], over: list[str]) -> DataFrame:
    """The summaries of groups by `keys` combined into those of groups by `over`, a part of keys.

    At each point the bounds of all parts are summed: a part whose points beside x are p < x < q has at least least(p) rows
    <= x and at most most(q) rows < x. Both are step functions, so the sums run over the points in order. Points of a group
    by `over` meet in one task: as many summaries as one step combines, each of bounded size.
    """
    within = Window.partitionBy(*keys).orderBy("x")
    width = F.col("least") - F.col("most")  # of a full summary's points both bounds rise by this
    whole = points.where("full").select(*over, "x", "full", width.alias("_rise"), width.alias("_ahead"), F.when(F.col("most") == 0, F.struct("n", "most")).alias("_start"))
    other = points.where("NOT full").select(*over, "x", "full", (F.col("least") - F.coalesce(F.lag("least").over(within), F.lit(0))).alias("_rise"), (F.coalesce(F.lead("most").over(within), F.col("n")) - F.col("most")).alias("_ahead"), F.when(F.lag("x").over(within).isNull(), F.struct("n", "most")).alias("_start"))
    at = whole.unionByName(other).groupBy(*over, "x").agg(F.sum("_rise").alias("_rise"), F.sum("_ahead").alias("_ahead"), F.coalesce(F.sum("_start.n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_start.most"), F.lit(0)).alias("_start"), F.bool_and("full").alias("full"))
    group, order = Window.partitionBy(*over), Window.partitionBy(*over).orderBy("x")
    most = F.sum("_start").over(group) + F.sum("_ahead").over(order) - F.col("_ahead")
    return at.select(*over, "x", F.sum("_rise").over(order).alias("least"), most.alias("most"), F.sum("n").over(group).alias("n"), F.bool_and("full").over(group).alias("full"))


def compress(points: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """At most `limit` points (two at least) of each summary, spread evenly by rank; the bounds of those that stay still hold."""
    order = Window.partitionBy(*keys).orderBy("x")
    before = F.coalesce(F.lag("least").over(order), F.lit(0))
    marked = points.withColumn("_size", F.count("*").over(Window.partitionBy(*keys))).withColumn("_before", before).withColumn("_row", F.row_number().over(order))
    stays = (F.col("_size") <= limit) | (F.col("_row") == 1) | F.expr(f"least * {limit - 1} div n > _before * {limit - 1} div n")
    return marked.where(stays).withColumn("full", F.col("full") & (F.col("_size") <= limit)).drop("_size", "_before", "_row")


def _targets(low: Column, high: Column, n: Column, parts: int) -> Column:
    """The i of 1..parts - 1 whose target ceil(i n / parts) is over low and at most high."""
    first, last = F.floor(low * parts / n) + 1, F.least(F.floor(high * parts / n), F.lit(parts - 1).cast("long"))
    return F.when(first <= last, F.sequence(first, last))


def answers(points: DataFrame, keys: list[str], parts: int = 10) -> DataFrame:
    """keys, i, n, target and answer: for each target rank ceil(i n / parts) the first point that surely reaches it, or the
    point before, if that is surely nearer.

    Answers rise with i. Between neighbours of a merged summary less than n / cuts rows are uncertain, so no answer is
    farther from its target than that.
    """
    order = Window.partitionBy(*keys).orderBy("x")
    at = points.select(*keys, "x", "least", "most", "n", F.lag("x").over(order).alias("_x_before"), F.coalesce(F.lag("least").over(order), F.lit(0).cast("long")).alias("_reached"))
    each = at.select(*keys, "x", "_x_before", "most", "_reached", "n", F.explode(_targets(F.col("_reached"), F.col("least"), F.col("n"), parts)).alias("i"))
    each = each.withColumn("target", F.expr(f"(i * n + {parts - 1}) div {parts}"))
    nearer = F.col("_x_before").isNotNull() & (F.col("target") - F.col("_reached") < F.col("most") + 1 - F.col("target"))
    return each.select(*keys, F.col("i").cast("int").alias("i"), "n", "target", F.when(nearer, F.col("_x_before")).otherwise(F.col("x")).alias("answer"))


def exact(points: DataFrame, keys: list[str], parts: int = 10) -> DataFrame:
    """keys, i and exact_x, the value of rank ceil(i n / parts), from points with exact numbers that include those values."""
    return points.select(*keys, F.explode(_targets(F.col("most"), F.col("least"), F.col("n"), parts)).alias("i"), F.col("x").alias("exact_x")).withColumn("i", F.col("i").cast("int"))


def _salted(counts: DataFrame) -> DataFrame:
    """counts with a part of their group by value; what meets them comes once for each part."""
    return counts.withColumn("_salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int"))


def _for_each_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.array(*[F.lit(s) for s in range(SALTS)])))


def ranks(counts: DataFrame, keys: list[str], asked: DataFrame, parts: int = 10) -> DataFrame:
    """keys, i, n_below and n_upto: exactly how many rows of counts (keys, x, w) are below asked's answer, and up to it."""
    at = [f"_a{i}" for i in range(1, parts)]
    wide = asked.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("answer"))).alias(c) for i, c in enumerate(at, 1)])
    met = _salted(counts).join(_for_each_salt(wide).hint("shuffle_hash"), [*keys, "_salt"])
    zero = F.lit(0)
    sums = met.groupBy(*keys).agg(*[F.sum(F.when(F.col("x") < F.col(c), F.col("w")).otherwise(zero)).alias(f"{c}_below") for c in at], *[F.sum(F.when(F.col("x") <= F.col(c), F.col("w")).otherwise(zero)).alias(f"{c}_upto") for c in at])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"{c}_below").alias("n_below"), F.col(f"{c}_upto").alias("n_upto")) for i, c in enumerate(at, 1)])).alias("r")
    return sums.select(*keys, each).select(*keys, "r.*")


BATCHES = 8
#: Summaries of fewer rows are not asked.
LEAST_ROWS = 20
PARTS = 10


def batch_of(id: Column) -> Column:
    """crc32 of the decimal id, modulo BATCHES; 0 where it is null."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % BATCHES, F.lit(0)).cast("int")


def streams(clicks: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """stream, grp, batch, x and w of both streams, counted.

    Rows of clicks that share a click_id are one: the least (client_id, value, ...). Of items that share an item_id the
    least (brand, price) counts. Lines are counted by item and batch before they meet the items. Rows without item, group or money, or with
    money that is no finite number, are left out.
    """
    cents = lambda money: F.floor(F.lit(100) * money.cast("double") + F.lit(0.5)) + F.lit(1000) * F.col("batch")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    once = clicks.groupBy("click_id").agg(F.min(F.struct(F.col("client_id"), F.col("value").cast("double").alias("value"))).alias("r")).select("click_id", "r.*")
    once = once.where(F.col("client_id").isNotNull() & finite("value")).select(F.lit("value").alias("stream"), F.col("client_id").cast("string").alias("grp"), batch_of(F.col("click_id")).alias("batch"), "value")
    value = once.select("stream", "grp", "batch", cents(F.col("value")).alias("x")).groupBy("stream", "grp", "batch", "x").agg(F.count("*").alias("w"))
    sold = lines.where("item_id IS NOT NULL").groupBy("item_id", batch_of(F.col("vendor_id")).alias("batch")).agg(F.count("*").alias("w"))
    priced = items.groupBy("item_id").agg(F.min(F.struct("brand", F.col("price").cast("double").alias("price"))).alias("r")).select("item_id", "r.*").where(F.col("brand").isNotNull() & finite("price"))
    price = sold.join(priced, "item_id").select(F.lit("price").alias("stream"), F.col("brand").alias("grp"), "batch", cents(F.col("price")).alias("x"), "w")
    return value.unionByName(price.groupBy("stream", "grp", "batch", "x").agg(F.sum("w").alias("w")))


def quantile_report(counts: DataFrame) -> DataFrame:
    """Answers of the batch summaries and of the wholes merged from them (batch -1), held against exact ranks.

    counts: stream, grp, batch, x, w. Wholes come from summaries only; their exact ranks from their points where these are
    all their values, else from the rows.
    """
    group, keys = ["stream", "grp"], ["stream", "grp", "batch"]
    counts = materialise(counts, "counts")
    points = materialise(multiselect(counts, keys), "points")
    whole = merge(points, keys, group).withColumn("batch", F.lit(-1))
    asked_of = F.col("n") >= LEAST_ROWS
    both = points.where(asked_of).unionByName(whole.where(asked_of))
    both = materialise(both.withColumn("points", F.count("*").over(Window.partitionBy(*keys))), "summaries")
    sized = both.groupBy(*keys).agg(F.max("points").alias("points"), F.bool_or("full").alias("full"))
    asked = materialise(answers(both, keys, PARTS).join(sized, keys), "answers")
    # batches and full wholes have exact numbers at every point
    sure = F.col("full") | (F.col("batch") >= 0)
    own = both.where(sure).select(*keys, F.col("x").alias("answer"), F.col("most").alias("n_below"), F.col("least").alias("n_upto"))
    told = asked.where(sure).join(own, [*keys, "answer"]).join(exact(both.where(sure), keys, PARTS), [*keys, "i"])
    rest = asked.where(~sure)
    some = _salted(counts).join(_for_each_salt(rest.select(*group).distinct()).hint("shuffle_hash"), [*group, "_salt"], "left_semi")
    some = materialise(some.drop("_salt"), "unsure")
    large = materialise(some.groupBy(*group, "x").agg(F.sum("w").alias("w")), "wholes")
    truth = exact(multiselect(large, group, PARTS, 0), group, PARTS)
    counted_ = rest.join(ranks(some, group, rest, PARTS), [*group, "i"]).join(truth, [*group, "i"])
    out = told.unionByName(counted_.select(*told.columns))
    error = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    out = out.withColumn("rank_error", error).withColumn("points", F.col("points").cast("long"))
    return out.select("stream", "grp", "batch", "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", (1000 * F.col("rank_error") <= 50 * F.col("n")).alias("within"))
