"""Vector operators: centroids, distances, range joins and density clustering."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import small
from .storage import cut

#: Vectors in a block of the range join: BLOCK of a few, of more so many that there are about BLOCKS blocks, MOST at last.
#: So what a vector is sent to does not grow with their number, up to BLOCKS * MOST of them.
BLOCK, BLOCKS, MOST = 512, 16, 1 << 16
#: Rows and columns of a block's product that a task holds at once, and pairs whose distances it computes at once.
TILE, CHUNK = 1024, 1 << 12


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def normalise(v: Column) -> Column:
    """v at unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """The mean vector of each group; partial sums by position, so a hot group is summed where its rows are."""
    sums = df.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return sums.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


#: Centers in a block that a vector meets at once, blocks that are broadcast or make a key, and parts of a key.
CENTERS, TOGETHER, PARTS = 256, 64, 64


def nearest(df: DataFrame, key: str, vector: str, centers: DataFrame, id: str, center: str) -> DataFrame:
    """key, nearest (the id of the nearest center, the least of equals) and its distance.

    Centers are dealt into blocks of about CENTERS, and every vector meets every block once, as that is what nearest asks
    for. A few blocks go to all vectors by broadcast; of more, TOGETHER make a key, and vectors are dealt to each key and a
    part of it, so it is an equi-join without a large task.
    """
    blocks = max(1, -(-centers.count() // CENTERS))
    listed = centers.select(F.pmod(F.xxhash64(id), F.lit(blocks)).alias("_b"), F.struct(F.col(id).alias("id"), F.col(center).alias("c")).alias("x"))
    listed = cut(listed.groupBy("_b").agg(F.array_sort(F.collect_list("x")).alias("_all")), "centers")
    best = F.array_min(F.transform("_all", lambda x: F.struct(distance(F.col(vector), x["c"]).alias("d"), x["id"].alias("id"))))
    v = df.select(key, vector)
    if blocks <= TOGETHER:
        met = v.crossJoin(F.broadcast(listed))
    else:
        keys = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        v = v.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS))).withColumn("_key", keys(-(-blocks // TOGETHER)))
        met = v.join(listed.withColumn("_key", F.floor(F.col("_b") / TOGETHER)).withColumn("_part", keys(PARTS)), ["_key", "_part"])
    met = met.select(key, best.alias("b"))
    if blocks > 1:
        met = met.groupBy(key).agg(F.min("b").alias("b"))
    return met.select(key, F.col("b.id").alias("nearest"), F.col("b.d").alias("distance"))


#: Principal axes by which the range join lays its cells.
AXES = 2


def in_cells(df: DataFrame, key: str, vector: str, eps: float) -> DataFrame | None:
    """k, v and cell of vectors, written; None if there are none. Cells are as wide as eps along the principal axes."""
    exact = df.schema[vector].dataType.simpleString() in ("array<float>", "array<double>")
    v = df.select(F.col(key).alias("k"), (F.col(vector) if exact else F.col(vector).cast("array<double>")).alias("v")).where("v IS NOT NULL")
    if not v.limit(1).count():
        return None
    kind = df.schema[key].dataType.simpleString()
    if kind not in ("int", "bigint", "smallint", "tinyint"):
        raise TypeError(f"keys must be numbers: {kind}")
    mean, axes = principal_axes(v, "v", AXES)
    names = [f"x{i}" for i in range(len(axes))]
    placed = cut(projected(v, "v", mean, axes, names), "placed")
    low = placed.agg(*[F.min(n).alias(n) for n in names]).first()
    width = eps * (1 + 1e-9) + 1e-12
    return placed.select("k", "v", F.array(*[F.floor((F.col(n) - F.lit(low[n])) / F.lit(width)) for n in names]).alias("cell"))


def meetings(placed: DataFrame):
    """The rows (k, v, cell and what else is there) of each two blocks that may hold a pair, grouped by these two."""
    axes, rest = len(placed.select("cell").first()["cell"]), [c for c in placed.columns if c != "cell"]
    block = max(BLOCK, min(-(-placed.count() // BLOCKS), MOST))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = cut(sizes, "cells")
    steps = F.array(*[F.array(*[F.lit(x).cast("long") for x in step]) for step in itertools.product((-1, 0, 1), repeat=axes)])
    own = placed.join(small(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).drop("blocks")
    # a vector goes to each block that touches its own, its own included
    beside = own.select(*rest, "cell", "block", F.explode(F.transform(steps, lambda s: F.zip_with("cell", s, lambda x, y: x + y))).alias("other"))
    met = beside.join(small(sizes.select(F.col("cell").alias("other"), "blocks")), "other").select(*rest, F.struct("cell", "block").alias("me"), "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    it = F.struct(F.col("other").alias("cell"), F.col("j").alias("block"))
    dealt = met.select(*rest, (F.col("me") <= it).alias("first"), (F.col("me") == it).alias("same"), F.least("me", it).alias("i"), F.greatest("me", it).alias("j"))
    return dealt.groupBy("i", "j")


def gathered(batches: Iterator[pa.RecordBatch], *columns: str) -> tuple:
    """Keys, vectors, columns and how many rows are of the first block, whose rows come first; 0 if both blocks are one."""
    t = pa.Table.from_batches(list(batches))
    first = t["first"].to_numpy()
    order = np.argsort(~first, kind="stable")
    m = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(first), -1)[order].astype(float)
    return t["k"].to_numpy()[order].astype(np.int64), m, *[t[c].to_numpy()[order] for c in columns], 0 if t["same"][0].as_py() else int(first.sum())


def tiles(n: int, split: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of rows that meet at once, TILE and TILE: of those before and after split, or each two of all n if it is 0."""
    for i in range(0, split or n, TILE):
        for j in range(split or i, n, TILE):
            yield np.arange(i, min(i + TILE, split or n)), np.arange(j, min(j + TILE, n))


def far(m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows x from the rows y, CHUNK at once."""
    d = np.empty(len(x))
    for c in range(0, len(x), CHUNK):
        d[c : c + CHUNK] = ((m[x[c : c + CHUNK]] - m[y[c : c + CHUNK]]) ** 2).sum(axis=1)
    return np.sqrt(d)


def finder(k: np.ndarray, m: np.ndarray, eps: float):
    """near(i, j): positions x in i and y in j of all pairs of rows with different keys within eps.

    A product gives the squared distances. Its rounding has a bound, and distances that lie as near to eps as that are
    computed anew by differences, so the product is in single precision where that leaves few of them.
    """
    low = m - m.mean(axis=0)  # products of large numbers would hide small distances
    square = (low * low).sum(axis=1)
    most = square.max() or 1.0
    low /= np.sqrt(most)
    square /= most
    n, bound = m.shape[1], min(eps * eps / most, 8.0)  # no square is above 4 now
    off = {t: float(4 * (n + 8) * np.finfo(t).eps) for t in (np.float32, np.float64)}
    kind = np.float32 if off[np.float32] <= bound / 100 else np.float64
    sure, ever = float(bound - off[kind]), float(bound + off[kind])
    right = np.empty((len(m), n + 2), kind)
    right[:, :n], right[:, n], right[:, n + 1] = low, 1, square
    left = -2 * right
    left[:, n], left[:, n + 1] = square, 1
    del low, square

    def near(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d2 = (left[i] @ right[j].T).ravel()
        at = np.flatnonzero(d2 <= ever)
        x, y = np.divmod(at, max(1, len(j)))
        x, y = i[x], j[y]
        ok = k[x] != k[y]
        unsure = np.flatnonzero(ok & (d2[at] > sure))
        ok[unsure] = far(m, x[unsure], y[unsure]) <= eps
        return x[ok], y[ok]

    return near


def near_pairs(k: np.ndarray, m: np.ndarray, split: int, eps: float):
    """Positions x, y and distances of pairs within eps, a tile's at once: between the rows before and after split, of all if it is 0."""
    near = finder(k, m, eps)
    for i, j in tiles(len(m), split):
        x, y = near(i, j)
        if not split:
            x, y = x[x < y], y[x < y]
        yield x, y, far(m, x, y)


def range_join(df: DataFrame, key: str, vector: str, eps: float) -> DataFrame:
    """Pairs a < b of keys whose vectors are within eps.

    Vectors are laid into cells as wide as eps along their principal axes: a pair within eps is in one cell or in two that
    touch, so all others never meet. A cell's vectors are dealt into blocks, and two blocks that may hold a pair are a
    matrix product in one task, tile by tile; blocks have a bounded size and only pairs within eps leave a task. Where eps
    is as wide as the data, all are in one cell and every two blocks meet.
    """
    placed = in_cells(df, key, vector, eps)
    if placed is None:
        return df.limit(0).select(F.col(key).cast("long").alias("a"), F.col(key).cast("long").alias("b"), F.lit(0.0).alias("distance"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, m, split = gathered(batches)
        for x, y, d in near_pairs(k, m, split, eps):
            yield pa.RecordBatch.from_pydict({"a": np.minimum(k[x], k[y]), "b": np.maximum(k[x], k[y]), "distance": d})

    return meetings(placed).applyInArrow(near, "a long, b long, distance double")


def joined_roots(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """root (of each position the least one known to be linked with it) once positions x and y are linked, too."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def components(links: DataFrame) -> DataFrame:
    """node and label, the least node that links (a, b) lead to; label propagation with pointer jumping, each round written."""
    edges = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = cut(labels, "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        stepped = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        new = cut(stepped.join(up, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "was"), "labels")
        labels = new.select("node", "label")
        if not new.where(F.col("label") != F.col("was")).limit(1).count():
            return labels


def dbscan(df: DataFrame, key: str, vector: str, eps: float, min_points: int) -> DataFrame:
    """key, core and cluster: the least key of the cluster's cores, or -1 for noise.

    A point is a core if min_points are within eps, itself included. A border point joins the cluster of its least core.
    Pairs, which may grow with the square of the points, never leave a task: a first pass counts each point's neighbours,
    a second one returns a forest of the links among the cores of two blocks, and the least core beside each other point.
    Rows that a task knows as cores are counted no further, and cores that it has linked don't meet again; so what is dense
    takes few products, and all others are made.
    """
    placed = in_cells(df, key, vector, eps)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, m, split = gathered(batches)
        near, n = finder(k, m, eps), np.zeros(len(k), np.int64)
        for i, j in tiles(len(m), split):
            a, b = i[n[i] < min_points - 1], j[n[j] < min_points - 1]
            if i[0] == j[0]:
                found = [near(a, j)[0]]
            elif len(a) * len(j) + len(i) * len(b) < len(i) * len(j):
                found = [near(a, j)[0], near(i, b)[1]]
            else:
                found = near(i, j)
            for x in found:
                n += np.bincount(x, minlength=len(n))
        yield pa.RecordBatch.from_pydict({"k": k[n > 0], "n": n[n > 0]})

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, m, core, split = gathered(batches, "core")
        root, none = np.arange(len(k)), np.iinfo(np.int64).max
        near, least = finder(k, m, eps), np.full(len(k), none)
        for i, j in tiles(len(m), split):
            a, b = i[core[i]], j[core[j]]
            roots, times = np.unique(root[np.append(a, b)], return_counts=True)
            if len(roots) > 1:  # those of the most frequent root needn't meet each other
                most = roots[times.argmax()]
                root = joined_roots(root, *near(a[root[a] != most], b))
                root = joined_roots(root, *near(a, b[root[b] != most]))
            for edge, beside in ((i[~core[i]], b), (j[~core[j]], a)):
                x, y = near(edge, beside)
                np.minimum.at(least, x, k[y])
        linked, beside = np.flatnonzero(root != np.arange(len(k))), np.flatnonzero(least != none)
        yield pa.RecordBatch.from_pydict({"a": np.append(k[root[linked]], least[beside]), "b": np.append(k[linked], k[beside]), "border": np.arange(len(linked) + len(beside)) >= len(linked)})

    keys = df.select(F.col(key).cast("long").alias("core"))
    if placed is None:
        core, met = keys if min_points <= 1 else keys.limit(0), df.sparkSession.createDataFrame([], "a long, b long, border boolean")
    else:
        degree = meetings(placed).applyInArrow(count, "k long, n long").groupBy("k").agg((F.sum("n") + 1).alias("n"))
        core = cut(keys if min_points <= 1 else degree.where(F.col("n") >= min_points).select(F.col("k").alias("core")), "cores")
        flagged = placed.join(core.distinct().withColumnRenamed("core", "_c"), F.col("k") == F.col("_c"), "left").select("k", "v", "cell", F.col("_c").isNotNull().alias("core"))
        met = cut(meetings(flagged).applyInArrow(link, "a long, b long, border boolean"), "met")
    linked = components(met.where("NOT border"))
    label = core.join(linked, F.col("core") == F.col("node"), "left").select("core", F.coalesce("label", "core").alias("cluster"))
    border = met.where("border").groupBy("b").agg(F.min("a").alias("nearest"))
    out = df.select(key).join(label.select(F.col("core").alias(key), F.col("cluster").alias("own")), key, "left")
    out = out.join(border.withColumnRenamed("b", key), key, "left").join(label.select(F.col("core").alias("nearest"), F.col("cluster").alias("via")), "nearest", "left")
    return out.select(key, F.col("own").isNotNull().alias("core"), F.coalesce("own", "via", F.lit(-1)).alias("cluster"))


def principal_axes(df: DataFrame, vector: str, k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the first k principal axes (rows) of vectors, each axis with its greatest entry positive.

    Tasks sum vectors and products of their entries, and these sums are added by position on the executors: the driver
    receives one triangle of a matrix, however many tasks there are.
    """

    def sums(batches):
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                m = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                m = np.column_stack([np.ones(len(m)), m])  # row 0 has the count and the sums
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": total[i, j]})

    parts = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>")).mapInArrow(sums, "i int, j int, s double")
    got = parts.groupBy("i", "j").agg(F.sum("s").alias("s")).orderBy("i", "j").toPandas()
    gram = np.zeros((got["j"].max() + 1,) * 2)
    gram[got["i"], got["j"]] = gram[got["j"], got["i"]] = got["s"]
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :k].T
    return mean, axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]


def projected(df: DataFrame, vector: str, mean: np.ndarray, axes: np.ndarray, names: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """df with the coordinates of its vectors along the axes."""
    dot = lambda axis: F.aggregate(F.zip_with(F.col(vector), F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(m)).alias("m")) for a, m in zip(axis, mean)]), lambda v, w: (v.cast("double") - w["m"]) * w["a"]), F.lit(0.0), lambda s, x: s + x)
    return df.select("*", *[dot(a).alias(n) for n, a in zip(names, axes)])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
