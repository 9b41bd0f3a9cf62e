"""Near-duplicate vectors by an epsilon grid order join.

Vectors of unit length are turned onto their principal axes, which keeps all distances, and sorted by the cells of a grid
on the leading ones: by label, then cell by cell. Runs of BLOCK vectors in that order are blocks; FANOUT neighbours make a
node of the next level, up to one node a label. Every node has the box of its vectors in all turned coordinates. The join
descends from the roots: two sequence intervals whose boxes lie farther apart than epsilon are skipped, two whose boxes
lie within epsilon altogether are counted as wholes, and others go on as pairs of their children. What is left are pairs
of blocks, each one matrix product within a task.

Only counts and the links of a spanning forest leave a task, so a group of copies costs its rows, not its pairs. Equal
vectors are one vector with a weight. No pair with a cosine of at least the limit is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.operators.vectors import components, principal_axes

from .batches import by_value, small_batches
from .store import materialise, maybe_broadcast

COSINE = 0.93
#: Vectors in a block, children of a node, and leading axes of the grid.
BLOCK, FANOUT_BITS, AXES = 512, 3, 16
#: Width of a cell, as a share of epsilon.
CELL = 0.5
#: Partners of a block that one task group meets.
PARTNERS = 8
#: Boxes are held against epsilon with so much to spare, and cosines this near to the limit are summed exactly.
SPARE, CLOSE = 1e-9, 1e-12


def usable(v: Column) -> Column:
    """Whether a vector has components, all of them finite, and not only zeros."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at unit length, in double precision and without overflow."""
    m = m.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def units(batches):
    """Batches of vectors of one length at unit length."""
    for batch in batches:
        if batch.num_rows:
            u = unit(flat(batch.column(0)).reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * u.shape[1], pa.int32()), pa.array(u.ravel()))], names=["v"])


def turned(m: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates along the axes; vectors of another length than these stay as they are."""
    return m @ axes.T if m.shape[1] == axes.shape[1] else m


def placer(mean: np.ndarray, axes: np.ndarray, width: float):
    """A function that adds the grid cells to batches with vectors in the column v."""

    def place(batches):
        for batch in batches:
            at = batch.schema.get_field_index("v")
            v = batch.column(at)
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            values, starts = flat(v), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            cells: list = [None] * batch.num_rows
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                u = unit(values[starts[rows][:, None] + np.arange(d)])
                x = turned(u - mean if d == len(mean) else u, axes)[:, :AXES]
                for row, cell in zip(rows, np.floor(x / width + 0.5).astype(np.int32)):
                    cells[row] = cell
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return place


def packer(axes: np.ndarray):
    """A function that packs a sorted partition's rows (g, rep, copies, h1, h2, v) into blocks with their boxes."""

    def pack(batches):
        part, seq, kept, kept_g = None, 0, [], None

        def out(rows, g):
            nonlocal seq
            t = pa.Table.from_batches(rows).combine_chunks()
            v = t["v"].combine_chunks()
            x = turned(unit(flat(v).reshape(t.num_rows, -1)), axes)
            copies = t["copies"].to_numpy()
            one = {"part": [part], "seq": [seq], "g": [g], "n": [int(copies.sum())], "rep": [t["rep"].to_numpy()], "copies": [copies], "h1": [t["h1"].to_numpy()], "h2": [t["h2"].to_numpy()], "lo": [x.min(axis=0)], "hi": [x.max(axis=0)]}
            seq += 1
            arrays = {k: pa.array(c) for k, c in one.items()} | {"v": pa.ListArray.from_arrays(pa.array([0, len(v.flatten())], pa.int32()), v.flatten())}
            arrays["part"] = arrays["part"].cast(pa.int32())
            arrays["seq"] = arrays["seq"].cast(pa.int32())
            return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for batch in batches:
            gs = batch.column(batch.schema.get_field_index("g")).to_pylist()
            at = 0
            while at < len(gs):
                if kept and (gs[at] != kept_g or sum(r.num_rows for r in kept) == BLOCK):
                    yield out(kept, kept_g)
                    kept = []
                kept_g = gs[at]
                room = BLOCK - sum(r.num_rows for r in kept)
                to = at
                while to < len(gs) and to - at < room and gs[to] == kept_g:
                    to += 1
                kept.append(batch.slice(at, to - at))
                at = to
        if kept:
            yield out(kept, kept_g)

    return pack


def joined_blocks(cosine: float):
    """A function of a group of packed blocks: one with role 0 meets all with role 1."""

    def spread(lab: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The least label that links (x, y) lead to."""
        while True:
            least = np.minimum(lab[x], lab[y])
            new = lab.copy()
            np.minimum.at(new, x, least)
            np.minimum.at(new, y, least)
            np.minimum.at(new, lab[x], least)
            np.minimum.at(new, lab[y], least)
            new = new[new]
            if (new == lab).all():
                return lab
            lab = new

    def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        c = a @ b.T
        mask = c >= cosine
        for i, j in zip(*np.nonzero(np.abs(c - cosine) < CLOSE)):
            mask[i, j] = math.fsum(a[i] * b[j]) >= cosine
        return mask

    def join(t: pa.Table) -> pa.Table:
        role, number = t["role"].to_numpy(), t["number"].to_numpy()
        copies = [np.asarray(c.values) for c in t["copies"]]
        vectors = [unit(np.asarray(v.values).reshape(len(c), -1)) for v, c in zip(t["v"], copies)]
        start = np.concatenate([[0], np.cumsum([len(c) for c in copies])])
        keys = np.concatenate([n * BLOCK + np.arange(len(c)) for n, c in zip(number, copies)])
        left = int(np.flatnonzero(role == 0)[0])
        lab, found = np.arange(start[-1]), np.zeros(start[-1], np.int64)
        for r in np.flatnonzero(role == 1):
            mask = linked(vectors[left], vectors[r])
            found[start[left] : start[left + 1]] += mask @ copies[r]
            if number[r] == number[left]:
                np.fill_diagonal(mask, False)
            else:
                found[start[r] : start[r + 1]] += copies[left] @ mask
            x, y = np.nonzero(mask)
            if len(x):
                lab = spread(lab, x + start[left], y + start[r if number[r] != number[left] else left])
        counted, moved = np.flatnonzero(found), np.flatnonzero(lab != np.arange(len(lab)))
        return pa.table({
            "k": pa.array(np.concatenate([keys[counted], keys[moved]])),
            "other": pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(keys[lab[moved]])]),
            "found": pa.concat_arrays([pa.array(found[counted]), pa.nulls(len(moved), pa.int64())]),
        })

    return join


def _boxed(level: DataFrame) -> DataFrame:
    """The nodes above a level's: parents with their rows, boxes and first key."""
    merge = lambda c, pick: F.aggregate(F.slice(F.collect_list(c), 2, 1 << FANOUT_BITS), F.get(F.collect_list(c), F.lit(0)), lambda s, x: F.zip_with(s, x, pick))
    up = level.groupBy("g", F.col("parent").alias("node")).agg(F.sum("n").alias("n"), F.min("k").alias("k"), merge("lo", lambda x, y: F.least(x, y)).alias("lo"), merge("hi", lambda x, y: F.greatest(x, y)).alias("hi"))
    return up.withColumn("parent", F.shiftright("node", FANOUT_BITS))


def _descend(levels: list[DataFrame], eps2: float) -> list[DataFrame]:
    """For each level, from the blocks up, the pairs of nodes that the join reaches there: g, a, b, their rows and first keys,
    and whether all their vectors are within epsilon (near). Pairs that are not near go on to their children.
    """
    zero = F.lit(0).cast("long")
    front = levels[-1].select("g", zero.alias("pa"), zero.alias("pb")).distinct()
    out = []
    for level in reversed(levels):
        side = lambda s: level.select("g", F.col("parent").alias(f"p{s}"), F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "k", "lo", "hi")])  # noqa: B023, E731
        pairs = front.join(side("a"), ["g", "pa"]).join(side("b"), ["g", "pb"]).where((F.col("pa") != F.col("pb")) | (F.col("a") <= F.col("b")))
        boxes = F.arrays_zip("lo_a", "hi_a", "lo_b", "hi_b")

        def total(one):
            return F.aggregate(boxes, F.lit(0.0), lambda s, x: s + one(x) * one(x))  # noqa: B023

        gap = total(lambda x: F.greatest(F.lit(0.0), x["lo_b"] - x["hi_a"], x["lo_a"] - x["hi_b"]))
        reach = total(lambda x: F.greatest(x["hi_a"] - x["lo_b"], x["hi_b"] - x["lo_a"]))
        judged = materialise(pairs.where(gap <= eps2 + SPARE).select("g", "a", "b", "n_a", "n_b", "k_a", "k_b", (reach <= eps2 - SPARE).alias("near")), "intervals")
        out.append(judged)
        front = judged.where(~F.col("near")).select("g", F.col("a").alias("pa"), F.col("b").alias("pb"))
    return out[::-1]


def near_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """id, n_links (other rows linked directly), component_id (least id reachable) and kept for each row of df.

    Rows with equal labels link where their cosine, in double precision, is at least `cosine`, which is over 0. Vectors that
    are null, empty, zero or hold null or non-finite components, rows without label or id, and vectors of different lengths
    link with nothing; a row without id has a null component. Repeated rows are vectors of their own. No rows give no rows;
    further columns are ignored.
    """
    small_batches(df.sparkSession)
    kind = df.schema[vector].dataType
    v = F.col(vector) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else F.col(vector).cast("array<double>")
    fit = usable(v) & F.col(label).isNotNull() & F.col(id).isNotNull()
    own = df.select(F.col(id).alias("id"), F.when(fit, F.concat(F.size(v).cast("string"), F.lit(":"), F.col(label).cast("string"))).alias("g"), F.when(fit, v).alias("v"))
    hashed = own.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), "v"))
    same = ["g", "h1", "h2"]
    reps = hashed.where("g IS NOT NULL").groupBy(*same).agg(F.min("id").cast("long").alias("rep"), F.count("*").alias("copies"), F.min_by("v", "id").alias("v"))
    reps = materialise(reps, "vectors")
    common = reps.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not common:
        return df.select(F.col(id), F.lit(0).cast("long").alias("n_links"), F.col(id).alias("component_id"), F.lit(True).alias("kept"))
    d, eps2 = common[0].d, 2 - 2 * cosine
    mean, axes = principal_axes(reps.where(F.size("v") == d).select("v").mapInArrow(units, "v array<double>"), "v", d)
    schema = T.StructType([*reps.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    order = ["g", "cells", "h1"]
    placed = materialise(reps.mapInArrow(placer(mean, axes, CELL * math.sqrt(eps2)), schema), "placed").repartitionByRange(*order).sortWithinPartitions(*order)
    element = placed.schema["v"].dataType.elementType.simpleString()
    packed = placed.select("g", "rep", "copies", "h1", "h2", "v").mapInArrow(packer(axes), f"part int, seq int, g string, n long, rep array<bigint>, copies array<bigint>, h1 array<bigint>, h2 array<bigint>, lo array<double>, hi array<double>, v array<{element}>")
    packed = materialise(packed, "blocks")
    parts, most = packed.agg(F.max("part"), F.max("seq")).first()
    bits = (most + 1).bit_length()
    number = F.shiftleft(F.col("part").cast("long"), bits) + F.col("seq")
    blocks = packed.withColumn("number", number).drop("part", "seq")
    levels = [blocks.select("g", F.col("number").alias("node"), F.shiftright("number", FANOUT_BITS).alias("parent"), "n", (F.col("number") * BLOCK).alias("k"), "lo", "hi")]
    top = (parts << bits) + most
    while top >> FANOUT_BITS:
        top >>= FANOUT_BITS
        levels.append(materialise(_boxed(levels[-1]), "nodes"))
    reached = _descend(levels, eps2)

    # pairs of blocks that need their vectors: a block with up to PARTNERS others in a group
    pairs = reached[0].where(~F.col("near")).select("a", "b", F.floor(F.col("b") / PARTNERS).alias("chunk"))
    body = blocks.select("number", "copies", "v")
    left = pairs.select("a", "chunk", F.lit(0).alias("role"), F.col("a").alias("number")).distinct()
    dealt = left.unionByName(pairs.select("a", "chunk", F.lit(1).alias("role"), F.col("b").alias("number"))).join(body, "number")
    found = materialise(dealt.groupBy("a", "chunk").applyInArrow(joined_blocks(cosine), "k long, other long, found long"), "links")

    # pairs of nodes whose vectors are all linked, at any level
    near = [x.where("near").select(F.lit(i).alias("level"), "g", "a", "b", "n_a", "n_b", "k_a", "k_b") for i, x in enumerate(reached)]
    near = materialise(_union(near), "near")
    ends = near.select("level", "g", F.col("a").alias("node"), F.col("n_b").alias("found"), F.col("k_a").alias("k")).unionByName(near.where("a <> b").select("level", "g", F.col("b").alias("node"), F.col("n_a").alias("found"), F.col("k_b").alias("k")))
    ends = ends.groupBy("level", "g", "node").agg(F.sum("found").alias("found"), F.min("k").alias("first"))
    above = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright("number", i * FANOUT_BITS).alias("node")) for i in range(len(levels))])).alias("up")
    under = materialise(blocks.select("g", "number", F.size("rep").alias("size"), above).select("g", "number", "size", "up.*").join(maybe_broadcast(ends), ["level", "g", "node"]).select("number", "size", "found", "first"), "under")
    whole = under.groupBy("number").agg(F.sum("found").alias("whole"))
    keys = lambda size: F.explode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.col("number") * BLOCK + i))
    edges = found.where("other IS NOT NULL").select(F.col("k").alias("a"), F.col("other").alias("b"))
    edges = edges.unionByName(near.where("a <> b").select(F.col("k_a").alias("a"), F.col("k_b").alias("b"))).unionByName(under.select(F.col("first").alias("a"), keys(F.col("size")).alias("b")).where("a <> b"))

    members = blocks.select("number", "g", F.posexplode(F.arrays_zip("rep", "h1", "h2")).alias("i", "m")).select("number", (F.col("number") * BLOCK + F.col("i")).alias("k"), "g", "m.*")
    counts = found.where("found IS NOT NULL").groupBy("k").agg(F.sum("found").alias("found"))
    label_of = components(edges).withColumnRenamed("node", "k").withColumnRenamed("label", "root")
    nodes = members.join(counts, "k", "left").join(whole, "number", "left").join(label_of, "k", "left")
    nodes = materialise(nodes.select(*same, "rep", "root", (F.coalesce("found", F.lit(0)) + F.coalesce("whole", F.lit(0)) - 1).alias("n_links")).where("n_links > 0"), "members")
    least = nodes.where("root IS NOT NULL").groupBy("root").agg(F.min("rep").alias("least"))
    told = nodes.join(least, "root", "left").select(*same, "n_links", F.coalesce("least", "rep").alias("component_id"))
    out = hashed.select("id", *same).join(maybe_broadcast(materialise(told, "told")), same, "left")
    component = F.coalesce(F.col("component_id"), F.col("id"))
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


by_value(__name__)
