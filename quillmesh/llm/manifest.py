"""A Merkle manifest of a dataset with an authentication path for every record, by fractal traversal.

Leaves stand in order within their group; every ARITY consecutive nodes become their hash until one is left, the group's
subroot; subroots, ordered by group, give the root likewise. Leaves are dealt by aligned blocks of ARITY ** LEVELS, so a
block is a whole subtree. Within a block the levels are cut into storeys; for each storey there are the existing subtree
over the present leaf and the desired one to its right, which takes in one leaf a step and is done when it is needed. So a
block's paths come out one after the other from bounded memory. Block roots are authenticated in the same way, level of
blocks by level of blocks, and each block's upper path is appended to those of its leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import by_value
from .store import materialise, maybe_broadcast

ARITY = 3
#: Levels of a block, and of a storey within it.
LEVELS, STOREY = 7, 2
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


class Subtree:
    """The nodes of levels base to top - 1 over an aligned run of leaves, taken in one by one."""

    def __init__(self, base: int, top: int):
        self.base, self.top = base, top
        self.nodes: list[list[bytes]] = [[] for _ in range(top - base)]
        self.open: list[list[bytes]] = [[] for _ in range(top)]

    def add(self, node: bytes, level: int = 0) -> None:
        while True:
            if level >= self.base:
                self.nodes[level - self.base].append(node)
            if level == self.top - 1:
                return
            run = self.open[level]
            run.append(node)
            if len(run) < ARITY:
                return
            node, level = digest(*run), level + 1
            run.clear()

    def close(self) -> None:
        """The last leaf is in: short runs become nodes, too."""
        for level, run in enumerate(self.open[:-1]):
            if run:
                node = digest(*run)
                run.clear()
                self.add(node, level + 1)


def levels_of(n: int, block: int) -> int:
    """Levels within a block of n leaves: all of them, or as many as leave one node where there is no other block."""
    levels = 0
    while levels < LEVELS and (block or n > 1):
        n, levels = -(-n // ARITY), levels + 1
    return levels


def top_of(leaves: list[bytes], levels: int) -> bytes:
    tree = Subtree(levels, levels + 1)
    for leaf in leaves:
        tree.add(leaf)
    tree.close()
    return tree.nodes[0][0]


def paths(leaves: list[bytes], levels: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """For each leaf in turn its siblings from below, at each level those before and those after it."""
    n, storeys = len(leaves), []
    for base in range(0, levels, STOREY):
        top = min(base + STOREY, levels)
        existing = Subtree(base, top)
        for leaf in leaves[: ARITY**top]:
            existing.add(leaf)
        if n <= ARITY**top:
            existing.close()
        storeys.append([ARITY**top, existing, Subtree(base, top)])
    for p in range(n):
        path = []
        for storey in storeys:
            span, existing, desired = storey
            if p and p % span == 0:
                storey[1:] = existing, desired = desired, Subtree(existing.base, existing.top)
            if p + span < n:
                desired.add(leaves[p + span])
                if p + span == n - 1:
                    desired.close()
            for level in range(existing.base, existing.top):
                at = p % span // ARITY**level
                first = at - at % ARITY
                nodes = existing.nodes[level - existing.base]
                path.append((b"".join(nodes[first:at]), b"".join(nodes[at + 1 : first + ARITY])))
        yield path


def _sorted(t: pa.Table) -> tuple[pa.Table, list[bytes]]:
    t = t.sort_by("pos")
    return t, [x.encode() for x in t["node"].to_pylist()]


def block_top(t: pa.Table) -> pa.Table:
    t, leaves = _sorted(t)
    block = t["block"][0].as_py()
    return pa.table({"g": t["g"].slice(0, 1), "pos": t["block"].slice(0, 1), "node": pa.array([top_of(leaves, levels_of(len(leaves), block)).decode()])})


def block_paths(t: pa.Table, upper: pa.Table) -> pa.Table:
    """The rows of a block with their paths, those of the block's root appended."""
    t, leaves = _sorted(t)
    if not len(leaves):
        return t.append_column("path", pa.array([], pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))).append_column("top", pa.array([], pa.string()))
    above = upper["path"][0].as_py()
    own = [[{"before": a.decode(), "after": b.decode()} for a, b in path] + above for path in paths(leaves, levels_of(len(leaves), t["block"][0].as_py()))]
    t = t.append_column("path", pa.array(own, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))))
    return t.append_column("top", pa.array([upper["top"][0].as_py()] * len(leaves), pa.string()))


def in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {ARITY**LEVELS}"))


def upper_paths(nodes: DataFrame) -> DataFrame:
    """g, block, path and top of each block of nodes (g, pos, node): the way from the block's root to its group's."""
    tops = materialise(in_blocks(nodes.select("g", "pos", "node")).groupBy("g", "block").applyInArrow(block_top, "g string, pos long, node string"), "tops")
    if not tops.where("pos > 0").limit(1).count():  # every group is one block
        return tops.select("g", F.col("pos").alias("block"), F.expr(f"CAST(array() AS {PATH})").alias("path"), F.col("node").alias("top"))
    return with_paths(tops, upper_paths(tops)).select("g", F.col("pos").alias("block"), "path", "top")


def with_paths(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """nodes (g, pos, node, ...) with path and top, from the upper paths (g, block, path, top) of their blocks."""
    dealt = in_blocks(nodes)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields), f"path {PATH}", "top string"])
    left, right = dealt.groupBy("g", "block"), upper.select("g", "block", "path", "top").groupBy("g", "block")
    return left.cogroup(right).applyInArrow(block_paths, schema).drop("block")


def placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with pos, each row's place from 0 among those of its group; written. Rows are dealt by ranges of the order, so a
    hot group is in many tasks; the table of starts has a row for each range and group in it.
    """
    at = materialise(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_id", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_id", 33)
    runs = at.groupBy(part.alias("_part"), F.col(group).alias("_g")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(runs.select("_part", "_g", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")), "starts")
    return at.join(maybe_broadcast(starts), (part == F.col("_part")) & (F.col(group) == F.col("_g"))).select(*df.columns, (F.col("_id") + F.col("_shift")).alias("pos"))


def authenticate(leaves: DataFrame, group: str, order: list[str], leaf: str) -> DataFrame:
    """leaves with path (the siblings before and after, from the leaf to the root), subroot and root.

    Groups stand in the order of their names' UTF-8 bytes, a null first; leaves by `order`, nulls first, then by their hash.
    Rows equal in all of that may swap places. leaf is a hexadecimal SHA-256. No rows give no rows. The columns of leaves are
    not named g, node, pos, block, path, top, subroot or root.
    """
    # a letter before each name, so that null is apart and first
    name = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit(""))
    nodes = placed(leaves.withColumn("g", name).withColumn("node", F.col(leaf)), "g", [*order, "node"])
    blocks = materialise(upper_paths(nodes), "blocks")
    roots = placed(blocks.select(F.col("g").alias("name"), F.col("top").alias("node")).distinct().withColumn("g", F.lit("")), "g", ["name"])
    over = with_paths(roots, upper_paths(roots)).select(F.col("name").alias("g"), F.col("path").alias("over"), F.col("top").alias("root"))
    upper = blocks.join(over, "g").select("g", "block", F.concat("path", "over").alias("path"), F.struct("top", "root").alias("tops"))
    out = with_paths(nodes, upper.select("g", "block", "path", F.concat("tops.top", "tops.root").alias("top")))
    half = 64  # two hexadecimal hashes, one after the other
    return out.select(*leaves.columns, "path", F.substring("top", 1, half).alias("subroot"), F.substring("top", half + 1, half).alias("root"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]).cast("binary"), 256))


def record_hash(*values: Column) -> Column:
    """SHA-256 of values as UTF-8 bytes, each with its length, `-` for null."""

    def told(v: Column) -> Column:
        text = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[told(v) for v in values]).cast("binary"), 256)


def document_manifest(docs: DataFrame) -> DataFrame:
    """Every document's leaf, roots and path, and whether it verifies after text lines of some were run together.

    Where crc32 of the decimal doc_id is even, the text loses its line feeds before it is held against the manifest. Null
    values, ids and sources included, are values of their own; a null doc_id is not tampered with. Repeated rows are leaves
    of their own. Further columns are ignored.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    other = record_hash(*[F.col(c) for c in columns[:-1]], F.translate("text", "\n", ""))
    leaves = docs.select("doc_id", "source", record_hash(*[F.col(c) for c in columns]).alias("leaf"), F.when(tampered, other).alias("met"))
    proven = authenticate(leaves, "source", ["doc_id"], "leaf")
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = proven.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), fold(F.coalesce("met", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


by_value(__name__)
