"""Pairs of near vectors by p-stable hashing: candidates share a bucket, and exact distances decide.

A hash is the cell of a vector's coordinate along a random direction; HASHES of them make a bucket, and each table has its
own. Two vectors at a distance of exactly eps share a cell with the probability p of same_cell(), so tables_for() gives the
number of tables that finds such a pair with a wanted probability; nearer pairs are found more often.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizes import small
from .storage import cut

HASHES = 6
#: Width of a cell, in eps.
WIDTH = 4.0
#: Vectors of a bucket that a task takes in from one side.
BLOCK = 2048


def same_cell(ratio: float) -> float:
    """The probability that two vectors share a cell whose width is `ratio` times their distance."""
    normal = 0.5 * (1 + math.erf(-ratio / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def tables_for(recall: float, hashes: int = HASHES, width: float = WIDTH) -> int:
    """Tables that find a pair at a distance of eps with the probability `recall`, which is below 1."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same_cell(width) ** hashes)))


def lsh_join(df: DataFrame, key: str, vector: str, eps: float, recall: float = 0.95, hashes: int = HASHES, width: float = WIDTH, seed: int = 7) -> DataFrame:
    """Pairs a < b of keys whose vectors are within eps, and their distance: each such pair with a probability of at least
    `recall`, and no other. vectors.range_join() is the exact way.

    Keys are integers; null vectors are in no pair, and vectors have one length. A large bucket is dealt into blocks, so no
    task holds it. A pair is looked at in the first table where it shares a bucket, and only pairs within eps leave a task.
    """
    v = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k IS NOT NULL AND v IS NOT NULL")
    first = v.select(F.size("v")).first()
    if first is None:
        return v.select(F.col("k").alias("a"), F.col("k").alias("b"), F.lit(0.0).alias("distance"))
    tables, r = tables_for(recall, hashes, width), np.random.default_rng(seed)
    directions, shifts = r.normal(size=(first[0], tables * hashes)), r.random(tables * hashes)
    odd = r.integers(1, 1 << 62, size=(tables, hashes)) * 2 + 1

    def bucket(batches):
        for batch in batches:
            if batch.num_rows:
                m = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cells = np.floor(m @ directions / (width * eps) + shifts).astype(np.int64).reshape(len(m), tables, hashes)
                keys = (cells * odd).sum(axis=2)
                keys = (keys ^ (keys >> 29)) * np.int64(0x1B873593CC9E2D51)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * tables, pa.int32()), pa.array(keys.ravel()))], names=["k", "v", "keys"])

    hashed = cut(v.mapInArrow(bucket, "k long, v array<double>, keys array<bigint>"), "hashed")
    held = hashed.select("k", F.posexplode("keys").alias("t", "key"))
    shared = held.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = held.join(small(cut(shared, "buckets")), ["t", "key"]).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("k", "t", "key", "block", other).select("k", "t", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def near(group: pa.Table) -> pa.Table:
        k, block, t = group["k"].to_numpy(), group["block"].to_numpy(), group["t"][0].as_py()
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        m = group["v"].combine_chunks().flatten().to_numpy().reshape(len(k), -1)
        keys = group["keys"].combine_chunks().flatten().to_numpy().reshape(len(k), -1)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        square = (m * m).sum(axis=1)
        x, y = np.nonzero(square[left][:, None] + square[right][None, :] - 2 * m[left] @ m[right].T <= eps * eps * (1 + 1e-9) + 1e-9)
        x, y = left[x], right[y]
        ok = (k[x] < k[y]) if i == j else (k[x] != k[y])
        x, y = x[ok], y[ok]
        x, y = np.where(k[x] < k[y], x, y), np.where(k[x] < k[y], y, x)
        earlier = (keys[x, :t] == keys[y, :t]).any(axis=1)
        d = np.sqrt(((m[x] - m[y]) ** 2).sum(axis=1))
        ok = ~earlier & (d <= eps)
        return pa.table({"a": k[x][ok], "b": k[y][ok], "distance": d[ok]})

    return dealt.join(hashed, "k").groupBy("t", "key", "i", "j").applyInArrow(near, "a long, b long, distance double")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
