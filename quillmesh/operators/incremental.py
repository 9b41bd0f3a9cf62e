"""Density clusters batch by batch: what earlier batches found is carried on by a few anchors of each cluster, and noise waits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .relational import draw, numbered
from .sizes import small
from .storage import cut

#: Vectors of a batch, and anchors that stand for a cluster in the next one.
BATCH, ANCHORS = 2000, 20


def batch_clusters(df: DataFrame, key: str, vector: str, eps: float, min_points: int, batch: int = BATCH, anchors: int = ANCHORS, seed: str = "7", enough: Callable[[int, int], bool] | None = None) -> DataFrame:
    """key and cluster (the least key of the cluster, -1 for noise) of vectors that are clustered batch by batch.

    Batches are near-equal parts of a seeded order. Each is clustered together with the anchors of all clusters so far and
    with the points that were noise, which so join a cluster once it is dense enough. A group with anchors keeps their
    cluster; anchors of several clusters in one group join these. An anchor counts as a point of the density. enough(new
    clusters, noise) after a batch ends the run early; keys that no batch has had are then left out. Separated blobs, with
    at least min_points vectors and anchors no fewer than min_points, come out as in one run over all; others may split.
    """
    v = df.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("k IS NOT NULL AND v IS NOT NULL")
    rows, total = numbered(v.withColumn("_draw", draw(F.col("k"), seed=seed)), ["_draw", "k"], "row")
    spark = df.sparkSession
    kind = {f.name: f.dataType.simpleString() for f in v.schema.fields}
    known = spark.createDataFrame([], f"k {kind['k']}, cluster {kind['k']}")
    carried = spark.createDataFrame([], f"k {kind['k']}, v {kind['v']}, cluster {kind['k']}")  # cluster is null for waiting noise
    for start in range(0, total, batch):
        fresh = rows.where((F.col("row") >= start) & (F.col("row") < start + batch)).select("k", "v", F.lit(None).cast(kind["k"]).alias("cluster"))
        points = cut(fresh.unionByName(carried), "batch")
        found = vectors.dbscan(points, "k", "v", eps, min_points).select("k", F.col("cluster").alias("found")).where("found <> -1")
        now = cut(points.join(found, "k", "left"), "found")
        # groups and the clusters whose anchors they hold: what is linked is one cluster
        held = now.where("found IS NOT NULL AND cluster IS NOT NULL").select("found", "cluster").distinct()
        name = held.groupBy("found").agg(F.min("cluster").alias("name"))
        same = held.join(name, "found").where("cluster <> name").select(F.col("name").alias("a"), F.col("cluster").alias("b")).distinct()
        joined = cut(vectors.components(same), "joined")  # no rows where no clusters meet
        name = name.join(small(joined.withColumnRenamed("node", "name")), "name", "left").select("found", F.coalesce("label", "name").alias("name"))
        now = cut(now.join(small(name), "found", "left").select("k", "v", F.coalesce("name", "found", "cluster").alias("cluster"), (F.col("found").isNotNull() & F.col("name").isNull()).alias("new")), "named")
        known = known.unionByName(now.where("cluster IS NOT NULL").select("k", "cluster"))
        known = known.join(small(joined.withColumnRenamed("node", "cluster")), "cluster", "left").select("k", F.coalesce("label", "cluster").alias("cluster"))
        known = cut(known.groupBy("k").agg(F.min("cluster").alias("cluster")), "known")
        rank = F.row_number().over(Window.partitionBy("cluster").orderBy(draw(F.col("k"), seed=seed), "k"))
        first = now.where("cluster IS NOT NULL").dropDuplicates(["k"]).withColumn("_rank", rank).where(F.col("_rank") <= anchors).drop("_rank")
        carried = cut(first.select("k", "v", "cluster").unionByName(now.where("cluster IS NULL").select("k", "v", "cluster")), "carried")
        if enough is not None and enough(now.where("new").select("cluster").distinct().count(), now.where("cluster IS NULL").count()):
            break
    least = known.groupBy("cluster").agg(F.min("k").alias("least"))
    told = known.join(least, "cluster").select("k", F.col("least").alias("cluster"))
    noise = carried.where("cluster IS NULL").select("k", F.lit(-1).cast(kind["k"]).alias("cluster"))
    return told.unionByName(noise).withColumnRenamed("k", key)
