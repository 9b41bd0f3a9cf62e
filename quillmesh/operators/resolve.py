"""Names for clusters, triplets of vectors, and walks of small graphs."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .relational import draw


def resolve_clusters(clustered: DataFrame, anchors: DataFrame, campaigns: DataFrame) -> DataFrame:
    """cluster, verdict and known for clusters (id, cluster) from anchors (id, known) and campaigns (known, campaign).

    Noise is `noise`; a cluster without anchors is `new`; one known cluster is taken over; several of one campaign are a
    `conflict` to be settled by the nearest centroid; several of more campaigns are `unresolved`.
    """
    with_known = clustered.join(anchors.join(campaigns, "known", "left"), "id", "left")
    by = with_known.groupBy("cluster").agg(F.array_sort(F.collect_set("known")).alias("all"), F.collect_set("campaign").alias("campaigns"), F.count_if(F.col("known").isNotNull() & F.col("campaign").isNull()).alias("loose"))
    verdict = F.when(F.col("cluster") == -1, "noise").when(F.size("all") == 0, "new").when(F.size("all") == 1, "known").when((F.size("campaigns") == 1) & (F.col("loose") == 0), "conflict").otherwise("unresolved")
    return by.select("cluster", verdict.alias("verdict"), F.when(F.size("all") == 1, F.get("all", F.lit(0))).alias("known"), "all")


def settle_clusters(clustered: DataFrame, anchors: DataFrame, campaigns: DataFrame, centers: DataFrame) -> DataFrame:
    """id, cluster, verdict and known of each element of clusters (id, cluster, v); centers are (known, centroid).

    Verdicts are those of resolve_clusters. An element of a conflict goes to the nearest of the centroids of the known
    clusters that are involved, the least one of equals; noise and what is unresolved go to -1, and a new cluster has no
    known one yet.
    """
    verdicts = resolve_clusters(clustered.select("id", "cluster"), anchors, campaigns)
    involved = verdicts.where("verdict = 'conflict'").select("cluster", F.explode("all").alias("known")).join(centers.select("known", "centroid"), "known")
    choice = involved.groupBy("cluster").agg(F.collect_list(F.struct("known", "centroid")).alias("centers"))
    nearest = F.array_min(F.transform("centers", lambda x: F.struct(V.squared_distance(F.col("v"), x["centroid"]).alias("d"), x["known"].alias("known"))))
    known = F.when(F.col("verdict") == "conflict", nearest["known"]).when(F.col("verdict").isin("noise", "unresolved"), F.lit(-1)).otherwise(F.col("known"))
    return clustered.select("id", "cluster", "v").join(verdicts.drop("all"), "cluster").join(choice, "cluster", "left").select("id", "cluster", "verdict", known.alias("known"))


def conflict_log(clustered: DataFrame, anchors: DataFrame, campaigns: DataFrame) -> DataFrame:
    """first and second (the lesser before) of known clusters of different campaigns that have anchors in one cluster, once each.

    Within a cluster, pairs are of its known clusters, not of its elements.
    """
    known = clustered.join(anchors.join(campaigns, "known"), "id").select("cluster", "known", "campaign").distinct()
    by = known.groupBy("cluster").agg(F.array_sort(F.collect_set(F.struct("known", "campaign"))).alias("all"))
    one = by.select("all", F.explode("all").alias("x"))
    two = one.select("x", F.explode(F.filter("all", lambda y: (y["known"] > F.col("x")["known"]) & (y["campaign"] != F.col("x")["campaign"]))).alias("y"))
    return two.select(F.col("x.known").alias("first"), F.col("y.known").alias("second")).distinct()


def new_cluster_notice(clusters: DataFrame, day: str) -> DataFrame:
    """text: a message that lists the ids of the clusters (id, made_on) of a day; no row where there are none."""
    ids = clusters.where(F.col("made_on") == F.lit(day).cast("date")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    line = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("New cluster with id:"), i.cast("string"))), " \n")
    return ids.where(F.size("ids") > 0).select(F.concat(F.lit("A new cluster has been created: \n"), line).alias("text"))


def ladder(vectors: DataFrame, steps: list[float], min_points: int, good) -> DataFrame:
    """Density clusters at falling eps until good(labels) holds; the last ones otherwise. There are a few steps."""
    for eps in steps:
        labels = V.dbscan(vectors, "id", "v", eps, min_points)
        if good(labels):
            break
    return labels


#: About how many vectors an arc of a ring of triplets() has at most.
RING = 10_000


def triplets(vectors: DataFrame, label: str = "label", seed: str = "7") -> DataFrame:
    """One positive of the same and one negative of another label for each vector (id, v, label) that has both.

    Vectors are put in a seeded ring within their label and in one over all labels; the next one is the positive, the next
    of another label is the negative, both around the ring's end. Rings are cut in their order into arcs of about RING
    vectors, so no task sorts a whole label and nothing is joined with everything; what follows an arc is found from a row
    for each arc. Rows without a label are left out.
    """
    from pyspark.sql import Window

    r = vectors.select("id", F.col(label).alias("label"), draw(F.col("id"), seed=seed).alias("o")).where("label IS NOT NULL")
    # draws are spread evenly, so equal ranges of their first digits are arcs of about equal size
    arc = lambda n: F.floor(F.conv(F.substring("o", 1, 8), 16, 10).cast("long") * F.greatest(F.ceil(n / RING), F.lit(1)) / F.lit(1 << 32))
    later = lambda w: w.rowsBetween(1, Window.unboundedFollowing)
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = r.groupBy("label").agg(F.count("*").alias("n"))

    own = r.join(sizes, "label").select("id", "label", "o", arc(F.col("n")).alias("arc"))
    arcs = own.groupBy("label", "arc").agg(F.min_by("id", F.struct("o", "id")).alias("first"))
    by_label = Window.partitionBy("label").orderBy("arc")
    arcs = arcs.select("label", "arc", F.coalesce(F.lead("first").over(by_label), F.first("first").over(whole(by_label))).alias("after"))
    inside = F.lead("id").over(Window.partitionBy("label", "arc").orderBy("o", "id"))
    pos = own.withColumn("next", inside).join(arcs, ["label", "arc"]).select("id", "label", F.coalesce("next", "after").alias("positive"))

    # the next of another label is where the next run of a label starts
    total = F.broadcast(sizes.agg(F.sum("n").alias("n")))
    run = Window.partitionBy("arc").orderBy("o", "id")
    runs = r.crossJoin(total).select("id", "label", "o", arc(F.col("n")).alias("arc"))
    runs = runs.withColumn("start", F.when(F.lag("label").over(run) != F.col("label"), F.col("id")))  # but that of the arc's first run
    place = F.struct("o", "id")
    arcs = runs.groupBy("arc").agg(F.min_by("id", place).alias("first"), F.min_by("label", place).alias("first_label"), F.max_by("label", place).alias("last_label"), F.min_by("start", F.when(F.col("start").isNotNull(), place)).alias("start"))
    by_arc = Window.orderBy("arc")  # a row for each RING vectors
    arcs = arcs.withColumn("start", F.when(F.lag("last_label").over(by_arc) != F.col("first_label"), F.col("first")).otherwise(F.col("start")))
    around = F.when(F.first("first_label").over(whole(by_arc)) != F.col("last_label"), F.first("first").over(whole(by_arc)))
    second = F.first("start", ignorenulls=True).over(whole(by_arc))
    arcs = arcs.select("arc", F.coalesce(F.first("start", ignorenulls=True).over(later(by_arc)), around, second).alias("after"))
    back = Window.partitionBy("arc").orderBy(F.desc("o"), F.desc("id"))  # backwards: what follows a row is a running value
    further = F.last("start", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    neg = runs.withColumn("next", further).join(arcs, "arc").select("id", F.coalesce("next", "after").alias("negative"))
    return pos.join(neg, "id").where(F.col("negative").isNotNull() & (F.col("positive") != F.col("id")))


def triplet_loss(chosen: DataFrame, vectors: DataFrame, margin: float) -> DataFrame:
    """Loss of each triplet: squared distance to the positive less that to the negative, plus a margin, 0 at least."""
    v = vectors.select("id", "v")
    out = chosen.join(v.withColumnRenamed("v", "a"), "id")
    for side in ("positive", "negative"):
        out = out.join(v.select(F.col("id").alias(side), F.col("v").alias(f"{side}_v")), side)
    loss = V.squared_distance(F.col("a"), F.col("positive_v")) - V.squared_distance(F.col("a"), F.col("negative_v")) + margin
    return out.select("id", "positive", "negative", F.greatest(loss, F.lit(0.0)).alias("loss"))


TRIPLETS = "anchor long, positive long, negative long, loss double, losses long, negatives long"


def choose_triplets(frame, margin: float, rule: str, seed: int = 7):
    """The triplets of one batch; see mine_triplets."""
    frame = frame.sort_values("id")
    ids, labels, v = frame["id"].to_numpy(), frame["label"].to_numpy(), np.array(frame["v"].tolist(), float)
    norms = (v * v).sum(1)
    squared = np.maximum(norms[:, None] + norms[None] - 2 * v @ v.T, 0)
    random, out = np.random.default_rng([seed, int(ids[0]) & 0x7FFFFFFF]), []
    for label in np.unique(labels):
        own, others = np.flatnonzero(labels == label), np.flatnonzero(labels != label)
        for n, a in enumerate(own if len(others) else []):
            for p in own[n + 1 :]:
                loss = squared[a, p] - squared[a, others] + margin
                bad = int((loss <= 0).sum())
                picks = np.flatnonzero((loss > 0) & (loss < margin) if rule == "semihard" else loss > 0)
                if len(picks) and rule == "hardest":
                    picks = [int(loss.argmax())]
                elif len(picks) and rule in ("semihard", "random"):
                    picks = [int(random.choice(picks))]
                # the counts of a pair go with its first row, chosen or not
                rows = [(ids[a], ids[p], ids[others[k]], loss[k]) for k in picks] or [(ids[a], ids[p], None, None)]
                out += [(*r, len(loss) if not i else 0, bad if not i else 0) for i, r in enumerate(rows)]
    names = [c.split()[0] for c in TRIPLETS.split(", ")]
    return pd.DataFrame(out, columns=names).astype({"negative": "Int64", "loss": float})


def mine_triplets(vectors: DataFrame, margin: float, rule: str = "hardest", batch: str = "batch") -> DataFrame:
    """Triplets of batches (id, v, label, batch) by loss: squared distance to the positive less that to the negative plus margin.

    Each pair of a label meets all other labels' vectors of its batch. rule: hardest (the greatest loss), semihard (one
    below margin), random (one of all) or all; only losses above 0 count. losses and negatives add up to how many losses
    there are and how many are at most 0; a pair without a negative has null there. A batch is what a training step
    holds, so a task's work is bounded by its size; batches are never joined with each other.
    """
    return vectors.select("id", "v", "label", batch).groupBy(batch).applyInPandas(lambda f: choose_triplets(f, margin, rule), TRIPLETS)


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node and depth of what roots (node) lead to by edges (src, dst); a frontier a round, until it is empty.

    Each round finds new nodes, so there is an end; there are as many rounds as the farthest node is away. As in ways(),
    joins with what was written shuffle.
    """
    from .storage import cut

    seen = cut(roots.select("node", F.lit(0).alias("depth")).distinct(), "reach")
    front, depth = seen, 0
    while True:
        depth += 1
        step = front.join(edges.hint("merge"), F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen.hint("merge"), "node", "left_anti")
        front = cut(step.withColumn("depth", F.lit(depth)), "front")
        if not front.limit(1).count():
            break
        seen = cut(seen.unionByName(front), "reach")
    return seen


#: Parts into which the edges of a hub are dealt.
HUB_PARTS = 8


def ways(edges: DataFrame, starts: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """doc, node, depth and way (the nodes from a start on) of what the starts (doc, node) of many graphs lead to by edges
    (doc, src, dst): of a node's shortest ways the least one. One search runs over all graphs, a round for each depth.

    With goals (doc, node) a graph is left once all of its goals are found, or its frontier is empty. Edges are dealt by a
    part of their other end, too, so a hub's are met by several tasks. Rows with nulls are no edges, starts or goals.
    What a round meets is written, and may be many times its files' size in memory, so its joins shuffle by their hints: by
    file size Spark would broadcast it through the driver.
    """
    from .storage import cut

    part = lambda c: F.pmod(F.xxhash64(c), F.lit(HUB_PARTS)).cast("int")
    dealt = cut(edges.select("doc", "src", "dst").where("doc IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL").distinct().withColumn("part", part("dst")), "edges")
    front = starts.select("doc", "node").where("doc IS NOT NULL AND node IS NOT NULL").distinct()
    front = seen = cut(front.select("doc", "node", F.lit(0).alias("depth"), F.array("node").alias("way")), "ways")
    left = None if goals is None else cut(goals.select("doc", "node").where("doc IS NOT NULL AND node IS NOT NULL").distinct(), "goals")
    depth = 0
    while True:
        if left is not None:
            left = cut(left.join(front.select("doc", "node").hint("merge"), ["doc", "node"], "left_anti"), "goals")
            front = front.join(left.select("doc").distinct().hint("merge"), "doc", "left_semi")
        depth += 1
        each = front.select("doc", F.col("node").alias("src"), "way", F.explode(F.sequence(F.lit(0), F.lit(HUB_PARTS - 1))).alias("part"))
        step = each.join(dealt.hint("merge"), ["doc", "src", "part"]).groupBy("doc", F.col("dst").alias("node")).agg(F.min("way").alias("way"))
        step = step.join(seen.select("doc", "node").hint("merge"), ["doc", "node"], "left_anti")
        front = cut(step.select("doc", "node", F.lit(depth).alias("depth"), F.concat("way", F.array("node")).alias("way")), "front")
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front) if depth % 8 else cut(seen.unionByName(front), "ways")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
