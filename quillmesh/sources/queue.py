"""A work queue in a merged table, with a feed that streams read: an item is accepted once, whoever pushes it and how often."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .merged import MergedTable


class StreamQueue:
    """Items with a key, the push that brought them in (since), and whether they are done.

    A push is a merge, so of two at once one fails and is run again, and a repeated one adds nothing. What a push has added
    is published as files of its own, which a stream reads once each; its checkpoint is the place to go on from.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], buckets: int = 64):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.table = MergedTable(spark, f"{self.folder}/items", f"{schema}, since string, done boolean", key, buckets)
        self.names = [n for n in self.table.schema.names if n != "done"]

    def push(self, items: DataFrame, run: str) -> bool:
        """Add the items that aren't there yet, the least row of equal keys, and publish them; whether the run was new.

        A run that died between the two publishes when it is repeated.
        """
        rest = [n for n in self.names if n not in (*self.key, "since")]
        one = items.groupBy(*self.key).agg(F.min(F.struct(*rest, F.lit(0).alias("_"))).alias("_r"))
        fresh = one.select(*self.key, *[F.col("_r")[c].alias(c) for c in rest], F.lit(run).alias("since"), F.lit(False).alias("done"))
        new = self.table.merge(fresh, lambda old, add: old.unionByName(add.join(old, self.key, "left_anti")), f"push-{run}")
        self.publish(run)
        return new

    def publish(self, run: str) -> None:
        fs, target = self.table._fs(), self.table._path(f"../feed/{uuid.uuid5(uuid.NAMESPACE_URL, run).hex}")
        if fs.exists(target):
            return
        draft = f"{self.folder}/drafts/{uuid.uuid4().hex}"
        self.table.read().where(F.col("since") == run).select(*self.names).write.parquet(draft)
        fs.mkdirs(target.getParent())
        if not fs.rename(self.table._path(f"../drafts/{draft.rsplit('/', 1)[1]}"), target) and not fs.exists(target):
            raise OSError(f"can't publish {run}")

    def stream(self, files: int | None = None) -> DataFrame:
        """All items as they are published, with `since`; at most so many files a trigger."""
        fs, feed = self.table._fs(), self.table._path("../feed")
        fs.mkdirs(feed)
        schema = self.table.schema
        read = self.spark.readStream.schema(type(schema)([f for f in schema.fields if f.name != "done"]))
        return (read if files is None else read.option("maxFilesPerTrigger", files)).parquet(f"{self.folder}/feed/*")

    def finish(self, items: DataFrame, run: str) -> bool:
        """Mark items as done; those that aren't in the queue are left out."""
        mark = items.select(*self.key).distinct()
        return self.table.merge(mark, lambda old, keys: old.join(keys.withColumn("_hit", F.lit(True)), self.key, "left").withColumn("done", F.col("done") | F.coalesce("_hit", F.lit(False))), f"finish-{run}")

    def waiting(self) -> DataFrame:
        return self.table.read().where("NOT done").select(*self.names)
