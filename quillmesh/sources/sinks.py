"""Where tables go: appended rows, dated copies, bodies by hash, work queues, and tables behind JDBC."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import url as U


def append(df: DataFrame, folder: str) -> None:
    """Add rows to a table of Parquet files."""
    df.write.mode("append").parquet(folder)


def dated(df: DataFrame, folder: str, day: str) -> None:
    """The copy of a table for a day; a repeated run replaces that day's copy only."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\d", day):
        raise ValueError(f"not a day: {day}")
    df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/day={day}")


def bodies(df: DataFrame, folder: str, digest: str = "url_hash", rescan: bool = False) -> None:
    """Captured files (digest, name, content as binary) below a folder for the first two digits of the digest.

    Rescans are apart, so a reader can prefer the first capture (files.prefer). path is the place a single file would have.
    """
    out = df.withColumn("path", U.shard_path(F.col(digest))).withColumn("shard", F.substring(digest, 1, 2)).withColumn("rescan", F.lit(int(rescan)))
    out.write.mode("append").partitionBy("rescan", "shard").parquet(folder)


def dump(objects: DataFrame, folder: str) -> None:
    """Objects of parsed files and their references, by version, as two tables."""
    objects.write.mode("overwrite").partitionBy("version").parquet(f"{folder.rstrip('/')}/objects")
    objects.select("path", "version", F.col("id").alias("src"), F.explode("refs").alias("dst")).write.mode("overwrite").partitionBy("version").parquet(f"{folder.rstrip('/')}/references")


class Queue:
    """A work queue as two tables: what was pushed, and what was done. An item is pushed once and taken until it is done."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str]):
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key

    def _read(self, part: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        there = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
        frame = self.spark.read.schema(self.schema)
        return frame.parquet(f"{self.folder}/{part}") if there else self.spark.createDataFrame([], self.schema)

    def push(self, items: DataFrame) -> None:
        """Add the items that aren't there yet."""
        fresh = items.dropDuplicates(self.key).join(self._read("pushed").select(*self.key), self.key, "left_anti")
        fresh.select(*self._read("pushed").columns).write.mode("append").parquet(f"{self.folder}/pushed")

    def waiting(self) -> DataFrame:
        return self._read("pushed").join(self._read("done").select(*self.key), self.key, "left_anti")

    def take(self, workers: int, worker: int) -> DataFrame:
        """One worker's share of what waits: items are dealt by a hash of their key."""
        return self.waiting().where(F.pmod(F.xxhash64(*self.key), F.lit(workers)) == worker)

    def done(self, items: DataFrame) -> None:
        items.select(*self._read("pushed").columns).write.mode("append").parquet(f"{self.folder}/done")

    def count(self) -> int:
        return self.waiting().count()

    def clean(self) -> None:
        for part in ("pushed", "done"):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 8, rows: int = 10_000, **options: str) -> DataFrame:
    """A table behind JDBC, read in parts by ranges of a numeric key, `rows` at a time; without a key by one task."""
    read = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=rows, **options)
    if key is None:
        return read.load()
    name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    low, high = spark.read.format("jdbc").options(url=url, query=f"SELECT min({name}) AS low, max({name}) AS high FROM {table}", **options).load().first()
    if low is None:
        return read.load()
    return read.options(partitionColumn=key, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts).load()


def write_jdbc(df: DataFrame, url: str, table: str, rows: int = 1000, **options: str) -> None:
    """Add rows to a table behind JDBC, `rows` in a statement's batch."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=rows, **options).mode("append").save()


def save(df: DataFrame, write: Callable[[DataFrame], None], aside: str, retries: int = 2, wait: float = 0.0) -> bool:
    """Write df, with up to `retries` further attempts; then it goes to the folder `aside`, with the error. Whether it was written."""
    for attempt in range(retries + 1):
        try:
            write(df)
            return True
        except Exception as e:
            error = str(e)
            if attempt < retries:
                time.sleep(wait)
    df.withColumn("error", F.lit(error)).write.mode("append").parquet(aside)
    return False


def poll(step: Callable[[], int], empties: int = 3, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Call step until it has found nothing `empties` times in a row, with waits that double; how much it found in all."""
    total = idle = 0
    while idle < empties:
        found = step()
        total, idle = total + found, 0 if found else idle + 1
        if not found and idle < empties:
            sleep(base * 2**idle)
    return total


def two_pass(direct: DataFrame, rescan: DataFrame, key: list[str], ok: Column) -> DataFrame:
    """Results of a direct scan; where it missed, those of the rescan of the misses, if there are any."""
    missed = direct.where(~F.coalesce(ok, F.lit(False)))
    again = rescan.join(missed.select(*key), key, "left_semi")
    return direct.join(again.select(*key), key, "left_anti").unionByName(again.select(*direct.columns))
