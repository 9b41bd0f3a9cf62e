"""A stored table that is merged into: files by bucket of the key, and numbered manifests that name the files of a version.

A merge rewrites the buckets that new rows fall into and no others. It is done when its manifest has got its number, by a
rename that fails if the number is taken; until then readers see the version before. A manifest remembers the runs that are
in it, so a run that is repeated, after a failure or by a restarted stream, changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.operators.storage import cut

#: Runs that a manifest remembers.
RUNS = 10_000

Fold = Callable[[DataFrame, DataFrame], DataFrame]


class MergedTable:
    """Rows with a schema below a folder that all machines share; each key belongs to one bucket.

    The number of buckets holds for the table's life: about as many as make a bucket's rows one task's work.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.schema = T._parse_datatype_string(schema)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        path = self._path("")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def version(self) -> int:
        """The newest version's number, 0 before the first merge."""
        fs, at = self._fs(), self._path("manifests")
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """buckets: the folder of each bucket that has rows; runs: the newest runs, in order."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "buckets": {}, "runs": []}
        stream = self._fs().open(self._path(f"manifests/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Give a manifest its number; an error if another merge has taken it."""
        jvm, fs = self.spark._jvm, self._fs()
        draft = self._path(f"manifests/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(draft, self._path(f"manifests/{manifest['version']:012d}.json"), plain)

    def _of(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{x}" for x in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        return self._of(sorted(self.manifest(version)["buckets"].values()))

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def merge(self, new: DataFrame, fold: Fold, run: str) -> bool:
        """fold(old, new) in the buckets of new's rows; whether that changed the table.

        old has the rows of these buckets, new all of its own; the fold's rows must have keys of these buckets. Nothing is
        collected but the numbers of the buckets. An empty new is a run, too.
        """
        manifest = self.manifest()
        if run in manifest["runs"]:
            return False
        new = cut(new.withColumn("_bucket", self._bucket()), "new")
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())
        old = self._of([manifest["buckets"][str(b)] for b in touched if str(b) in manifest["buckets"]])
        name = f"data/{uuid.uuid4().hex}"
        if touched:
            rows = fold(old, new.drop("_bucket")).select(*self.schema.names).withColumn("_bucket", self._bucket())
            # files of a bucket are written together, large ones by several tasks
            rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{name}")
        fs = self._fs()
        written = {b: f"{name}/_bucket={b}" for b in touched if fs.exists(self._path(f"{name}/_bucket={b}"))}
        buckets = {k: v for k, v in manifest["buckets"].items() if int(k) not in set(touched)} | {str(b): p for b, p in written.items()}
        self._commit({"version": manifest["version"] + 1, "buckets": buckets, "runs": [*manifest["runs"], run][-RUNS:]})
        return True

    def merge_stream(self, stream: DataFrame, fold: Fold, checkpoint: str, name: str) -> None:
        """Merge what a stream has now, each batch once: a batch that is repeated is a run that the table knows."""
        q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: self.merge(df, fold, f"{name}-{n}") and None).start()
        q.awaitTermination()

    def clean(self, keep: int = 2) -> int:
        """Delete files that the newest `keep` versions don't name, and older manifests; how many folders went.

        For a time when no merge is under way, as a merge's files are in no version until it is done.
        """
        fs, newest = self._fs(), self.version()
        versions = range(max(1, newest - keep + 1), newest + 1)
        named = {p.split("/")[1] for v in versions for p in self.manifest(v)["buckets"].values()}
        gone = 0
        for s in fs.listStatus(self._path("data")) if fs.exists(self._path("data")) else []:
            if s.getPath().getName() not in named:
                gone += fs.delete(s.getPath(), True)
        for s in fs.listStatus(self._path("manifests")) if newest else []:
            n = s.getPath().getName()
            if not n.endswith(".json") or int(n[:-5]) not in versions:
                fs.delete(s.getPath(), False)
        return gone
