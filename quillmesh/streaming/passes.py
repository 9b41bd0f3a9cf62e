"""Two passes of a scan as streams that meet, and writes of batches that may fail."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def two_pass(direct: DataFrame, rescan: DataFrame, key: str, at: str, ok: str, wait: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """Results of a direct scan as they arrive; for one that missed, the rescan's if it comes within `wait`, else the miss.

    Both streams have the same columns: a key, a timestamp `at`, whether it reached (`ok`, null counts as no), and more. Rows
    that repeat a key are dropped while the watermark remembers it. A hit goes out at once; a miss goes out with its
    rescan, or when the watermark has passed its wait. State is kept for the wait and what is late, and no longer.
    """
    hit = F.coalesce(F.col(ok), F.lit(False))
    first = direct.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    again = rescan.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    again = again.select(*[F.col(c).alias(f"again_{c}") for c in rescan.columns])
    near = (F.col(f"again_{at}") >= F.col(at)) & (F.col(f"again_{at}") <= F.col(at) + F.expr(f"INTERVAL {wait}"))
    # the condition on the hit is the left side's alone, so hits don't wait
    met = first.join(again, ~hit & (F.col(key) == F.col(f"again_{key}")) & near, "left_outer")
    found = F.col(f"again_{key}").isNotNull()
    return met.select(*[F.when(found, F.col(f"again_{c}")).otherwise(F.col(c)).alias(c) for c in direct.columns], found.alias("second"))


def saved(write: Callable[[DataFrame, int], None], aside: str, retries: int = 2, wait: float = 0.0) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: write, up to `retries` times more, else the batch goes to a folder of its number, with the
    error. A batch that is repeated replaces what it has left there.
    """

    def run(df: DataFrame, n: int) -> None:
        df.persist()  # a batch is computed once for all its attempts
        try:
            for attempt in range(retries + 1):
                try:
                    return write(df, n)
                except Exception as e:
                    error = str(e)
                    if attempt < retries:
                        time.sleep(wait)
            df.withColumn("error", F.lit(error)).write.mode("overwrite").parquet(f"{aside.rstrip('/')}/batch={n}")
        finally:
            df.unpersist()

    return run
