"""Helpers for functions that run over Arrow batches on executors.

Functions of this subpackage are pickled by value, so executors need no copy of the package.
"""

from __future__ import annotations

import pickle
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

CHUNK_BYTES = 4 << 20
#: Rows in an Arrow batch, so that a batch of long texts or of pairs of sets stays small; Spark's own default is 10,000.
BATCH_ROWS = 1000


def small_batches(spark) -> None:
    """Lower the session's rows in an Arrow batch to BATCH_ROWS where they are more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def by_value(module: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module])


def per_process(key, make):
    """make(), kept for later tasks of this Python worker."""
    kept = sys.__dict__.setdefault("_quillmesh_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def shared(spark, name: str, value):
    """A function that gives value on executors, read once by each Python worker.

    The broadcast is bytes in which classes of this subpackage are whole, as a plain broadcast would name their module only.
    """
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    number = packed._jbroadcast.id()

    def get():
        kept = per_process(("shared", name), dict)
        if number not in kept:
            kept.clear()  # an earlier model of this name goes
            kept[number] = pickle.loads(packed.value)
        return kept[number]

    return get


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Slices of batch with at most limit bytes in column, or a single row."""
    arr = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(lengths(arr))
    at, n = 0, batch.num_rows
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def lengths(arr: pa.Array) -> np.ndarray:
    """Bytes of each string; null counts as 0."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after the other, and n + 1 offsets; null has no bytes."""
    import pyarrow.compute as pc

    arr = pc.fill_null(arr, "").cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


by_value(__name__)
