"""Search of byte strings that are hidden by a single-byte key."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def xor_hits(content: bytes, needle: bytes, ignore_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Keys from 0 to 255 and byte offsets where content, XORed with the key, has needle; overlapping ones too.

    A needle's first byte can stand at an offset under one key only (two, if its case is free), so each offset is
    tried with that key and no key needs a search of its own.
    """
    if not needle:
        raise ValueError("nothing to search for")
    c, fold = np.frombuffer(content, np.uint8), np.arange(256, dtype=np.uint8)
    if ignore_case:
        fold, needle = np.frombuffer(bytes(range(256)).lower(), np.uint8), needle.lower()
    starts, found = max(0, len(c) - len(needle) + 1), []
    for first in np.flatnonzero(fold == needle[0]).astype(np.uint8):
        at, key = np.arange(starts), c[:starts] ^ first
        for j in range(1, len(needle)):
            ok = fold[c[at + j] ^ key] == needle[j]
            at, key = at[ok], key[ok]
        found.append((key, at))
    key, at = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((at, key))
    return key[order].astype(np.int32), at[order].astype(np.int64)


def xor_search(df: DataFrame, id: str, content: str, needle: bytes, ignore_case: bool = False) -> DataFrame:
    """id, key and offset of each place where a row's whole content (string or binary) has needle under a single-byte key.

    Strings are searched as UTF-8; offsets count bytes. Key 0 is the content as it is. Null content has no places.
    """
    xor_hits(b"", needle)

    def run(batches):
        for batch in batches:
            ids, keys, offsets = [], [], []
            for row, text in enumerate(batch.column(1)):
                if text.is_valid:
                    key, at = xor_hits(text.as_py(), needle, ignore_case)
                    ids.append(np.full(len(key), row))
                    keys.append(key)
                    offsets.append(at)
            if ids:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(keys)), pa.array(np.concatenate(offsets))], names=["id", "key", "offset"])

    kind = df.schema[id].dataType.simpleString()
    found = df.select(F.col(id).alias("id"), F.col(content).cast("binary").alias("c")).mapInArrow(run, f"id {kind}, key int, offset long")
    return found.withColumnRenamed("id", id)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
