"""Intermediate tables in shared storage, and size checks before broadcasts; both are the core's."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillmesh.operators.sizes import is_small, small
from quillmesh.operators.storage import cut


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to shared storage and read it again: lineage ends here and lost executors lose nothing."""
    return cut(df, name)


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if a count of its rows and bytes shows that it is small, else df as it is."""
    return small(df)


__all__ = ["is_small", "materialise", "maybe_broadcast"]
