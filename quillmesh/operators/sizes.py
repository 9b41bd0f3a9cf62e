"""Broadcasts only of sides whose size has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS, BYTES = 500_000, 32 << 20


def width(field: T.StructField):
    """About the bytes of a column's value: strings by their length, arrays by their elements, others as eight."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = F.aggregate(c, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16) if isinstance(kind.elementType, T.StringType) else 8 * F.size(c)
        return F.coalesce(inner, F.lit(0)) + 16
    return F.lit(8)


def is_small(df: DataFrame, rows: int = ROWS, size: int = BYTES) -> bool:
    """Whether a count of df's rows and bytes is within the limits."""
    n, total = df.agg(F.count("*"), F.sum(sum((width(f).cast("long") for f in df.schema.fields), F.lit(0)))).first()
    return n <= rows and (total or 0) <= size


def small(df: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """df with a broadcast hint if it is small, else df as it is, for a join that shuffles."""
    return F.broadcast(df) if is_small(df, rows, size) else df
