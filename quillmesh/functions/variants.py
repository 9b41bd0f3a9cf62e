"""JSON whose labels aren't known ahead, as VARIANT: every label is a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of nesting that are opened; what lies deeper stays a value, as JSON.
DEPTH = 8


def labels(df: DataFrame, json: str, keep: list[str], depth: int = DEPTH) -> DataFrame:
    """keep, path, kind and value of each scalar in a column of JSON text; elements of arrays share the path `name[]`.

    kind is the value's type, value its text as JSON has it, null for null. Text that is null or no JSON, and a scalar that
    stands alone, has no labels; empty objects and arrays have none either.
    """
    spark, out = df.sparkSession, None
    level = df.select(*keep, F.lit("").alias("path"), F.try_parse_json(json).alias("v")).where("v IS NOT NULL")
    for k in range(depth):
        opened = spark.sql("SELECT d.*, e.key AS label, e.value AS item FROM {d} AS d, LATERAL variant_explode(d.v) AS e", d=level)
        name = F.when(F.col("label").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), "label"))
        opened = opened.select(*keep, name.alias("path"), F.col("item").alias("v"), F.schema_of_variant("item").alias("kind"))
        nested = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        scalars = opened.where(~nested if k < depth - 1 else F.lit(True)).select(*keep, "path", "kind", F.when(F.col("kind") != "VOID", F.col("v").cast("string")).alias("value"))
        out = scalars if out is None else out.unionByName(scalars)
        level = opened.where(nested).drop("kind")
    return out


def shape(df: DataFrame, json: str) -> str:
    """The schema that all JSON of a column has in common, widened where it differs; null without any."""
    return df.agg(F.schema_of_variant_agg(F.try_parse_json(json))).first()[0]
