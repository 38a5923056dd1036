"""Rule tables as small DataFrames. Their size is fixed by the rules, so they may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rule_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def mapped(values: dict[str, object], key: Column) -> Column:
    """The value of a small fixed map, null for an unknown key."""
    entries = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)
