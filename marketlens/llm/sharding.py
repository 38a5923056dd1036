"""Sharding: global prefix sums of byte sizes from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.common import register, table
from marketlens.session import stored


def prefix_sums(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """Add ``before`` (sum of ``value`` over all earlier rows) and ``row`` (their number).

    Rows are dealt out by ranges of ``order``, written once, and each partition's totals
    (one row per partition) give every partition its offset, so no task sees more than its
    own range. Equal rows are told apart by their place in the input, which spreads a
    repeated row over ranges; which of them comes first changes no result.
    """
    place = df.withColumn("__place", F.monotonically_increasing_id())
    ranged = place.repartitionByRange(*order, "__place").withColumn("__part", F.spark_partition_id())
    rows = stored(ranged, "ranges")
    totals = rows.groupBy("__part").agg(F.sum(value).alias("__sum"), F.count("*").alias("__rows"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select(
        "__part",
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"),
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__first"),
    )
    within = Window.partitionBy("__part").orderBy(*order, "__place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .withColumn("__count", F.count("__place").over(within))
        .join(F.broadcast(offsets), "__part")  # as many rows as shuffle partitions
        .withColumn("before", F.col("__offset") + F.col("__within"))
        .withColumn("row", F.col("__first") + F.col("__count"))
        .drop("__place", "__part", "__within", "__count", "__offset", "__first")
    )


def shard_by_bytes(docs: DataFrame, shards: int = 16, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Put every row into one of ``shards`` contiguous shards of nearly equal bytes.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1. Rows stand in the order
    of ``order`` (nulls first), equal ones by the hash of their text; a row belongs to the
    shard that holds the middle of its bytes, so a shard misses its target by less than
    one row at either end. ``slot`` numbers the rows of a shard from 0. An empty table gives
    no rows; other columns are not read.
    """
    value = F.col(f"`{text}`")
    rows = docs.select(
        F.col(f"`{order}`").alias("doc_id"),
        (F.coalesce(F.octet_length(value), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(value, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(value).alias("__text"),
    )
    placed = prefix_sums(rows, ["doc_id", "__text"], "size")
    total = placed.agg(F.sum("size").alias("__total"))
    middle = (F.col("before") * 2 + F.col("size")).cast("decimal(38,0)") * shards
    placed = placed.crossJoin(F.broadcast(total)).withColumn(  # one row
        "shard", F.least(F.floor(middle / (F.col("__total") * 2)), F.lit(shards - 1)).cast("int")
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("__start"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("__start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("before").alias("first_byte"),
    )


@register("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), 16)
