"""Duplicates, counters and dense ids. Duplicates fold map-side; no group is sorted as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID_PREFIX = 4  # hexadecimal digits: 65,536 buckets


def keep_first(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """One row per key: the smallest by ``order`` and then by all other columns."""
    rest = [c for c in df.columns if c not in order]
    names = [f"__k{i}" for i in range(len(keys))]
    row = F.min(F.struct(*order, *rest)).alias("__row")
    return df.groupBy(*[k.alias(n) for k, n in zip(keys, names)]).agg(row).select("__row.*").select(*df.columns)


def dedup_auctions(auctions: DataFrame, order: list[str]) -> DataFrame:
    return keep_first(auctions, [F.col("uuid")], order)


def dedup_bids(bids: DataFrame, order: list[str]) -> DataFrame:
    """Bids of one bidder and amount on the same day of the year, whatever the year, count once."""
    return keep_first(bids, [F.dayofyear("ts"), F.col("bidder"), F.col("amount")], order)


def dedup_points(points: DataFrame, order: list[str]) -> DataFrame:
    return keep_first(points, [F.col("volume"), F.col("item_id"), F.col("date")], order)


def dedup_enchants(enchants: DataFrame) -> DataFrame:
    return enchants.select("auction_id", "type", "level").distinct()


def dedup_names(names: DataFrame) -> DataFrame:
    """Alternative names: the smallest id of each (name, item) stays."""
    return names.groupBy("name", "item_id").agg(F.min("id").alias("id"))


def add_hits(stored: DataFrame, lookups: DataFrame, key: str) -> DataFrame:
    """Add the number of look-ups to the stored hit counts; unknown keys are skipped."""
    counted = lookups.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return stored.join(counted, [key], "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("__n", F.lit(0))).drop("__n")


def dense_ids(values: DataFrame, keys: list[str], start: Column | int = 0, prefix: int = ID_PREFIX) -> DataFrame:
    """Number distinct rows without gaps, without sorting them in one task.

    The order is that of the keys' MD5. Rows are numbered inside buckets of equal
    hash prefix; a running total over the bucket sizes (at most 16^prefix rows)
    gives each bucket its offset.
    """
    hashed = values.withColumn("__h", F.md5(F.concat_ws("\x1f", *keys))).withColumn("__p", F.left("__h", F.lit(prefix)))
    sizes = hashed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy("__h", *keys))
    first = F.lit(start) if isinstance(start, int) else start
    return (
        hashed.withColumn("__r", place)
        .join(F.broadcast(offsets), ["__p"])
        .withColumn("id", (first + F.col("__offset") + F.col("__r")).cast("bigint"))
        .drop("__h", "__p", "__offset", "__r")
    )


def fresh_ids(known: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """(id, keys) of the seen keys that are not known yet; ids follow the largest known one."""
    fresh = seen.select(*keys).distinct().join(known.select(*keys), keys, "left_anti")
    last = known.agg(F.coalesce(F.max("id"), F.lit(0)))
    return dense_ids(fresh, keys).select((F.col("id") + last.scalar()).alias("id"), *keys)


def get_or_create_ids(known: DataFrame, seen: DataFrame, keys: list[str], read_only: bool = False) -> DataFrame:
    """The dictionary with ids for all seen keys; new ones follow the largest known id.

    Read-only, a new key gets id 0 instead. A dictionary must have a single writer.
    """
    if read_only:
        fresh = seen.select(*keys).distinct().join(known.select(*keys), keys, "left_anti")
        return known.select("id", *keys).unionByName(fresh.withColumn("id", F.lit(0).cast("bigint")).select("id", *keys))
    return known.select("id", *keys).unionByName(fresh_ids(known, seen, keys))
