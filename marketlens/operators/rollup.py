"""Price and volume roll-ups. Everything aggregates map-side before its one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators.skew import hot_join

# Fixed values of the roll-up semantics.
SPIKE_FACTOR = 1000
MAX_INT = 2147483647
BACKFILL_DAYS = 7


def when_sold(start: str, end: str) -> Column:
    """Sold auctions that ended inside a window, both bounds left out."""
    return (F.col("end") > F.lit(start)) & (F.col("end") < F.lit(end)) & (F.col("highest_bid") > 1)


def unit_price() -> Column:
    """Price of one piece, whole coins; null for an empty stack."""
    return F.expr("highest_bid div nullif(`count`, 0)")


def price_rollup(sales: DataFrame, keys: list[str], unit: str = "day", at: str = "end") -> DataFrame:
    """avg/max/min unit price and volume per key and day or hour."""
    return (
        sales.withColumn("__unit", unit_price())
        .groupBy(*keys, F.date_trunc(unit, F.col(at)).alias("date"))
        .agg(
            F.avg("__unit").alias("avg"),
            F.max("__unit").alias("max"),
            F.min("__unit").alias("min"),
            F.sum("count").cast("bigint").alias("volume"),
        )
    )


def bazaar_rollup(points: DataFrame, start: str, end: str) -> DataFrame:
    """One price point per product over an inclusive period of commodity snapshots."""
    hours = (F.unix_timestamp(F.lit(end)) - F.unix_timestamp(F.lit(start))) / 3600
    inside = points.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") <= F.lit(end)))
    return inside.groupBy("product_id").agg(
        (F.avg("buy_moving_week") / 7 / 24 * hours).cast("int").alias("volume"),
        (F.avg(F.col("buy_price") + F.col("sell_price")) / 2).alias("avg"),
        F.max("buy_price").alias("max"),
        F.min("sell_price").alias("min"),
        F.lit(start).cast("timestamp").alias("date"),
    )


def bazaar_points(feed: DataFrame) -> DataFrame:
    """A price point per commodity snapshot; the volume is the weekly one cut down step by step."""
    return feed.select(
        *[c for c in ("event_id", "user_id") if c in feed.columns],
        "product_id",
        F.col("ts").alias("date"),
        F.col("buy_price").alias("max"),
        F.col("sell_price").alias("min"),
        ((F.col("buy_price") + F.col("sell_price")) / 2).alias("avg"),
        F.expr("sell_moving_week div 7 div 24 div 60 div 6").alias("volume"),
    )


def sale_points(sales: DataFrame) -> DataFrame:
    """A price point per sold auction: the whole bid, not the price of a piece."""
    bid = F.col("highest_bid")
    return sales.select(
        "item_id",
        F.col("end").alias("date"),
        bid.alias("avg"),
        bid.alias("min"),
        bid.alias("max"),
        F.col("count").alias("volume"),
    )


def combine_points(points: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Fold the points of a period into one.

    The average divides by the number of all points of the key, also those
    outside the period or without a price.
    """
    inside = (F.col("date") >= F.lit(start)) & (F.col("date") <= F.lit(end)) & (F.col("avg") > 0)

    def only(column: str) -> Column:
        return F.when(inside, F.col(column))

    return (
        points.groupBy(*keys)
        .agg(
            F.count(only("avg")).alias("__n"),
            (F.sum(only("avg")) / F.count(F.lit(1))).alias("avg"),
            F.greatest(F.lit(0), F.max(only("max"))).alias("max"),
            F.least(F.lit(MAX_INT), F.min(only("min"))).alias("min"),
            F.sum(only("volume")).cast("bigint").alias("volume"),
            F.min(only("date")).alias("date"),
        )
        .filter("__n > 0")
        .drop("__n")
    )


def spike_filter(points: DataFrame, keys: list[str], factor: float = SPIKE_FACTOR, hot_rows: int = 1_000_000) -> DataFrame:
    """Drop points whose maximum reaches ``factor`` times the mean minimum of their key."""
    usual = points.groupBy(*keys).agg(F.avg("min").alias("__usual"))
    joined = hot_join(points, usual, keys, "inner", hot_rows=hot_rows)
    return joined.filter(F.col("max") < F.col("__usual") * factor).drop("__usual")


def append_missing(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing price rows plus the new ones whose key is not there yet."""
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti"))


def with_live_point(series: DataFrame, live: DataFrame) -> DataFrame:
    """A stored series and the point of the running period, left out while it has no volume."""
    return series.unionByName(live.filter("volume <> 0").select(*series.columns))


def backfill(sales: DataFrame, existing: DataFrame, start: str, as_of: str, days: int = BACKFILL_DAYS) -> DataFrame:
    """Daily price rows for every item-week that has none.

    Weeks count from ``start`` and are closed to the left, so a sale on a week's
    edge is kept. A week is taken once it began more than a week before
    ``as_of``; it counts as filled if a price lies within a minute of it. The
    sales are rolled up first, so the join sees one row per item and day.
    """
    span = days * 86400
    origin = F.unix_timestamp(F.lit(start))

    def offset(column: str) -> Column:
        return F.unix_timestamp(F.col(column).cast("timestamp")) - origin

    week = F.floor(offset("date") / span)
    due = (F.col("end") >= F.lit(start)) & (F.col("highest_bid") > 1)
    rows = price_rollup(sales.filter(due), ["item_id"]).withColumn("__week", week)
    rows = rows.filter((F.col("__week") * span) < (F.unix_timestamp(F.lit(as_of)) - origin - span))
    into = offset("date") - week * span
    touched = F.array_compact(
        F.array(
            week,
            F.when(into < 60, week - 1),
            F.when(F.lit(span) - into < 60, week + 1),
        )
    )
    filled = existing.select("item_id", F.explode(touched).alias("__week")).distinct()
    return rows.join(filled, ["item_id", "__week"], "left_anti").drop("__week")


def daily_fill(sales: DataFrame, existing: DataFrame, day: str, next_day: str) -> DataFrame:
    """The price rows of one day for the items that have none in it (both edges count as in it)."""
    rows = price_rollup(sales.filter(when_sold(day, next_day)), ["item_id"])
    there = existing.filter((F.col("date") >= F.lit(day)) & (F.col("date") <= F.lit(next_day))).select("item_id")
    return rows.join(there.distinct(), ["item_id"], "left_anti")


def house_state(listings: DataFrame, by: str) -> DataFrame:
    """Active auctions per item; parts of a split state merge by adding up."""
    return listings.groupBy(by).agg(F.count(F.lit(1)).alias("active"), F.countDistinct("seller_id").alias("sellers"))


def merge_house_state(parts: DataFrame) -> DataFrame:
    return parts.groupBy("tag").agg(F.sum("item_count").alias("item_count"))


def bucket_start(ts: Column, seconds: int) -> Column:
    """The start of the span a time falls in, spans counted from the year 1."""
    year_one = 62135596800
    epoch = F.unix_timestamp(ts.cast("timestamp")) + F.lit(year_one)
    return F.timestamp_seconds(F.floor(epoch / seconds) * seconds - year_one)
