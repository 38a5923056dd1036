"""Event tables: routing, active set, funnel, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.ids import has_flag
from marketlens.operators.skew import hot_join

# Flip event flags and alert flags.
FLIP_EVENTS = {
    "FLIP_RECEIVE": 1, "FLIP_CLICK": 2, "PURCHASE_START": 4, "PURCHASE_CONFIRM": 8, "AUCTION_SOLD": 16, "UPVOTE": 32, "DOWNVOTE": 64,
}
ALERT_FLAGS = {
    "PRICE_LOWER_THAN": 1, "PRICE_HIGHER_THAN": 2, "OUTBID": 4, "SOLD": 8, "BIN": 16, "USE_SELL_NOT_BUY": 32, "AUCTION": 64, "PLAYER": 128,
}
OPENING = ["new", "bid"]


def of_kind(events: DataFrame, *kinds: str) -> DataFrame:
    """Events of some kinds; works on tables and on streams."""
    return events.filter(F.col("kind").isin(*kinds))


def latest_events(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key."""
    rest = [c for c in events.columns if c not in (key, *order)]
    last = F.max(F.struct(*order, *rest)).alias("__last")
    return events.groupBy(key).agg(last).select(key, "__last.*").select(*events.columns)


def active_set(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keys whose last event opens or keeps them, not sells, cancels or ends them."""
    return of_kind(latest_events(events, key, order), *OPENING)


def flip_funnel(events: DataFrame) -> DataFrame:
    """Events per auction and step; a combined flag counts for each of its steps."""
    steps = [F.sum(has_flag(F.col("type"), flag).cast("bigint")).alias(name.lower()) for name, flag in FLIP_EVENTS.items()]
    return events.groupBy("auction_uid").agg(*steps)


def daily_ranges(points: DataFrame, key: str) -> DataFrame:
    """Per key one array of daily price ranges, no longer than the calendar."""
    daily = points.groupBy(key, F.unix_date(F.col("ts").cast("date")).alias("day")).agg(
        F.min("buy_price").alias("min_buy"), F.max("buy_price").alias("max_buy"), F.min("sell_price").alias("min_sell"), F.max("sell_price").alias("max_sell")
    )
    row = F.struct("day", "min_buy", "max_buy", "min_sell", "max_sell")
    return daily.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("__days"))


def price_alerts(subscriptions: DataFrame, points: DataFrame, key: str, hot_rows: int = 1_000_000) -> DataFrame:
    """The first day each subscription fires: a price below or above its own, not before its day.

    Points are folded to daily ranges first, so a subscription meets one row, however
    many subscribe to the same item.
    """
    joined = hot_join(subscriptions, daily_ranges(points, key), [key], "inner", hot_rows=hot_rows)
    sells = has_flag(F.col("type"), ALERT_FLAGS["USE_SELL_NOT_BUY"])
    lower = has_flag(F.col("type"), ALERT_FLAGS["PRICE_LOWER_THAN"])
    higher = has_flag(F.col("type"), ALERT_FLAGS["PRICE_HIGHER_THAN"])

    def fires(d):
        least = F.when(sells, d["min_sell"]).otherwise(d["min_buy"])
        most = F.when(sells, d["max_sell"]).otherwise(d["max_buy"])
        hit = (lower & (least < F.col("price"))) | (higher & (most > F.col("price")))
        return (d["day"] >= F.col("not_before_day")) & hit

    first = F.get(F.filter("__days", fires), F.lit(0))
    return joined.withColumn("day", first["day"]).filter("day is not null").drop("__days")
