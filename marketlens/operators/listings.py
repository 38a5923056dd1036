"""Listings and sales: active scan, top lists, filters, projections."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.names import reforge_of_name, tag_to_name
from marketlens.operators.skew import hot_join

# Length of the lists, and how far back a filtered query may start.
RECENT_SALES = 12
ACTIVE_LISTINGS = 24
LOWEST_LISTINGS = 2
FILTER_DAYS = 35

FilterBuilder = Callable[[str], Column]

NAMED_FILTERS: dict[str, FilterBuilder] = {
    "ItemId": lambda value: F.col("item_id") == int(value),
    "Bin": lambda value: F.col("bin") == (value.lower() == "true"),
    "Rarity": lambda value: F.col("tier") == value,
}


def register_filter(name: str, build: FilterBuilder) -> None:
    """Add a named filter: a function from the filter's text to a condition."""
    NAMED_FILTERS[name] = build


def named_filters(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    conditions = [NAMED_FILTERS[name](value) for name, value in filters.items()]
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def plain_filters(df: DataFrame, reforge: str | None = None, tier: str | None = None) -> DataFrame:
    """Equality on reforge and tier; "Any" and "UNKNOWN" stand for no filter."""
    if reforge not in (None, "Any"):
        df = df.filter(F.col("reforge") == reforge)
    if tier not in (None, "UNKNOWN"):
        df = df.filter(F.col("tier") == tier)
    return df


def with_bid_state(headers: DataFrame, bids: DataFrame) -> DataFrame:
    """Headers with number of bids, highest bid (0 without one) and the price to show."""
    state = bids.groupBy("auction_id").agg(F.count(F.lit(1)).alias("n_bids"), F.max("amount").alias("highest_bid"))
    joined = headers.join(state, ["auction_id"], "left")
    highest = F.coalesce("highest_bid", F.lit(0)).cast("bigint")
    return joined.withColumns({"n_bids": F.coalesce("n_bids", F.lit(0)), "highest_bid": highest}).withColumn(
        "price", F.when(F.col("highest_bid") == 0, F.col("starting_bid")).otherwise(F.col("highest_bid"))
    )


def active_listings(headers: DataFrame, bids: DataFrame, as_of: str) -> DataFrame:
    """Listings still open; a buy-it-now listing with a bid is gone."""
    open_ = with_bid_state(headers.filter(F.col("end") > F.lit(as_of)), bids)
    return open_.filter(~F.col("bin") | (F.col("n_bids") == 0))


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key. Every task keeps n rows per key before the shuffle."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(rank)).filter(F.col("position") <= n)


def listing_order(order: str) -> list[Column]:
    if order == "ENDING_SOON":
        return [F.asc("end"), F.asc("auction_id")]
    if order == "LOWEST_PRICE":
        return [F.asc("price"), F.asc("auction_id")]
    return [F.desc("price"), F.asc("auction_id")]


def listing_board(active: DataFrame, keys: list[str], order: str, n: int = ACTIVE_LISTINGS) -> DataFrame:
    return top_per(active, keys, listing_order(order), n)


def lowest_bin(active: DataFrame, keys: list[str], n: int = LOWEST_LISTINGS) -> DataFrame:
    return top_per(active.filter("bin"), keys, listing_order("LOWEST_PRICE"), n)


def recent_sales(sales: DataFrame, keys: list[str], ties: list[str], n: int = RECENT_SALES) -> DataFrame:
    return top_per(sales, keys, [F.desc("end"), *[F.asc(c) for c in ties]], n)


def with_player_name(rows: DataFrame, players: DataFrame, on: str, hot_rows: int = 1_000_000) -> DataFrame:
    """Add the player's name; unknown players keep a null name."""
    names = players.select(F.col("id").alias(on), F.col("name").alias("player_name"))
    return hot_join(rows, names, [on], "left", hot_rows=hot_rows)


def page(df: DataFrame, order: str, number: int, size: int) -> DataFrame:
    """One page in a fixed order. Prefer :func:`pages_by_key` for walking a whole table."""
    return df.orderBy(order).offset(number * size).limit(size)


def pages_by_key(df: DataFrame, key: str, size: int) -> DataFrame:
    """Number pages by ranges of a dense key, without sorting the table."""
    return df.withColumn("page", F.floor(F.col(key) / size))


def guess_missing(rows: DataFrame) -> DataFrame:
    """Blank names come from the tag; a buy-it-now row without a starting bid takes the highest bid."""
    blank = F.coalesce("item_name", F.lit("")) == ""
    return rows.withColumns(
        {
            "item_name": F.when(blank, tag_to_name(F.col("tag"))).otherwise(F.col("item_name")),
            "starting_bid": F.when((F.col("starting_bid") == 0) & F.col("bin"), F.col("highest_bid")).otherwise(
                F.col("starting_bid")
            ),
        }
    )


def auction_result(rows: DataFrame) -> DataFrame:
    return rows.select("auction_id", "highest_bid", "item_name", "tag", "end", "starting_bid", "bin")


def index_elements(rows: DataFrame) -> DataFrame:
    """Short form of an auction: price, reforge read from the name, number of bids."""
    return rows.select(
        "auction_id",
        "end",
        F.col("highest_bid").alias("price"),
        reforge_of_name(F.col("item_name")).alias("reforge"),
        "count",
        "n_bids",
    )
