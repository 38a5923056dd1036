"""Scans of commodity snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pulls_from_feed(feed: DataFrame) -> DataFrame:
    """Snapshots in their nested form: a time and an array of products with status and order book."""
    status = F.struct(
        "buy_price",
        "sell_price",
        "buy_moving_week",
        "sell_moving_week",
    ).alias("quick_status")
    order = F.struct(
        F.col("k").cast("int").alias("amount"),
        F.col("buy_price").alias("price_per_unit"),
        F.lit(1).cast("smallint").alias("orders"),
    )
    product = F.struct("product_id", F.array(order).alias("buy_summary"), status)
    return feed.select("event_id", "ts", F.array(product).alias("products"))


def pulls_with_books(feed: DataFrame, products: list[str]) -> DataFrame:
    """One pull per snapshot of the feed with several products, each with both sides of its book, up to four orders a side."""

    def side(offset: int):
        def order(i):
            amount = (F.col("k") + i * 7 + offset) % 5 + 1
            price = (F.col("user_id") + i * offset) % 4 + 0.5
            return F.struct(amount.cast("int").alias("amount"), price.alias("price_per_unit"), ((F.col("k") + i) % 3 + 1).cast("smallint").alias("orders"))

        return F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < (F.col("k") + offset) % 5), order)

    def product(n: int, name: str):
        bought = F.when(F.col("k") % 7 != n, side(n))
        return F.struct(F.lit(name).alias("product_id"), bought.alias("buy_summary"), side(n + 1).alias("sell_summary"))

    return feed.select("event_id", "ts", F.array(*[product(n, p) for n, p in enumerate(products)]).alias("products"))


def product_rows(pulls: DataFrame, start: str, end: str) -> DataFrame:
    """One row per product of every snapshot inside a period, both bounds taken."""
    return (
        pulls.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") <= F.lit(end)))
        .withColumn("product", F.explode("products"))
        .select(
            *[c for c in pulls.columns if c != "products"],
            "product.product_id",
            "product.quick_status.*",
        )
    )


SIDES = ["buy_summary", "sell_summary"]


def order_rows(pulls: DataFrame, sides: list[str] = SIDES) -> DataFrame:
    """One row per order of both sides of every product's book, with its place in it; a missing side has none."""
    keys = [c for c in pulls.columns if c != "products"]
    books = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"product.{s}").alias("orders")) for s in sides])
    return (
        pulls.withColumn("product", F.explode("products"))
        .select(*keys, "product.product_id", F.explode(books).alias("book"))
        .select(*keys, "product_id", "book.side", F.posexplode("book.orders").alias("level", "order"))
        .select(*keys, "product_id", "side", "level", "order.*")
    )


def book_rows(pulls: DataFrame, sides: list[str] = SIDES) -> DataFrame:
    """One row per product and side of every pull, its whole list of orders as ``book`` (empty where there is none)."""
    keys = [c for c in pulls.columns if c != "products"]
    empty = F.array().cast("array<struct<amount:int,price_per_unit:double,orders:smallint>>")
    books = F.array(*[F.struct(F.lit(s).alias("side"), F.coalesce(F.col(f"product.{s}"), empty).alias("book")) for s in sides])
    return (
        pulls.withColumn("product", F.explode("products"))
        .select(*keys, "product.product_id", F.explode(books).alias("b"))
        .select(*keys, "product_id", "b.*")
    )
