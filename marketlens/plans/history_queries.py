"""Registered queries: requests through the router, for the items the tables hold."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from marketlens import tables as t
from marketlens.functions.ids import uuid_to_long
from marketlens.operators import listings
from marketlens.operators import rollup as r
from marketlens.plans import history as h
from marketlens.plans.listing_queries import SIGNED, UID
from marketlens.plans.price_queries import DAILY, HOURLY, SALES, live_sales
from marketlens.plans.registry import query

NOW = datetime(2001, 6, 1)
LIVE_NOW = datetime(2024, 1, 20, 12)
PART_ID = "(SELECT min(p_partkey) FROM part WHERE p_name = 'hot rod')"


def market(spark, d) -> h.MarketTables:
    """Items are tagged by their name; the smallest key of a name is the item."""
    sales = t.sales(spark, d)
    return h.MarketTables(
        sales=sales,
        items=t.items(spark, d).select("id", F.upper("name").alias("tag")),
        prices=r.price_rollup(sales.filter("highest_bid > 1"), ["item_id"]),
        players=t.players(spark, d),
    )


@query("price_history_daily", f"SELECT * FROM ({DAILY}) WHERE item_id = {PART_ID} AND date > '1996-01-01' AND date <= '2001-06-01'")
def price_history_daily(spark, d):
    return h.price_history(h.PriceRequest("HOT ROD", datetime(1996, 1, 1)), market(spark, d), NOW)


@query(
    "price_history_filtered",
    f"""SELECT item_id, date_trunc('day', "end")::TIMESTAMP AS date, avg(unit) AS avg, max(unit) AS max, min(unit) AS min, sum(cnt)::BIGINT AS volume FROM {SALES}
WHERE item_id = {PART_ID} AND "end" > '1996-01-01' AND "end" < '2001-06-01' AND highest_bid > 1 AND tier = 'A' AND reforge = 'F' GROUP BY ALL""",
)
def price_history_filtered(spark, d):
    return h.price_history(h.PriceRequest("HOT ROD", datetime(1996, 1, 1), tier="A", reforge="F"), market(spark, d), NOW)


@query(
    "price_history_hourly",
    "SELECT * FROM (" + HOURLY.replace("WHERE", """WHERE "end" > '2024-01-19 09:50:24' AND "end" < '2024-01-20 12:00:00' AND """) + ") WHERE item_id = 7",
)
def price_history_hourly(spark, d):
    tables = h.MarketTables(sales=live_sales(spark, d), items=t.items(spark, d).select("id", F.col("id").cast("string").alias("tag")))
    found = h.price_history(h.PriceRequest("7", datetime(2024, 1, 19, 12)), tables, LIVE_NOW)
    return found.fillna({"max": -1, "min": -1})


@query(
    "recent_sales_of_item",
    f"""SELECT "end", highest_bid AS price, seller_id, c_name AS player_name FROM (SELECT * FROM {SALES} WHERE item_id = {PART_ID} AND highest_bid > 1
AND "end" > '1996-01-01' AND "end" < '2001-06-01' ORDER BY "end" DESC, auction_id LIMIT 12) LEFT JOIN customer ON c_custkey = seller_id""",
)
def recent_sales_of_item(spark, d):
    found = h.recent(h.PriceRequest("HOT ROD", datetime(1996, 1, 1)), market(spark, d), NOW)
    return found.select("end", F.col("highest_bid").alias("price"), "seller_id", "player_name")


@query("price_history_live", f"SELECT * FROM ({HOURLY}) WHERE item_id = 7")
def price_history_live(spark, d):
    """A request from within the last hour is answered from the live points."""
    points = r.price_rollup(live_sales(spark, d).filter("highest_bid > 1"), ["item_id"], "hour")
    tables = h.MarketTables(sales=live_sales(spark, d), live=points, items=t.items(spark, d).select("id", F.col("id").cast("string").alias("tag")))
    found = h.price_history(h.PriceRequest("7", datetime(2024, 1, 20, 11, 30)), tables, LIVE_NOW)
    return found.fillna({"max": -1, "min": -1})


@query(
    "custom_filter",
    "SELECT * FROM ("
    + HOURLY.replace("'hour'", "'day'").replace("WHERE", """WHERE "end" > '2024-01-05 00:00:00' AND "end" < '2024-01-20 12:00:00' AND highest_bid >= 5000 AND """)
    + ") WHERE item_id = 7",
)
def custom_filter(spark, d):
    """A filter registered by name, in a request inside the days that filtered requests may reach back."""
    listings.register_filter("CostsAtLeast", lambda value: F.col("highest_bid") >= int(value))
    tables = h.MarketTables(sales=live_sales(spark, d), items=t.items(spark, d).select("id", F.col("id").cast("string").alias("tag")))
    found = h.price_history(h.PriceRequest("7", datetime(2024, 1, 5), filters={"CostsAtLeast": "5000"}), tables, LIVE_NOW)
    return found.fillna({"max": -1, "min": -1})


@query("auction_by_id", f"SELECT o_orderkey AS auction_id, {SIGNED} AS uid FROM {UID} WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def auction_by_id(spark, d):
    """An auction by its uuid: that of order 0, the first."""
    auctions = t.headers(spark, d).select("auction_id", uuid_to_long(F.md5(F.col("auction_id").cast("string"))).alias("uid"))
    return h.auction_by_id(auctions, "cfcd208495d565ef66e7dff9f98764da")
