"""Which table a request is answered from."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from marketlens.operators.listings import NAMED_FILTERS, register_filter
from marketlens.plans import history as h

NOW = datetime(2024, 2, 1, 12)


@pytest.fixture(scope="module")
def tables(spark):
    sales = [
        (1, 7, 10, 100, 1, NOW - timedelta(days=20, hours=h_), "RARE", "Sharp", True) for h_ in (1, 2)
    ] + [(2, 7, 10, 300, 2, NOW - timedelta(hours=2), "EPIC", "None", False), (3, 8, 11, 900, 1, NOW - timedelta(hours=3), "EPIC", "None", True)]
    columns = "auction_id int, item_id int, seller_id int, highest_bid long, count int, end timestamp, tier string, reforge string, bin boolean"
    point = "item_id int, date timestamp, avg double, max double, min double, volume long"
    headers = [(1, 7, 10, True, 50, NOW + timedelta(hours=1), "RARE"), (2, 7, 10, False, 40, NOW + timedelta(hours=2), "RARE"), (3, 7, 10, True, 30, NOW + timedelta(hours=3), "EPIC"), (4, 7, 10, True, 20, NOW + timedelta(hours=3), "EPIC")]
    return h.MarketTables(
        sales=spark.createDataFrame(sales, columns),
        items=spark.createDataFrame([(7, "BLADE"), (8, "BOW")], "id int, tag string"),
        prices=spark.createDataFrame([(7, NOW - timedelta(days=d), 1.0 * d, 2.0, 1.0, 3) for d in (5, 10, 90)], point),
        live=spark.createDataFrame([(7, NOW, 5.0, 5.0, 5.0, 1)], point),
        enchantments=spark.createDataFrame([(1, 7, "growth", 5), (2, 7, "growth", 5), (2, 7, "smite", 7)], "auction_id int, item_id int, type string, level int"),
        players=spark.createDataFrame([(10, "ann")], "id int, name string"),
        headers=spark.createDataFrame(headers, "auction_id int, item_id int, seller_id int, bin boolean, starting_bid long, end timestamp, tier string"),
        bids=spark.createDataFrame([(2, 70), (4, 25)], "auction_id int, amount long"),
    )


def ask(tables, start, **kwargs):
    return h.price_history(h.PriceRequest("BLADE", start, **kwargs), tables, NOW).collect()


def test_daily_table(tables):
    assert sorted(r.avg for r in ask(tables, NOW - timedelta(days=10, hours=1))) == [5.0, 10.0]
    assert [r.avg for r in ask(tables, NOW - timedelta(days=10))] == [5.0]  # the start is left out


def test_hours_of_the_last_day(tables):
    (row,) = ask(tables, NOW - timedelta(days=1))
    assert (row.avg, row.volume) == (150.0, 2) and row.date == NOW - timedelta(hours=2)


def test_live_hour(tables):
    assert [r.avg for r in ask(tables, NOW - timedelta(minutes=30))] == [5.0]
    with pytest.raises(LookupError):
        h.price_history(h.PriceRequest("BOW", NOW), tables, NOW)


def test_filters_go_to_the_raw_sales(tables):
    start = NOW - timedelta(days=30)
    assert [r.volume for r in ask(tables, start, tier="RARE")] == [2]
    assert [r.volume for r in ask(tables, start, reforge="None")] == [2]
    assert [r.max for r in ask(tables, start, enchantments=(("growth", 5), ("smite", 7)))] == [150]
    assert sorted(r.max for r in ask(tables, start, enchantments=(("growth", 5),))) == [100, 150]
    assert [r.max for r in ask(tables, start, enchantments=(("None", 0),))] == [100]
    assert [r.max for r in ask(tables, start, filters={"Bin": "true", "Rarity": "RARE"})] == [100]


def test_filtered_requests_reach_back_a_month(tables):
    with pytest.raises(ValueError):
        ask(tables, NOW - timedelta(days=36), filters={"Bin": "true"})
    assert h.is_detailed(NOW - timedelta(days=1), NOW) and not h.is_detailed(NOW - timedelta(days=2), NOW)


def test_spikes_are_cut_for_commodities_only(spark, tables):
    points = [(7, NOW - timedelta(days=1 + d), 1.0, mx, 1.0, 1) for d, mx in enumerate([2.0, 999.0, 1000.0])]
    prices = spark.createDataFrame(points, "item_id int, date timestamp, avg double, max double, min double, volume long")
    start = NOW - timedelta(days=30)
    plain = h.MarketTables(sales=tables.sales, items=tables.items, prices=prices)
    commodity = h.MarketTables(sales=tables.sales, items=tables.items, prices=prices, bazaar_ids=spark.createDataFrame([(7,)], "item_id int"))
    assert len(ask(plain, start)) == 3 and len(ask(commodity, start)) == 2


def test_lists(tables):
    recent = h.recent(h.PriceRequest("BLADE", NOW - timedelta(days=30)), tables, NOW).collect()
    assert [r.highest_bid for r in sorted(recent, key=lambda r: r.position)] == [300, 100, 100] and recent[0].player_name == "ann"
    board = h.active(h.PriceRequest("BLADE", NOW, order="ENDING_SOON"), tables, NOW).collect()
    assert [r.auction_id for r in sorted(board, key=lambda r: r.position)] == [1, 2, 3]
    assert {r.auction_id for r in h.lowest_bin("BLADE", tables, NOW, tier="EPIC").collect()} == {3}
    assert {r.auction_id for r in h.lowest_bin("BLADE", tables, NOW, tier="UNCOMMON").collect()} == {1, 3}


def test_filters_can_be_added(tables):
    from pyspark.sql import functions as F

    register_filter("MinBid", lambda value: F.col("highest_bid") >= int(value))
    try:
        assert [r.max for r in ask(tables, NOW - timedelta(days=30), filters={"MinBid": "200"})] == [150]
    finally:
        del NAMED_FILTERS["MinBid"]


def test_auction_by_id(spark):
    auctions = spark.createDataFrame([(1, 0x1111111111111111), (2, 55)], "auction_id int, uid long")
    assert [r.auction_id for r in h.auction_by_id(auctions, "1" * 32).collect()] == [1]
    assert [r.auction_id for r in h.auction_by_id(auctions, "55", lambda df: df.select("auction_id")).collect()] == [2]
