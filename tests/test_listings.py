"""Listings, enchantments, look-ups, duplicates and search on hand-made rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from marketlens.operators import dedup, enchants, events, listings, lookups, search

NOW = "2024-01-10 00:00:00"


def day(n: int, hour: int = 0) -> datetime:
    return datetime(2024, 1, n, hour)


def test_active_listings(spark, rows_of):
    headers = [(1, True, 50, day(20)), (2, True, 60, day(20)), (3, False, 70, day(20)), (4, False, 80, day(9)), (5, False, 90, day(20))]
    headers = spark.createDataFrame(headers, "auction_id int, bin boolean, starting_bid long, end timestamp")
    bids = spark.createDataFrame([(1, 55), (3, 75), (3, 77)], "auction_id int, amount long")
    got = listings.active_listings(headers, bids, NOW)
    assert rows_of(got, "auction_id", "price", "n_bids") == [(2, 60, 0), (3, 77, 2), (5, 90, 0)]


def test_top_lists_are_cut_before_the_shuffle(spark):
    rows = spark.range(100).select(F.col("id").alias("auction_id"), (F.col("id") % 3).alias("k"), F.lit(1).alias("price"), F.lit(day(1)).alias("end"))
    plan = listings.listing_board(rows, ["k"], "LOWEST_PRICE", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")


ROWS = [(1, "a", 1), (1, "b", 2), (2, "a", 1), (3, "a", 1), (3, "a", 1), (4, "b", 2), (5, "a", 1), (5, "b", 2), (5, "c", 3)]


def enchant_frames(spark):
    auctions = spark.createDataFrame([(i,) for i in range(7)], "auction_id int")
    return auctions, spark.createDataFrame([(a, t, l, 9) for a, t, l in ROWS], "auction_id int, type string, level int, item_id int")


def test_enchantment_filters(spark, rows_of):
    auctions, rows = enchant_frames(spark)
    assert rows_of(enchants.has_enchant(auctions, rows, "b", 2)) == [(1,), (4,), (5,)]
    # a row that is there twice counts as two; the third wish is not looked at
    assert rows_of(enchants.has_two_enchants(auctions, rows, [("a", 1), ("b", 2), ("z", 1)])) == [(1,), (3,), (5,)]
    assert rows_of(enchants.has_two_enchants(auctions, rows, [("a", 1), ("b", 2)], strict=True)) == [(1,), (5,)]
    assert rows_of(enchants.without_enchants(auctions, rows)) == [(0,), (2,), (4,), (6,)]
    assert rows_of(enchants.without_enchants(auctions, rows, strict=True)) == [(0,), (6,)]
    assert rows_of(enchants.has_enchant(auctions, rows, "b", 2, item_id=8)) == []


def test_best_enchant_takes_level_rank_then_type_rank(spark, rows_of):
    _, rows = enchant_frames(spark)
    by_level = spark.createDataFrame([("b", 2, 1)], "type string, level int, worth_rank int")
    by_type = spark.createDataFrame([("a", 1)], "type string, worth_rank int")
    got = enchants.best_enchant(rows.select("auction_id", "type", "level"), by_level, by_type)
    assert rows_of(got) == [(1, "b", 2), (2, "a", 1), (3, "a", 1), (4, "b", 2), (5, "b", 2)]


def test_relevant_and_irrelevant(spark, rows_of):
    rows = spark.createDataFrame(
        [("ultimate_x", 1, "T"), ("smite", 6, "T"), ("smite", 7, "T"), ("nothing", 9, "T"), ("ender_slayer", 6, "VORPAL_KATANA"), ("ender_slayer", 6, "T"), ("ender_slayer", 6, None), ("efficiency", 6, "STONK_PICKAXE")],
        "type string, level int, tag string",
    )
    assert rows_of(enchants.relevant_enchants(rows), "type", "level") == [("smite", 7), ("ultimate_x", 1)]
    kept = rows_of(enchants.drop_irrelevant(rows), "type", "tag")
    assert ("ender_slayer", "VORPAL_KATANA") in kept and ("ender_slayer", None) in kept
    assert ("ender_slayer", "T") not in kept and ("efficiency", "STONK_PICKAXE") not in kept


def test_unique_rune_and_unknown_tag(spark, rows_of):
    items = spark.createDataFrame([(1, "RUNE_A"), (2, "UNIQUE_RUNE_A"), (3, "RUNE_B"), (4, "UNIQUE_RUNE_C")], "id int, tag string")
    rows = spark.createDataFrame([("RUNE_A",), ("RUNE_B",), ("RUNE_C",), ("X",)], "tag string")
    assert rows_of(lookups.tag_to_id(rows, items)) == [("RUNE_A", 2), ("RUNE_B", 3), ("RUNE_C", 4), ("X", 0)]


def test_child_list_of_a_hot_auction_stays_small(spark):
    rows = spark.createDataFrame([(1, "a", 1)] * 500 + [(1, "b", 2)], "auction_id int, type string, level int")
    got = lookups.children_lists(rows).first().enchantments
    assert [tuple(e) for e in got] == [("a", 1, 500), ("b", 2, 1)]


def test_bids_of_a_day_of_any_year(spark, rows_of):
    rows = [(1, "x", 5, datetime(2023, 3, 1, 9)), (2, "x", 5, datetime(2022, 3, 1, 10)), (3, "x", 6, datetime(2023, 3, 1, 9)), (4, "x", 5, datetime(2023, 3, 2, 9))]
    bids = spark.createDataFrame(rows, "id int, bidder string, amount int, ts timestamp")
    assert rows_of(dedup.dedup_bids(bids, ["ts", "id"]), "id") == [(2,), (3,), (4,)]


def test_search_order_and_exact_hits(spark, rows_of):
    players = spark.createDataFrame([("u1", "anna", 5), ("u2", "ann", 0), ("u3", "annabel", 100), ("u4", "bob", 1)], "uuid string, name string, hit_count int")
    terms = spark.createDataFrame([("ann",), ("an n",), ("",), ("BO",)], "term string")
    got = search.player_search(terms, players, 2)
    assert rows_of(got, "term", "position", "name") == [("BO", 1, "bob"), ("ann", 1, "ann"), ("ann", 2, "annabel")]


def test_item_of_the_terms_own_name_is_never_cut(spark, rows_of):
    """It is found by its tag only, behind items that are better but for the exact name."""
    items = [(k, f"Aspect {k}", f"ASPECT_OF_X{k}", 100) for k in range(7)] + [(9, "Aspect Of X", "ASPECT_OF_X", 0)]
    items = spark.createDataFrame(items, "id int, name string, tag string, hit_count int")
    names = spark.createDataFrame([], "item_id int, name string")
    terms = spark.createDataFrame([("Aspect Of X",)], "term string")
    got = search.item_search(terms, items, names).filter("position <= 2")
    assert rows_of(got, "position", "item_id") == [(1, 9), (2, 0)]


def test_uuid_search(spark, rows_of):
    uuid = "00123456789a4bcd" + "0" * 16
    players = spark.createDataFrame([(uuid, "someone", 0)], "uuid string, name string, hit_count int")
    terms = spark.createDataFrame([(uuid.upper(),), (str(0x7123456789ABBCDE),)], "term string")
    assert rows_of(search.player_search(terms, players), "name") == [("someone",)]
    numbered = spark.createDataFrame([("7123456789ab4bcde" + "0" * 15, "numbered", 0)], "uuid string, name string, hit_count int")
    assert rows_of(search.player_search(terms, numbered), "name") == [("numbered",)]


def test_fuzzy_search_stops_at_the_first_pattern_with_a_hit(spark, rows_of):
    items = spark.createDataFrame([(1, "Sword", 3), (2, "Swrod", 1), (3, "Board", 2)], "id int, name string, hit_count int")
    names = items.select(F.col("id").alias("item_id"), "name")
    assert rows_of(search.fuzzy_item_search("Swodr", items, names), "name") == [("Sword",)]
    assert rows_of(search.fuzzy_item_search("Sw", items, names)) == []


def test_active_set_and_funnel(spark, rows_of):
    rows = [("a", "new", 1), ("a", "sold", 2), ("b", "new", 1), ("b", "bid", 3), ("c", "ended", 5), ("c", "new", 6)]
    feed = spark.createDataFrame(rows, "uuid string, kind string, seq int")
    assert rows_of(events.active_set(feed, "uuid", ["seq"]), "uuid") == [("b",), ("c",)]
    flips = spark.createDataFrame([(1, 1), (1, 3), (1, 16)], "auction_uid int, type int")
    first = events.flip_funnel(flips).first()
    assert (first.flip_receive, first.flip_click, first.auction_sold, first.downvote) == (2, 1, 1, 0)
