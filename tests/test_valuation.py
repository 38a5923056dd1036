"""Valuation rules on hand-made rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from marketlens.operators import valuation as v
from marketlens.sources import catalogue as c

PROPERTY = "row int, tag string, key string, value string, base string, flat map<string,string>"
F5, H = "FUMING_POTATO_BOOK", "HOT_POTATO_BOOK"


@pytest.mark.parametrize(
    "key, value, base, tag, expected",
    [
        ("hpc", "15", "", "T", {F5: 1}),
        ("hpc", "12", "3", "T", {F5: 2, H: 7}),
        ("hpc", "12", "9", "T", {F5: 2}),  # a difference of one gives nothing
        ("hpc", "15", "12", "T", {F5: 3}),
        ("hpc", "11", "10", "T", {F5: 1}),
        ("hpc", "7", "", "T", {H: 7}),
        ("hpc", "7", "6", "T", None),
        ("hotpc", "1", "", "T", {F5: 4}),
        ("hotpc", "1", "5", "T", {F5: 5, H: 10}),
        ("hotpc", "1", "0.1", "T", {F5: 4}),
        ("upgrade_level", "8", "6", "T", {"THIRD_MASTER_STAR": 1, "SECOND_MASTER_STAR": 1}),
        ("upgrade_level", "8", "6", "HOT_CRIMSON_BOOTS", None),
        ("stats_book", "500", "", "T", {"BOOK_OF_STATS": 1}),
        ("stats_book", "500", "2", "T", None),
        ("heldItem", '"X"', "", "T", {"X": 1}),
        ("RUNE_A", "3", "", "T", {"RUNE_A_3": 1, "RUNE_A": 12, "UNIQUE_RUNE_A": 1}),
        ("RUNE_SPELLBOUND", "3", "", "T", {"RUNE_SPELLBOUND_3": 1, "RUNE_SPELLBOUND": 1, "UNIQUE_RUNE_SPELLBOUND": 1}),
        ("ability_scroll", "A B,A", "B", "T", {"A": 1}),
        ("talisman_enrichment", "speed", "", "T", {"TALISMAN_ENRICHMENT_SPEED": 1}),
        ("talisman_enrichment", "speed", "x", "T", {"TALISMAN_ENRICHMENT_SWAPPER": 1}),
        ("something", "1", "", "T", None),
    ],
)
def test_ingredients(spark, key, value, base, tag, expected):
    got = v.property_ingredients(spark.createDataFrame([(1, tag, key, value, base, {})], PROPERTY)).first().ingredients
    if expected is None:
        assert got is None
        return
    counted: dict[str, int] = {}
    for part in got:
        counted[part.item] = counted.get(part.item, 0) + part.n
    assert counted == expected


DOCUMENT = {
    "success": True,
    "items": [
        {
            "id": "BLADE", "tier": "rare", "color": "1,2,3", "category": "SWORD",
            "upgrade_costs": [[{"type": "ESSENCE", "essence_type": "ICE", "amount": "10"}], [{"type": "ITEM", "item_id": "GEM", "amount": 4}, {"type": "ODD", "amount": 1}]],
            "gemstone_slots": [{"slot_type": "JADE", "costs": [{"type": "COINS", "coins": 500}]}, {"slot_type": "JADE"}, {"slot_type": "RUBY", "costs": [{"type": "ITEM", "item_id": "R", "amount": "2"}]}],
            "museum_data": {"armor_set_donation_xp": {"SNOW_SUIT": 5}},
        },
        {"id": "STARRED_BLADE", "gemstone_slots": [{"slot_type": "AMBER", "costs": [{"type": "COINS", "coins": 7}]}]},
        {"id": None, "tier": "EPIC"},
        {"id": "PET_ITEM_CLAW", "tier": "LEGENDARY"},
    ],
}


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("catalogue") / "items.json"
    path.write_text(json.dumps(DOCUMENT))
    return c.read_catalogue(spark, str(path))


def test_catalogue_file(catalogue, rows_of):
    assert rows_of(catalogue, "tag") == [("BLADE",), ("PET_ITEM_CLAW",), ("STARRED_BLADE",)]
    assert catalogue.filter("tag = 'BLADE'").first().upgrade_costs[0][0].amount == 10


@pytest.mark.parametrize(
    "base, tier, expected",
    [
        (0, 1, {"ESSENCE_ICE": 10}),
        (1, 2, {"GEM": 4}),
        (0, 7, {"ESSENCE_ICE": 10, "GEM": 4, "FIRST_MASTER_STAR": 1, "SECOND_MASTER_STAR": 1}),
        (6, 10, {"SECOND_MASTER_STAR": 1, "THIRD_MASTER_STAR": 1, "FOURTH_MASTER_STAR": 1, "FIFTH_MASTER_STAR": 1}),
        (5, 3, {}),
    ],
)
def test_star_costs(spark, catalogue, base, tier, expected):
    asked = spark.createDataFrame([("BLADE", base, tier), ("NONE", base, tier)], "tag string, base_tier int, tier int")
    assert {r.item: r.n for r in v.star_costs(asked, catalogue, hot_rows=1).collect()} == expected


def test_slot_costs(spark, catalogue, rows_of):
    asked = spark.createDataFrame([("BLADE", ["RUBY_0"], ["JADE_0", "JADE_1", "JADE_2", "RUBY_0", "AMBER_0"])], "tag string, existing array<string>, result array<string>")
    # the second jade is free; the third jade is on neither form, but there is a starred form
    assert rows_of(v.slot_costs(asked, catalogue), "slot", "item", "n") == [("AMBER_0", v.COIN, 7), ("JADE_0", v.COIN, 500)]
    lone = spark.createDataFrame([("STARRED_BLADE", [], ["JADE_0"])], "tag string, existing array<string>, result array<string>")
    assert rows_of(v.slot_costs(lone, catalogue), "slot", "item") == [("JADE_0", "unavailable")]


def test_unlockable_slots_and_sets(catalogue, rows_of):
    assert rows_of(v.unlockable_slots(catalogue)) == [("BLADE", "JADE_0"), ("BLADE", "RUBY_0"), ("STARRED_BLADE", "AMBER_0")]
    assert ("SNOW_SUIT", "SNOW_CLOAK") in rows_of(v.armor_sets(catalogue)) and ("SNOW_SUIT", "BLADE") in rows_of(v.armor_sets(catalogue))


def test_pet_item_removal(spark, catalogue, rows_of):
    rows = spark.createDataFrame([("CLAW",), ("BLADE",), ("WHAT",), ("STARRED_BLADE",)], "tag string")
    assert rows_of(v.pet_item_removal(rows, catalogue)) == [("BLADE", 100_000), ("CLAW", 500_000), ("STARRED_BLADE", 50_000), ("WHAT", 50_000)]


def test_gems_and_property_dispatch(spark, catalogue, rows_of):
    rows = [
        (1, "BLADE", "COMBAT_0", "FINE", "", {"COMBAT_0_gem": "JASPER"}),
        (2, "BLADE", "JADE_0", "PERFECT", "", {}),
        (3, "BLADE", "upgrade_level", "2", "", {}),
        (4, "BLADE", "unlocked_slots", "JADE_0,RUBY_0", "", {}),
        (5, "BLADE", "FLAWED_0", "FLAWED", "", {}),
        (6, "BLADE", "ability_scroll", "A B A", "", {}),
    ]
    got = v.property_items(spark.createDataFrame(rows, PROPERTY), catalogue, ["row"], hot_rows=1)
    assert rows_of(got, "row", "item", "n") == [
        (1, "FINE_JASPER_GEM", 1), (2, "PERFECT_JADE_GEM", 1), (3, "ESSENCE_ICE", 10), (3, "GEM", 4), (4, "R", 2), (4, v.COIN, 500), (6, "A", 1), (6, "B", 1),
    ]


def test_reforge_costs(spark, rows_of):
    rows = spark.createDataFrame([("Gilded", "LEGENDARY"), ("Gilded", "MYTHIC"), ("fruitful", "RARE"), ("None", "RARE"), ("toil", "EPIC"), ("toil", "RARE")], "reforge string, tier string")
    stones = spark.createDataFrame([("toil", "EPIC", 5, "STONE")], "reforge string, tier string, cost int, item string")
    assert rows_of(v.reforge_costs(rows, stones)) == [
        ("Gilded", "LEGENDARY", "MIDAS_JEWEL", 5_000_000), ("Gilded", "MYTHIC", "MIDAS_JEWEL", 10_000_000), ("None", "RARE", "", 0),
        ("fruitful", "RARE", "ONYX", 1250), ("toil", "EPIC", "STONE", 5), ("toil", "RARE", "STONE", 0),
    ]


def test_reforge_takes_one_stone_whole(spark, rows_of):
    """Of several stones the last counts, with its own tiers only; a tier named twice costs the more."""
    rows = spark.createDataFrame([("toil", t) for t in ("EPIC", "RARE", "MYTHIC")], "reforge string, tier string")
    stones = spark.createDataFrame(
        [("toil", "EPIC", 5, "A"), ("toil", "RARE", 6, "A"), ("toil", "RARE", 7, "B"), ("toil", "RARE", 9, "B"), ("other", "MYTHIC", 1, "C")], "reforge string, tier string, cost int, item string"
    )
    assert rows_of(v.reforge_costs(rows, stones), "tier", "stone", "apply_cost") == [("EPIC", "B", 0), ("MYTHIC", "B", 0), ("RARE", "B", 9)]


@pytest.mark.parametrize(
    "type_, level, tag, flat, worth",
    [
        ("growth", 5, "T", None, 100),
        ("growth", 6, "T", None, 10 * 2**5),
        ("growth", 3, "T", None, 40),  # the market price is below level 1's
        ("growth", 9, "T", None, 100 * 2**4),
        ("efficiency", 8, "T", None, 7 * 3),
        ("scavenger", 6, "T", None, 1_000_000),
        ("venomous", 7, "T", None, 7_000_000),
        ("ender_slayer", 7, "T", None, 51_000_000),
        ("cultivating", 4, "T", None, 1000 + int(0.13 * 100_000_000 * 4 / 10)),
        ("cultivating", 4, "FUNGI_CUTTER", {"farmed_cultivating": "100"}, 1030),
        ("cultivating", 9, "T", {"other": "1"}, 1000),
        ("ultimate_duplex", 2, "T", None, 77),
        ("nothing", 2, "T", None, -1),
        ("pricey", 2, "T", None, -1),
    ],
)
def test_enchant_value(spark, type_, level, tag, flat, worth):
    prices = {
        "ENCHANTMENT_GROWTH_1": 10, "ENCHANTMENT_GROWTH_3": 9, "ENCHANTMENT_GROWTH_5": 100, "SIL_EX": 7, "ENCHANTMENT_CULTIVATING_1": 1000,
        "ENCHANTMENT_CULTIVATING_5": 5, "ENCHANTMENT_ULTIMATE_REITERATE_2": 77, "ENCHANTMENT_PRICEY_2": 600_000_000,
    }
    table = spark.createDataFrame([(k, 1, p) for k, p in prices.items()], "tag string, day int, price long")
    rows = spark.createDataFrame([(type_, level, tag, 1, flat)], "type string, level int, tag string, day int, flat map<string,string>")
    assert v.enchant_values(rows, table, hot_rows=1).first().worth == worth


@pytest.mark.parametrize(
    "tag, code, color, category, expected",
    [
        ("GREAT_SPOOK_HAT", "070008", None, None, "ORIGINAL"),
        ("GREAT_SPOOK_HAT", "123456", "18:52:86", None, "EXOTIC"),
        ("LEATHER_CAP", "123456", None, None, "ORIGINAL"),
        ("REAPER_BOOTS", "ff0000", None, "BOOTS", "ORIGINAL"),
        ("HAT", "123456", "18,52,86", "HELMET", "ORIGINAL"),
        ("HAT", "FF99FF", None, "HELMET", "OG_FAIRY"),
        ("HAT", "FF99FF", None, None, "FAIRY"),
        ("A_BOOTS", "660033", None, "HELMET", "OG_FAIRY"),
        ("HAT", "660033", None, "HELMET", "FAIRY"),
        ("HAT", "a06540", None, None, "UNDYED"),
        ("HAT", "1F0030", None, None, "CRYSTAL"),
        ("SHARK_SCALE_HELMET", "FFDC51", None, None, "GLITCHED"),
        ("POWER_WITHER_CHESTPLATE", "45413C", None, None, "EXOTIC"),
        ("FAIRY_HAT", "000000", None, None, "SPOOK"),
        ("HAT", "123456", None, None, "EXOTIC"),
    ],
)
def test_color_class(spark, tag, code, color, category, expected):
    columns = [F.lit(x).cast("string") for x in (tag, code, color, category)]
    assert spark.range(1).select(v.color_class(*columns).alias("x")).first().x == expected


def test_reforge_stone_file(spark, tmp_path, rows_of):
    path = tmp_path / "stones.json"
    path.write_text(json.dumps({
        "A": {"reforgeName": "Fang-tastic Chocolate Chip", "internalName": "?", "reforgeCosts": {"VERY SPECIAL": 3, "none": 1}},
        "B": {"reforgeName": "x", "internalName": "deep-fried", "reforgeCosts": {"rare": 4}},
        "C": {"reforgeName": "x", "internalName": "y", "reforgeCosts": {"RARE": 5}},
    }))
    assert rows_of(c.read_reforge_stones(spark, str(path))) == [("deep_fried", "RARE", 4, "B")]


def test_value_columns_of_plain_attributes(spark, rows_of):
    """An attribute without ingredients has a column of 0, also under a null key; one with ingredients keeps its worth."""
    properties = spark.createDataFrame([(1, "hpc", "3"), (1, "skin", "X"), (None, "skin", "X")], "auction_id int, key string, value string")
    parts = spark.createDataFrame([(1, "hpc", "3", "BOOK", 3, 5)], "auction_id int, key string, value string, item string, n long, day int")
    dated = spark.createDataFrame([("BOOK", 5, 40)], "item string, day int, price long")
    no_enchants = spark.createDataFrame([], "auction_id int, type string, level int, worth long")
    no_reforges = spark.createDataFrame([], "auction_id int, reforge string, stone string, apply_cost long, day int")
    no_ingredients = spark.createDataFrame([], "auction_id int, item string, day int")
    found = v.value_columns(properties, parts, no_enchants, no_reforges, no_ingredients, dated, ["auction_id"], hot_rows=1)
    assert rows_of(found) == [(1, "hpc:3", 120), (1, "skin:X", 0), (None, "skin:X", 0)]


def test_value_columns_query(spark):
    """Every attribute has its column, reforges cost the default tier, enchantments the day's smoothed price."""
    from collections import defaultdict

    from marketlens import tables as t
    from marketlens.plans import valuation_queries as q

    d = "/root/testdata/sf0.001"
    found = defaultdict(list)  # an order may have a line number twice
    for r in q.value_columns(spark, d).collect():
        found[r.auction_id, r.line, r["column"]].append(r.worth)
    attributes = t.properties(spark, d).collect()
    assert all((r.auction_id, r.line, f"{r.key}:{r.value}") in found for r in attributes)
    gilded = [w for (_, _, c), worths in found.items() if c == "Gilded" for w in worths]
    at_legendary = v.reforge_costs(spark.createDataFrame([("Gilded", "LEGENDARY")], "reforge string, tier string")).first().apply_cost
    assert gilded and min(gilded) > at_legendary // 2 and {w - at_legendary for w in gilded} == {1}
    sums, books = defaultdict(list), t.enchantments(spark, d).selectExpr("*", "unix_date(to_date(`end`)) day").collect()
    for r in books:
        sums[r.type, r.level, r.day].append(r.highest_bid)
    daily = {k: sum(x) // len(x) for k, x in sums.items()}

    def price(type_, level, day):
        around = sorted(daily[k] for e in range(-2, 3) if (k := (type_, level, day + e)) in daily)
        return around[len(around) // 2]

    checked = 0
    for r in books:
        if (r.type, 1, r.day) not in daily:
            assert price(r.type, r.level, r.day) in found[r.auction_id, r.line, f"!ench{r.type}:{r.level}"]
            checked += 1
    assert checked > 100
