"""Column logic on the cases that go wrong easily."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketlens.functions import ids, names, numbers


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "name, clean",
    [
        ("Hyper Sword ✪✪✪", "Sword"),
        ("[Lvl 100] Bee", "Bee"),
        ("Strong Dragon Helmet", "Strong Dragon Helmet"),
        ("Strong Helmet", "Helmet"),
        ("Sharp Bow", "Bow"),
        ("Sharp", "Sharp"),
        ("◆ Fire Rune", "Fire Rune"),
        ("⚚ Sharp Bow ✦", "Sharp Bow"),
        (None, None),
    ],
)
def test_clean_item_name(spark, name, clean):
    assert value(spark, names.clean_item_name(F.lit(name).cast("string"))) == clean


@pytest.mark.parametrize("tag, name", [("BOOK_OF_THE_X", "Book of the X"), ("AB", "AB"), ("WOLF", "Wolf")])
def test_tag_to_name(spark, tag, name):
    assert value(spark, names.tag_to_name(F.lit(tag))) == name


@pytest.mark.parametrize("text, number", [("1,5k", 1500.0), ("2B", 2e9), ("12%", 12.0), (" ", 0.0), ("abc", None), ("1.2.3", None), ("3m", 3e6)])
def test_normalize_amount(spark, text, number):
    assert value(spark, numbers.normalize_amount(F.lit(text))) == number


@pytest.mark.parametrize(
    "name, tenths",
    [("§67M coins", 70_000_000), ("1,000 coins", 10_000), ("2B coins", 20_000_000_000), ("1.5k coins", 15_000), ("M coins", 0), ("7M Coins", 0), ("3m coins", 0)],
)
def test_coin_names(spark, name, tenths):
    assert value(spark, numbers.coins_of_name(F.lit(name))) == tenths


@pytest.mark.parametrize("text, coins", [("§7Total Coins Offered:\n§618M\n§8(18,000,000)", 18_000_000), ("Total Coins Offered:\n18M", 18_000_000), ("nothing", None)])
def test_stated_coins(spark, text, coins):
    assert value(spark, numbers.stated_coins(F.lit(text))) == coins


@pytest.mark.parametrize("text, number", [("II", 2), ("IV", 4), ("XIX", 19), ("XC", 90), ("7", 7), ("abc", None)])
def test_roman(spark, text, number):
    assert value(spark, numbers.roman_to_int(F.lit(text))) == number


@pytest.mark.parametrize(
    "text, moment",
    [
        ("6/3/20 5:07 PM", "2020-06-03 17:07:00"),
        ("6/3/20 5:07", "2020-06-03 05:07:00"),
        ("6/3/20 15:07", None),
        ("1591160820000", "2020-06-03 05:07:00"),
        ("6/3/20 12:07 AM", "2020-06-03 00:07:00"),
    ],
)
def test_market_time(spark, text, moment):
    got = value(spark, ids.market_time(F.lit(text)))
    assert (str(got) if got else None) == moment


def test_uuid_surrogate_is_signed_and_never_zero(spark):
    assert value(spark, ids.uuid_to_long(F.lit("f" * 32))) == -1
    assert value(spark, ids.uuid_to_long(F.lit("short"))) == -1
    assert value(spark, ids.uuid_to_long(F.lit("0" * 32))) == 1
    assert value(spark, ids.uuid_to_long(F.lit("00000000-0000-4001-8000-000000000000"))) == 0x0018


def test_colors(spark):
    assert value(spark, ids.rgb_text(F.lit(0x0102FF))) == "1:2:255"
    assert value(spark, ids.rgb_hex(F.lit("255,0:16"))) == "FF0010"
    assert value(spark, ids.rgb_packed(F.lit("255:0:0"))) == -16777216


@pytest.mark.parametrize("email, masked", [("someone@example.com", "som****@******e.com"), ("ab@cd.ef", "ab@cd.ef")])
def test_mask_email(spark, email, masked):
    assert value(spark, names.mask_email(F.lit(email))) == masked


@pytest.mark.parametrize("key, shown", [("syphon", "Drain"), ("ultimate_jerry", "Ultimate Jerry"), ("ultimate_bank", "Bank"), ("growth", "Growth")])
def test_enchant_display_name(spark, key, shown):
    assert value(spark, names.enchant_display_name(F.lit(key))) == shown


@pytest.mark.parametrize("tag, pet", [("PET_BEE", True), ("PET_SKIN_BEE", False), ("PET_ITEM_X", False), ("PET_CAKE", False), (None, False)])
def test_is_pet(spark, tag, pet):
    assert value(spark, ids.is_pet(F.lit(tag).cast("string"))) is pet
