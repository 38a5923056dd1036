"""Flattening and encoding of attributes."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from marketlens.operators import attributes as a


def flat(spark, document: dict) -> dict[str, str]:
    items = spark.createDataFrame([(1, json.dumps(document))], "auction_id int, attributes string")
    rows = a.flat_rows(items).collect()
    assert len({r.key for r in rows}) == len(rows)
    return {r.key: r.text for r in rows}


@pytest.mark.parametrize(
    "document, expected",
    [
        ({"id": "X", "modifier": "a", "timestamp": 1, "originTag": "q", "hot_potato_count": 3}, {"hpc": "3"}),
        ({"uuid": "12345678-1234-1234-1234-123456789abc"}, {"uuid": "12345678-1234-1234-1234-123456789abc", "uid": "123456789abc"}),
        ({"petInfo": '{"type":"BEE","uuid":"u","hideInfo":false,"extraData":{"kills":4}}'}, {"type": "BEE", "hideInfo": "False", "kills": "4"}),
        ({"petInfo": {"type": "BEE", "exp": 1.5}, "kills": 1}, {"type": "BEE", "exp": "1.5", "kills": "1"}),
        ({"gems": {"JADE_0": {"quality": "FINE", "uuid": "u"}, "RUBY_1": "ROUGH", "JADE_25": {"quality": "X"}, "unlocked_slots": ["A_0", "B_1"]}},
         {"JADE_0": "FINE", "JADE_0.uuid": "u", "RUBY_1": "ROUGH", "quality": "X", "unlocked_slots": "A_0,B_1"}),
        ({"runes": {"ZAP": 2}}, {"RUNE_ZAP": "2"}),
        ({"ability_scroll": ["W", "I"], "mixins": ["b", "a"]}, {"ability_scroll": "I W", "mixins": "a b"}),
        ({"hook": {"part": "P", "uuid": "u"}, "line": {"part": "Q"}}, {"hook.part": "P", "hook.uuid": "u", "part": "Q"}),
        ({"engine": {"id": "E", "uuid": "u", "speed": 3}, "fuel_tank": "text"}, {"engine.id": "E", "engine.uuid": "u", "speed": "3", "fuel_tank": "text"}),
        ({"level": 1, "effects": [{"effect": "a", "level": 2}, {"effect": "b"}]}, {"effect": "b", "level": "2"}),
        ({"a": {"b": {"c": 1}}, "c": 2}, {"c": "1"}),
        ({"a": {"b": {"c": {"d": {"e": 1, "f": {"g": {"h": [1, 2]}}}}}, "i": {"j": "{{"}}}, {"e": "1", "h": "1,2", "j": "{{"}),
        ({"runes": {"ZAP": {"level": {"n": 3}}}}, {"n": "3"}),
        ({"necromancer_souls": [{"m": "Z"}, {"m": "Z"}, {"m": "S"}]}, {"Z": "2", "S": "1"}),
        ({"gone": None, "yes": True}, {"yes": "True"}),
    ],
)
def test_flatten(spark, document, expected):
    assert flat(spark, document) == expected


def test_routing_and_encoding(spark, rows_of):
    document = {
        "exp": 2.5, "uuid": "f" * 32, "tier": "EPIC", "active": True, "heldItem": "A", "skin": "S", "petInfo": {"type": "BEE"}, "color": "1:2:3",
        "cake_owner": "ዞx", "other": "free", "noMove": "1",
    }
    items = spark.createDataFrame([(1, json.dumps(document))], "auction_id int, attributes string")
    rows = a.routed(a.flat_rows(items))
    got = {r.key: (r.route, r.number, r.entry) for r in rows.collect()}
    assert got["exp"] == ("number", 2, None)  # half to even
    assert got["uid"] == ("id", 0xFFFFFFFF, None)
    assert got["active"] == ("json", None, "true")
    assert got["heldItem"][0] == "item" and got["skin"][0] == "skin"
    assert got["color"] == ("color", (1 << 24) + (2 << 16) + (3 << 8), None)
    assert got["cake_owner"] == ("text", None, "Hx")
    assert got["other"] == ("json", None, '"free"')
    assert "tier" not in got and "type" not in got and "noMove" not in got

    keys = a.key_dictionary(spark.createDataFrame([(40, "exp")], "id bigint, slug string"), rows)
    values = a.value_dictionary(spark.createDataFrame([], "id bigint, key string, value string"), rows)
    catalogue = spark.createDataFrame([(11, "A"), (12, "PET_SKIN_S"), (13, "S")], "id int, tag string")
    encoded = a.encoded(rows, keys, values, catalogue, hot_rows=1)
    named = encoded.join(keys.withColumnRenamed("id", "key_id"), ["key_id"])
    got = {r.slug: r.value for r in named.collect()}
    assert got["exp"] == 2 and got["heldItem"] == 11 and got["skin"] == 12
    assert rows_of(keys.filter("slug = 'exp'"), "id") == [(40,)]
    assert encoded.count() == rows.count()


def test_enchant_levels_wrap_to_a_byte_and_attributes_are_skipped(spark, rows_of):
    document = {"enchantments": {"Duplex": 2, "mana_pool": 1, "wise": 260, "growth": 5, "what": 1}}
    items = spark.createDataFrame([(1, json.dumps(document))], "auction_id int, attributes string")
    types = spark.createDataFrame([("growth",), ("ultimate_wise",), ("ultimate_reiterate",)], "name string")
    got = rows_of(a.enchant_rows(items, types), "type", "level")
    assert got == [("growth", 5), ("ultimate_reiterate", 2), ("ultimate_wise", 4), ("unknown", 1)]


@pytest.mark.parametrize(
    "document, tag",
    [
        ({"id": "PET", "petInfo": '{"type":"BEE"}'}, "PET_BEE"),
        ({"id": "PET", "petInfo": {"type": "BEE"}}, "PET_BEE"),
        ({"id": "POTION", "potion": "speed"}, "POTION_speed"),
        ({"id": "POTION"}, "POTION"),
        ({"id": "UNIQUE_RUNE", "runes": {"ZAP": 1}}, "UNIQUE_RUNE_ZAP"),
        ({"id": "ABICASE", "model": "M"}, "ABICASE_M"),
        ({"id": "X" * 50}, "X" * 40),
    ],
)
def test_item_tag(spark, document, tag):
    got = spark.createDataFrame([(json.dumps(document),)], "j string").select(a.item_tag(a.parsed(F.col("j"))).alias("t"))
    assert got.first().t == tag


@pytest.mark.parametrize("name, tag", [("§9Growth IV", "ENCHANTMENT_GROWTH_4"), ("BUY Wise 5-7", "ENCHANTMENT_ULTIMATE_WISE_5"), ("§9Stacking Enchants", None), ("Nothing here", None)])
def test_book_tag(spark, name, tag):
    types = spark.createDataFrame([("growth",), ("ultimate_wise",)], "name string")
    assert a.book_tags(spark.createDataFrame([(name,)], "name string"), types).first().book_tag == tag
