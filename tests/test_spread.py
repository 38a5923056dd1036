"""Costly row work gets tasks of a bounded number of rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from marketlens.operators import attributes as a
from marketlens.operators import series as s
from marketlens.operators import valuation as v
from marketlens.plans.stream_queries import stream_encoded_attributes
from marketlens.session import shared_folder, spread


def test_tasks_grow_with_the_rows(spark):
    one = spark.range(0, 1000, 1, 1)
    assert spread(one, rows=50).rdd.getNumPartitions() == 20
    assert spread(one, rows=5000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 1000, 1, 30), rows=50).rdd.getNumPartitions() == 30
    assert sorted(x.id for x in spread(one, rows=50).collect()) == list(range(1000))


def test_attribute_text_is_not_carried_to_its_rows(spark):
    items = spark.createDataFrame([(1, '{"petInfo":{"type":"BEE"},"skin":"BLUE","a":1}')], "auction_id long, attributes string")
    rows = a.routed(a.flat_rows(items)).select("key", "route")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("get_json_object") > plan.index("Generate explode")  # read below the explode, once an item
    assert "get_json_object" not in plan[: plan.index("Generate explode")]
    assert ("skin", "skin") in [tuple(r) for r in rows.collect()]


def test_numbers_pass_the_lookup_by(spark, rows_of):
    routed = spark.createDataFrame(
        [(1, "hpc", "number", 7, None, None, None), (2, "note", "json", None, '"x"', None, None), (3, "skin", "skin", None, None, None, "BLUE"), (4, "odd", "number", None, None, None, None)],
        "auction_id long, key string, route string, number long, entry string, item_tag string, skin string",
    )
    keys = spark.createDataFrame([(1, "hpc"), (2, "note"), (3, "skin")], "id long, slug string")
    values = spark.createDataFrame([(9, "note", '"x"')], "id long, key string, value string")
    items = spark.createDataFrame([(5, "PET_SKIN_BLUE")], "id long, tag string")
    found = a.encoded(routed, keys, values, items)
    assert rows_of(found) == [(1, 1, 7), (2, 2, 9), (3, 3, 5), (4, 0, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "__number" not in plan  # only rows with a text meet the table of texts


def test_stream_batches_go_to_all_cores(spark):
    before = set(Path(shared_folder(spark)).glob("batch-attributes-*"))
    stream_encoded_attributes(spark, "/root/testdata/sf0.001").count()
    (new,) = set(Path(shared_folder(spark)).glob("batch-attributes-*")) - before
    assert len(list(new.glob("part-*"))) >= spark.sparkContext.defaultParallelism


def test_sized_prices_hold_a_bounded_number_of_rows(spark, rows_of):
    sales = spark.createDataFrame([(i % 7, 100 + i, 1, f"2024-01-{i % 28 + 1:02d}") for i in range(60)], "item_id long, highest_bid long, count int, end string").withColumn("end", F.to_timestamp("end"))
    asked = sales.select("item_id", (s.day_number(F.col("end")) + 1).alias("day"))
    plain = s.price_at(asked, s.daily_prices(sales, "item_id"), "item_id")
    sized = s.price_at(asked, s.daily_prices(sales, "item_id", 5), "item_id", hot_rows=3, parts=5)
    assert rows_of(sized) == rows_of(plain)
    plan = sized._jdf.queryExecution().optimizedPlan().toString()
    # sales, asked days, the line of both, the rows twice (to count and to join) and the prices they meet
    assert plan.count("RepartitionByExpression") >= 6


def test_sized_star_costs_join_in_as_many_tasks(spark, rows_of):
    costs = [[("WITHER", 10, None, "ESSENCE")], [("WITHER", 20, None, "ESSENCE")]]
    catalogue = spark.createDataFrame([("A", costs)], "tag string, upgrade_costs array<array<struct<essence_type:string,amount:int,item_id:string,type:string>>>")
    asked = spark.createDataFrame([(i, "A", 0, i % 3) for i in range(40)], "id long, tag string, base_tier int, tier int")
    sized = v.star_costs(asked, catalogue, hot_rows=5, parts=6)
    assert rows_of(sized) == rows_of(v.star_costs(asked, catalogue))
    assert sized._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2


def test_only_star_and_slot_attributes_meet_the_catalogue(spark, rows_of):
    properties = spark.createDataFrame(
        [(1, "A", "upgrade_level", "1", "", {}), (2, "A", "hpc", "3", "", {}), (3, None, "upgrade_level", "1", "", {}), (4, "A", None, "1", "", {})],
        "id long, tag string, key string, value string, base string, flat map<string,string>",
    )
    costs = "upgrade_costs array<array<struct<essence_type:string,amount:int,item_id:string,type:string>>>"
    slots = "gemstone_slots array<struct<slot_type:string,costs:array<struct<type:string,coins:int,item_id:string,amount:int>>>>"
    catalogue = spark.createDataFrame([("A", [[("WITHER", 10, None, "ESSENCE")]], [])], f"tag string, {costs}, {slots}")
    found = v.property_items(properties, catalogue, ["id"])
    assert rows_of(found, "id", "item", "n") == [(1, "ESSENCE_WITHER", 10), (2, "HOT_POTATO_BOOK", 3)]
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()


def test_few_prices_go_to_every_task(spark, rows_of):
    rows = spark.createDataFrame([(1, "A", 5), (2, "A", 6), (3, None, 5), (4, "B", 5), (5, "A", 5)], "id long, item string, day int")
    dated = spark.createDataFrame([("A", 5, 40), ("B", 5, 7), (None, 5, 9)], "item string, day int, price long")
    salted = s.with_price(rows, dated, "item", hot_rows=2)
    for few in (2, 3):  # one too few for the table, and just enough
        found = s.with_price(rows, dated, "item", hot_rows=2, few=few)
        assert found.columns == salted.columns and rows_of(found) == rows_of(salted)
        assert ("__salt" in found._jdf.queryExecution().optimizedPlan().toString()) == (few == 2)
    assert rows_of(found, "id", "price") == [(1, 40), (2, 1), (3, 1), (4, 7), (5, 40)]


def test_parts_listed_one_by_one_are_worth_the_same(spark, rows_of):
    properties = spark.createDataFrame(
        [(1, "A", "hpc", "12", "", {}, 5), (1, "A", "hpc", "12", "", {}, 5), (2, "A", "skin_color", "x", "", {}, 5), (3, "A", "unlocked_slots", "", "", {}, 5), (4, None, None, None, "", {}, 5)],
        "id long, tag string, key string, value string, base string, flat map<string,string>, day int",
    )
    costs = "upgrade_costs array<array<struct<essence_type:string,amount:int,item_id:string,type:string>>>"
    slots = "gemstone_slots array<struct<slot_type:string,costs:array<struct<type:string,coins:int,item_id:string,amount:int>>>>"
    catalogue = spark.createDataFrame([("A", None, [])], f"tag string, {costs}, {slots}")
    dated = spark.createDataFrame([("FUMING_POTATO_BOOK", 5, 40)], "item string, day int, price long")
    rows = v.property_rows(properties, catalogue, ["id", "day"], whole=True)
    assert rows_of(rows.select("id").distinct()) == [(1,), (2,), (3,), (4,)]
    parts, nothing = rows.filter("n is not null"), rows.filter("n is null")
    assert rows_of(nothing, "id") == [(2,), (3,), (4,)]
    none = [spark.createDataFrame([], schema) for schema in (
        "id long, type string, level int, worth long", "id long, reforge string, stone string, apply_cost long, day int", "id long, item string, day int")]
    before = v.value_columns(properties, v.property_items(properties, catalogue, ["id", "day"]), *none, dated, ["id"])
    now = v.value_columns(nothing, parts, *none, dated, ["id"], few=10)
    assert now.schema == before.schema and rows_of(now) == rows_of(before)
    assert (1, "hpc:12", 80) in rows_of(now) and (2, "skin_color:x", 0) in rows_of(now)
