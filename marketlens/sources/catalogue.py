"""Item catalogue and reforge stone documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.rules.items import REFORGES, TIERS
from marketlens.rules.tables import mapped

# Numbers may come as JSON numbers or as numeric text, so both are read as text first.
_COST = "struct<essence_type:string,amount:string,item_id:string,type:string>"
_SLOT = "struct<slot_type:string,costs:array<struct<type:string,coins:string,item_id:string,amount:string>>>"
ITEM_SCHEMA = (
    "id string, name string, tier string, color string, category string, dungeon_item boolean,"
    f"upgrade_costs array<array<{_COST}>>, gemstone_slots array<{_SLOT}>,"
    "museum_data struct<armor_set_donation_xp:map<string,string>>"
)
ROOT_SCHEMA = f"success boolean, lastUpdated bigint, items array<struct<{ITEM_SCHEMA.replace(' string', ':string').replace(' boolean', ':boolean').replace(' array', ':array').replace(' struct', ':struct')}>>"
STONE_SCHEMA = "map<string,struct<reforgeName:string,internalName:string,reforgeCosts:map<string,int>>>"


def _int(text: Column) -> Column:
    return text.try_cast("int")


def typed_items(items: DataFrame) -> DataFrame:
    """Catalogue rows with numbers as numbers; rows without id are left out."""
    def cost(c: Column) -> Column:
        return F.struct(c["essence_type"].alias("essence_type"), _int(c["amount"]).alias("amount"), c["item_id"].alias("item_id"), c["type"].alias("type"))

    def slot_cost(c: Column) -> Column:
        return F.struct(c["type"].alias("type"), _int(c["coins"]).alias("coins"), c["item_id"].alias("item_id"), _int(c["amount"]).alias("amount"))

    def slot(s: Column) -> Column:
        return F.struct(s["slot_type"].alias("slot_type"), F.transform(s["costs"], slot_cost).alias("costs"))

    return items.filter("id is not null").select(
        F.col("id").alias("tag"),
        "tier",
        "color",
        "category",
        F.transform("upgrade_costs", lambda level: F.transform(level, cost)).alias("upgrade_costs"),
        F.transform("gemstone_slots", slot).alias("gemstone_slots"),
        F.transform_values("museum_data.armor_set_donation_xp", lambda k, v: _int(v)).alias("set_xp"),
    )


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue file: one JSON document with an array of items."""
    root = spark.read.schema(ROOT_SCHEMA).json(path, multiLine=True)
    return typed_items(root.select(F.explode("items").alias("i")).select("i.*"))


def catalogue_from_json(rows: DataFrame, json: str) -> DataFrame:
    """Catalogue from a column with one item document per row."""
    return typed_items(rows.select(F.from_json(json, ITEM_SCHEMA).alias("i")).select("i.*"))


def reforge_stones(documents: DataFrame, json: str) -> DataFrame:
    """(reforge, tier, cost, item) rows of reforge stone documents; unknown reforges and tiers are left out."""
    by_name = {name.lower(): name for name in REFORGES}
    stones = documents.select(F.explode(F.from_json(json, STONE_SCHEMA)).alias("item", "s"))
    internal = mapped(by_name, F.lower(F.replace("s.internalName", F.lit("-"), F.lit("_"))))
    spoken = mapped(by_name, F.lower(F.replace(F.replace("s.reforgeName", F.lit("-"), F.lit("_")), F.lit("'"), F.lit(""))))
    costs = stones.select("item", F.coalesce(internal, spoken).alias("reforge"), F.explode("s.reforgeCosts").alias("t", "cost"))
    tier = F.upper(F.replace("t", F.lit(" "), F.lit("_")))
    return costs.select("reforge", tier.alias("tier"), "cost", "item").filter(F.col("reforge").isNotNull() & tier.isin(list(TIERS)))


def read_reforge_stones(spark: SparkSession, path: str) -> DataFrame:
    return reforge_stones(spark.read.text(path, wholetext=True), "value")
