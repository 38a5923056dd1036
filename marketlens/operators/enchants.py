"""Enchantment filters, rankings and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators.skew import hot_join
from marketlens.rules import enchants as rules
from marketlens.rules.tables import rule_table


def wanted(type_: str, level: int) -> Column:
    return (F.col("type") == type_) & (F.col("level") == level)


def of_item(enchants: DataFrame, item_id: int | None) -> DataFrame:
    return enchants if item_id is None else enchants.filter(F.col("item_id") == item_id)


def has_enchant(auctions: DataFrame, enchants: DataFrame, type_: str, level: int, item_id: int | None = None) -> DataFrame:
    ids = of_item(enchants, item_id).filter(wanted(type_, level)).select("auction_id").distinct()
    return auctions.join(ids, ["auction_id"], "left_semi")


def has_two_enchants(
    auctions: DataFrame,
    enchants: DataFrame,
    requested: list[tuple[str, int]],
    item_id: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """Auctions with more than one row among the first two requested enchantments.

    Further requested ones are ignored. ``strict`` asks for all of them, each at least once.
    """
    if strict:
        hits = [F.max(wanted(*one).cast("int")) for one in requested]
        having = sum(hits[1:], hits[0]) == len(requested)
    else:
        requested = requested[:2]
        having = F.count(F.lit(1)) > 1
    any_of = wanted(*requested[0])
    for one in requested[1:]:
        any_of = any_of | wanted(*one)
    grouped = of_item(enchants, item_id).filter(any_of).groupBy("auction_id").agg(having.alias("hit"))
    return auctions.join(grouped.filter("hit").select("auction_id"), ["auction_id"], "left_semi")


def without_enchants(auctions: DataFrame, enchants: DataFrame, item_id: int | None = None, strict: bool = False) -> DataFrame:
    """Auctions that do not have more than one enchantment row; ``strict`` allows none at all."""
    least = 1 if strict else 2
    many = of_item(enchants, item_id).groupBy("auction_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return auctions.join(many.select("auction_id"), ["auction_id"], "left_anti")


def newest_with_enchant(auctions: DataFrame, enchants: DataFrame, type_: str, level: int, order: list[Column], n: int) -> DataFrame:
    """Auctions behind the newest ``n`` matching enchantment rows; the rows are limited before the join."""
    ids = enchants.filter(wanted(type_, level)).orderBy(*order).limit(n).select("auction_id").distinct()
    return auctions.join(ids, ["auction_id"], "left_semi")


def worth_ranking(enchants: DataFrame, auctions: DataFrame, keys: list[str], hot_rows: int = 1_000_000) -> DataFrame:
    """Enchantments ordered by the mean price of the auctions that carry them.

    The result has one row per type and level, so numbering it in one task is cheap.
    """
    paid = auctions.filter("highest_bid > 0").select("auction_id", "highest_bid")
    mean = (
        hot_join(enchants.select("auction_id", *keys, "end"), paid, ["auction_id"], "inner", hot_rows=hot_rows)
        .groupBy(*keys)
        .agg(F.avg("highest_bid").alias("mean_bid"), F.count(F.lit(1)).alias("n"))
    )
    order = Window.orderBy(F.desc("mean_bid"), *keys)
    return mean.withColumn("worth_rank", F.row_number().over(order))


def best_enchant(enchants: DataFrame, level_ranks: DataFrame, type_ranks: DataFrame) -> DataFrame:
    """The best enchantment of each auction: by (type, level) rank, then by type rank alone, else left out."""
    by_level = level_ranks.select("type", "level", F.col("worth_rank").alias("__level_rank"))
    by_type = type_ranks.select("type", F.col("worth_rank").alias("__type_rank"))
    # one row per distinct type (and level): a few thousand at most
    ranked = enchants.join(F.broadcast(by_level), ["type", "level"], "left").join(F.broadcast(by_type), ["type"], "left")
    rank = F.when(F.col("__level_rank").isNotNull(), F.struct(F.lit(0).alias("tier"), F.col("__level_rank").alias("rank"))).when(
        F.col("__type_rank").isNotNull(), F.struct(F.lit(1).alias("tier"), F.col("__type_rank").alias("rank"))
    )
    place = F.struct(rank["tier"].alias("tier"), rank["rank"].alias("rank"), F.col("level").alias("level"))
    return (
        ranked.filter(rank.isNotNull())
        .groupBy("auction_id")
        .agg(F.min_by(F.struct("type", "level"), place).alias("best"))
        .select("auction_id", "best.type", "best.level")
    )


def relevant_enchants(enchants: DataFrame) -> DataFrame:
    """Rows at or above the relevant level of their type; an unlisted ultimate one always counts."""
    levels = rule_table(enchants.sparkSession, list(rules.RELEVANT_LEVELS.items()), "type string, min_level int")
    joined = enchants.join(levels, ["type"], "left")
    least = F.coalesce("min_level", F.when(F.lower("type").startswith("ultimate_"), F.lit(1)))
    return joined.filter(F.col("level") >= least).drop("min_level")


def very_valuable_enchants(enchants: DataFrame) -> DataFrame:
    levels = rule_table(enchants.sparkSession, list(rules.VERY_VALUABLE_LEVELS.items()), "type string, min_level int")
    return enchants.join(levels, ["type"], "inner").filter("level >= min_level").drop("min_level")


def above_table_level(enchants: DataFrame) -> DataFrame:
    """Rows above what an enchanting table gives; types a table does not know are left out."""
    levels = rule_table(enchants.sparkSession, list(rules.TABLE_LEVELS.items()), "type string, table_level int")
    return enchants.join(levels, ["type"], "inner").filter("level > table_level")


def drop_irrelevant(enchants: DataFrame) -> DataFrame:
    """Leave out the (type, level) that do not matter on the row's item tag; a null tag keeps all."""
    spark = enchants.sparkSession
    rows = [(type_, level, tag) for type_, level, tags in rules.IRRELEVANT_ON for tag in tags]
    listed = rule_table(spark, rows, "type string, level int, tag string")
    type_, level, tags = rules.RELEVANT_ONLY_ON
    only = (F.col("type") == type_) & (F.col("level") == level) & ~F.col("tag").isin(tags)
    return enchants.join(listed, ["type", "level", "tag"], "left_anti").filter(~F.coalesce(only, F.lit(False)))
