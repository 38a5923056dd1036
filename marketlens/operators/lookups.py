"""Key look-ups and enrichment joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.ids import uuid_to_long
from marketlens.functions.names import clean_item_name
from marketlens.operators.skew import hot_join


def tag_lookup(items: DataFrame) -> DataFrame:
    """(tag, found): the id of each tag, where a rune takes its unique form if there is one."""
    ids = items.filter("tag is not null").groupBy("tag").agg(F.min("id").alias("__id"))
    runes = ids.filter(F.col("tag").startswith("UNIQUE_RUNE_")).select(
        F.substr("tag", F.lit(len("UNIQUE_") + 1)).alias("tag"), F.col("__id").alias("__unique")
    )
    return ids.join(runes, ["tag"], "full_outer").select("tag", F.coalesce("__unique", "__id").alias("found"))


def id_of_tag(items: DataFrame, tag: str) -> DataFrame:
    """(found): the id of one tag as ``tag_lookup`` has it; only items of this tag are read."""
    unique = f"UNIQUE_{tag}"
    wanted = [tag, unique] if tag.startswith("RUNE_") else [tag]
    own, better = (F.min(F.when(F.col("tag") == name, F.col("id"))) for name in (tag, unique))
    return items.filter(F.col("tag").isin(wanted)).agg(F.coalesce(better, own).alias("found"))


def tag_to_id(rows: DataFrame, items: DataFrame, tag: str = "tag", out: str = "item_id", hot_rows: int = 1_000_000) -> DataFrame:
    """Add the item id of a tag; unknown tags give 0."""
    lookup = tag_lookup(items).select(F.col("tag").alias(tag), F.col("found").alias("__found"))
    return hot_join(rows, lookup, [tag], "left", hot_rows=hot_rows).withColumn(out, F.coalesce("__found", F.lit(0))).drop("__found")


def skin_to_id(rows: DataFrame, items: DataFrame, skin: str = "skin", out: str = "skin_id", hot_rows: int = 1_000_000) -> DataFrame:
    """Add the item id of a pet skin: PET_SKIN_ + name first, then the name itself.

    The distinct skins are resolved once; one join brings the result to the rows.
    """
    lookup = tag_lookup(items)
    prefixed = lookup.select(F.col("tag").alias("__tag"), F.col("found").alias("__a"))
    plain = lookup.select(F.col("tag").alias(skin), F.col("found").alias("__b"))
    skins = rows.select(skin).distinct().withColumn("__tag", F.concat(F.lit("PET_SKIN_"), F.col(skin)))
    resolved = skins.join(prefixed, ["__tag"], "left").join(plain, [skin], "left")
    resolved = resolved.select(skin, F.coalesce("__a", "__b").alias(out))
    return hot_join(rows, resolved, [skin], "left", hot_rows=hot_rows).withColumn(out, F.coalesce(out, F.lit(0)))


def name_to_item(rows: DataFrame, items: DataFrame, alt_names: DataFrame, name: str = "full_name", hot_rows: int = 1_000_000) -> DataFrame:
    """Resolve names to items: by tag, by an alternative name (as given or cleaned), else by looks.

    Adds ``found_id`` (0 if unknown) and ``found_tag``: an all-upper-case name is taken
    for a tag, anything else is "Unknown". The distinct names are resolved once; one
    join brings the result to the rows.
    """
    names = rows.select(name).filter(F.col(name).isNotNull()).distinct().withColumn("__clean", clean_item_name(F.col(name)))
    by_tag = tag_lookup(items).select(F.col("tag").alias("__clean"), F.col("found").alias("__by_tag"))
    alt = alt_names.filter("name is not null").groupBy("name").agg(F.min("item_id").alias("__alt"))
    by_raw = alt.select(F.col("name").alias(name), F.col("__alt").alias("__by_raw"))
    by_clean = alt.select(F.col("name").alias("__clean"), F.col("__alt").alias("__by_clean"))
    looked_up = names.join(by_tag, ["__clean"], "left").join(by_clean, ["__clean"], "left").join(by_raw, [name], "left")
    found = F.coalesce("__by_tag", F.least("__by_raw", "__by_clean"), F.lit(0))
    looks = F.when(F.upper(F.col(name)) == F.col(name), F.col(name)).otherwise(F.lit("Unknown"))
    tags = items.select(F.col("id").alias("found_id"), F.col("tag").alias("__tag"))
    resolved = (
        looked_up.withColumn("found_id", F.when(found > 1, found).otherwise(F.lit(0)))
        .join(tags, ["found_id"], "left")
        .select(name, "found_id", F.when(F.col("found_id") > 0, F.coalesce("__tag", looks)).otherwise(looks).alias("found_tag"))
    )
    return hot_join(rows, resolved, [name], "left", hot_rows=hot_rows)


def players_by_key(keys: DataFrame, players: DataFrame, key: str = "key", hot_rows: int = 1_000_000) -> DataFrame:
    """Find players by uuid or by name: both become rows of one look-up table, so one equi-join does."""
    lookup = players.select("id", F.explode(F.array_distinct(F.array("uuid", "name"))).alias(key))
    lookup = lookup.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("player_id"))
    return hot_join(keys, lookup, [key], "left", hot_rows=hot_rows)


def auctions_by_key(keys: DataFrame, auctions: DataFrame, key: str = "key", hot_rows: int = 1_000_000) -> DataFrame:
    """Find auctions by uuid surrogate, else by the key read as that number itself."""
    asked = keys.select(key).distinct().select(key, uuid_to_long(F.col(key)).alias("__uid"), F.col(key).try_cast("bigint").alias("__number"))
    first = auctions.select(F.col("uid").alias("__uid"), F.col("auction_id").alias("__a"))
    second = auctions.select(F.col("uid").alias("__number"), F.col("auction_id").alias("__b"))
    resolved = asked.join(first, ["__uid"], "left").join(second, ["__number"], "left")
    return hot_join(keys, resolved.select(key, F.coalesce("__a", "__b").alias("auction_id")), [key], "left", hot_rows=hot_rows)


def player_history(players: DataFrame, auctions: DataFrame, bids: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """Every auction a player sold and every bid a player made, one row each."""
    sold = auctions.select(
        F.col("seller_id").alias("id"), F.lit("auction").alias("kind"), "auction_id", F.col("starting_bid").alias("amount"), F.col("end").alias("ts")
    )
    made = bids.select(F.col("bidder_id").alias("id"), F.lit("bid").alias("kind"), "auction_id", "amount", "ts")
    return hot_join(sold.unionByName(made), players.select("id", "name"), ["id"], "inner", hot_rows=hot_rows)


def bazaar_flag(rows: DataFrame, products: DataFrame, key: str, hot_rows: int = 1_000_000) -> DataFrame:
    """Add whether the item is traded as a commodity."""
    known = products.select(key).distinct().withColumn("is_bazaar", F.lit(True))
    return hot_join(rows, known, [key], "left", hot_rows=hot_rows).withColumn("is_bazaar", F.coalesce("is_bazaar", F.lit(False)))


def children_lists(enchants: DataFrame) -> DataFrame:
    """The enchantments of an auction as one sorted array of (type, level, copies).

    Rows are counted per (auction, type, level) first, so the array is bounded by
    the number of types however often a row is repeated.
    """
    counted = enchants.groupBy("auction_id", "type", "level").agg(F.count(F.lit(1)).alias("copies"))
    return counted.groupBy("auction_id").agg(F.sort_array(F.collect_list(F.struct("type", "level", "copies"))).alias("enchantments"))


def with_children(auctions: DataFrame, children: list[DataFrame]) -> DataFrame:
    """Auctions with their child arrays; every child is one row per auction, so nothing multiplies."""
    for child in children:
        auctions = auctions.join(child, ["auction_id"], "left")
    return auctions
