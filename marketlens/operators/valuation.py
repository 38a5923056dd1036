"""What an item is worth from the dated market prices of its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.ids import rgb_hex
from marketlens.functions.numbers import coins_of_name, stated_coins
from marketlens.operators.series import centered_median, daily_prices, dated_prices, with_price
from marketlens.operators.skew import hot_join
from marketlens.rules import colors
from marketlens.rules import items as item_rules
from marketlens.rules import properties as rules
from marketlens.rules.enchants import GROWTH
from marketlens.rules.tables import mapped, rule_table

PART = "array<struct<item:string,n:bigint>>"
SLOT_PART = "array<struct<slot:string,item:string,n:bigint>>"
# Names and default prices the valuation falls back to.
COIN = "SKYBLOCK_COIN"
MAX_MARKET_PRICE = 500_000_000
FALLBACK_PRICES = {
    "SIL_EX": 8_000_000,
    "GOLDEN_BOUNTY": 1_000_000,
    "FATEFUL_STINGER": 5_000_000,
    "ENCHANTMENT_VENOMOUS_6": 2_000_000,
    "ENDER_SLAYER_6": 1_000_000,
    "ENDSTONE_IDOL": 50_000_000,
}
FUNGI_FACTOR = 0.3


def inventory_coins(items: DataFrame, key: str, order: str) -> DataFrame:
    """Coins in an inventory: the total its first summary states, else the sum of the parsed names."""
    stated = stated_coins(F.col("description"))
    summary = F.col("description").contains("Total Coins Offered:")
    first = F.when(summary, F.struct(F.col(order).alias("o"), stated.alias("s")))
    return (
        items.select(key, coins_of_name(F.col("name")).alias("__coins"), first.alias("__stated"))
        .groupBy(key)
        .agg(F.min("__stated").alias("__first"), F.sum("__coins").alias("__sum"))
        .select(key, F.coalesce("__first.s", "__sum").alias("coins"))
    )


# Ingredients of attributes ---------------------------------------------------


def _rule_chains(spark: SparkSession) -> DataFrame:
    """Per (key, value) the levels below it in order, what each needs, and the level after the last one."""
    rows = []
    for (key, value), _ in rules.EXACT_RULES.items():
        levels, needs, level = [], [], value
        while (key, level) in rules.EXACT_RULES:
            needed, below = rules.EXACT_RULES[key, level]
            levels.append(level)
            needs.append([(item, needed.count(item)) for item in dict.fromkeys(needed)])
            level = below
        rows.append((key, value, levels, needs, level))
    return rule_table(spark, rows, f"key string, value string, __levels array<string>, __needs array<{PART}>, __below string")


def _parts(*pairs: tuple[Column | str, Column | int]) -> Column:
    made = [
        F.struct((F.lit(i) if isinstance(i, str) else i).alias("item"), (F.lit(n) if isinstance(n, int) else n).cast("bigint").alias("n"))
        for i, n in pairs
    ]
    return F.array(*made).cast(PART)


def property_ingredients(properties: DataFrame) -> DataFrame:
    """Add ``ingredients``, the items an attribute stands for, null where no rule applies.

    ``properties`` has ``tag``, ``key``, ``value`` and ``base`` (the value that is
    there already, empty for none). A rule with levels takes the levels below it,
    down to the base; without a base it stands for its own level only.
    """
    tag, key, value, base = (F.col(c) for c in ("tag", "key", "value", "base"))
    ruled = properties.join(_rule_chains(properties.sparkSession), ["key", "value"], "left")
    no_base = base == ""
    number, base_number = value.try_cast("int"), F.coalesce(base.try_cast("int"), F.lit(0))

    family = F.element_at(F.reverse(F.split(F.concat(F.lit("none_"), tag), "_")), 2)
    other_stars = (key == "upgrade_level") & family.isin(rules.STAR_FAMILIES)

    runes = F.when(key.isin(rules.SINGLE_RUNES), F.lit(1)).otherwise(F.floor(F.pow(F.lit(3.5), number - 1)))
    rune = _parts((F.concat_ws("_", key, value), 1), (key, runes), (F.concat(F.lit("UNIQUE_"), key), 1))

    scrolls = F.array_except(F.split(value, "[ ,]"), F.split(base, " "))
    scroll = F.transform(scrolls, lambda s: F.struct(s.alias("item"), F.lit(1).cast("bigint").alias("n")))

    enrichment = (
        F.when(value == "yes", F.lit("TALISMAN_ENRICHMENT_FEROCITY"))
        .when(no_base, F.concat(F.lit("TALISMAN_ENRICHMENT_"), F.upper(value)))
        .otherwise(F.lit("TALISMAN_ENRICHMENT_SWAPPER"))
    )

    wild_item = mapped({k: item for k, (item, _) in rules.WILDCARD_RULES.items()}, key)
    wild_counts = key.isin([k for k, (_, counts) in rules.WILDCARD_RULES.items() if counts])

    size = F.size("__levels")
    reached = F.array_position(F.slice("__levels", 2, F.greatest(size - 1, F.lit(0))), base)
    steps = F.when(no_base, F.lit(1)).when(reached > 0, reached.cast("int")).otherwise(size)
    rest = F.col("__below").try_cast("int") - base_number
    walked_out = ~no_base & (reached == 0) & (F.col("__below") != base) & wild_counts & (rest > 1)
    chain = F.concat(
        F.flatten(F.slice("__needs", 1, steps)),
        F.when(walked_out, _parts((wild_item, rest))).otherwise(F.array().cast(PART)),
    )

    plain_count = F.when(wild_counts & (number > 1), number).otherwise(F.lit(1))
    ingredients = (
        F.when(key.isin(rules.ITEM_KEYS) & (value != ""), _parts((F.btrim(value, F.lit('"')), 1)))
        .when(other_stars, F.lit(None).cast(PART))
        .when(key.startswith("RUNE_"), rune)
        .when(key == "ability_scroll", scroll)
        .when(key == "talisman_enrichment", _parts((enrichment, 1)))
        .when(F.col("__levels").isNotNull(), chain)
        .when(wild_item.isNotNull() & no_base, _parts((wild_item, plain_count)))
        .when(wild_counts & (number - base_number > 1), _parts((wild_item, number - base_number)))
    )
    return ruled.withColumn("ingredients", ingredients).drop("__levels", "__needs", "__below")


def star_levels(costs: Column) -> Column:
    """Catalogue star costs as items per level. Done per catalogue row, not per asked row."""
    def named(c: Column) -> Column:
        essence = F.concat(F.lit("ESSENCE_"), c["essence_type"])
        item = F.when(c["type"] == "ESSENCE", essence).otherwise(c["item_id"])
        return F.struct(item.alias("item"), c["amount"].cast("bigint").alias("n"))

    known = ["ESSENCE", "ITEM"]
    return F.transform(costs, lambda level: F.transform(F.filter(level, lambda c: c["type"].isin(known)), named))


def star_parts(levels: Column, base: Column, tier: Column) -> Column:
    """Items for raising an item from one star tier to another; master stars where the costs end."""
    bought = F.flatten(F.slice(levels, base + 1, F.greatest(tier - base, F.lit(0)))).cast(PART)
    last = max(level for level, _ in item_rules.MASTER_STARS)
    stars = [
        F.when(((tier == level) if level == last else (tier >= level)) & (base < level), F.struct(F.lit(star).alias("item"), F.lit(1).cast("bigint").alias("n")))
        for level, star in item_rules.MASTER_STARS
    ]
    none = F.array().cast(PART)
    extra = F.when(tier > F.size(levels), F.array_compact(F.array(*stars)).cast(PART)).otherwise(none)
    return F.when(levels.isNotNull(), F.concat(bought, extra)).otherwise(none)


def star_costs(asked: DataFrame, catalogue: DataFrame, hot_rows: int = 1_000_000, parts: int | None = None) -> DataFrame:
    """(…, item, n) for rows with ``tag``, ``base_tier`` and ``tier``. ``parts`` is the number of tasks where it must follow the rows."""
    levels = catalogue.select("tag", star_levels(F.col("upgrade_costs")).alias("__levels"))
    priced = hot_join(asked, levels, ["tag"], "inner", hot_rows=hot_rows, parts=parts)
    items = star_parts(F.col("__levels"), F.col("base_tier"), F.col("tier"))
    return priced.select(*asked.columns, F.explode(items).alias("p")).select(*asked.columns, "p.item", "p.n")


def new_entries(rows: DataFrame, existing: str, result: str, out: str) -> DataFrame:
    """One row per distinct entry of a list that another list does not have."""
    return rows.withColumn(out, F.explode(F.array_except(result, existing)))


def _slot_table(catalogue: DataFrame) -> DataFrame:
    """Per tag its star costs, its slots and the slots of its starred form."""
    starred = catalogue.filter(F.col("tag").startswith("STARRED_")).select(
        F.substr("tag", F.lit(len("STARRED_") + 1)).alias("tag"),
        F.col("gemstone_slots").alias("__starred"),
        F.lit(True).alias("__has_starred"),
    )
    stars = star_levels(F.col("upgrade_costs")).alias("__stars")
    own = catalogue.select("tag", stars, F.col("gemstone_slots").alias("__slots"), F.lit(True).alias("__known"))
    return own.join(starred, ["tag"], "left")


def nth_slot(slots: Column, type_: Column, index: Column) -> Column:
    """The slot of a type with that many of its type before it."""
    return F.get(F.filter(slots, lambda s: s["slot_type"] == type_), index)


def slot_parts(slots: Column, starred: Column, has_starred: Column, existing: Column, result: Column) -> Column:
    """(slot, item, n) for each new slot; one that neither the item nor its starred form has is "unavailable"."""

    def paid(slot: Column, c: Column) -> Column:
        coins = F.coalesce(c["coins"], F.lit(0)) != 0
        return F.struct(
            slot.alias("slot"),
            F.when(coins, F.lit(COIN)).otherwise(c["item_id"]).alias("item"),
            F.when(coins, c["coins"]).otherwise(c["amount"]).cast("bigint").alias("n"),
        )

    def one(slot: Column) -> Column:
        index = F.coalesce(F.right(slot, F.lit(1)).try_cast("int"), F.lit(99))
        type_ = F.left(slot, F.length(slot) - 2)
        own, other = nth_slot(slots, type_, index), nth_slot(starred, type_, index)
        nothing = F.array(F.struct(slot.alias("slot"), F.lit("unavailable").alias("item"), F.lit(0).cast("bigint").alias("n")))
        costs = F.transform(F.coalesce(own, other)["costs"], lambda c: paid(slot, c))
        return F.when(own.isNull() & has_starred.isNull(), nothing).otherwise(F.coalesce(costs, F.array().cast(SLOT_PART)))

    return F.flatten(F.transform(F.array_except(result, existing), one))


def slot_costs(asked: DataFrame, catalogue: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """What unlocking new slots costs, for rows with ``tag``, ``existing`` and ``result`` slot lists.

    Gives (…, slot, item, n) rows. Coins are an item of their own.
    """
    known = hot_join(asked, _slot_table(catalogue), ["tag"], "left", hot_rows=hot_rows).filter("__known")
    parts = slot_parts(F.col("__slots"), F.col("__starred"), F.col("__has_starred"), F.col("existing"), F.col("result"))
    return known.select(*asked.columns, F.explode(parts).alias("p")).select(*asked.columns, "p.*")


def unlockable_slots(catalogue: DataFrame) -> DataFrame:
    """(tag, slot): TYPE_0, TYPE_1, … for the slots that cost something."""
    types = F.transform(F.filter("gemstone_slots", lambda s: s["costs"].isNotNull()), lambda s: s["slot_type"])
    numbered = F.transform(
        types, lambda t, i: F.concat(t, F.lit("_"), F.size(F.filter(F.slice(types, 1, i), lambda o: o == t)).cast("string"))
    )
    return catalogue.select("tag", F.explode(numbered).alias("slot"))


def gem_key(slot: Column, quality: Column, flat: Column) -> Column:
    """Item of a gem: quality and type; slots that take several types name it under <slot>_gem."""
    own = F.split(slot, "_")[0]
    any_gem = F.get(F.filter(F.map_entries(flat), lambda e: e["key"].endswith("_gem")), F.lit(0))["value"]
    named = F.try_element_at(flat, F.concat(slot, F.lit("_gem")))
    type_ = F.when(own.isin(rules.GENERIC_SLOTS), named).when(own == "quality", any_gem).otherwise(own)
    return F.concat(quality, F.lit("_"), F.coalesce(type_, F.lit("")), F.lit("_GEM"))


def property_rows(properties: DataFrame, catalogue: DataFrame, keys: list[str], hot_rows: int = 1_000_000, whole: bool = False) -> DataFrame:
    """(keys, key, value, item, n): everything the attributes of an item stand for, one row per listed item.

    ``properties`` has ``keys``, ``tag``, ``key``, ``value``, ``base`` and ``flat``, the
    whole attribute map of the item. Only star and slot attributes look at the catalogue.
    ``whole`` keeps an attribute that stands for no items, as one row with a null item and ``n``.
    """
    key, value = F.col("key"), F.col("value")
    by_catalogue = F.coalesce(key.isin("upgrade_level", "unlocked_slots") & F.col("tag").isNotNull(), F.lit(False))
    lookup = _slot_table(catalogue)
    joined = hot_join(properties.filter(by_catalogue), lookup, ["tag"], "left", hot_rows=hot_rows)
    # the rest, most of them, are not shuffled
    joined = joined.unionByName(properties.filter(~by_catalogue), allowMissingColumns=True)
    tier = F.coalesce(value.try_cast("int"), F.lit(0))
    none = F.array().cast("array<string>")
    slots = slot_parts(F.col("__slots"), F.col("__starred"), F.col("__has_starred"), none, F.split(value, "[ ,]"))
    priced_slots = F.transform(
        F.filter(slots, lambda s: s["item"] != "unavailable"), lambda s: F.struct(s["item"].alias("item"), s["n"].alias("n"))
    )
    other = (
        F.when(key == "upgrade_level", star_parts(F.col("__stars"), F.lit(0), tier))
        .when(value.isin(rules.GEM_QUALITIES), _parts((gem_key(key, value, F.col("flat")), 1)))
        .when((key == "unlocked_slots") & F.col("__known"), priced_slots)
    )
    each = F.explode_outer if whole else F.explode
    rows = property_ingredients(joined).select(*keys, "key", "value", each(F.coalesce("ingredients", other)).alias("p"))
    return rows.select(*keys, "key", "value", "p.item", "p.n")


def property_items(properties: DataFrame, catalogue: DataFrame, keys: list[str], hot_rows: int = 1_000_000) -> DataFrame:
    """The rows of :func:`property_rows` with equal items counted together."""
    rows = property_rows(properties, catalogue, keys, hot_rows)
    return rows.groupBy(*keys, "key", "value", "item").agg(F.sum("n").alias("n"))


# Prices ------------------------------------------------------------------------


def _part_worth(parts: DataFrame, dated: DataFrame, of: list[str], hot_rows: int, few: int) -> DataFrame:
    """(of, worth) of each part at the price of its day."""
    worth = F.col("n") * F.when(F.col("item") == COIN, F.lit(1)).otherwise(F.col("price"))
    return with_price(parts, dated, "item", hot_rows, few=few).select(*of, worth.alias("worth"))


def component_values(parts: DataFrame, dated: DataFrame, keys: list[str], hot_rows: int = 1_000_000, few: int = 0) -> DataFrame:
    """Value of each attribute: its items (``item``, ``n``), counted together or not, at the price of the ``day``.

    ``dated`` has ``item``, ``day`` and ``price``, see :func:`dated_prices`; ``few`` as in :func:`hot_join`.
    """
    of = [*keys, "key", "value"]
    return _part_worth(parts, dated, of, hot_rows, few).groupBy(*of).agg(F.sum("worth").cast("bigint").alias("worth"))


def reforge_costs(rows: DataFrame, stones: DataFrame | None = None) -> DataFrame:
    """Add ``stone`` and ``apply_cost`` for rows with ``reforge`` and ``tier``.

    A reforge of the stone table costs what its stone (the last by ``item`` where there are
    several) says for the tier, 0 if it does not; any other has a fixed cost, doubled
    above LEGENDARY and halved below.
    """
    spark = rows.sparkSession
    flat = rule_table(spark, item_rules.REFORGE_COSTS, "reforge string, __stone string, __cost int")
    order = F.coalesce(mapped(item_rules.TIERS, F.col("tier")), F.lit(0))
    top = item_rules.TIERS["LEGENDARY"]
    fixed = F.when(order > top, F.col("__cost") * 2).when(order < top, F.expr("__cost div 2")).otherwise(F.col("__cost"))
    joined = rows.join(flat, ["reforge"], "left").withColumn("__cost", fixed)
    stone, cost = F.col("__stone"), F.col("__cost")
    if stones is not None:
        # a stone has few tiers; the table has at most one row per reforge name, a fixed list
        whole = stones.groupBy("reforge", "item", "tier").agg(F.max("cost").alias("cost")).groupBy("reforge", "item").agg(F.collect_list(F.struct("tier", "cost")).alias("costs"))
        table = whole.groupBy("reforge").agg(F.max("item").alias("__item"), F.map_from_entries(F.max_by("costs", "item")).alias("__by_tier"))
        joined = joined.join(F.broadcast(table), ["reforge"], "left")
        listed = F.col("__item").isNotNull()
        stone = F.when(listed, F.col("__item")).otherwise(stone)
        cost = F.when(listed, F.coalesce(F.try_element_at("__by_tier", F.col("tier")), F.lit(0))).otherwise(cost)
    return joined.select(*rows.columns, F.coalesce(stone, F.lit("")).alias("stone"), F.coalesce(cost, F.lit(0)).cast("bigint").alias("apply_cost"))


def enchant_price_table(prices: DataFrame) -> DataFrame:
    """(type, day, levels): market prices of enchanted books, the levels of a type in one map."""
    pattern = r"^ENCHANTMENT_(.+)_(\d+)$"
    books = prices.filter(F.col("tag").rlike(pattern)).select(
        F.lower(F.regexp_extract("tag", pattern, 1)).alias("__book"), F.regexp_extract("tag", pattern, 2).cast("int").alias("level"), "day", "price"
    )
    books = books.groupBy("__book", "day", "level").agg(F.min("price").alias("price"))  # one tag may have two spellings
    return books.groupBy("__book", "day").agg(F.map_from_entries(F.collect_list(F.struct("level", "price"))).alias("__levels"))


def enchant_values(enchants: DataFrame, prices: DataFrame, hot_rows: int = 1_000_000, few: int = 0) -> DataFrame:
    """Add ``worth`` to rows with ``type``, ``level``, ``tag``, ``day`` and ``flat`` (attribute map, may be null).

    ``prices`` has ``tag``, ``day`` and ``price``. Worth is the market price of the
    level where there is a sane one, a special item for a few top levels, else scaled
    up from level 5 or level 1, or grown with an attribute; -1 if nothing applies.
    ``few`` as in :func:`hot_join`, for maps of the levels of a book; ``prices`` should then be stored.
    """
    type_, level = F.col("type"), F.col("level")
    books = enchant_price_table(prices)
    # a handful of columns per day, so no larger than the calendar
    extras = (
        prices.filter(F.col("tag").isin(list(FALLBACK_PRICES)))
        .groupBy("day")
        .agg(F.map_from_entries(F.collect_list(F.struct("tag", F.col("price").cast("double")))).alias("__extra"))
    )
    asked = enchants.withColumn("__book", F.when(type_ == "ultimate_duplex", "ultimate_reiterate").otherwise(F.lower(type_)))
    joined = hot_join(asked, books, ["__book", "day"], "left", hot_rows=hot_rows, few=few).join(F.broadcast(extras), ["day"], "left")

    def at(n: Column) -> Column:
        return F.try_element_at("__levels", n).cast("double")

    def special(tag: str) -> Column:
        return F.coalesce(F.try_element_at("__extra", F.lit(tag)), F.lit(float(FALLBACK_PRICES[tag])))

    exact, first = at(level), at(F.lit(1))
    fifth = F.when(type_ != "ultimate_duplex", at(F.lit(5)))
    sane = (exact > 0) & (exact < MAX_MARKET_PRICE) & (first.isNull() | (first <= exact))
    attribute = mapped({k: v[0] for k, v in GROWTH.items()}, type_)
    factor = mapped({k: v[1] for k, v in GROWTH.items()}, type_)
    factor = F.when((F.col("tag") == "FUNGI_CUTTER") & (type_ == "cultivating"), F.lit(FUNGI_FACTOR)).otherwise(factor)
    most = mapped({k: v[2] for k, v in GROWTH.items()}, type_)
    amount = F.coalesce(F.try_element_at("flat", attribute).try_cast("double"), F.lit(0.0))
    grown = F.when(F.col("flat").isNull(), first + factor * most * level / 10).otherwise(first + F.least(amount, most.cast("double")) * factor)
    worth = (
        F.when(sane, exact)
        .when((type_ == "efficiency") & (level >= 6), special("SIL_EX") * (level - 5))
        .when((type_ == "scavenger") & (level == 6), special("GOLDEN_BOUNTY"))
        .when((type_ == "venomous") & (level == 7), special("FATEFUL_STINGER") + special("ENCHANTMENT_VENOMOUS_6"))
        .when((type_ == "ender_slayer") & (level == 7), special("ENDER_SLAYER_6") + special("ENDSTONE_IDOL"))
        .when((level > 7) & (fifth > 0) & attribute.isNull(), fifth * F.pow(F.lit(2.0), level - 5))
        .when((first > 0) & attribute.isNotNull(), grown)
        .when(first > 0, first * F.pow(F.lit(2.0), level - 1))
        .otherwise(F.lit(-1.0))
    )
    return joined.select(*enchants.columns, worth.cast("bigint").alias("worth"))


def ingredients_of(rows: DataFrame, ingredients: DataFrame, keys: list[str], hot_rows: int = 1_000_000) -> DataFrame:
    """(keys, day, item) of the ingredients of each row's ``tag``; an item has few of them."""
    listed = ingredients.groupBy("tag").agg(F.collect_set("item").alias("__items"))
    parts = hot_join(rows.select(*keys, "tag", "day"), listed, ["tag"], "inner", hot_rows=hot_rows)
    return parts.select(*keys, "day", F.explode("__items").alias("item"))


def prices_for(prices: DataFrame, asked: list[DataFrame]) -> DataFrame:
    """Dated prices for all (item, day) of several frames at once."""
    wanted = asked[0].select("item", "day")
    for other in asked[1:]:
        wanted = wanted.unionByName(other.select("item", "day"))
    return dated_prices(prices, wanted, "item")


def observed_prices(sales: DataFrame) -> DataFrame:
    """(tag, day, price): the smoothed price of each day with sales, what an enchantment is valued from."""
    return centered_median(daily_prices(sales, "tag"), "tag").select("tag", "day", F.col("smoothed").alias("price"))


def value_columns(
    properties: DataFrame,
    parts: DataFrame,
    enchants: DataFrame,
    reforges: DataFrame,
    ingredients: DataFrame,
    dated: DataFrame,
    keys: list[str],
    hot_rows: int = 1_000_000,
    few: int = 0,
) -> DataFrame:
    """Everything that adds to the value of an auction as (keys, column, worth) rows.

    Every attribute of ``properties`` (keys, ``key``, ``value``) and of ``parts`` has a column, 0 where it
    stands for no items; ``properties`` need not hold those that have parts. Attribute parts (counted
    together or not) and ingredients have ``item`` and ``day``, reforges
    ``stone``, ``apply_cost`` (at the default tier) and ``day``; they are priced from the table
    of dated prices. Enchantments come with their ``worth``, see :func:`enchant_values`
    with :func:`observed_prices`. ``few`` as in :func:`hot_join`, for the table of dated prices.
    """
    of = [*keys, "key", "value"]
    nothing = properties.select(*of, F.lit(0).cast("bigint").alias("worth"))
    attributes = _part_worth(parts, dated, of, hot_rows, few).unionByName(nothing).groupBy(*of).agg(F.sum("worth").cast("bigint").alias("worth"))
    attribute_rows = attributes.select(*keys, F.concat_ws(":", "key", "value").alias("column"), "worth")
    enchant_rows = enchants.select(*keys, F.concat(F.lit("!ench"), "type", F.lit(":"), F.col("level").cast("string")).alias("column"), "worth")
    stones = with_price(reforges.withColumnRenamed("stone", "item"), dated, "item", hot_rows, few=few)
    reforge_rows = stones.select(*keys, F.col("reforge").alias("column"), (F.col("apply_cost") + F.col("price")).alias("worth"))
    ingredient_rows = with_price(ingredients, dated, "item", hot_rows, few=few).select(*keys, F.col("item").alias("column"), F.col("price").alias("worth"))
    return attribute_rows.unionByName(enchant_rows).unionByName(reforge_rows).unionByName(ingredient_rows)


# Catalogue ----------------------------------------------------------------------


def armor_sets(catalogue: DataFrame) -> DataFrame:
    """(set_name, tag) rows of all armour sets, with the fixed further items of the sets there are."""
    named = catalogue.filter("set_xp is not null").select(F.explode(F.map_keys("set_xp")).alias("set_name"), "tag").distinct()
    extra = rule_table(catalogue.sparkSession, item_rules.EXTRA_SET_ITEMS, "__set string, __item string")
    added = named.select("set_name").distinct().join(extra, F.upper("set_name") == F.col("__set")).select("set_name", F.col("__item").alias("tag"))
    return named.unionByName(added).distinct()


def pet_item_removal(rows: DataFrame, catalogue: DataFrame, tag: str = "tag", hot_rows: int = 1_000_000) -> DataFrame:
    """Add ``removal_cost`` of a pet item by its tier, looked up as it is, then with PET_ITEM_ before it."""
    tiers = catalogue.select("tag", F.upper("tier").alias("__tier"), F.lit(True).alias("__known"))
    asked = rows.select(tag).distinct().withColumn("__long", F.concat(F.lit("PET_ITEM_"), F.col(tag)))
    short = tiers.select(F.col("tag").alias(tag), F.col("__tier").alias("__t1"), F.col("__known").alias("__k1"))
    long = tiers.select(F.col("tag").alias("__long"), F.col("__tier").alias("__t2"))
    both = asked.join(short, [tag], "left").join(long, ["__long"], "left")
    tier = F.when(F.col("__k1"), F.col("__t1")).otherwise(F.col("__t2"))
    cost = F.coalesce(mapped(item_rules.PET_ITEM_REMOVAL, F.coalesce(tier, F.lit(""))), F.lit(item_rules.PET_ITEM_REMOVAL["UNCOMMON"]))
    return hot_join(rows, both.select(tag, cost.cast("bigint").alias("removal_cost")), [tag], "left", hot_rows=hot_rows)


def color_class(tag: Column, hex_code: Column, original: Column, category: Column) -> Column:
    """Class of a dyed item's colour, first hit of a fixed order. ``original`` is the catalogue colour r:g:b or r,g,b."""
    code = F.upper(hex_code)
    variant = F.lit(False)
    for item, codes in colors.VARIANTS.items():
        variant = variant | ((tag == item) & code.isin(codes))
    listed = (
        F.when(tag.startswith("FAIRY"), code.isin(colors.FAIRY))
        .when(tag.startswith("CRYSTAL"), code.isin(colors.CRYSTAL))
        .when(tag.startswith("LEATHER") | tag.isin(colors.ANY_COLOR_ITEMS), F.lit(True))
        .otherwise(variant)
    )
    is_original = F.when(tag.startswith("GREAT_SPOOK"), code.isin(colors.SPOOK)).otherwise(listed | (code == rgb_hex(original)))
    piece = F.lit(False)
    for name, codes in reversed(colors.OG_FAIRY_PIECES):
        piece = F.when(tag.contains(name) | (category == name), code.isin(codes)).otherwise(piece)
    og_fairy = category.isNotNull() & (code.isin(colors.OG_FAIRY) | piece)
    family = mapped(colors.GLITCHED, code)
    glitched = ~tag.contains("WITHER") & family.isNotNull() & F.startswith(tag, family)
    return (
        F.when(is_original, "ORIGINAL")
        .when(og_fairy, "OG_FAIRY")
        .when(code.isin(colors.FAIRY), "FAIRY")
        .when(code.isin(colors.UNDYED), "UNDYED")
        .when(code.isin(colors.CRYSTAL), "CRYSTAL")
        .when(glitched, "GLITCHED")
        .when(tag.startswith("FAIRY_") & code.isin(colors.SPOOK), "SPOOK")
        .otherwise("EXOTIC")
    )


def color_classes(dyed: DataFrame, catalogue: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """Add ``color_class`` to rows with ``tag`` and ``hex``."""
    known = catalogue.select("tag", "color", "category")
    joined = hot_join(dyed, known, ["tag"], "left", hot_rows=hot_rows)
    class_ = color_class(F.col("tag"), F.col("hex"), F.col("color"), F.col("category"))
    return joined.select(*dyed.columns, class_.alias("color_class"))
