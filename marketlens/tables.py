"""How the test tables play the market roles (plain projections, no row is left out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.session import HELD_ROWS, configure, spread

# Fixed values of the role mapping.
BOOK_TYPES = ["efficiency", "scavenger", "venomous", "ender_slayer", "cultivating", "ultimate_wise", "growth"]
NAME_WORDS = [
    "Sharp", "Fabled", "Giant", "Wise", "Strong", "Gilded", "Withered", "Odd", "Legendary", "Renowned",
    "Ancient", "Pure", "Clean", "Fierce", "Heavy", "Light", "Spicy", "Plain", "Golden", "Wooden",
    "Strong Dragon", "Wise Dragon", "◆ Ender", "[Lvl 7]", "[Lvl 100]",
]
COMPONENT_TAGS = [
    "HOT_POTATO_BOOK", "FUMING_POTATO_BOOK", "RECOMBOBULATOR_3000", "FIRST_MASTER_STAR", "SECOND_MASTER_STAR",
    "RUNE_ZAP", "RUNE_ZAP_1", "RUNE_ZAP_2", "RUNE_ZAP_3", "UNIQUE_RUNE_ZAP", "FINE_JADE_GEM", "SIL_EX",
    "MIDAS_JEWEL", "JADERALD",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(words: list[str], index: Column) -> Column:
    """The word at a zero-based position, counted round and round."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(index, F.lit(len(words))) + 1).cast("int"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sold auctions: one row per lineitem row."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("auction_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").cast("bigint").alias("highest_bid"),
        F.col("l_quantity").cast("int").alias("count"),
        F.col("l_shipdate").alias("end"),
        F.col("l_returnflag").alias("tier"),
        F.col("l_linestatus").alias("reforge"),
    )


def enchantments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enchantment rows: (order, line) as (auction, type), level 1 to 10 from the quantity."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("auction_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_linenumber").alias("line"),
        pick(BOOK_TYPES, F.col("l_linenumber") - 1).alias("type"),
        F.ceil(F.col("l_quantity") / 5).cast("int").alias("level"),
        F.col("l_extendedprice").cast("bigint").alias("highest_bid"),
        F.col("l_shipdate").alias("end"),
        F.col("l_linestatus").alias("status"),
    )


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("auction_id"),
        F.col("l_suppkey").alias("bidder_id"),
        F.col("l_extendedprice").cast("bigint").alias("amount"),
        F.col("l_shipdate").alias("ts"),
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auction headers: one row per order; status O is a buy-it-now listing."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("auction_id"),
        F.col("o_custkey").alias("seller_id"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_orderstatus") == "O").alias("bin"),
        F.col("o_totalprice").cast("bigint").alias("starting_bid"),
        F.col("o_orderdate").alias("end"),
        F.col("o_orderpriority").alias("tier"),
    )


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.md5(F.col("c_custkey").cast("string")).alias("uuid"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").cast("int").alias("hit_count"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item catalogue: the tag is the upper-case name with the key, the full name carries a prefix word."""
    part = read(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    ending = F.when(F.col("p_type") == "LARGE", " ✪✪").when(F.col("p_type") == "SMALL", " ⚚").otherwise("")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.concat_ws("_", F.upper(F.regexp_replace("p_name", " ", "_")), F.col("p_partkey").cast("string")).alias("tag"),
        F.col("p_name").alias("name"),
        F.concat(pick(NAME_WORDS, brand - 1), F.lit(" "), F.initcap("p_name"), ending).alias("full_name"),
        F.col("p_type").alias("category"),
        F.col("p_size").alias("hit_count"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").cast("bigint").alias("coins"),
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commodity feed: one snapshot per event; the product is the event type."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.col("event_type").alias("product_id"),
        F.col("value").alias("buy_price"),
        (F.col("value") * 0.9).alias("sell_price"),
        (k * 1000).alias("buy_moving_week"),
        (k * 100000).alias("sell_moving_week"),
        k.alias("k"),
    )


def component_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of upgrade components: the component is chosen by the supplier key."""
    return read(spark, sf_dir, "lineitem").select(
        pick(COMPONENT_TAGS, F.col("l_suppkey")).alias("tag"),
        F.col("l_extendedprice").cast("bigint").alias("highest_bid"),
        F.col("l_quantity").cast("int").alias("count"),
        F.col("l_shipdate").alias("end"),
    )


def attribute_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with nested attributes: one JSON text per event."""
    return attribute_documents(spread(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")))


def attribute_documents(events: DataFrame) -> DataFrame:
    """(auction_id, attributes) of events, a table or a stream: one JSON text each, its shape chosen by the event type."""
    # in a select of their own, so that they are computed once a row, not at every place of a template
    events = events.select("*", F.get_json_object("props", "$.k").alias("__k"), F.md5(F.col("event_id").cast("string")).alias("__digest"))
    k, digest = F.col("__k"), F.col("__digest")
    uuid = F.concat_ws("-", *[F.substr(digest, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    short = F.left(digest, F.lit(12))
    user = F.col("user_id").cast("string")

    def js(template: str) -> Column:
        """Fill {k}, {uuid}, {short} and {user} into a JSON template written with ' for "."""
        out = [F.lit("")]
        text = template.replace("'", '"')
        values = {"k": k, "uuid": uuid, "short": short, "user": user}
        while text:
            places = [(text.find("<" + n + ">"), n) for n in values if "<" + n + ">" in text]
            if not places:
                out.append(F.lit(text))
                break
            place, name = min(places)
            out += [F.lit(text[:place]), values[name]]
            text = text[place + len(name) + 2 :]
        return F.concat(*out)

    common = "'uuid':'<uuid>','modifier':'odd','timestamp':5,'hot_potato_count':<k>,'exp':<k>.25,'color':'<k>:0:7'"
    shapes = {
        "error": "{'id':'PET'," + common + ",'petInfo':'{\\'type\\':\\'BEE\\',\\'heldItem\\':\\'HELD_<user>\\',\\'uuid\\':\\'x\\',"
        "\\'hideInfo\\':false,\\'extraData\\':{\\'blaze_kills\\':<k>}}','skin':'BEE_BLUE'}",
        "click": "{'id':'DIVAN_HELMET'," + common + ",'gems':{'JADE_0':{'quality':'FINE','uuid':'<short>'},'RUBY_1':'FLAWED',"
        "'unlocked_slots':['A_0','B_0']},'enchantments':{'growth':5,'Duplex':2,'mana_pool':3,'wise':1,'zzz':300}}",
        "view": "{'id':'RUNE'," + common + ",'runes':{'ZAP':<k>},'chest':{'a':{'b':{'c':{'deep_kills':<k>},'near':1}}},'big_count':9007199254740993,'ability_scroll':['WITHER','IMPLODE']}",
        "signup": "{'id':'POTION','potion':'speed'," + common + ",'hook':{'part':'HOOK_<user>','uuid':'<short>'},"
        "'engine':{'id':'ENGINE_1','uuid':'<short>','speed':<k>},'uniqueId':'gone'}",
        "purchase": "{'id':'ENCHANTED_BOOK'," + common + ",'level':99,'necromancer_souls':[{'mob':'ZOMBIE'},{'mob':'ZOMBIE'},{'mob':'SKELETON'}],"
        "'effects':[{'effect':'SPEED','level':<k>}],'cake_owner':'a<user>ዞ','note':'n<user>','enchantments':{'sharpness':7}}",
    }
    first, *rest = shapes.items()
    body = F.when(F.col("event_type") == first[0], js(first[1]))
    for kind, template in rest:
        body = body.when(F.col("event_type") == kind, js(template))
    return events.select(F.col("event_id").alias("auction_id"), body.alias("attributes"))


def known_types(spark: SparkSession) -> DataFrame:
    """Type names the test attributes know."""
    names = ["growth", "sharpness", "ultimate_wise", "ultimate_reiterate", "efficiency", "unknown"]
    return spark.createDataFrame([(n,) for n in names], "name string")


SLOT_TYPES = ["JADE", "RUBY", "COMBAT"]
SET_NAMES = ["SNOW_SUIT", "Crimson_Hunter", "DRAGON"]
CATEGORIES = ["BOOTS", "HELMET", "SWORD"]
COLORS = ["255:153:255", "31,0,48", "0:0:0", "204:85:0"]


TAG_HEADS = ["FAIRY_", "CRYSTAL_", "SHARK_SCALE_", "GREAT_SPOOK_", "LEATHER_", "PLAIN_", "WITHER_"]


def catalogue_tag(key: Column) -> Column:
    return F.concat(pick(TAG_HEADS, key), F.lit("ITEM_"), key.cast("string"))


def catalogue_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalogue document per part, numbers partly as text; parts of size 1 have no id."""
    size, key = F.col("p_size"), F.col("p_partkey")
    tag = F.when(key % 9 == 4, F.concat(F.lit("STARRED_"), catalogue_tag(key - 4))).otherwise(catalogue_tag(key))

    def level(i: Column) -> Column:
        essence = F.struct(
            F.lit("WITHER").alias("essence_type"), ((i + 1) * 10).cast("string").alias("amount"), F.lit(None).cast("string").alias("item_id"), F.lit("ESSENCE").alias("type")
        )
        item = F.struct(
            F.lit(None).cast("string").alias("essence_type"), size.cast("string").alias("amount"), F.concat(F.lit("STAR_"), i.cast("string")).alias("item_id"), F.lit("ITEM").alias("type")
        )
        return F.array(essence, item)

    levels = F.transform(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: i < size % 7), level)

    def slot(i: Column) -> Column:
        coins = F.struct(F.lit("COINS").alias("type"), (size * 1000).alias("coins"), F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("int").alias("amount"))
        gem = F.struct(F.lit("ITEM").alias("type"), F.lit(None).cast("int").alias("coins"), F.lit("FINE_JADE_GEM").alias("item_id"), (i + 1).alias("amount"))
        costs = F.when((size + i) % 4 != 0, F.array(coins, gem))
        return F.struct(pick(SLOT_TYPES, size + i * i).alias("slot_type"), costs.alias("costs"))

    slots = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < size % 5), slot)
    sets = F.create_map(pick(SET_NAMES, size), F.lit("5"))
    document = F.struct(
        F.when(size != 1, tag).alias("id"),
        pick(["common", "RARE", "LEGENDARY", "odd"], size).alias("tier"),
        pick(COLORS, size).alias("color"),
        F.when(size % 6 != 5, pick(CATEGORIES, size)).alias("category"),
        F.when(size % 3 != 2, levels).alias("upgrade_costs"),
        slots.alias("gemstone_slots"),
        F.struct(F.when(size % 4 == 0, sets).alias("armor_set_donation_xp")).alias("museum_data"),
    )
    return spread(read(spark, sf_dir, "part")).select(key.alias("id"), "p_size", F.to_json(document).alias("document"))


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attribute per lineitem row: the kind by line number, the value by quantity, the base by supplier."""
    line = spread(read(spark, sf_dir, "lineitem"), HELD_ROWS)
    n, q, supp, part = F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.col("l_suppkey"), F.col("l_partkey")
    tenth = F.ceil(F.col("l_quantity") / 5).cast("int")
    last = F.when(supp % 3 == 0, "farming_for_dummies_count").when(supp % 3 == 1, "COMBAT_0").otherwise("unlocked_slots")
    last_value = F.when(supp % 3 == 0, q.cast("string")).when(supp % 3 == 1, "FINE").otherwise("JADE_0,RUBY_1")
    key = (
        F.when(n == 1, "hpc")
        .when(n == 2, "upgrade_level")
        .when(n == 3, F.when(supp % 2 == 0, "RUNE_ZAP").otherwise("RUNE_SPELLBOUND"))
        .when(n == 4, "ability_scroll")
        .when(n == 5, "talisman_enrichment")
        .when(n == 6, "hotpc")
        .otherwise(last)
    )
    value = (
        F.when(n == 1, (q % 15 + 1).cast("string"))
        .when(n == 2, tenth.cast("string"))
        .when(n == 3, (q % 3 + 1).cast("string"))
        .when(n == 4, F.when(q % 2 == 0, "WITHER 12,IMPLODE").otherwise("IMPLODE"))
        .when(n == 5, F.when(q % 2 == 0, "yes").otherwise("speed"))
        .when(n == 6, pick(["0", "0.1", "1"], q))
        .otherwise(last_value)
    )
    tag = F.when(part % 5 == 0, "HOT_CRIMSON_HELMET").otherwise(catalogue_tag(part))
    return line.select(
        F.col("l_orderkey").alias("auction_id"),
        n.alias("line"),
        part.alias("part"),
        supp.alias("supp"),
        tag.alias("tag"),
        F.col("l_shipdate").alias("end"),
        key.alias("key"),
        value.alias("value"),
        pick(["", "3", "9", "12"], supp).alias("base"),
        F.create_map(F.lit("COMBAT_0_gem"), F.lit("RUBY"), key, value).alias("flat"),
    )


def book_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly mean prices of enchanted books and of upgrade components."""
    books = enchantments(spark, sf_dir)
    tag = F.concat(F.lit("ENCHANTMENT_"), F.upper("type"), F.lit("_"), F.col("level").cast("string"))
    sold = books.select(tag.alias("tag"), "end", F.col("highest_bid").alias("price"))
    parts = component_sales(spark, sf_dir).select("tag", "end", F.col("highest_bid").alias("price"))
    week = F.floor(F.unix_date(F.col("end").cast("date")) / 7).cast("int")
    return sold.unionByName(parts).groupBy("tag", week.alias("day")).agg(F.avg("price").cast("bigint").alias("price"))
