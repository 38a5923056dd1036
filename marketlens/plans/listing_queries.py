"""Registered queries: listings, sales lists, enchantments, look-ups, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import tables as t
from marketlens.functions import ids
from marketlens.operators import dedup, enchants, listings, lookups
from marketlens.plans.price_queries import FEED, SALES
from marketlens.plans.registry import query
from marketlens.rules import enchants as rules
from marketlens.rules import items as item_rules

AS_OF = "1998-01-01 00:00:00"


def words(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def values(rows) -> str:
    def one(v):
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


BOOK = f"""(SELECT l_orderkey AS auction_id, l_partkey AS item_id, l_linenumber AS line, [{words(t.BOOK_TYPES)}][(l_linenumber - 1) % 7 + 1] AS type,
  ceil(l_quantity / 5)::INT AS level, trunc(l_extendedprice)::BIGINT AS highest_bid, l_shipdate AS "end", l_linestatus AS status FROM lineitem)"""
ACTIVE = f"""(SELECT o_orderkey AS auction_id, o_custkey AS seller_id, o_orderstatus = 'O' AS bin, o_orderdate AS "end", o_orderpriority AS tier,
  coalesce(n_bids, 0) AS n_bids, CASE WHEN coalesce(highest, 0) = 0 THEN trunc(o_totalprice)::BIGINT ELSE highest END AS price
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_bids, max(trunc(l_extendedprice)::BIGINT) AS highest FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  WHERE o_orderdate > '1998-01-01' AND (o_orderstatus <> 'O' OR n_bids IS NULL))"""
HEADERS = """(SELECT o_orderkey AS auction_id, o_custkey AS seller_id, o_orderstatus AS status, o_orderpriority AS tier,
  trunc(o_totalprice)::BIGINT AS starting_bid, o_orderdate AS "end" FROM orders)"""


def active(spark, d):
    return listings.active_listings(t.headers(spark, d), t.bids(spark, d), AS_OF)


@query("active_listing_scan", f"SELECT * FROM {ACTIVE}")
def active_listing_scan(spark, d):
    return active(spark, d).select("auction_id", "seller_id", "bin", "end", "tier", "n_bids", "price")


def board(order: str, keys: str, n: int, where: str = "true") -> str:
    return f"""SELECT auction_id, seller_id, tier, "end", price, position FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}, auction_id) AS position
FROM {ACTIVE} WHERE {where}) WHERE position <= {n}"""


BOARD_COLUMNS = ["auction_id", "seller_id", "tier", "end", "price", "position"]


@query("active_listings_lowest", board("price", "tier", 24))
def active_listings_lowest(spark, d):
    return listings.listing_board(active(spark, d), ["tier"], "LOWEST_PRICE").select(*BOARD_COLUMNS)


@query("active_listings_highest", board("price DESC", "tier", 24))
def active_listings_highest(spark, d):
    return listings.listing_board(active(spark, d), ["tier"], "RELEVANT").select(*BOARD_COLUMNS)


@query("active_listings_ending", board('"end"', "tier", 24))
def active_listings_ending(spark, d):
    return listings.listing_board(active(spark, d), ["tier"], "ENDING_SOON").select(*BOARD_COLUMNS)


@query("lowest_bin", board("price", "seller_id, tier", 2, "bin"))
def lowest_bin(spark, d):
    return listings.lowest_bin(active(spark, d), ["seller_id", "tier"]).select(*BOARD_COLUMNS)


@query(
    "recent_sales",
    f"""SELECT s.*, c_name AS player_name FROM (SELECT item_id, "end", highest_bid AS price, seller_id, row_number() OVER (PARTITION BY item_id
ORDER BY "end" DESC, auction_id, line, highest_bid, seller_id) AS position FROM {SALES} WHERE highest_bid > 1) s
LEFT JOIN customer ON c_custkey = seller_id WHERE position <= 12""",
)
def recent_sales(spark, d):
    sales = t.sales(spark, d).filter("highest_bid > 1")
    top = listings.recent_sales(sales, ["item_id"], ["auction_id", "line", "highest_bid", "seller_id"])
    preview = top.select("item_id", "end", F.col("highest_bid").alias("price"), "seller_id", "position")
    return listings.with_player_name(preview, t.players(spark, d), "seller_id")


# The auction's uuid goes with the preview; here it is the order's hash.
@query(
    "recent_sales_preview",
    f"""SELECT s.*, c_name AS player_name FROM (SELECT item_id, md5(auction_id::VARCHAR) AS uuid, "end", highest_bid AS price, seller_id, row_number() OVER (PARTITION BY item_id
ORDER BY "end" DESC, auction_id, line, highest_bid, seller_id) AS position FROM {SALES} WHERE highest_bid > 1) s
LEFT JOIN customer ON c_custkey = seller_id WHERE position <= 12""",
)
def recent_sales_preview(spark, d):
    """What a preview shows of an item's last sales: uuid, end, price, seller and name."""
    sales = t.sales(spark, d).filter("highest_bid > 1").withColumn("uuid", F.md5(F.col("auction_id").cast("string")))
    top = listings.recent_sales(sales, ["item_id"], ["auction_id", "line", "highest_bid", "seller_id"])
    preview = top.select("item_id", "uuid", "end", F.col("highest_bid").alias("price"), "seller_id", "position")
    return listings.with_player_name(preview, t.players(spark, d), "seller_id")


# A listing's item is chosen by its number.
@query(
    "lowest_bin_of_item",
    f"""SELECT auction_id % 40 AS item_id, tier, auction_id, price, row_number() OVER (PARTITION BY auction_id % 40, tier ORDER BY price, auction_id) AS position
FROM {ACTIVE} WHERE bin QUALIFY position <= 2""",
)
def lowest_bin_of_item(spark, d):
    """The two cheapest buy-it-now listings of every item and tier."""
    of_item = active(spark, d).withColumn("item_id", F.col("auction_id") % 40)
    return listings.lowest_bin(of_item, ["item_id", "tier"]).select("item_id", "tier", "auction_id", "price", "position")


@query(
    "named_filter",
    f"SELECT auction_id, seller_id, price FROM {ACTIVE} WHERE bin AND tier = '1-URGENT'",
)
def named_filter(spark, d):
    return listings.named_filters(active(spark, d), {"Bin": "true", "Rarity": "1-URGENT"}).select("auction_id", "seller_id", "price")


@query(
    "tier_reforge_filter",
    f"""SELECT auction_id, line, item_id, highest_bid FROM {SALES} WHERE reforge = 'F' AND tier = 'A'""",
)
def tier_reforge_filter(spark, d):
    return listings.plain_filters(t.sales(spark, d), "F", "A").select("auction_id", "line", "item_id", "highest_bid")


@query(
    "page_by_key",
    "SELECT o_orderkey // 1000 AS page, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1",
)
def page_by_key(spark, d):
    paged = listings.pages_by_key(t.headers(spark, d), "auction_id", 1000)
    return paged.groupBy("page").agg(
        F.count(F.lit(1)).alias("n"), F.min("auction_id").alias("first"), F.max("auction_id").alias("last")
    )


@query("ordered_page", "SELECT o_orderkey AS auction_id, o_custkey AS seller_id FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 300")
def ordered_page(spark, d):
    return listings.page(t.headers(spark, d).select("auction_id", "seller_id"), "auction_id", 3, 100)


# Headers with their item: the item is the customer key among the parts.
RESULT = f"""(SELECT h.*, CASE WHEN h.status = 'P' THEN '' ELSE p_name END AS item_name,
  upper(replace(p_name, ' ', '_')) || '_' || p_partkey AS tag, h.status = 'O' AS bin, p_size AS count,
  CASE WHEN h.status = 'O' THEN 0 ELSE starting_bid END AS bid0, starting_bid // 2 AS highest_bid
  FROM {HEADERS} h LEFT JOIN part ON p_partkey = seller_id)"""


def result_rows(spark, d):
    items = t.items(spark, d).select(F.col("id").alias("seller_id"), "name", "tag", F.col("hit_count").alias("count"))
    rows = t.headers(spark, d).join(items, ["seller_id"], "left")
    return rows.withColumns(
        {
            "item_name": F.when(F.col("status") == "P", "").otherwise(F.col("name")),
            "highest_bid": F.expr("starting_bid div 2"),
            "starting_bid": F.when(F.col("bin"), F.lit(0)).otherwise(F.col("starting_bid")),
        }
    )


TITLED = """trim(array_to_string(list_transform(string_split(lower({tag}), '_'), lambda w: CASE WHEN w IN ('of', 'the') THEN w
  ELSE upper(w[1:1]) || w[2:] END), ' '))"""


@query(
    "guess_missing_fields",
    f"""SELECT auction_id, highest_bid, CASE WHEN item_name = '' THEN {TITLED.format(tag="tag")} ELSE item_name END AS item_name, tag, "end",
CASE WHEN bid0 = 0 AND bin THEN highest_bid ELSE bid0 END AS starting_bid, bin FROM {RESULT}""",
)
def guess_missing_fields(spark, d):
    return listings.auction_result(listings.guess_missing(result_rows(spark, d)))


CANON = values([(w.lower(), w) for w in {w.lower(): w for w in item_rules.REFORGES}.values()])
BRAND = "regexp_extract(p_brand, '([0-9]+)$', 1)::INT"
TITLE_NAME = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
ENDING = "CASE p_type WHEN 'LARGE' THEN ' ✪✪' WHEN 'SMALL' THEN ' ⚚' ELSE '' END"
FULL_NAME = f"([{words(t.NAME_WORDS)}][({BRAND} - 1) % 25 + 1] || ' ' || {TITLE_NAME} || {ENDING})"


@query(
    "index_elements",
    f"""SELECT i.auction_id, "end", price, coalesce(canon, 'None') AS reforge, count, n_bids FROM (SELECT p_partkey AS auction_id, max(o_orderdate) AS "end",
  any_value(trunc(p_retailprice)::BIGINT) AS price, any_value({FULL_NAME}) AS full_name, any_value(p_size) AS count, count(o_orderkey) AS n_bids
  FROM part LEFT JOIN orders ON o_custkey = p_partkey GROUP BY p_partkey) i
LEFT JOIN (VALUES {CANON}) c(low, canon) ON low = lower(string_split(full_name, ' ')[1])""",
)
def index_elements(spark, d):
    items = t.items(spark, d).select("id", F.col("full_name").alias("item_name"), F.col("hit_count").alias("count"), F.col("coins").alias("highest_bid"))
    ended = t.headers(spark, d).groupBy(F.col("seller_id").alias("id")).agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n_bids"))
    rows = items.join(ended, ["id"], "left").withColumn("n_bids", F.coalesce("n_bids", F.lit(0)))
    return listings.index_elements(rows.withColumnRenamed("id", "auction_id"))


# Enchantments --------------------------------------------------------------

HEADER_COLUMNS = ["auction_id", "seller_id", "tier"]


@query(
    "has_enchant",
    f"""SELECT auction_id, seller_id, tier FROM {HEADERS} WHERE auction_id IN
(SELECT auction_id FROM {BOOK} WHERE type = 'growth' AND level = 6)""",
)
def has_enchant(spark, d):
    return enchants.has_enchant(t.headers(spark, d), t.enchantments(spark, d), "growth", 6).select(*HEADER_COLUMNS)


@query(
    "has_two_enchants",
    f"""SELECT auction_id, seller_id, tier FROM {HEADERS} WHERE auction_id IN (SELECT auction_id FROM {BOOK}
WHERE (type = 'growth' AND level = 6) OR (type = 'efficiency' AND level = 5) GROUP BY 1 HAVING count(*) > 1)""",
)
def has_two_enchants(spark, d):
    requested = [("growth", 6), ("efficiency", 5), ("venomous", 1)]
    return enchants.has_two_enchants(t.headers(spark, d), t.enchantments(spark, d), requested).select(*HEADER_COLUMNS)


@query(
    "without_enchants",
    f"""SELECT auction_id, seller_id, tier FROM {HEADERS} WHERE auction_id NOT IN
(SELECT auction_id FROM {BOOK} GROUP BY 1 HAVING count(*) > 1)""",
)
def without_enchants(spark, d):
    return enchants.without_enchants(t.headers(spark, d), t.enchantments(spark, d)).select(*HEADER_COLUMNS)


@query(
    "newest_with_enchant",
    f"""SELECT auction_id, seller_id, tier FROM {HEADERS} WHERE auction_id IN (SELECT auction_id FROM {BOOK}
WHERE type = 'cultivating' AND level = 10 ORDER BY "end" DESC, auction_id DESC LIMIT 50)""",
)
def newest_with_enchant(spark, d):
    order = [F.desc("end"), F.desc("auction_id")]
    found = enchants.newest_with_enchant(t.headers(spark, d), t.enchantments(spark, d), "cultivating", 10, order, 50)
    return found.select(*HEADER_COLUMNS)


def rank_sql(keys: str) -> str:
    return f"""SELECT {keys}, avg(starting_bid) AS mean_bid, count(*) AS n, row_number() OVER (ORDER BY avg(starting_bid) DESC, {keys}) AS worth_rank
FROM {BOOK} b JOIN {HEADERS} h USING (auction_id) WHERE starting_bid > 0 GROUP BY {keys}"""


def paid_headers(spark, d):
    return t.headers(spark, d).withColumnRenamed("starting_bid", "highest_bid")


@query("enchant_worth_rank", rank_sql("type, level"))
def enchant_worth_rank(spark, d):
    return enchants.worth_ranking(t.enchantments(spark, d), paid_headers(spark, d), ["type", "level"])


@query("enchant_type_rank", rank_sql("type"))
def enchant_type_rank(spark, d):
    return enchants.worth_ranking(t.enchantments(spark, d), paid_headers(spark, d), ["type"])


@query(
    "best_enchant",
    f"""WITH l AS ({rank_sql("type, level")}), ty AS ({rank_sql("type")}),
r AS (SELECT b.auction_id, b.type, b.level, CASE WHEN l.worth_rank IS NOT NULL THEN 0 ELSE 1 END AS tier,
  coalesce(l.worth_rank, ty.worth_rank) AS rnk
  FROM {BOOK} b LEFT JOIN l ON l.type = b.type AND l.level = b.level JOIN ty ON ty.type = b.type)
SELECT auction_id, type, level FROM (SELECT *, row_number() OVER (PARTITION BY auction_id ORDER BY tier, rnk, level) AS rn FROM r) WHERE rn = 1""",
)
def best_enchant(spark, d):
    books, paid = t.enchantments(spark, d), paid_headers(spark, d)
    by_level = enchants.worth_ranking(books, paid, ["type", "level"])
    by_type = enchants.worth_ranking(books, paid, ["type"])
    return enchants.best_enchant(books.select("auction_id", "type", "level"), by_level, by_type)


BOOK_COLUMNS = ["auction_id", "line", "type", "level", "highest_bid"]
BOOK_LIST = ", ".join("b." + c for c in BOOK_COLUMNS)


@query(
    "relevant_enchants",
    f"""SELECT {BOOK_LIST} FROM {BOOK} b LEFT JOIN (VALUES {values(rules.RELEVANT_LEVELS.items())}) r(ty, least) ON ty = type
WHERE level >= coalesce(least, CASE WHEN type LIKE 'ultimate\\_%' ESCAPE '\\' THEN 1 END)""",
)
def relevant_enchants(spark, d):
    return enchants.relevant_enchants(t.enchantments(spark, d)).select(*BOOK_COLUMNS)


@query(
    "very_valuable_enchants",
    f"""SELECT {BOOK_LIST} FROM {BOOK} b JOIN (VALUES {values(rules.VERY_VALUABLE_LEVELS.items())}) r(ty, least) ON ty = type WHERE level >= least""",
)
def very_valuable_enchants(spark, d):
    return enchants.very_valuable_enchants(t.enchantments(spark, d)).select(*BOOK_COLUMNS)


@query(
    "above_table_level",
    f"""SELECT {BOOK_LIST}, table_level FROM {BOOK} b JOIN (VALUES {values(rules.TABLE_LEVELS.items())}) r(ty, table_level) ON ty = type WHERE level > table_level""",
)
def above_table_level(spark, d):
    return enchants.above_table_level(t.enchantments(spark, d)).select(*BOOK_COLUMNS, "table_level")


TOOL_TAGS = ["STONK_PICKAXE", "VORPAL_KATANA", "PROMISING_HOE", "DIVAN_DRILL", "DIRT"]
TOOL = f"[{words(TOOL_TAGS)}][item_id % 5 + 1]"


@query(
    "drop_irrelevant_enchants",
    f"""SELECT {BOOK_LIST}, {TOOL} AS tag FROM {BOOK} b WHERE NOT EXISTS (SELECT 1 FROM (VALUES
{values([(ty, lv, tag) for ty, lv, tags in rules.IRRELEVANT_ON for tag in tags])}) r(ty, lv, tag) WHERE ty = b.type AND lv = b.level AND tag = {TOOL})
AND NOT (b.type = 'ender_slayer' AND b.level = 6 AND {TOOL} NOT IN ({words(rules.RELEVANT_ONLY_ON[2])}))""",
)
def drop_irrelevant_enchants(spark, d):
    books = t.enchantments(spark, d).withColumn("tag", t.pick(TOOL_TAGS, F.col("item_id")))
    return enchants.drop_irrelevant(books).select(*BOOK_COLUMNS, "tag")


# Predicates ------------------------------------------------------------------


@query(
    "relevant_reforge_items",
    f"""SELECT id, reforge FROM (SELECT p_partkey AS id, coalesce(canon, 'None') AS reforge FROM part
LEFT JOIN (VALUES {CANON}) c(low, canon) ON low = lower(string_split({FULL_NAME}, ' ')[1])) WHERE reforge IN ({words(item_rules.RELEVANT_REFORGES)})""",
)
def relevant_reforge_items(spark, d):
    from marketlens.functions.names import reforge_of_name

    named = t.items(spark, d).select("id", reforge_of_name(F.col("full_name")).alias("reforge"))
    return named.filter(F.col("reforge").isin(item_rules.RELEVANT_REFORGES))


ITEM_TAG = "upper(replace(p_name, ' ', '_')) || '_' || p_partkey"


@query(
    "rarity_upgrade_items",
    f"""SELECT id, tag, category FROM (SELECT p_partkey AS id, {ITEM_TAG} AS tag, CASE p_type WHEN 'PROMO' THEN 'WEAPON' ELSE p_type END AS category FROM part)
WHERE category IN ({words(item_rules.RECOMB_CATEGORIES)}) OR {" OR ".join(f"contains(tag, '{w}')" for w in item_rules.RECOMB_TAG_PARTS)}""",
)
def rarity_upgrade_items(spark, d):
    items = t.items(spark, d).withColumn("category", F.when(F.col("category") == "PROMO", "WEAPON").otherwise(F.col("category")))
    return items.filter(ids.rarity_upgrade_matters(F.col("category"), F.col("tag"))).select("id", "tag", "category")


PET_WORDS = ["PET_", "PET_SKIN_", "PET_ITEM_", ""]


@query(
    "pet_items",
    f"""SELECT id, tag FROM (SELECT p_partkey AS id, [{words(PET_WORDS)}][p_size % 4 + 1] || upper(replace(p_name, ' ', '_')) AS tag FROM part)
WHERE starts_with(tag, 'PET_') AND NOT starts_with(tag, 'PET_SKIN') AND NOT starts_with(tag, 'PET_ITEM') AND tag <> 'PET_CAKE'""",
)
def pet_items(spark, d):
    tag = F.concat(t.pick(PET_WORDS, F.col("hit_count")), F.upper(F.translate("name", " ", "_")))
    return t.items(spark, d).select("id", tag.alias("tag")).filter(ids.is_pet(F.col("tag")))


@query("flag_filter", f"SELECT event_id, k FROM {FEED} WHERE (k & 12) <> 0")
def flag_filter(spark, d):
    return t.feed(spark, d).filter(ids.has_flag(F.col("k"), 4 | 8)).select("event_id", "k")


@query(
    "bazaar_flag",
    f"""SELECT item_id, count(*) AS n, item_id IN (SELECT user_id FROM events) AS is_bazaar FROM {SALES} GROUP BY item_id""",
)
def bazaar_flag(spark, d):
    known = t.feed(spark, d).select(F.col("user_id").alias("item_id"))
    counted = t.sales(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return lookups.bazaar_flag(counted, known, "item_id")


@query(
    "house_state",
    f"SELECT tier, count(*) AS active, count(DISTINCT seller_id) AS sellers FROM {ACTIVE} GROUP BY tier",
)
def house_state(spark, d):
    from marketlens.operators.rollup import house_state as state

    return state(active(spark, d), "tier")


# Look-ups --------------------------------------------------------------------


@query(
    "batch_player_lookup",
    """WITH k AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN md5(user_id::VARCHAR) ELSE 'Customer#' || lpad((user_id * 100)::VARCHAR, 9, '0') END AS key FROM events)
SELECT event_id, key, coalesce(a.c_custkey, b.c_custkey, -1) AS player_id FROM k LEFT JOIN customer a ON md5(a.c_custkey::VARCHAR) = key LEFT JOIN customer b ON b.c_name = key""",
)
def batch_player_lookup(spark, d):
    by_name = F.concat(F.lit("Customer#"), F.lpad((F.col("user_id") * 100).cast("string"), 9, "0"))
    key = F.when(F.col("event_id") % 2 == 0, F.md5(F.col("user_id").cast("string"))).otherwise(by_name)
    found = lookups.players_by_key(t.feed(spark, d).select("event_id", key.alias("key")), t.players(spark, d))
    return found.fillna({"player_id": -1})


HEX = "md5(o_orderkey::VARCHAR)"
UID = f"""(SELECT o_orderkey, list_reduce(list_transform(string_split({HEX}[1:12] || {HEX}[14:17], ''), lambda c: (strpos('0123456789abcdef', c) - 1)::HUGEINT),
  lambda a, b: a * 16 + b) AS u FROM orders)"""
SIGNED = "CASE WHEN u >= 9223372036854775808 THEN (u - 18446744073709551616)::BIGINT ELSE u::BIGINT END"


@query("uuid_surrogate", f"SELECT o_orderkey AS auction_id, {SIGNED} AS uid FROM {UID}")
def uuid_surrogate(spark, d):
    return t.headers(spark, d).select("auction_id", ids.uuid_to_long(F.md5(F.col("auction_id").cast("string"))).alias("uid"))


@query(
    "batch_auction_lookup",
    f"""WITH a AS (SELECT o_orderkey, {SIGNED} AS uid FROM {UID}), k AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN md5(event_id::VARCHAR) ELSE coalesce(a.uid, 0)::VARCHAR END AS key
  FROM events LEFT JOIN a ON a.o_orderkey = event_id)
SELECT k.event_id, coalesce(a.o_orderkey, -1) AS auction_id FROM k LEFT JOIN a ON a.o_orderkey = k.event_id""",
)
def batch_auction_lookup(spark, d):
    uuid = F.md5(F.col("auction_id").cast("string"))
    auctions = t.headers(spark, d).select("auction_id", ids.uuid_to_long(uuid).alias("uid"))
    event_uuid = F.md5(F.col("event_id").cast("string"))
    numbers = t.feed(spark, d).select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, event_uuid).otherwise(ids.uuid_to_long(event_uuid).cast("string")).alias("key"),
    )
    return lookups.auctions_by_key(numbers, auctions).select("event_id", F.coalesce("auction_id", F.lit(-1)).alias("auction_id"))


@query(
    "player_history",
    f"""SELECT c_name AS name, kind, auction_id, amount, ts FROM customer JOIN (
SELECT seller_id AS id, 'auction' AS kind, auction_id, starting_bid AS amount, "end" AS ts FROM {HEADERS}
UNION ALL SELECT l_suppkey, 'bid', l_orderkey, trunc(l_extendedprice)::BIGINT, l_shipdate FROM lineitem) ON id = c_custkey""",
)
def player_history(spark, d):
    rows = lookups.player_history(t.players(spark, d), t.headers(spark, d), t.bids(spark, d))
    return rows.select("name", "kind", "auction_id", "amount", "ts")


@query(
    "auction_children",
    f"""WITH c AS (SELECT auction_id, type, level, count(*) AS copies FROM {BOOK} GROUP BY ALL),
e AS (SELECT auction_id, string_agg(type || ':' || level || 'x' || copies, ' ' ORDER BY type, level) AS enchantments FROM c GROUP BY 1),
b AS (SELECT l_orderkey AS auction_id, count(*) AS n_bids FROM lineitem GROUP BY 1)
SELECT h.auction_id, coalesce(enchantments, '') AS enchantments, coalesce(n_bids, 0) AS n_bids FROM {HEADERS} h LEFT JOIN e USING (auction_id) LEFT JOIN b USING (auction_id)""",
)
def auction_children(spark, d):
    bids = t.bids(spark, d).groupBy("auction_id").agg(F.count(F.lit(1)).alias("n_bids"))
    joined = lookups.with_children(t.headers(spark, d), [lookups.children_lists(t.enchantments(spark, d)), bids])
    text = F.transform("enchantments", lambda e: F.concat(e["type"], F.lit(":"), e["level"].cast("string"), F.lit("x"), e["copies"].cast("string")))
    return joined.select("auction_id", F.coalesce(F.array_join(text, " "), F.lit("")).alias("enchantments"), F.coalesce("n_bids", F.lit(0)).alias("n_bids"))


RUNE_PREFIX = ["RUNE_", "UNIQUE_RUNE_", "", ""]
RUNE_ITEMS = f"""(SELECT p_partkey AS id, [{words(RUNE_PREFIX)}][p_size % 4 + 1] || upper(replace(p_name, ' ', '_')) AS tag FROM part)"""


def rune_items(spark, d):
    tag = F.concat(t.pick(RUNE_PREFIX, F.col("hit_count")), F.upper(F.translate("name", " ", "_")))
    return t.items(spark, d).select("id", tag.alias("tag"), "name")


@query(
    "tag_to_id",
    f"""WITH i AS (SELECT tag, min(id) AS id FROM {RUNE_ITEMS} GROUP BY tag),
s AS (SELECT l_orderkey AS auction_id, l_linenumber AS line, [{words(["RUNE_", "", "NO_"])}][l_suppkey % 3 + 1] || upper(replace(p_name, ' ', '_')) AS tag
  FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT auction_id, line, s.tag, coalesce(u.id, i.id, 0) AS item_id FROM s LEFT JOIN i ON i.tag = s.tag
LEFT JOIN i u ON starts_with(s.tag, 'RUNE_') AND u.tag = 'UNIQUE_' || s.tag""",
)
def tag_to_id(spark, d):
    names = t.items(spark, d).select(F.col("id").alias("item_id"), "name")
    sales = t.sales(spark, d).join(names, ["item_id"])
    tag = F.concat(t.pick(["RUNE_", "", "NO_"], F.col("seller_id")), F.upper(F.translate("name", " ", "_")))
    return lookups.tag_to_id(sales.select("auction_id", "line", tag.alias("tag")), rune_items(spark, d))


SKIN_PREFIX = ["PET_SKIN_", ""]


@query(
    "skin_to_id",
    f"""WITH i AS (SELECT tag, min(id) AS id FROM (SELECT p_partkey AS id, [{words(SKIN_PREFIX)}][p_size % 2 + 1] || upper(p_type) || '_' || p_size % 7 AS tag FROM part) GROUP BY tag),
s AS (SELECT event_id, ['LARGE', 'SMALL', 'HUGE', 'PROMO'][user_id % 4 + 1] || '_' || user_id % 9 AS skin FROM events)
SELECT event_id, skin, coalesce(a.id, b.id, 0) AS skin_id FROM s LEFT JOIN i a ON a.tag = 'PET_SKIN_' || skin LEFT JOIN i b ON b.tag = skin""",
)
def skin_to_id(spark, d):
    size = F.col("hit_count")
    tag = F.concat(t.pick(SKIN_PREFIX, size), F.upper("category"), F.lit("_"), (size % 7).cast("string"))
    user = F.col("user_id")
    skin = F.concat(t.pick(["LARGE", "SMALL", "HUGE", "PROMO"], user), F.lit("_"), (user % 9).cast("string"))
    return lookups.skin_to_id(t.feed(spark, d).select("event_id", skin.alias("skin")), t.items(spark, d).select("id", tag.alias("tag")))


CLEAN = f"""trim(regexp_replace(CASE WHEN ((lower(string_split(n, ' ')[1]) IN ({words(sorted({w.lower() for w in item_rules.REFORGES}))})
  AND coalesce(string_split(n, ' ')[2], '') <> 'Dragon') OR starts_with(n, '◆')) AND contains(n, ' ') THEN n[strpos(n, ' ') + 1:] ELSE n END, '\\[Lvl [0-9]{{1,3}}\\] ', '', 'g'))"""
CLEANED = f"""(SELECT p_partkey AS id, full_name, {CLEAN} AS clean FROM (SELECT *, translate(trim(full_name, '✪'), '⚚✦', '') AS n
  FROM (SELECT p_partkey, {FULL_NAME} AS full_name FROM part)))"""


@query("clean_names", f"SELECT id, full_name, clean FROM {CLEANED}")
def clean_names(spark, d):
    from marketlens.functions.names import clean_item_name

    return t.items(spark, d).select("id", "full_name", clean_item_name(F.col("full_name")).alias("clean"))


@query(
    "name_to_item",
    f"""WITH asked AS (SELECT id, CASE WHEN id % 4 = 0 THEN upper(full_name) ELSE full_name END AS full_name FROM {CLEANED}),
c AS (SELECT id, full_name, {CLEAN} AS clean FROM (SELECT *, translate(trim(full_name, '✪'), '⚚✦', '') AS n FROM asked)),
alt AS (SELECT name, min(item_id) AS item_id FROM (SELECT {TITLE_NAME} AS name, p_partkey + 2 AS item_id FROM part) GROUP BY name),
tags AS (SELECT p_partkey AS id, upper(p_name) AS tag FROM part), tag1 AS (SELECT tag, min(id) AS id FROM tags GROUP BY tag),
f AS (SELECT c.id, c.full_name, CASE WHEN coalesce(t.id, 0) <> 0 THEN t.id ELSE coalesce(least(a.item_id, b.item_id), 0) END AS found
  FROM c LEFT JOIN tag1 t ON t.tag = clean LEFT JOIN alt a ON a.name = full_name LEFT JOIN alt b ON b.name = clean)
SELECT f.id, f.full_name, CASE WHEN found > 1 THEN found ELSE 0 END AS found_id, CASE WHEN found > 1 AND tags.tag IS NOT NULL THEN tags.tag
  WHEN upper(f.full_name) = f.full_name THEN f.full_name ELSE 'Unknown' END AS found_tag FROM f LEFT JOIN tags ON found > 1 AND tags.id = found""",
)
def name_to_item(spark, d):
    items = t.items(spark, d)
    asked = items.select("id", F.when(F.col("id") % 4 == 0, F.upper("full_name")).otherwise(F.col("full_name")).alias("full_name"))
    alt = items.select((F.col("id") + 2).alias("item_id"), F.initcap("name").alias("name"))
    catalogue = items.select("id", F.upper("name").alias("tag"))
    return lookups.name_to_item(asked, catalogue, alt)


# Duplicates and counters -----------------------------------------------------


@query(
    "dedup_auctions",
    """SELECT uuid, line, price FROM (SELECT md5(l_orderkey::VARCHAR) AS uuid, l_linenumber AS line, trunc(l_extendedprice)::BIGINT AS price,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, trunc(l_extendedprice)::BIGINT) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedup_auctions(spark, d):
    rows = t.sales(spark, d).select(F.md5(F.col("auction_id").cast("string")).alias("uuid"), "line", F.col("highest_bid").alias("price"))
    return dedup.dedup_auctions(rows, ["line", "price"])


@query(
    "dedup_bids",
    f"""SELECT event_id, bidder, amount, ts FROM (SELECT event_id, user_id AS bidder, k // 20 AS amount, ts,
row_number() OVER (PARTITION BY dayofyear(ts), user_id, k // 20 ORDER BY ts, event_id) AS rn FROM {FEED}) WHERE rn = 1""",
)
def dedup_bids(spark, d):
    bids = t.feed(spark, d).select("event_id", F.col("user_id").alias("bidder"), F.expr("k div 20").alias("amount"), "ts")
    return dedup.dedup_bids(bids, ["ts", "event_id"])


@query(
    "dedup_points",
    """SELECT item_id, date, volume, min(avg) AS avg FROM (SELECT l_suppkey AS item_id, l_shipdate AS date, trunc(l_quantity)::BIGINT AS volume,
trunc(l_extendedprice)::BIGINT AS avg FROM lineitem) GROUP BY ALL""",
)
def dedup_points(spark, d):
    points = t.sales(spark, d).select(
        F.col("seller_id").alias("item_id"), F.col("end").alias("date"), F.col("count").cast("bigint").alias("volume"), F.col("highest_bid").alias("avg")
    )
    return dedup.dedup_points(points, ["avg"])


@query("dedup_enchants", f"SELECT DISTINCT auction_id, type, level FROM {BOOK}")
def dedup_enchants(spark, d):
    return dedup.dedup_enchants(t.enchantments(spark, d))


@query("dedup_names", "SELECT p_name AS name, p_size % 5 AS item_id, min(p_partkey) AS id FROM part GROUP BY 1, 2")
def dedup_names(spark, d):
    return dedup.dedup_names(t.items(spark, d).select("id", "name", (F.col("hit_count") % 5).alias("item_id")))


@query(
    "hit_counts",
    """SELECT c_custkey AS id, c_name AS name, trunc(c_acctbal)::INT + coalesce(n, 0) AS hit_count FROM customer
LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey""",
)
def hit_counts(spark, d):
    looked_up = t.feed(spark, d).select(F.col("user_id").alias("id"))
    return dedup.add_hits(t.players(spark, d), looked_up, "id").select("id", "name", "hit_count")


@query(
    "assign_ids",
    """WITH known AS (SELECT id, slug FROM (SELECT min(p_partkey) + 10 AS id, p_name AS slug FROM part WHERE p_type = 'PROMO' GROUP BY p_name)),
fresh AS (SELECT DISTINCT slug FROM (SELECT p_name AS slug FROM part UNION ALL SELECT p_brand || ' ' || p_name FROM part) WHERE slug NOT IN (SELECT slug FROM known))
SELECT id, slug FROM known UNION ALL SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY md5(slug), slug), slug FROM fresh""",
)
def assign_ids(spark, d):
    items = t.items(spark, d)
    known = items.filter("category = 'PROMO'").groupBy(F.col("name").alias("slug")).agg((F.min("id") + 10).alias("id"))
    seen = items.select(F.col("name").alias("slug")).unionByName(items.select(F.concat_ws(" ", "brand", "name").alias("slug")))
    return dedup.get_or_create_ids(known, seen, ["slug"])


@query(
    "player_ids",
    """SELECT uuid, row_number() OVER (ORDER BY md5(uuid), uuid) AS id FROM (SELECT DISTINCT md5(user_id::VARCHAR) AS uuid FROM events)""",
)
def player_ids(spark, d):
    seen = t.feed(spark, d).select(F.md5(F.col("user_id").cast("string")).alias("uuid")).distinct()
    return dedup.dense_ids(seen, ["uuid"])
