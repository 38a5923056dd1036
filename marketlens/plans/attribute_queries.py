"""Registered queries: attributes and text normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import tables as t
from marketlens.functions import ids, names, numbers
from marketlens.operators import attributes as a
from marketlens.operators.dictionaries import extend_dictionary, known_ids
from marketlens.operators.export import export_pages, exported
from marketlens.plans.listing_queries import TITLED, values, words
from marketlens.plans.price_queries import FEED
from marketlens.plans.registry import query
from marketlens.rules import enchants as erules
from marketlens.rules import properties as prules
from marketlens.session import new_folder, stored

EV = """(SELECT event_id AS auction_id, event_type, user_id::VARCHAR AS u, json_extract(props, '$.k')::BIGINT::VARCHAR AS k, md5(event_id::VARCHAR) AS h FROM events)"""
UUID = "h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32]"


def _flat_sql() -> str:
    """(key, type, text) of every shape, written out."""
    rows = [
        ("true", "uuid", "STRING", UUID),
        ("true", "uid", "STRING", "h[21:32]"),
        ("true", "hpc", "BIGINT", "k"),
        ("true", "exp", "DECIMAL", "k || '.25'"),
        ("true", "color", "STRING", "k || ':0:7'"),
        ("event_type = 'error'", "type", "STRING", "'BEE'"),
        ("event_type = 'error'", "heldItem", "STRING", "'HELD_' || u"),
        ("event_type = 'error'", "hideInfo", "BOOLEAN", "'False'"),
        ("event_type = 'error'", "blaze_kills", "BIGINT", "k"),
        ("event_type = 'error'", "skin", "STRING", "'BEE_BLUE'"),
        ("event_type = 'click'", "JADE_0", "STRING", "'FINE'"),
        ("event_type = 'click'", "JADE_0.uuid", "STRING", "h[1:12]"),
        ("event_type = 'click'", "RUBY_1", "STRING", "'FLAWED'"),
        ("event_type = 'click'", "unlocked_slots", "ARRAY", "'A_0,B_0'"),
        ("event_type = 'view'", "RUNE_ZAP", "BIGINT", "k"),
        ("event_type = 'view'", "deep_kills", "BIGINT", "k"),
        ("event_type = 'view'", "near", "BIGINT", "'1'"),
        ("event_type = 'view'", "big_count", "BIGINT", "'9007199254740993'"),
        ("event_type = 'view'", "ability_scroll", "STRING", "'IMPLODE WITHER'"),
        ("event_type = 'signup'", "potion", "STRING", "'speed'"),
        ("event_type = 'signup'", "hook.part", "STRING", "'HOOK_' || u"),
        ("event_type = 'signup'", "hook.uuid", "STRING", "h[1:12]"),
        ("event_type = 'signup'", "engine.id", "STRING", "'ENGINE_1'"),
        ("event_type = 'signup'", "engine.uuid", "STRING", "h[1:12]"),
        ("event_type = 'signup'", "speed", "BIGINT", "k"),
        ("event_type = 'signup'", "uniqueId", "STRING", "'gone'"),
        ("event_type = 'purchase'", "ZOMBIE", "BIGINT", "'2'"),
        ("event_type = 'purchase'", "SKELETON", "BIGINT", "'1'"),
        ("event_type = 'purchase'", "effect", "STRING", "'SPEED'"),
        ("event_type = 'purchase'", "level", "BIGINT", "k"),
        ("event_type = 'purchase'", "cake_owner", "STRING", "'a' || u || 'ዞ'"),
        ("event_type = 'purchase'", "note", "STRING", "'n' || u"),
    ]
    return " UNION ALL ".join(
        f"SELECT auction_id, event_type, u, h, '{key}' AS key, '{kind}' AS type, {text} AS text FROM ev WHERE {where}" for where, key, kind, text in rows
    )


FLAT = f"(WITH ev AS {EV} {_flat_sql()})"


def flat(spark, d):
    return a.flat_rows(t.attribute_items(spark, d))


@query("flatten_attributes", f"SELECT auction_id, key, type, text FROM {FLAT}")
def flatten_attributes(spark, d):
    return flat(spark, d).select("auction_id", "key", "type", "text")


HEXNUM = """list_reduce(list_transform(string_split({h}, ''), lambda c: (strpos('0123456789abcdef', c) - 1)::HUGEINT), lambda x, y: x * 16 + y)::BIGINT"""
ROUTED = f"""(SELECT auction_id, key, CASE WHEN type IN ('BIGINT', 'DECIMAL') THEN 'number' WHEN key IN ('uuid', 'uid') OR key LIKE '%.uuid' THEN 'id'
  WHEN key IN ('hideInfo', 'type', 'uniqueId') THEN 'drop' WHEN key = 'skin' THEN 'skin' WHEN key IN ({words(prules.ITEM_KEYS)}) THEN 'item'
  WHEN key IN ({words(prules.TEXT_KEYS)}) THEN 'text' WHEN key = 'color' THEN 'color' ELSE 'json' END AS route, text, u, h FROM {FLAT})"""
NUMBERED = f"""(SELECT auction_id, key, route, text,
  CASE route WHEN 'number' THEN CASE WHEN text LIKE '%.25' THEN replace(text, '.25', '')::BIGINT ELSE text::BIGINT END
  WHEN 'id' THEN {HEXNUM.format(h="CASE WHEN key LIKE '%.uuid' THEN h[1:12] ELSE h[21:32] END")}
  WHEN 'color' THEN CASE WHEN string_split(text, ':')[1]::BIGINT * 16777216 + 1792 >= 2147483648 THEN string_split(text, ':')[1]::BIGINT * 16777216 + 1792 - 4294967296
    ELSE string_split(text, ':')[1]::BIGINT * 16777216 + 1792 END END AS number,
  CASE route WHEN 'text' THEN replace(text, 'ዞ', 'H') WHEN 'json' THEN '"' || text || '"' END AS entry FROM {ROUTED} WHERE route <> 'drop')"""


@query(
    "route_attributes",
    f"SELECT auction_id, key, route, coalesce(number, -1) AS number, coalesce(entry, '') AS entry FROM {NUMBERED}",
)
def route_attributes(spark, d):
    return a.routed(flat(spark, d)).select(
        "auction_id", "key", "route", F.coalesce("number", F.lit(-1)).alias("number"), F.coalesce("entry", F.lit("")).alias("entry")
    )


# Items the attributes name: the tag of a held item or a hook ends in the user, the id is the key.
NAMED = """(SELECT p_partkey + 1000 AS id, CASE p_size % 3 WHEN 0 THEN 'HELD_' || p_partkey WHEN 1 THEN 'HOOK_' || p_partkey ELSE 'PET_SKIN_BEE_BLUE' END AS tag FROM part)"""


def named_items(spark, d):
    size, key = F.col("hit_count") % 3, F.col("id").cast("string")
    tag = F.when(size == 0, F.concat(F.lit("HELD_"), key)).when(size == 1, F.concat(F.lit("HOOK_"), key)).otherwise(F.lit("PET_SKIN_BEE_BLUE"))
    return t.items(spark, d).select((F.col("id") + 1000).alias("id"), tag.alias("tag"))


ENCODED = f"""n AS (SELECT * FROM {NUMBERED}), keys AS (SELECT slug, row_number() OVER (ORDER BY md5(slug), slug) AS id FROM (SELECT DISTINCT key AS slug FROM n)),
vals AS (SELECT key, entry, row_number() OVER (ORDER BY md5(key || chr(31) || entry), key, entry) AS id FROM (SELECT DISTINCT key, entry FROM n WHERE entry IS NOT NULL)),
tags AS (SELECT tag, min(id) AS id FROM {NAMED} GROUP BY tag),
enc AS (SELECT auction_id, keys.slug, keys.id AS key_id, CASE WHEN route IN ('number', 'id', 'color') THEN number WHEN n.entry IS NOT NULL THEN vals.id
  WHEN route = 'item' THEN coalesce(tags.id, 0) ELSE coalesce(skin.id, 0) END AS value FROM n JOIN keys ON keys.slug = n.key
  LEFT JOIN vals ON vals.key = n.key AND vals.entry = n.entry LEFT JOIN tags ON route = 'item' AND tags.tag = text
  LEFT JOIN tags skin ON route = 'skin' AND skin.tag = 'PET_SKIN_' || text)"""


def dictionaries(spark, rows):
    """Keys and values of all attributes, as tables of their own."""
    no_keys = spark.createDataFrame([], "id bigint, slug string")
    no_values = spark.createDataFrame([], "id bigint, key string, value string")
    return stored(a.key_dictionary(no_keys, rows), "keys"), stored(a.value_dictionary(no_values, rows), "values")


def encoded(spark, d, only: list[str] | None = None):
    """Encoded attributes, of all keys or of some; the dictionaries always hold all."""
    rows = stored(a.routed(flat(spark, d)), "attributes")
    keys, held = dictionaries(spark, rows)
    return a.encoded(rows if only is None else rows.filter(F.col("key").isin(only)), keys, held, named_items(spark, d)), keys


@query("encode_attributes", f"WITH {ENCODED} SELECT auction_id, key_id, value FROM enc")
def encode_attributes(spark, d):
    return encoded(spark, d)[0]


@query("attribute_filter", f"WITH {ENCODED} SELECT event_id, user_id, ts FROM events WHERE event_id IN (SELECT auction_id FROM enc WHERE slug = 'hpc' AND value = 42)")
def attribute_filter(spark, d):
    auctions = t.feed(spark, d).withColumnRenamed("event_id", "auction_id")
    found = a.with_asked_attribute(auctions, a.routed(flat(spark, d).filter("key = 'hpc'")), "hpc", "42")
    return found.select(F.col("auction_id").alias("event_id"), "user_id", "ts")


@query("attribute_lookup", f"WITH {ENCODED} SELECT event_id, user_id, ts FROM events WHERE event_id IN (SELECT auction_id FROM enc WHERE slug = 'hpc' AND value = 42)")
def attribute_lookup(spark, d):
    """The same answer from the encoded look-up table, as it stands once it is kept."""
    lookup, keys = encoded(spark, d, ["hpc"])
    key_id = keys.filter("slug = 'hpc'").select("id").scalar()
    events = t.feed(spark, d).withColumnRenamed("event_id", "auction_id")
    return a.with_attribute(events, lookup, key_id, 42).select(F.col("auction_id").alias("event_id"), "user_id", "ts")


@query(
    "attribute_features",
    f"""WITH {ENCODED}, f AS (SELECT slug, feature FROM (VALUES {values([(k, i + 1) for i, k in enumerate(prules.FEATURE_KEYS)])}) v(slug, feature)),
x AS (SELECT auction_id, feature, value, count(*) AS copies FROM enc JOIN f USING (slug) GROUP BY ALL),
at_ AS (SELECT auction_id, string_agg(feature || '=' || value || 'x' || copies, ' ' ORDER BY feature, value) AS attributes FROM x GROUP BY 1)
SELECT event_id AS auction_id, ts AS "end", round(value * 100)::BIGINT AS highest_bid, coalesce(attributes, '') AS attributes,
CASE event_type WHEN 'click' THEN 'growth:5x1 ultimate_reiterate:2x1 ultimate_wise:1x1 unknown:44x1' WHEN 'purchase' THEN 'sharpness:7x1' ELSE '' END AS enchantments
FROM events LEFT JOIN at_ ON auction_id = event_id WHERE ts > '2024-01-05' AND round(value * 100) > 0""",
)
def attribute_features(spark, d):
    def text(column, first, sep):
        return F.coalesce(F.array_join(F.transform(column, lambda e: F.concat(e[first].cast("string"), F.lit(sep), e["level" if first == "type" else "value"].cast("string"), F.lit("x"), e["copies"].cast("string"))), " "), F.lit(""))

    return features(spark, d).select("auction_id", "end", "highest_bid", text("attributes", "feature", "=").alias("attributes"), text("enchantments", "type", ":").alias("enchantments"))


def features(spark, d):
    lookup, keys = encoded(spark, d, prules.FEATURE_KEYS)
    auctions = t.feed(spark, d).select(
        F.col("event_id").alias("auction_id"), F.col("ts").alias("end"), F.round(F.col("buy_price") * 100).cast("bigint").alias("highest_bid")
    )
    enchants = a.enchant_rows(t.attribute_items(spark, d), t.known_types(spark))
    return a.training_features(auctions, enchants, lookup, keys, "2024-01-05 00:00:00")


# The dictionary of two runs: one over the first events, one over all. Ids of the first stay, new ones follow in order of their hash.
ENTRIES = f"(SELECT DISTINCT key, entry AS value, auction_id <= (SELECT max(event_id) // 3 FROM events) AS early FROM {NUMBERED} WHERE entry IS NOT NULL)"


@query(
    "dictionary_runs",
    f"""WITH e AS (SELECT key, value, CASE WHEN bool_or(early) THEN 0 ELSE 1 END AS run FROM {ENTRIES} GROUP BY ALL)
SELECT key, value, run::BIGINT AS run, row_number() OVER (ORDER BY run, md5(key || chr(31) || value), key, value) AS id FROM e""",
)
def dictionary_runs(spark, d):
    rows = stored(a.routed(flat(spark, d)).filter("entry is not null").select("auction_id", "key", F.col("entry").alias("value")), "entries")
    path = new_folder(spark, "dictionary")
    last = t.read(spark, d, "events").agg(F.floor(F.max("event_id") / 3)).scalar()
    extend_dictionary(path, rows.filter(F.col("auction_id") <= last), ["key", "value"], 0)
    extend_dictionary(path, rows, ["key", "value"], 1)
    return known_ids(spark, path, ["key", "value"]).select("key", "value", "run", "id")


@query(
    "feature_export",
    """SELECT event_id AS auction_id, event_id // 1000 AS page, ts AS "end", round(value * 100)::BIGINT AS highest_bid FROM events WHERE ts > '2024-01-05' AND round(value * 100) > 0""",
)
def feature_export(spark, d):
    """The training features written in pages and read back by the manifest."""
    path = new_folder(spark, "features")
    export_pages(stored(features(spark, d), "feature-rows"), "auction_id", path)
    return exported(spark, path).select("auction_id", F.col("page").cast("bigint").alias("page"), "end", "highest_bid")


@query(
    "enchant_rows",
    """SELECT event_id AS auction_id, type, level FROM events JOIN (VALUES ('click', 'growth', 5), ('click', 'ultimate_reiterate', 2), ('click', 'ultimate_wise', 1),
('click', 'unknown', 44), ('purchase', 'sharpness', 7)) v(kind, type, level) ON kind = event_type""",
)
def enchant_rows(spark, d):
    return a.enchant_rows(t.attribute_items(spark, d), t.known_types(spark))


@query(
    "item_tags",
    """SELECT event_id AS auction_id, CASE event_type WHEN 'error' THEN 'PET_BEE' WHEN 'click' THEN 'DIVAN_HELMET' WHEN 'view' THEN 'RUNE_ZAP'
WHEN 'signup' THEN 'POTION_speed' ELSE 'ENCHANTMENT_SHARPNESS_7' END AS tag FROM events""",
)
def item_tags(spark, d):
    items = t.attribute_items(spark, d)
    tagged = items.select("auction_id", a.item_tag(a.parsed(F.col("attributes"))).alias("tag"))
    return a.single_book_tag(tagged, a.enchant_rows(items, t.known_types(spark)))


@query(
    "soul_counts",
    """SELECT event_id AS auction_id, soul, times FROM events JOIN (VALUES ('ZOMBIE', 2), ('SKELETON', 1)) v(soul, times) ON event_type = 'purchase'""",
)
def soul_counts(spark, d):
    return a.soul_rows(t.attribute_items(spark, d))


@query(
    "first_value_wins",
    """SELECT p_partkey AS id, key, min_by(val, pos) AS val FROM (SELECT p_partkey, unnest(string_split(p_name || ' ' || lower(p_type) || ' ' || p_name, ' ')) AS w,
generate_subscripts(string_split(p_name || ' ' || lower(p_type) || ' ' || p_name, ' '), 1) AS pos FROM part) x, LATERAL (SELECT w[1:1] AS key, w AS val) GROUP BY ALL""",
)
def first_value_wins(spark, d):
    words_ = F.split(F.concat_ws(" ", "name", F.lower("category"), "name"), " ")
    entries = F.transform(words_, lambda w: F.struct(F.left(w, F.lit(1)).alias("key"), w.alias("val")))
    first = t.items(spark, d).select("id", F.explode(a.first_wins(entries)).alias("e"))
    return first.select("id", "e.key", "e.val")


# Names and amounts -----------------------------------------------------------


@query("tag_names", f"""SELECT id, tag, {TITLED.format(tag="tag")} AS name FROM (SELECT p_partkey AS id, 'BOOK_OF_' || upper(replace(p_name, ' ', '_THE_')) || '_' || p_partkey AS tag FROM part)""")
def tag_names(spark, d):
    tag = F.concat(F.lit("BOOK_OF_"), F.upper(F.regexp_replace("name", " ", "_THE_")), F.lit("_"), F.col("id").cast("string"))
    return t.items(spark, d).select("id", tag.alias("tag")).withColumn("name", names.tag_to_name(F.col("tag")))


AMOUNT_ENDS = ["k", "M", "%", " coins", "b", "x", "", "T", "k%"]


@query(
    "parse_amounts",
    f"""WITH x AS (SELECT event_id, CASE WHEN k % 11 = 0 THEN ' ' ELSE k || ',' || (user_id % 10) || [{words(AMOUNT_ENDS)}][event_id % 9 + 1] END AS text FROM {FEED}),
y AS (SELECT *, rtrim(text, '%') AS v FROM x),
z AS (SELECT *, CASE lower(right(v, 1)) WHEN 't' THEN 1e12 WHEN 'b' THEN 1e9 WHEN 'm' THEN 1e6 WHEN 'k' THEN 1e3 ELSE 1 END AS f,
  try_cast(regexp_replace(replace(v, ',', '.'), '[^0-9.]', '', 'g') AS DOUBLE) AS num FROM y)
SELECT event_id, text, CASE WHEN trim(text) = '' THEN 0 ELSE num * f::DOUBLE END AS amount, CASE WHEN trim(text) = '' THEN 0 ELSE round_even(num * f::DOUBLE, 0)::BIGINT END AS whole FROM z""",
)
def parse_amounts(spark, d):
    written = F.concat(F.col("k").cast("string"), F.lit(","), (F.col("user_id") % 10).cast("string"), t.pick(AMOUNT_ENDS, F.col("event_id")))
    text = F.when(F.col("k") % 11 == 0, " ").otherwise(written)
    return t.feed(spark, d).select("event_id", text.alias("text")).select(
        "event_id", "text", numbers.normalize_amount(F.col("text")).alias("amount"), numbers.normalize_long(F.col("text")).alias("whole")
    )


COIN_ENDS = ["k", "M", "B", "", "m", " "]


@query(
    "coin_amounts",
    f"""WITH x AS (SELECT event_id, '§6' || k || CASE WHEN user_id % 2 = 0 THEN '.5' ELSE ',000' END || [{words(COIN_ENDS)}][event_id % 6 + 1] || CASE WHEN event_id % 7 = 0 THEN '' ELSE ' coins' END AS name FROM {FEED}),
y AS (SELECT *, trim(regexp_replace(regexp_replace(name, '§.', '', 'g'), ' coins$', '')) AS v FROM x)
SELECT event_id, name, CASE WHEN name NOT LIKE '% coins' OR v LIKE '%m' THEN 0 ELSE trunc(replace(regexp_replace(v, '[kMB]$', ''), ',', '')::DOUBLE *
  CASE right(v, 1) WHEN 'k' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END::DOUBLE * 10)::BIGINT END AS tenths FROM y""",
)
def coin_amounts(spark, d):
    half = F.when(F.col("user_id") % 2 == 0, ".5").otherwise(",000")
    name = F.concat(F.lit("§6"), F.col("k").cast("string"), half, t.pick(COIN_ENDS, F.col("event_id")), F.when(F.col("event_id") % 7 == 0, "").otherwise(" coins"))
    return t.feed(spark, d).select("event_id", name.alias("name")).withColumn("tenths", numbers.coins_of_name(F.col("name")))


@query(
    "inventory_coins",
    f"""WITH x AS (SELECT user_id, event_id, k, CASE WHEN user_id % 3 <> 0 OR k % 5 <> 0 THEN 'plain' ELSE 'Total Coins Offered:' END AS d FROM {FEED}),
s AS (SELECT user_id, min(event_id) AS e FROM x WHERE d <> 'plain' GROUP BY 1)
SELECT x.user_id, CASE WHEN s.e IS NULL THEN sum(k * 10000) ELSE min(CASE WHEN x.event_id = s.e THEN CASE WHEN k % 2 = 0 THEN k * 1001000 ELSE k * 1000 END END) END::BIGINT AS coins
FROM x LEFT JOIN s USING (user_id) GROUP BY x.user_id, s.e""",
)
def inventory_coins(spark, d):
    from marketlens.operators.valuation import inventory_coins as total

    k = F.col("k")
    stated = F.when(
        k % 2 == 0, F.concat(F.lit("§aTotal Coins Offered:\n§8("), F.format_number(k * 1001000, 0), F.lit(")"))
    ).otherwise(F.concat(F.lit("Total Coins Offered:\n§6"), k.cast("string"), F.lit("k\nmore")))
    text = F.when((F.col("user_id") % 3 != 0) | (k % 5 != 0), "plain").otherwise(stated)
    rows = t.feed(spark, d).select("user_id", "event_id", F.concat(k.cast("string"), F.lit("k coins")).alias("name"), text.alias("description"))
    return total(rows, "user_id", "event_id")


LINES = ["a COMMON thing", "UNCOMMON SWORD", "nothing here", "VERY SPECIAL", "SUPREME", "still nothing", "MYTHIC BOW", "UNKNOWN"]
LINE_TIER = ["COMMON", "UNCOMMON", None, "VERY_SPECIAL", "DIVINE", None, "MYTHIC", "UNKNOWN"]
NAME_COLORS = ["§f§cGod Potion", "§4Skin", "§bDrill", "Plain", "§f§f§cX"]


def _tier_sql(i: str) -> str:
    whens = " ".join(f"WHEN {n} THEN '{tier}'" for n, tier in enumerate(LINE_TIER) if tier)
    return f"CASE {i} {whens} END"


@query(
    "description_tiers",
    f"""SELECT event_id, CASE WHEN f IS NULL OR f = 'UNKNOWN' THEN CASE user_id % 5 WHEN 0 THEN 'SPECIAL' WHEN 1 THEN 'ULTIMATE' WHEN 2 THEN 'DIVINE' WHEN 4 THEN 'SPECIAL' ELSE 'UNKNOWN' END ELSE f END AS tier
FROM (SELECT event_id, user_id, coalesce({_tier_sql("k % 8")}, {_tier_sql("(event_id + k) % 8")}, {_tier_sql("event_id % 8")}) AS f FROM {FEED})""",
)
def description_tiers(spark, d):
    e, k = F.col("event_id"), F.col("k")
    lines = F.array(t.pick(LINES, e), t.pick(LINES, e + k), t.pick(LINES, k))
    tier = names.tier_of_description(lines, t.pick(NAME_COLORS, F.col("user_id")))
    return t.feed(spark, d).select("event_id", tier.alias("tier"))


BOOK_NAMES = ["§9Growth ", "BUY §aDuplex ", "SELL Wise ", "Mystery ", "§aEnchanted Book", "Sharp-ness "]
BOOK_LEVELS = ["IV", "7", "II-III", "XIX", "abc"]


@query(
    "book_tags",
    f"""SELECT event_id, CASE WHEN n IN (4) OR l = 4 THEN '' ELSE 'ENCHANTMENT_' || ['GROWTH', 'ULTIMATE_REITERATE', 'ULTIMATE_WISE', 'UNKNOWN', '', 'UNKNOWN'][n + 1] || '_' || ['4', '7', '2', '19', ''][l + 1] END AS book_tag
FROM (SELECT event_id, event_id % 6 AS n, user_id % 5 AS l FROM events)""",
)
def book_tags(spark, d):
    name = t.pick(BOOK_NAMES, F.col("event_id"))
    name = F.when(name == "§aEnchanted Book", name).otherwise(F.concat(name, t.pick(BOOK_LEVELS, F.col("user_id"))))
    books = t.feed(spark, d).select("event_id", name.alias("name"))
    return a.book_tags(books, t.known_types(spark)).select("event_id", F.coalesce("book_tag", F.lit("")).alias("book_tag"))


@query(
    "color_codes",
    f"""SELECT event_id, r || ':' || g || ':' || b AS rgb, upper(printf('%02x%02x%02x', r, g, b)) AS hex,
CASE WHEN p >= 2147483648 THEN p - 4294967296 ELSE p END AS packed FROM (SELECT *, r * 16777216 + g * 65536 + b * 256 AS p FROM
(SELECT event_id, (k * 2) AS r, user_id % 256 AS g, event_id % 256 AS b FROM {FEED}))""",
)
def color_codes(spark, d):
    color = (F.col("k") * 2 * 65536 + (F.col("user_id") % 256) * 256 + F.col("event_id") % 256).cast("int")
    rgb = t.feed(spark, d).select("event_id", ids.rgb_text(color).alias("rgb"))
    return rgb.select("event_id", "rgb", ids.rgb_hex(F.col("rgb")).alias("hex"), ids.rgb_packed(F.col("rgb")).alias("packed"))


@query(
    "market_times",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN CASE WHEN hour(ts) < 12 THEN date_trunc('minute', ts) WHEN hour(ts) = 12 THEN date_trunc('minute', ts) - INTERVAL 12 HOUR END
ELSE date_trunc('millisecond', ts) END AS at FROM events""",
)
def market_times(spark, d):
    ts = F.col("ts").cast("timestamp")
    hour = F.hour(ts)
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    day = F.concat_ws("/", F.month(ts).cast("string"), F.dayofmonth(ts).cast("string"), F.lit("24"))
    minute = F.lpad(F.minute(ts).cast("string"), 2, "0")
    half = F.when(hour < 12, " AM").otherwise(" PM")
    text = (
        F.when(F.col("event_id") % 3 == 0, F.concat(day, F.lit(" "), twelve.cast("string"), F.lit(":"), minute, half))
        .when(F.col("event_id") % 3 == 1, F.concat(day, F.lit(" "), hour.cast("string"), F.lit(":"), minute))
        .otherwise(F.unix_millis(ts).cast("string"))
    )
    return t.feed(spark, d).select("event_id", text.alias("text")).select("event_id", ids.market_time(F.col("text")).alias("at"))


@query(
    "player_names",
    """SELECT c_custkey AS id, CASE WHEN regexp_full_match(trim(n), '[A-Za-z0-9_]{1,16}') THEN trim(n) END AS name FROM (SELECT c_custkey,
CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN ' ' || c_mktsegment || '_' || c_custkey || ' ' WHEN 2 THEN replace(c_name, '#0', '') ELSE '' END AS n FROM customer)""",
)
def player_names(spark, d):
    people = t.read(spark, d, "customer")
    key = F.col("c_custkey")
    name = (
        F.when(key % 4 == 0, F.col("c_name"))
        .when(key % 4 == 1, F.concat(F.lit(" "), "c_mktsegment", F.lit("_"), key.cast("string"), F.lit(" ")))
        .when(key % 4 == 2, F.replace("c_name", F.lit("#0"), F.lit("")))
        .otherwise(F.lit(""))
    )
    return people.select(key.alias("id"), names.player_name(name).alias("name"))


@query(
    "enchant_display_names",
    f"""WITH shown AS (SELECT low, name FROM (VALUES {values([(v.lower(), k) for k, v in erules.RENAMED.items()])}) v(low, name)),
x AS (SELECT auction_id, line, type, CASE WHEN line % 3 = 0 THEN 'ultimate_reiterate' WHEN line % 3 = 1 THEN type ELSE 'ultimate_' || type END AS raw FROM
  (SELECT l_orderkey AS auction_id, l_linenumber AS line, [{words(t.BOOK_TYPES)}][(l_linenumber - 1) % 7 + 1] AS type FROM lineitem)),
y AS (SELECT *, coalesce(name, CASE WHEN raw LIKE 'ultimate\\_%' ESCAPE '\\' AND raw NOT IN ('ultimate_jerry', 'ultimate_wise') THEN raw[10:] ELSE raw END) AS k FROM x LEFT JOIN shown ON low = raw)
SELECT raw, {TITLED.format(tag="k")} AS shown_name, count(*) AS n FROM y GROUP BY ALL""",
)
def enchant_display_names(spark, d):
    raw = F.when(F.col("line") % 3 == 0, "ultimate_reiterate").when(F.col("line") % 3 == 1, F.col("type")).otherwise(F.concat(F.lit("ultimate_"), "type"))
    rows = t.enchantments(spark, d).select(raw.alias("raw"))
    return rows.groupBy("raw", names.enchant_display_name(F.col("raw")).alias("shown_name")).agg(F.count(F.lit(1)).alias("n"))


SHARD_WORDS = [
    "Wither Spectre", "Zealot Bruiser", "zealot bruiser", "Wild Hog", "Inferno Demonlord", "Bogged", "Cinderbat", "End Stone Protector",
    "Loch Emperor", "Abyssal Lanternfish", "Lotusfish", "Inkling", "Flipflopper", "Seashine", "Beetle", "Earthworm", "field mouse",
    "Stridersurfer",
]


@query(
    "shard_tags",
    f"""WITH renamed(low, to_tag) AS (VALUES ('inferno demonlord', 'BURNINGSOUL'), ('bogged', 'SEA_ARCHER'), ('cinderbat', 'CINDER_BAT'),
('end stone protector', 'ENDSTONE_PROTECTOR'), ('loch emperor', 'SEA_EMPEROR'), ('abyssal lanternfish', 'ABYSSAL_LANTERN'), ('lotusfish', 'LOTUS_FISH'),
('inkling', 'NIGHT_SQUID'), ('flipflopper', 'FLIP_FLOPPER'), ('seashine', 'SEA_SHINE'), ('beetle', 'CROPEETLE'), ('earthworm', 'TERMITE'),
('field mouse', 'PEST'), ('stridersurfer', 'STRIDER_SURFER'), ('wither spectre', 'WITHER_SPECTER'), ('zealot bruiser', 'BRUISER'))
SELECT id, name, CASE WHEN to_tag IS NOT NULL THEN to_tag WHEN upper(name) IN (SELECT upper(p_name) FROM part) THEN upper(replace(name, ' ', '_')) END AS tag
FROM (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN [{words(SHARD_WORDS)}][p_size // 2 % 18 + 1] ELSE p_name END AS name FROM part) LEFT JOIN renamed ON low = lower(name)""",
)
def shard_tags(spark, d):
    """Part names play the names of the shards there are; a name that is neither theirs nor an exception has no tag."""
    items = t.items(spark, d)
    name = F.when(F.col("hit_count") % 2 == 0, t.pick(SHARD_WORDS, F.floor(F.col("hit_count") / 2))).otherwise(F.col("name"))
    known = items.select(F.upper("name").alias("known")).distinct()
    shards = items.select("id", name.alias("name"))
    shards = shards.join(known, F.upper("name") == F.col("known"), "left")
    return shards.select("id", "name", names.shard_tag(F.col("name"), F.col("known").isNotNull()).alias("tag"))


@query(
    "mask_text",
    """SELECT doc_id, CASE WHEN length(text) <= 8 THEN text ELSE substring(text, 1, 3) || regexp_replace(substring(text, 4, length(text) - 8), '[^@]', '*', 'g') || right(text, 5) END AS masked FROM documents""",
)
def mask_text(spark, d):
    return t.read(spark, d, "documents").select("doc_id", names.mask_email(F.col("text")).alias("masked"))


@query(
    "mask_conversations",
    """SELECT conv_id, turn, CASE WHEN length(text) <= 8 THEN text ELSE substring(text, 1, 3) || regexp_replace(substring(text, 4, length(text) - 8), '[^@]', '*', 'g') || right(text, 5) END AS masked FROM conversations""",
)
def mask_conversations(spark, d):
    return t.read(spark, d, "conversations").select("conv_id", "turn", names.mask_email(F.col("text")).alias("masked"))
