"""Registered queries: catalogue and valuation."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import tables as t
from marketlens.operators import series, valuation as v
from marketlens.operators.skew import FEW_ROWS
from marketlens.plans.listing_queries import values, words
from marketlens.plans.registry import query
from marketlens.rules import colors
from marketlens.rules import items as irules
from marketlens.session import HELD_ROWS, spread, spread_tasks, stored
from marketlens.sources import catalogue as c


def catalogue(spark, d):
    return c.catalogue_from_json(t.catalogue_json(spark, d), "document")


def base_tag(key: str) -> str:
    return f"[{words(t.TAG_HEADS)}][({key}) % {len(t.TAG_HEADS)} + 1] || 'ITEM_' || ({key})"


CAT = f"""(SELECT p_partkey AS id, p_size, CASE WHEN p_partkey % 9 = 4 THEN 'STARRED_' || {base_tag("p_partkey - 4")} ELSE {base_tag("p_partkey")} END AS tag,
  ['common', 'RARE', 'LEGENDARY', 'odd'][p_size % 4 + 1] AS tier, [{words(t.COLORS)}][p_size % 4 + 1] AS color,
  CASE WHEN p_size % 6 <> 5 THEN [{words(t.CATEGORIES)}][p_size % 3 + 1] END AS category, CASE WHEN p_size % 3 <> 2 THEN p_size % 7 END AS n_levels FROM part WHERE p_size <> 1)"""
SLOTS = f"""(SELECT *, row_number() OVER (PARTITION BY tag, slot_type ORDER BY i) - 1 AS nth FROM (SELECT tag, p_size, i, [{words(t.SLOT_TYPES)}][(p_size + i * i) % 3 + 1] AS slot_type,
  (p_size + i) % 4 <> 0 AS priced FROM {CAT}, range(0, 4) r(i) WHERE i < p_size % 5))"""


@query("catalogue_items", f"SELECT tag, tier, color, coalesce(category, '') AS category, coalesce(n_levels, -1) AS n_levels, p_size % 5 AS n_slots FROM {CAT}")
def catalogue_items(spark, d):
    return catalogue(spark, d).select(
        "tag",
        "tier",
        "color",
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce(F.size("upgrade_costs"), F.lit(-1)).alias("n_levels"),
        F.coalesce(F.size("gemstone_slots"), F.lit(0)).alias("n_slots"),
    )


STONE_NAMES = ["Gilded", "jaded", "Fang-tastic Chocolate Chip", "aote_stone", "nonsense"]


@query(
    "reforge_stones",
    f"""SELECT item, reforge, tier, cost FROM (SELECT 'STONE_' || p_partkey AS item, CASE p_partkey % 5 WHEN 0 THEN 'Gilded' WHEN 1 THEN 'jaded' WHEN 3 THEN 'aote_stone' END AS reforge, p_size AS s FROM part),
LATERAL (VALUES ('COMMON', s * 10), ('VERY_SPECIAL', s * 20)) x(tier, cost) WHERE reforge IS NOT NULL""",
)
def reforge_stones(spark, d):
    name = t.pick(STONE_NAMES, F.col("id"))
    costs = F.create_map(F.lit("COMMON"), F.col("hit_count") * 10, F.lit("Very Special"), F.col("hit_count") * 20, F.lit("NO TIER"), F.lit(1))
    stone = F.struct(name.alias("reforgeName"), F.lit("no-such").alias("internalName"), costs.alias("reforgeCosts"))
    key = F.concat(F.lit("STONE_"), F.col("id").cast("string"))
    documents = t.items(spark, d).select(F.to_json(F.create_map(key, stone)).alias("document"))
    return c.reforge_stones(documents, "document").select("item", "reforge", "tier", "cost")


ASKED = f"""(SELECT l_orderkey AS auction_id, l_linenumber AS line, {base_tag("l_partkey")} AS tag, (l_linenumber - 1)::INT AS base_tier, ceil(l_quantity / 5)::INT AS tier FROM lineitem)"""


@query(
    "star_costs",
    f"""WITH a AS (SELECT a.*, p_size, n_levels FROM {ASKED} a JOIN {CAT} c ON c.tag = a.tag AND n_levels IS NOT NULL),
b AS (SELECT auction_id, line, 'ESSENCE_WITHER' AS item, (i + 1) * 10 AS n FROM a, range(0, 7) r(i) WHERE i < n_levels AND i >= base_tier AND i < tier
UNION ALL SELECT auction_id, line, 'STAR_' || i, p_size FROM a, range(0, 7) r(i) WHERE i < n_levels AND i >= base_tier AND i < tier
UNION ALL SELECT auction_id, line, star, 1 FROM a JOIN (VALUES {values(irules.MASTER_STARS)}) m(lv, star) ON tier > n_levels AND tier >= lv AND base_tier < lv)
SELECT auction_id, line, item, sum(n)::BIGINT AS n FROM b GROUP BY ALL""",
)
def star_costs(spark, d):
    rows = t.enchantments(spark, d).select(
        "auction_id", "line", t.catalogue_tag(F.col("item_id")).alias("tag"), (F.col("line") - 1).cast("int").alias("base_tier"), F.col("level").alias("tier")
    )
    # items of a row are seldom equal, so adding them up before the shuffle would only fill the memory of the tasks that read
    parts = spread_tasks(rows, HELD_ROWS)
    costs = v.star_costs(rows, catalogue(spark, d), parts=parts).repartition(parts, "auction_id", "line")
    return costs.groupBy("auction_id", "line", "item").agg(F.sum("n").alias("n"))


WANTED_SLOTS = ["JADE_0", "RUBY_0", "RUBY_1", "COMBAT_1", "JADE_0"]
SLOT_COST = f"""u AS (SELECT auction_id, line, tag, slot, slot[:length(slot) - 2] AS slot_type, right(slot, 1)::INT AS nth FROM q),
own AS (SELECT u.*, c.tag IS NOT NULL AS known, s.slot_type IS NOT NULL AS found, s.priced, s.i, s.p_size FROM u JOIN {CAT} c ON c.tag = u.tag LEFT JOIN {SLOTS} s ON s.tag = u.tag AND s.slot_type = u.slot_type AND s.nth = u.nth),
alt AS (SELECT o.auction_id, o.line, o.tag, o.slot, CASE WHEN o.found THEN o.priced ELSE s.priced END AS priced, CASE WHEN o.found THEN o.i ELSE s.i END AS i,
  CASE WHEN o.found THEN o.p_size ELSE s.p_size END AS p_size, NOT o.found AND c.tag IS NULL AS missing
  FROM own o LEFT JOIN {CAT} c ON c.tag = 'STARRED_' || o.tag LEFT JOIN {SLOTS} s ON s.tag = 'STARRED_' || o.tag AND s.slot_type = split_part(o.slot, '_', 1) AND s.nth = right(o.slot, 1)::INT),
sc AS (SELECT auction_id, line, slot, 'unavailable' AS item, 0 AS n FROM alt WHERE missing
  UNION ALL SELECT auction_id, line, slot, 'SKYBLOCK_COIN', p_size * 1000 FROM alt WHERE priced
  UNION ALL SELECT auction_id, line, slot, 'FINE_JADE_GEM', i + 1 FROM alt WHERE priced)"""


@query(
    "slot_costs",
    f"""WITH q AS (SELECT DISTINCT id AS auction_id, 0 AS line, tag, slot FROM {CAT}, (SELECT unnest([{words(WANTED_SLOTS)}]) AS slot) WHERE NOT (p_size % 2 = 0 AND slot = 'RUBY_0')),
{SLOT_COST} SELECT auction_id, slot, item, n::BIGINT AS n FROM sc""",
)
def slot_costs(spark, d):
    items = t.catalogue_json(spark, d).select("id", "p_size", F.get_json_object("document", "$.id").alias("tag"))
    existing = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("RUBY_0"))).otherwise(F.array().cast("array<string>"))
    asked = items.select(F.col("id").alias("auction_id"), "tag", existing.alias("existing"), F.array(*[F.lit(s) for s in WANTED_SLOTS]).alias("result"))
    return v.slot_costs(asked, catalogue(spark, d)).select("auction_id", "slot", "item", "n")


@query(
    "new_slots",
    f"""SELECT DISTINCT p_partkey AS id, slot FROM part, (SELECT unnest([{words(WANTED_SLOTS)}]) AS slot) WHERE NOT (p_size % 2 = 0 AND slot = 'RUBY_0')""",
)
def new_slots(spark, d):
    existing = F.when(F.col("hit_count") % 2 == 0, F.array(F.lit("RUBY_0"))).otherwise(F.array().cast("array<string>"))
    wanted = F.array(*[F.lit(s) for s in WANTED_SLOTS])
    rows = t.items(spark, d).select("id", existing.alias("existing"), wanted.alias("result"))
    return v.new_entries(rows, "existing", "result", "slot").select("id", "slot")


@query("unlockable_slots", f"SELECT tag, slot_type || '_' || (row_number() OVER (PARTITION BY tag, slot_type ORDER BY i) - 1) AS slot FROM {SLOTS} WHERE priced")
def unlockable_slots(spark, d):
    return v.unlockable_slots(catalogue(spark, d))


@query(
    "armor_sets",
    f"""WITH s AS (SELECT DISTINCT [{words(t.SET_NAMES)}][p_size % 3 + 1] AS set_name, tag FROM {CAT} WHERE p_size % 4 = 0)
SELECT set_name, tag FROM s UNION SELECT set_name, item FROM (SELECT DISTINCT set_name FROM s) JOIN (VALUES {values(irules.EXTRA_SET_ITEMS)}) x(st, item) ON upper(set_name) = st""",
)
def armor_sets(spark, d):
    return v.armor_sets(catalogue(spark, d))


@query(
    "pet_item_removal",
    f"""WITH i AS (SELECT CASE WHEN id % 2 = 0 THEN 'PET_ITEM_' ELSE '' END || p_size AS tag, upper(min(tier)) AS tier FROM {CAT} GROUP BY 1),
a AS (SELECT event_id, (user_id % 60)::VARCHAR AS tag FROM events)
SELECT event_id, a.tag, CASE coalesce(s.tier, l.tier, '') WHEN 'COMMON' THEN 25000 WHEN 'RARE' THEN 100000 WHEN 'LEGENDARY' THEN 500000 ELSE 50000 END AS removal_cost
FROM a LEFT JOIN i s ON s.tag = a.tag LEFT JOIN i l ON l.tag = 'PET_ITEM_' || a.tag""",
)
def pet_item_removal(spark, d):
    items = t.catalogue_json(spark, d).select("id", "p_size", F.get_json_object("document", "$.tier").alias("tier")).filter("p_size <> 1")
    tag = F.concat(F.when(F.col("id") % 2 == 0, "PET_ITEM_").otherwise(""), F.col("p_size").cast("string"))
    known = items.groupBy(tag.alias("tag")).agg(F.min("tier").alias("tier"))
    asked = t.feed(spark, d).select("event_id", (F.col("user_id") % 60).cast("string").alias("tag"))
    return v.pet_item_removal(asked, known)


HEXES = ["ff99ff", "1F0030", "000000", "cc5500", "A06540", "FFDC51", "660033", "E7413C", "070008", "123456"]


def _in(codes) -> str:
    return f"hex IN ({words(codes)})"


@query(
    "exotic_color_class",
    f"""WITH d AS (SELECT l_orderkey AS auction_id, l_linenumber AS line, {base_tag("l_partkey")} AS tag, upper([{words(HEXES)}][l_suppkey % 10 + 1]) AS hex FROM lineitem),
j AS (SELECT d.*, category, coalesce(array_to_string(list_transform(string_split(replace(color, ',', ':'), ':'), lambda x: upper(printf('%02x', x::INT))), ''), '') AS own FROM d LEFT JOIN {CAT} c ON c.tag = d.tag),
k AS (SELECT *, CASE WHEN tag LIKE 'GREAT_SPOOK%' THEN {_in(colors.SPOOK)} WHEN tag LIKE 'FAIRY%' THEN {_in(colors.FAIRY)} OR hex = own
  WHEN tag LIKE 'CRYSTAL%' THEN {_in(colors.CRYSTAL)} OR hex = own WHEN tag LIKE 'LEATHER%' THEN true ELSE hex = own END AS original,
  CASE WHEN category IS NULL THEN false WHEN {_in(colors.OG_FAIRY)} THEN true WHEN category = 'BOOTS' THEN hex IN ('660033', '99004C', 'CC0066')
  WHEN category = 'HELMET' THEN hex IN ('FFCCE5', 'FF99CC', 'FF66B2') ELSE false END AS og FROM j)
SELECT auction_id, line, tag, hex, CASE WHEN original THEN 'ORIGINAL' WHEN og THEN 'OG_FAIRY' WHEN {_in(colors.FAIRY)} THEN 'FAIRY' WHEN {_in(colors.UNDYED)} THEN 'UNDYED' WHEN {_in(colors.CRYSTAL)} THEN 'CRYSTAL'
WHEN hex = 'FFDC51' AND tag LIKE 'SHARK_SCALE%' THEN 'GLITCHED' WHEN tag LIKE 'FAIRY\\_%' ESCAPE '\\' AND {_in(colors.SPOOK)} THEN 'SPOOK' ELSE 'EXOTIC' END AS color_class FROM k""",
)
def exotic_color_class(spark, d):
    dyed = t.sales(spark, d).select("auction_id", "line", t.catalogue_tag(F.col("item_id")).alias("tag"), t.pick(HEXES, F.col("seller_id")).alias("hex"))
    return v.color_classes(dyed, catalogue(spark, d)).withColumn("hex", F.upper("hex"))


TIER_WORDS = ["EPIC", "LEGENDARY", "MYTHIC", "RARE"]
REFORGE_WORDS = ["Gilded", "jaded", "None", "withered", "Fabled"]
STONE_WORDS = ["jaded", "withered", "Fabled"]  # the others have a fixed cost or none
# A reforge takes the stone last in order, with that stone's costs only.
STONES = f"""(SELECT item, word AS reforge, tier, cost FROM (SELECT 'STONE_' || p_partkey AS item, [{words(REFORGE_WORDS)}][p_partkey % 5 + 1] AS word, p_size AS s FROM part),
  LATERAL (VALUES ('EPIC', s * 10, s % 2 = 0), ('LEGENDARY', s * 20, s % 3 <> 1), ('MYTHIC', s * 30, true)) x(tier, cost, has) WHERE has AND word IN ({words(STONE_WORDS)}))"""


def reforged_sql(tier: str) -> str:
    return f"""(SELECT r.auction_id, r.line, r.reforge, r.tier, r.day, CASE WHEN s.item IS NOT NULL THEN s.item ELSE coalesce(f.stone, '') END AS stone,
  CASE WHEN s.item IS NOT NULL THEN coalesce(k.cost, 0) WHEN f.cost IS NULL THEN 0 WHEN r.tier = 'MYTHIC' THEN f.cost * 2
  WHEN r.tier IN ('EPIC', 'RARE') THEN f.cost // 2 ELSE f.cost END::BIGINT AS apply_cost
  FROM (SELECT l_orderkey AS auction_id, l_linenumber AS line, [{words(REFORGE_WORDS)}][l_partkey % 5 + 1] AS reforge, {tier} AS tier,
    date_diff('day', TIMESTAMP '1970-01-01', l_shipdate)::INT AS day FROM lineitem) r
  LEFT JOIN (SELECT reforge, max(item) AS item FROM {STONES} GROUP BY reforge) s ON s.reforge = r.reforge
  LEFT JOIN {STONES} k ON k.reforge = r.reforge AND k.item = s.item AND k.tier = r.tier
  LEFT JOIN (VALUES {values(irules.REFORGE_COSTS)}) f(name, stone, cost) ON f.name = r.reforge)"""


REFORGED = reforged_sql(f"[{words(TIER_WORDS)}][l_suppkey % 4 + 1]")


def stones(spark, d):
    """Stone documents of all parts, each with the tiers its size gives it."""
    size = F.col("hit_count")
    costs = F.map_from_entries(
        F.filter(
            F.array(
                F.when(size % 2 == 0, F.struct(F.lit("EPIC").alias("k"), (size * 10).alias("v"))),
                F.when(size % 3 != 1, F.struct(F.lit("Legendary").alias("k"), (size * 20).alias("v"))),
                F.struct(F.lit("MYTHIC").alias("k"), (size * 30).alias("v")),
            ),
            lambda e: e.isNotNull(),
        )
    )
    name = t.pick(REFORGE_WORDS, F.col("id"))
    stone = F.struct(name.alias("reforgeName"), F.lit("no-such").alias("internalName"), costs.alias("reforgeCosts"))
    key = F.concat(F.lit("STONE_"), F.col("id").cast("string"))
    documents = spread(t.items(spark, d)).filter(name.isin(STONE_WORDS)).select(F.to_json(F.create_map(key, stone)).alias("document"))
    return c.reforge_stones(documents, "document")


def reforged(spark, d, tier=None):
    rows = t.sales(spark, d).select(
        "auction_id",
        "line",
        t.pick(REFORGE_WORDS, F.col("item_id")).alias("reforge"),
        (t.pick(TIER_WORDS, F.col("seller_id")) if tier is None else F.lit(tier)).alias("tier"),
        series.day_number(F.col("end")).alias("day"),
    )
    return v.reforge_costs(rows, stored(stones(spark, d), "stones"))


@query("reforge_cost", f"SELECT auction_id, line, reforge, tier, stone, apply_cost FROM {REFORGED}")
def reforge_cost(spark, d):
    return reforged(spark, d).select("auction_id", "line", "reforge", "tier", "stone", "apply_cost")


# Attributes --------------------------------------------------------------------

STAR_VALUES = values(irules.MASTER_STARS)
PROPS = f"""(SELECT l_orderkey AS auction_id, l_linenumber AS line, trunc(l_quantity)::INT AS q, l_suppkey AS supp, ['', '3', '9', '12'][l_suppkey % 4 + 1] AS base,
  CASE WHEN l_partkey % 5 = 0 THEN 'HOT_CRIMSON_HELMET' ELSE {base_tag("l_partkey")} END AS tag, ceil(l_quantity / 5)::INT AS tenth,
  date_diff('day', TIMESTAMP '1970-01-01', l_shipdate)::INT AS day FROM lineitem)"""
# one branch per kind of attribute: (auction_id, line, key, value, item, n, day)
DIRECT = f"""p AS (SELECT *, try_cast(nullif(base, '') AS INT) AS b, q % 15 + 1 AS hpc FROM {PROPS}),
x AS (
SELECT auction_id, line, day, 'hpc' AS key, hpc::VARCHAR AS value, base, 'FUMING_POTATO_BOOK' AS item, CASE WHEN base = '' THEN 1 WHEN b >= 11 AND b < hpc THEN hpc - b ELSE hpc - 10 END AS n FROM p WHERE line = 1 AND hpc > 10
UNION ALL SELECT auction_id, line, day, 'hpc', hpc::VARCHAR, base, 'HOT_POTATO_BOOK', 10 - b FROM p WHERE line = 1 AND hpc > 10 AND base <> '' AND NOT (b >= 10 AND b < hpc) AND 10 - b > 1
UNION ALL SELECT auction_id, line, day, 'hpc', hpc::VARCHAR, base, 'HOT_POTATO_BOOK', CASE WHEN base = '' THEN hpc ELSE hpc - b END FROM p WHERE line = 1 AND hpc <= 10 AND (base = '' OR hpc - b > 1)
UNION ALL SELECT auction_id, line, day, 'upgrade_level', tenth::VARCHAR, base, star, 1 FROM p JOIN (VALUES {STAR_VALUES}) m(lv, star)
  ON lv <= tenth AND (lv = tenth OR base <> '') AND NOT (base <> '' AND b >= 6 AND b < tenth AND lv <= b) WHERE line = 2 AND tenth >= 6 AND tag <> 'HOT_CRIMSON_HELMET'
UNION ALL SELECT auction_id, line, day, 'RUNE_ZAP', (q % 3 + 1)::VARCHAR, base, item, n FROM p, LATERAL (VALUES ('RUNE_ZAP_' || (q % 3 + 1), 1), ('RUNE_ZAP', CASE q % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 12 END), ('UNIQUE_RUNE_ZAP', 1)) r(item, n) WHERE line = 3 AND supp % 2 = 0
UNION ALL SELECT auction_id, line, day, 'RUNE_SPELLBOUND', (q % 3 + 1)::VARCHAR, base, item, 1 FROM p, LATERAL (VALUES ('RUNE_SPELLBOUND_' || (q % 3 + 1)), ('RUNE_SPELLBOUND'), ('UNIQUE_RUNE_SPELLBOUND')) r(item) WHERE line = 3 AND supp % 2 = 1
UNION ALL SELECT auction_id, line, day, 'ability_scroll', CASE WHEN q % 2 = 0 THEN 'WITHER 12,IMPLODE' ELSE 'IMPLODE' END, base, item, 1 FROM p, (SELECT unnest(['WITHER', '12', 'IMPLODE']) AS item) WHERE line = 4 AND (q % 2 = 0 OR item = 'IMPLODE') AND item <> base
UNION ALL SELECT auction_id, line, day, 'talisman_enrichment', CASE WHEN q % 2 = 0 THEN 'yes' ELSE 'speed' END, base, 'TALISMAN_ENRICHMENT_' || CASE WHEN q % 2 = 0 THEN 'FEROCITY' WHEN base = '' THEN 'SPEED' ELSE 'SWAPPER' END, 1 FROM p WHERE line = 5
UNION ALL SELECT auction_id, line, day, 'hotpc', ['0', '0.1', '1'][q % 3 + 1], base, item, n FROM p, LATERAL (VALUES ('HOT_POTATO_BOOK', CASE WHEN q % 3 = 0 OR base <> '' THEN 10 ELSE 0 END),
  ('FUMING_POTATO_BOOK', CASE q % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE CASE WHEN base = '' THEN 4 ELSE 5 END END)) r(item, n) WHERE line = 6 AND n > 0
UNION ALL SELECT auction_id, line, day, 'farming_for_dummies_count', q::VARCHAR, base, 'FARMING_FOR_DUMMIES', CASE WHEN base = '' THEN q ELSE q - b END FROM p WHERE line = 7 AND supp % 3 = 0 AND (base = '' OR q - b > 1))"""


def with_day(rows):
    return rows.withColumn("day", series.day_number(F.col("end")))


@query(
    "property_ingredients",
    f"""WITH {DIRECT} SELECT auction_id, line, key, value, base, item, sum(n)::BIGINT AS n FROM x GROUP BY ALL""",
)
def property_ingredients(spark, d):
    rows = v.property_ingredients(t.properties(spark, d)).filter("ingredients is not null")
    parts = rows.select("auction_id", "line", "key", "value", "base", F.explode("ingredients").alias("p"))
    return parts.groupBy("auction_id", "line", "key", "value", "base", "p.item").agg(F.sum("p.n").alias("n"))


ALL_PARTS = f"""{DIRECT},
st AS (SELECT p.*, p_size, n_levels FROM p JOIN {CAT} c ON c.tag = p.tag AND n_levels IS NOT NULL WHERE line = 2 AND tenth < 6),
q AS (SELECT auction_id, line, day, tag, slot FROM p, (SELECT unnest(['JADE_0', 'RUBY_1']) AS slot) WHERE line = 7 AND supp % 3 = 2),
u AS (SELECT DISTINCT tag, slot FROM q), su AS (WITH q AS (SELECT tag AS auction_id, 0 AS line, tag, slot FROM u), {SLOT_COST} SELECT auction_id AS tag, slot, item, n FROM sc WHERE item <> 'unavailable'),
parts AS (SELECT auction_id, line, day, key, value, item, n FROM x
UNION ALL SELECT auction_id, line, day, 'upgrade_level', tenth::VARCHAR, 'ESSENCE_WITHER', (i + 1) * 10 FROM st, range(0, 7) r(i) WHERE i < n_levels AND i < tenth
UNION ALL SELECT auction_id, line, day, 'upgrade_level', tenth::VARCHAR, 'STAR_' || i, p_size FROM st, range(0, 7) r(i) WHERE i < n_levels AND i < tenth
UNION ALL SELECT auction_id, line, day, 'COMBAT_0', 'FINE', 'FINE_RUBY_GEM', 1 FROM p WHERE line = 7 AND supp % 3 = 1
UNION ALL SELECT auction_id, line, day, 'unlocked_slots', 'JADE_0,RUBY_1', su.item, su.n FROM q JOIN su USING (tag, slot))"""


@query(
    "ingredient_counts",
    f"""WITH {ALL_PARTS} SELECT auction_id, line, day, key, value, item, sum(n)::BIGINT AS n FROM parts GROUP BY ALL""",
)
def ingredient_counts(spark, d):
    return property_parts(spark, d)


def property_parts(spark, d):
    rows = with_day(t.properties(spark, d))
    return v.property_items(rows, stored(catalogue(spark, d), "catalogue"), ["auction_id", "line", "day"])


def property_rows(spark, d, whole=False):
    rows = with_day(t.properties(spark, d))
    return v.property_rows(rows, stored(catalogue(spark, d), "catalogue"), ["auction_id", "line", "day"], whole=whole)


def dated(prices: str, asked: str, key: str) -> str:
    """CTEs that give dated(key, day, price) for the asked keys and days, by the definition of a dated price."""
    return f"""pr AS ({prices}), ask AS (SELECT DISTINCT {key}, day FROM ({asked})),
seed AS (SELECT {key}, list({{'day': day, 'price': price}} ORDER BY day)[1:5] AS seed FROM pr GROUP BY {key}),
smooth AS (SELECT a.{key}, a.day, greatest(1, list_sort(list(b.price))[len(list(b.price)) // 2 + 1]) AS smoothed FROM pr a JOIN pr b ON a.{key} = b.{key} AND b.day BETWEEN a.day - 2 AND a.day + 2 GROUP BY a.{key}, a.day),
gap AS (SELECT ask.{key}, ask.day FROM ask WHERE NOT EXISTS (SELECT 1 FROM smooth s WHERE s.{key} = ask.{key} AND s.day = ask.day)),
obs AS (SELECT g.{key}, g.day, coalesce(list({{'day': p.day, 'price': p.price}} ORDER BY p.day DESC) FILTER (WHERE p.day IS NOT NULL), [])[1:5] AS obs FROM gap g LEFT JOIN pr p ON p.{key} = g.{key} AND p.day < g.day AND p.day >= g.day - 400 GROUP BY ALL),
fill AS (SELECT o.{key}, o.day, list_sort(list_transform(list_reverse_sort(list_concat(seed.seed, o.obs))[1:5], lambda z: z.price)) AS buf FROM obs o JOIN seed USING ({key})),
dated AS (SELECT ask.{key}, ask.day, coalesce(s.smoothed, CASE WHEN f.buf IS NULL THEN 1 ELSE greatest(1, f.buf[len(f.buf) // 2 + 1]) END)::BIGINT AS price FROM ask LEFT JOIN smooth s ON s.{key} = ask.{key} AND s.day = ask.day LEFT JOIN fill f ON f.{key} = ask.{key} AND f.day = ask.day)"""


COMPONENT_PRICES = f"""SELECT [{words(t.COMPONENT_TAGS)}][l_suppkey % {len(t.COMPONENT_TAGS)} + 1] AS item, date_diff('day', TIMESTAMP '1970-01-01', l_shipdate)::INT AS day,
  trunc(avg(trunc(l_extendedprice)::BIGINT // nullif(trunc(l_quantity)::BIGINT, 0)))::BIGINT AS price FROM lineitem GROUP BY ALL"""


def component_prices(spark, d):
    return series.daily_prices(t.component_sales(spark, d), "tag").withColumnRenamed("tag", "item")


COMPONENT = f"""WITH {ALL_PARTS}, {dated(COMPONENT_PRICES, "SELECT item, day FROM parts", "item")}
SELECT auction_id, line, key, value, sum(n * CASE WHEN parts.item = 'SKYBLOCK_COIN' THEN 1 ELSE price END)::BIGINT AS worth FROM parts JOIN dated ON dated.item = parts.item AND dated.day = parts.day GROUP BY ALL"""


@query("component_value", COMPONENT)
def component_value(spark, d):
    parts = stored(property_rows(spark, d), "parts")
    dated = stored(v.prices_for(component_prices(spark, d), [parts]), "prices")
    return v.component_values(parts, dated, ["auction_id", "line"], few=FEW_ROWS)


ENCHANT_TAGS = ["FUNGI_CUTTER", "HOE", "AXE"]


def enchant_worth_sql(span: int, books: str, sil: str) -> str:
    """Enchantments valued from ``books`` (type, level, day, price) and ``sil`` (day, price), whose days are spans of ``span`` days."""
    return f"""WITH e AS (SELECT l_orderkey AS auction_id, l_linenumber AS line, [{words(t.BOOK_TYPES)}][(l_linenumber - 1) % 7 + 1] AS type, ceil(l_quantity / 5)::INT AS level,
  [{words(ENCHANT_TAGS)}][l_partkey % 3 + 1] AS tag, date_diff('day', TIMESTAMP '1970-01-01', l_shipdate)::INT // {span} AS day,
  CASE WHEN l_suppkey % 2 = 0 THEN CASE WHEN l_suppkey % 4 = 0 THEN l_partkey ELSE 0 END END AS farmed FROM lineitem), b AS ({books}), s AS ({sil}),
j AS (SELECT e.*, x.price AS ex, f.price AS l1, g.price AS l5, six.price AS v6, coalesce(s.price, 8000000) AS sil FROM e LEFT JOIN b x ON x.type = e.type AND x.level = e.level AND x.day = e.day
  LEFT JOIN b f ON f.type = e.type AND f.level = 1 AND f.day = e.day LEFT JOIN b g ON g.type = e.type AND g.level = 5 AND g.day = e.day
  LEFT JOIN b six ON six.type = 'venomous' AND six.level = 6 AND six.day = e.day LEFT JOIN s ON s.day = e.day)
SELECT auction_id, line, type, level, trunc(CASE WHEN ex > 0 AND ex < 500000000 AND (l1 IS NULL OR l1 <= ex) THEN ex
  WHEN type = 'efficiency' AND level >= 6 THEN sil * (level - 5) WHEN type = 'scavenger' AND level = 6 THEN 1000000 WHEN type = 'venomous' AND level = 7 THEN 5000000 + coalesce(v6, 2000000)
  WHEN type = 'ender_slayer' AND level = 7 THEN 51000000 WHEN level > 7 AND l5 > 0 AND type <> 'cultivating' THEN l5 * pow(2, level - 5)
  WHEN l1 > 0 AND type = 'cultivating' THEN CASE WHEN farmed IS NULL THEN l1 + CASE WHEN tag = 'FUNGI_CUTTER' THEN 0.3::DOUBLE ELSE 0.13::DOUBLE END * 100000000 * level / 10
    ELSE l1 + farmed::DOUBLE * CASE WHEN tag = 'FUNGI_CUTTER' THEN 0.3::DOUBLE ELSE 0.13::DOUBLE END END
  WHEN l1 > 0 THEN l1 * pow(2, level - 1) ELSE -1 END)::BIGINT AS worth FROM j"""


DAY = "date_diff('day', TIMESTAMP '1970-01-01', l_shipdate)::INT"
BOOK = f"[{words(t.BOOK_TYPES)}][(l_linenumber - 1) % 7 + 1] AS type, ceil(l_quantity / 5)::INT AS level"
IS_SIL = f"[{words(t.COMPONENT_TAGS)}][l_suppkey % {len(t.COMPONENT_TAGS)} + 1] = 'SIL_EX'"
ENCHANT_WORTH = enchant_worth_sql(
    7,
    f"SELECT {BOOK}, {DAY} // 7 AS day, trunc(avg(trunc(l_extendedprice)::BIGINT))::DOUBLE AS price FROM lineitem GROUP BY ALL",
    f"SELECT {DAY} // 7 AS day, trunc(avg(trunc(l_extendedprice)::BIGINT))::DOUBLE AS price FROM lineitem WHERE {IS_SIL} GROUP BY ALL",
)


def smoothed_sql(daily: str, keys: list[str]) -> str:
    """Each observed day's upper median over the days present from two before to two after, at least 1."""
    of, same = "".join(f"a.{k}, " for k in keys), "".join(f"a.{k} = n.{k} AND " for k in keys)
    return f"""SELECT {of}a.day, greatest(1, list_sort(list(n.price))[len(list(n.price)) // 2 + 1])::DOUBLE AS price
  FROM ({daily}) a JOIN ({daily}) n ON {same}n.day BETWEEN a.day - 2 AND a.day + 2 GROUP BY {of}a.day"""


# As ``value_columns`` takes them: whole-coin unit prices per day, smoothed, of observed days only.
DAILY_ENCHANT_WORTH = enchant_worth_sql(
    1,
    smoothed_sql(f"SELECT {BOOK}, {DAY} AS day, trunc(avg(trunc(l_extendedprice)::BIGINT))::BIGINT AS price FROM lineitem GROUP BY ALL", ["type", "level"]),
    smoothed_sql(f"SELECT {DAY} AS day, trunc(avg(trunc(l_extendedprice)::BIGINT // nullif(trunc(l_quantity)::BIGINT, 0)))::BIGINT AS price FROM lineitem WHERE {IS_SIL} GROUP BY ALL", []),
)


def enchant_worth(spark, d, prices, days=1):
    """Enchantments valued from the stored ``prices``, whose days are spans of ``days`` days."""
    source = t.read(spark, d, "lineitem")
    supp, part = F.col("l_suppkey"), F.col("l_partkey")
    farmed = F.when(supp % 4 == 0, F.create_map(F.lit("farmed_cultivating"), part.cast("string"))).otherwise(F.create_map(F.lit("other"), F.lit("1")))
    rows = source.select(
        F.col("l_orderkey").alias("auction_id"),
        F.col("l_linenumber").alias("line"),
        t.pick(t.BOOK_TYPES, F.col("l_linenumber") - 1).alias("type"),
        F.ceil(F.col("l_quantity") / 5).cast("int").alias("level"),
        t.pick(ENCHANT_TAGS, part).alias("tag"),
        F.floor(series.day_number(F.col("l_shipdate")) / days).cast("int").alias("day"),
        F.when(supp % 2 == 0, farmed).alias("flat"),
    )
    return v.enchant_values(rows, prices, few=FEW_ROWS // 10)  # a row holds all levels of a book


def market_sales(spark, d):
    """Sales of enchanted books, one at a time, and of components."""
    tag = F.concat(F.lit("ENCHANTMENT_"), F.upper("type"), F.lit("_"), F.col("level").cast("string"))
    books = t.enchantments(spark, d).select(tag.alias("tag"), "highest_bid", F.lit(1).alias("count"), "end")
    return books.unionByName(t.component_sales(spark, d))


@query("enchant_value", ENCHANT_WORTH)
def enchant_value(spark, d):
    return enchant_worth(spark, d, stored(t.book_prices(spark, d), "book-prices"), 7).select("auction_id", "line", "type", "level", "worth")


INGREDIENTS = f"""WITH r AS (SELECT l_orderkey AS auction_id, l_linenumber AS line, item, date_diff('day', TIMESTAMP '1970-01-01', l_shipdate)::INT AS day
  FROM lineitem JOIN part ON p_partkey = l_partkey, LATERAL (VALUES ('HOT_POTATO_BOOK', true), ('SIL_EX', p_size > 25)) x(item, has) WHERE has),
{dated(COMPONENT_PRICES, "SELECT item, day FROM r", "item")} SELECT auction_id, line, r.item, price FROM r JOIN dated USING (item, day)"""


def ingredients(spark, d):
    tagged = t.items(spark, d).select(t.catalogue_tag(F.col("id")).alias("tag"), "hit_count")
    both = tagged.select("tag", F.lit("HOT_POTATO_BOOK").alias("item")).unionByName(tagged.filter("hit_count > 25").select("tag", F.lit("SIL_EX").alias("item")))
    rows = t.sales(spark, d).select("auction_id", "line", t.catalogue_tag(F.col("item_id")).alias("tag"), series.day_number(F.col("end")).alias("day"))
    return v.ingredients_of(rows, both, ["auction_id", "line"])


@query("ingredient_price", INGREDIENTS)
def ingredient_price(spark, d):
    parts = stored(ingredients(spark, d), "ingredients")
    priced = series.with_price(parts, stored(v.prices_for(component_prices(spark, d), [parts]), "prices"), "item", few=FEW_ROWS)
    return priced.select("auction_id", "line", "item", "price")


REFORGE_WORTH = f"""WITH r AS (SELECT * FROM {reforged_sql("'LEGENDARY'")}), {dated(COMPONENT_PRICES, "SELECT stone AS item, day FROM r", "item")}
SELECT auction_id, line, reforge, apply_cost + coalesce(price, 1) AS worth FROM r LEFT JOIN dated ON item = stone AND dated.day = r.day"""
# Every attribute there is, with the kind and value its line gives it.
ATTRIBUTES = f"""SELECT auction_id, line, CASE line WHEN 1 THEN 'hpc:' || (q % 15 + 1) WHEN 2 THEN 'upgrade_level:' || tenth
  WHEN 3 THEN CASE supp % 2 WHEN 0 THEN 'RUNE_ZAP:' ELSE 'RUNE_SPELLBOUND:' END || (q % 3 + 1) WHEN 4 THEN 'ability_scroll:' || CASE q % 2 WHEN 0 THEN 'WITHER 12,IMPLODE' ELSE 'IMPLODE' END
  WHEN 5 THEN 'talisman_enrichment:' || CASE q % 2 WHEN 0 THEN 'yes' ELSE 'speed' END WHEN 6 THEN 'hotpc:' || ['0', '0.1', '1'][q % 3 + 1]
  ELSE CASE supp % 3 WHEN 0 THEN 'farming_for_dummies_count:' || q WHEN 1 THEN 'COMBAT_0:FINE' ELSE 'unlocked_slots:JADE_0,RUBY_1' END END AS "column" FROM {PROPS}"""


@query(
    "value_columns",
    f"""SELECT auction_id, line, "column", sum(worth)::BIGINT AS worth FROM (SELECT auction_id, line, key || ':' || value AS "column", worth FROM ({COMPONENT})
  UNION ALL SELECT auction_id, line, "column", 0 FROM ({ATTRIBUTES})) GROUP BY ALL
UNION ALL SELECT auction_id, line, '!ench' || type || ':' || level, worth FROM ({DAILY_ENCHANT_WORTH})
UNION ALL SELECT auction_id, line, reforge, worth FROM ({REFORGE_WORTH})
UNION ALL SELECT auction_id, line, item, price FROM ({INGREDIENTS})""",
)
def value_columns(spark, d):
    # The default tier, as no tier is handed on.
    rows, made_of, reforges = stored(property_rows(spark, d, whole=True), "parts"), stored(ingredients(spark, d), "ingredients"), reforged(spark, d, "LEGENDARY")
    parts, nothing = rows.filter("n is not null"), rows.filter("n is null")
    asked = [parts, made_of, reforges.withColumnRenamed("stone", "item")]
    dated = stored(v.prices_for(component_prices(spark, d), asked), "prices")
    enchants = enchant_worth(spark, d, stored(v.observed_prices(market_sales(spark, d)), "observed-prices"))
    return v.value_columns(nothing, parts, enchants, reforges, made_of, dated, ["auction_id", "line"], few=FEW_ROWS)
