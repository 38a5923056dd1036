"""Registered queries: search."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import tables as t
from marketlens.operators import search
from marketlens.plans.attribute_queries import words
from marketlens.plans.listing_queries import CLEAN, TITLE_NAME
from marketlens.plans.registry import query
from marketlens.session import stored

ALT = f"""(SELECT p_partkey AS item_id, {TITLE_NAME} AS name, p_size % 7 AS occured_times FROM part
UNION ALL SELECT p_partkey, 'Enchanted ' || {TITLE_NAME}, p_size % 5 FROM part WHERE p_size > 25
UNION ALL SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'Pet' ELSE upper(p_name) || ' ✦' END, p_size FROM part WHERE p_size % 2 = 0)"""


def alt_names(spark, d):
    items = t.items(spark, d)
    title = F.initcap("name")
    size = F.col("hit_count")
    plain = items.select(F.col("id").alias("item_id"), title.alias("name"), (size % 7).alias("occured_times"))
    better = items.filter(size > 25).select(F.col("id").alias("item_id"), F.concat(F.lit("Enchanted "), title).alias("name"), (size % 5).alias("occured_times"))
    odd = F.when(F.col("category") == "PROMO", "Pet").otherwise(F.concat(F.upper("name"), F.lit(" ✦")))
    third = items.filter(size % 2 == 0).select(F.col("id").alias("item_id"), odd.alias("name"), size.alias("occured_times"))
    return plain.unionByName(better).unionByName(third)


@query(
    "best_item_name",
    f"""SELECT item_id, name, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score, name) AS rn FROM
(SELECT item_id, name, CASE WHEN name = 'Pet' THEN 100 ELSE length(name) + CASE WHEN regexp_matches(name, '^[a-zA-Z0-9 ]*$') THEN 0 ELSE 40 END - occured_times END AS score FROM {ALT})) WHERE rn = 1""",
)
def best_item_name(spark, d):
    return search.best_item_name(alt_names(spark, d))


PLAYERS = "(SELECT md5(c_custkey::VARCHAR) AS uuid, c_name AS name, trunc(c_acctbal)::INT AS hit_count FROM customer)"
PLAYER_TERMS = """(SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN upper(c_name) WHEN 1 THEN left(c_name, 16) WHEN 2 THEN left(c_name, 17) WHEN 3 THEN md5(c_custkey::VARCHAR) ELSE 'no ' || c_name END AS term FROM customer)"""


def player_terms(spark, d):
    key = F.col("c_custkey")
    term = (
        F.when(key % 5 == 0, F.upper("c_name"))
        .when(key % 5 == 1, F.left("c_name", F.lit(16)))
        .when(key % 5 == 2, F.left("c_name", F.lit(17)))
        .when(key % 5 == 3, F.md5(key.cast("string")))
        .otherwise(F.concat(F.lit("no "), "c_name"))
    )
    return t.read(spark, d, "customer").select(term.alias("term"))


@query(
    "player_search",
    f"""SELECT term, uuid, name, hit_count, score, position FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score, name, uuid) AS position FROM
(SELECT t.term, p.*, length(name) - hit_count - CASE WHEN lower(name) = lower(term) OR uuid = lower(term) THEN 10000000 ELSE 0 END AS score
FROM {PLAYER_TERMS} t JOIN {PLAYERS} p ON starts_with(lower(name), lower(term)) OR (length(term) > 15 AND uuid = lower(term)) WHERE NOT contains(term, ' '))) WHERE position <= 5""",
)
def player_search(spark, d):
    return search.player_search(player_terms(spark, d), t.players(spark, d)).select("term", "uuid", "name", "hit_count", "score", "position")


# Numbers that shorten a uuid: its first 15 digits without the version (where that is 4), and small ones behind zeros.
NUMBER_TERMS = """(SELECT DISTINCT term, CASE WHEN n < 5000000000 THEN printf('%x', n) ELSE left(printf('%x', n), 12) || '4' || substr(printf('%x', n), 13) END AS start FROM
  (SELECT term, term::BIGINT AS n FROM (SELECT CASE WHEN substr(u, 13, 1) = '4' THEN (('0x' || left(u, 12) || substr(u, 14, 3))::BIGINT)::VARCHAR ELSE lpad((('0x' || left(u, 3))::BIGINT)::VARCHAR, 16, '0') END AS term
   FROM (SELECT md5(c_custkey::VARCHAR) AS u FROM customer)) WHERE length(term) BETWEEN 16 AND 29))"""


@query(
    "player_search_numbers",
    f"""SELECT term, uuid, name, hit_count, length(name) - hit_count AS score, row_number() OVER (PARTITION BY term ORDER BY length(name) - hit_count, name, uuid) AS position
FROM {NUMBER_TERMS} t JOIN {PLAYERS} p ON starts_with(uuid, start) QUALIFY position <= 5""",
)
def player_search_numbers(spark, d):
    """Numeric terms, each taken as the start of a uuid."""
    uuid = F.md5(F.col("c_custkey").cast("string"))
    long = F.conv(F.concat(F.left(uuid, F.lit(12)), F.substr(uuid, F.lit(14), F.lit(3))), 16, 10)
    small = F.lpad(F.conv(F.left(uuid, F.lit(3)), 16, 10), 16, "0")
    term = F.when(F.substr(uuid, F.lit(13), F.lit(1)) == "4", long).otherwise(small)
    terms = t.read(spark, d, "customer").select(term.alias("term")).filter(F.length("term").between(16, 29))
    return search.player_search(terms, t.players(spark, d)).select("term", "uuid", "name", "hit_count", "score", "position")


@query("direct_player_hits", f"SELECT term, uuid, hit_count + 10000000 AS hit_count FROM (SELECT DISTINCT 'Customer#' || lpad((user_id * 3)::VARCHAR, 9, '0') AS term FROM events) JOIN {PLAYERS} ON name = term")
def direct_player_hits(spark, d):
    name = F.concat(F.lit("Customer#"), F.lpad((F.col("user_id") * 3).cast("string"), 9, "0"))
    return search.direct_hits(t.feed(spark, d).select(name.alias("term")), t.players(spark, d))


LEADS = ["", "Sharp ", "enchanted ", "[Lvl 3] "]
ITEM_TERMS = f"""(SELECT DISTINCT CASE WHEN p_size % 10 = 9 THEN upper(replace(p_name, ' ', '_')) ELSE [{words(LEADS)}][p_size % 4 + 1] || left(p_name, 3 + p_size % 9) END AS term FROM part)"""


def item_terms(spark, d):
    size = F.col("hit_count")
    short = F.concat(t.pick(LEADS, size), F.left("name", 3 + size % 9))
    return t.items(spark, d).select(F.when(size % 10 == 9, F.upper(F.translate("name", " ", "_"))).otherwise(short).alias("term"))


FOUND = f"""(SELECT term, cleaned, item_id, main, tag, hit_count, score, position FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score, main, item_id) AS position FROM
(SELECT term, cleaned, p.item_id, main, tag, hit_count, length(main) // 2 - hit_count - CASE WHEN lower(main) = lower(cleaned) THEN 10000000 ELSE 0 END AS score
 FROM (SELECT term, {CLEAN} AS cleaned FROM (SELECT term, translate(trim(term, '✪'), '⚚✦', '') AS n FROM {ITEM_TERMS})) q,
 (SELECT p_partkey AS item_id, p_name AS main, upper(replace(p_name, ' ', '_')) || '_' || p_partkey AS tag, p_size AS hit_count FROM part) p
 WHERE starts_with(lower(tag), lower(replace(term, ' ', '_'))) OR EXISTS (SELECT 1 FROM {ALT} n WHERE n.item_id = p.item_id AND
  (starts_with(lower(n.name), lower(cleaned)) OR starts_with(lower(n.name), lower('Enchanted ' || cleaned)) OR starts_with(lower(n.name), lower(term)))))) WHERE position <= 5)"""


def found_items(spark, d):
    return search.item_search(item_terms(spark, d), t.items(spark, d), alt_names(spark, d))


@query("item_search", f"SELECT term, item_id, main, hit_count, score, position FROM {FOUND}")
def item_search(spark, d):
    return found_items(spark, d).select("term", "item_id", "main", "hit_count", "score", "position")


@query(
    "item_search_results",
    f"""SELECT f.term, f.item_id, f.position, coalesce(min(n.name), any_value(main)) AS shown FROM {FOUND} f
LEFT JOIN {ALT} n ON n.item_id = f.item_id AND starts_with(lower(n.name), lower(cleaned)) GROUP BY f.term, f.item_id, f.position""",
)
def item_search_results(spark, d):
    return search.shaped_results(stored(found_items(spark, d), "found"), alt_names(spark, d)).select("term", "item_id", "position", "shown")


FUZZY_TEXT = "rde wi"


@query(
    "fuzzy_item_search",
    "WITH pat AS (SELECT i, p FROM (VALUES "
    + ", ".join(f"({i}, '{p}%')" for i, p in enumerate(search.correction_patterns(FUZZY_TEXT)))
    + f""") v(i, p)), h AS (SELECT item_id, min(i) AS pattern FROM {ALT} JOIN pat ON lower(name) LIKE p GROUP BY 1)
SELECT item_id, pattern, p_name AS name, p_size AS hit_count FROM h JOIN part ON p_partkey = item_id WHERE pattern = (SELECT min(pattern) FROM h) ORDER BY p_size, item_id LIMIT 5""",
)
def fuzzy_item_search(spark, d):
    found = search.fuzzy_item_search(FUZZY_TEXT, t.items(spark, d), alt_names(spark, d))
    return found.select("item_id", "pattern", "name", "hit_count")


# Every way to mistype the start of an item's name, by its size: two letters changed places, one is missing, one is doubled.
MISTYPED = """(SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN left(s, a) || substr(s, a + 2, 1) || substr(s, a + 1, 1) || substr(s, a + 3) WHEN 1 THEN left(s, a) || substr(s, a + 2) ELSE left(s, a) || substr(s, a) END AS term
  FROM (SELECT p_size, left(p_name, 4 + p_size % 12) AS s, 1 + p_size % 3 AS a FROM part))"""
PATTERNS = f"""(SELECT term, i - 2 AS number, left(w, i - 1) || '__' || substr(w, i + 2) || '%' AS p FROM (SELECT term, lower(term) AS w FROM {MISTYPED}), range(2, 16) r(i) WHERE i < length(w) AND length(w) BETWEEN 4 AND 16
  UNION ALL SELECT term, length(w) - 2 + i - 1, left(w, i) || '_' || substr(w, i + 1) || '%' FROM (SELECT term, lower(term) AS w FROM {MISTYPED}), range(1, 16) r(i) WHERE i < length(w) AND length(w) BETWEEN 4 AND 16
  UNION ALL SELECT term, 2 * length(w) - 3 + i - 1, left(w, i) || substr(w, i + 2) || '%' FROM (SELECT term, lower(term) AS w FROM {MISTYPED}), range(1, 16) r(i) WHERE i < length(w) AND length(w) BETWEEN 4 AND 16)"""


@query(
    "fuzzy_search_terms",
    f"""WITH n AS (SELECT DISTINCT lower(name) AS low FROM {ALT}), h AS (SELECT term, number, low FROM {PATTERNS} JOIN n ON low LIKE p),
f AS (SELECT term, min(number) AS pattern FROM h GROUP BY term),
i AS (SELECT DISTINCT f.term, pattern, a.item_id FROM f JOIN h ON h.term = f.term AND h.number = f.pattern JOIN {ALT} a ON lower(a.name) = h.low)
SELECT term, item_id, pattern::INT AS pattern, p_name AS name, p_size AS hit_count, row_number() OVER (PARTITION BY term ORDER BY p_size, item_id) AS position FROM i JOIN part ON p_partkey = item_id QUALIFY position <= 5""",
)
def fuzzy_search_terms(spark, d):
    size, name = F.col("hit_count"), F.col("name")
    start, a = F.left(name, 4 + size % 12), 1 + size % 3
    rest = lambda k: F.substr(start, a + k)
    swapped = F.concat(F.left(start, a), F.substr(start, a + 2, F.lit(1)), F.substr(start, a + 1, F.lit(1)), rest(3))
    term = F.when(size % 3 == 0, swapped).when(size % 3 == 1, F.concat(F.left(start, a), rest(2))).otherwise(F.concat(F.left(start, a), rest(0)))
    found = search.fuzzy_search(t.items(spark, d).select(term.alias("term")), t.items(spark, d), alt_names(spark, d))
    return found.select("term", "item_id", "pattern", "name", "hit_count", "position")


@query("most_popular_players", "SELECT c_custkey AS id, c_name AS name, trunc(c_acctbal)::INT AS hit_count FROM customer ORDER BY 3 DESC, 2 LIMIT 100")
def most_popular_players(spark, d):
    return search.most_popular(t.players(spark, d).select("id", "name", "hit_count"), 100)
