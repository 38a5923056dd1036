"""Registered queries: scans, roll-ups, series."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import tables as t
from marketlens.operators import rollup as r
from marketlens.operators import series as s
from marketlens.plans.registry import query
from marketlens.session import HELD_ROWS, spread_tasks
from marketlens.sources.scans import book_rows, order_rows, pulls_with_books

# The market roles in the oracle's own words.
SALES = """(SELECT l_orderkey AS auction_id, l_linenumber AS line, l_partkey AS item_id, l_suppkey AS seller_id,
  trunc(l_extendedprice)::BIGINT AS highest_bid, trunc(l_quantity)::BIGINT AS cnt,
  trunc(l_extendedprice)::BIGINT // nullif(trunc(l_quantity)::BIGINT, 0) AS unit,
  l_shipdate AS "end", l_returnflag AS tier, l_linestatus AS reforge FROM lineitem)"""
FEED = """(SELECT event_id, ts, user_id, event_type AS product_id, value AS buy_price, value * 0.9::DOUBLE AS sell_price,
  json_extract(props, '$.k')::BIGINT AS k, json_extract(props, '$.k')::BIGINT * 1000 AS buy_moving_week,
  json_extract(props, '$.k')::BIGINT * 100000 AS sell_moving_week FROM events)"""
LIVE = """(SELECT event_id, user_id AS item_id, event_type AS tier, round(value * 100)::BIGINT AS highest_bid,
  json_extract(props, '$.k')::BIGINT AS cnt,
  round(value * 100)::BIGINT // nullif(json_extract(props, '$.k')::BIGINT, 0) AS unit, ts AS "end" FROM events)"""
AVG6 = "round({}, 6)"


def live_sales(spark, d):
    """Sales with times inside the day: one per event, the item is the user."""
    return t.feed(spark, d).select(
        "event_id",
        F.col("user_id").alias("item_id"),
        F.col("product_id").alias("tier"),
        F.round(F.col("buy_price") * 100).cast("bigint").alias("highest_bid"),
        F.col("k").alias("count"),
        F.col("ts").alias("end"),
    )


def rounded(df, *columns):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


@query(
    "sold_auction_scan",
    f"""SELECT item_id, seller_id, highest_bid, cnt AS count, "end" FROM {SALES}
WHERE "end" > '1998-01-01' AND "end" < '1999-01-01' AND highest_bid > 1""",
)
def sold_auction_scan(spark, d):
    sold = t.sales(spark, d).filter(r.when_sold("1998-01-01 00:00:00", "1999-01-01 00:00:00"))
    return sold.select("item_id", "seller_id", "highest_bid", F.col("count").cast("bigint").alias("count"), "end")


DAILY = f"""SELECT item_id, date_trunc('day', "end")::TIMESTAMP AS date, avg(unit) AS avg, max(unit) AS max, min(unit) AS min,
sum(cnt)::BIGINT AS volume FROM {SALES} WHERE highest_bid > 1 GROUP BY ALL"""


def daily(spark, d):
    return r.price_rollup(t.sales(spark, d).filter("highest_bid > 1"), ["item_id"])


@query("daily_price_rollup", DAILY)
def daily_price_rollup(spark, d):
    return daily(spark, d)


@query("price_table_scan", f"""SELECT * FROM ({DAILY}) WHERE date > '1998-01-01' AND date <= '1998-07-01'""")
def price_table_scan(spark, d):
    return daily(spark, d).filter((F.col("date") > "1998-01-01") & (F.col("date") <= "1998-07-01"))


HOURLY = f"""SELECT item_id, date_trunc('hour', "end")::TIMESTAMP AS date, avg(unit) AS avg, coalesce(max(unit), -1) AS max,
coalesce(min(unit), -1) AS min, sum(cnt)::BIGINT AS volume FROM {LIVE} WHERE highest_bid > 1 GROUP BY ALL"""


@query("hourly_price_rollup", HOURLY)
def hourly_price_rollup(spark, d):
    hourly = r.price_rollup(live_sales(spark, d).filter("highest_bid > 1"), ["item_id"], "hour")
    return hourly.fillna({"max": -1, "min": -1})


@query("warm_last_day_hours", f"""SELECT * FROM ({HOURLY.replace("WHERE", '''WHERE "end" > '2024-01-19 12:00:00' AND "end" < '2024-01-20 12:00:00' AND ''')})""")
def warm_last_day_hours(spark, d):
    sold = live_sales(spark, d).filter(r.when_sold("2024-01-19 12:00:00", "2024-01-20 12:00:00"))
    return r.price_rollup(sold, ["item_id"], "hour").fillna({"max": -1, "min": -1})


@query(
    "bazaar_snapshot_scan",
    f"""SELECT event_id, ts, product_id, buy_price, sell_price, buy_moving_week FROM {FEED}
WHERE ts >= '2024-01-10' AND ts <= '2024-01-20'""",
)
def bazaar_snapshot_scan(spark, d):
    from marketlens.sources.scans import product_rows, pulls_from_feed

    pulls = pulls_from_feed(t.feed(spark, d))
    rows = product_rows(pulls, "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    return rows.select("event_id", "ts", "product_id", "buy_price", "sell_price", "buy_moving_week")


@query(
    "bazaar_period_rollup",
    f"""SELECT product_id, trunc(avg(buy_moving_week) / 7 / 24 * 240)::INT AS volume,
round(avg(buy_price + sell_price) / 2, 6) AS avg, max(buy_price) AS max, min(sell_price) AS min,
TIMESTAMP '2024-01-10' AS date FROM {FEED} WHERE ts >= '2024-01-10' AND ts <= '2024-01-20' GROUP BY product_id""",
)
def bazaar_period_rollup(spark, d):
    return rounded(r.bazaar_rollup(t.feed(spark, d), "2024-01-10 00:00:00", "2024-01-20 00:00:00"), "avg")


POINTS = f"""(SELECT event_id, user_id, product_id, ts AS date, buy_price AS max, sell_price AS min,
(buy_price + sell_price) / 2 AS avg, sell_moving_week // 7 // 24 // 60 // 6 AS volume FROM {FEED})"""


@query("bazaar_points", f"SELECT * FROM {POINTS}")
def bazaar_points(spark, d):
    return r.bazaar_points(t.feed(spark, d))


@query(
    "sale_points",
    f"""SELECT item_id, "end" AS date, highest_bid AS avg, highest_bid AS min, highest_bid AS max, cnt AS volume FROM {SALES}""",
)
def sale_points(spark, d):
    return r.sale_points(t.sales(spark, d)).withColumn("volume", F.col("volume").cast("bigint"))


@query(
    "combine_points",
    f"""SELECT user_id, round(sum(avg) FILTER (WHERE hit) / count(*), 6) AS avg, max(max) FILTER (WHERE hit) AS max,
min(min) FILTER (WHERE hit) AS min, sum(volume) FILTER (WHERE hit)::BIGINT AS volume, min(date) FILTER (WHERE hit) AS date
FROM (SELECT *, date >= '2024-01-10' AND date <= '2024-01-20' AND avg > 0 AS hit FROM {POINTS})
GROUP BY user_id HAVING count(*) FILTER (WHERE hit) > 0""",
)
def combine_points(spark, d):
    points = r.bazaar_points(t.feed(spark, d))
    return rounded(r.combine_points(points, ["user_id"], "2024-01-10 00:00:00", "2024-01-20 00:00:00"), "avg")


SPIKE = f"""SELECT p.* FROM {POINTS} p JOIN (SELECT {{key}}, avg(min) AS usual FROM {POINTS} GROUP BY {{key}}) u USING ({{key}})
WHERE p.max < u.usual * {{factor}}"""


@query("spike_filter", SPIKE.format(key="product_id", factor=1000))
def spike_filter(spark, d):
    return r.spike_filter(r.bazaar_points(t.feed(spark, d)), ["product_id"])


@query("spike_filter_tight", SPIKE.format(key="user_id", factor=4))
def spike_filter_tight(spark, d):
    return r.spike_filter(r.bazaar_points(t.feed(spark, d)), ["user_id"], factor=4)


EXISTING = f"""SELECT item_id, date_trunc('day', "end")::TIMESTAMP AS date, avg(unit) AS avg, max(unit) AS max, min(unit) AS min,
sum(cnt)::BIGINT AS volume FROM {SALES} WHERE highest_bid > 1 AND tier = 'R' GROUP BY ALL"""


def stored_prices(spark, d):
    """Price rows already there: those of one tier."""
    return r.price_rollup(t.sales(spark, d).filter("highest_bid > 1 and tier = 'R'"), ["item_id"])


@query(
    "append_missing_prices",
    f"""SELECT * FROM ({EXISTING}) UNION ALL
SELECT * FROM ({DAILY}) n WHERE NOT EXISTS (SELECT 1 FROM ({EXISTING}) e WHERE e.item_id = n.item_id AND e.date = n.date)""",
)
def append_missing_prices(spark, d):
    return r.append_missing(stored_prices(spark, d), daily(spark, d), ["item_id", "date"])


@query(
    "backfill_missing",
    f"""WITH weeks AS (SELECT i AS week, TIMESTAMP '1995-01-01' + i * INTERVAL 7 DAY AS s, TIMESTAMP '1995-01-01' + (i + 1) * INTERVAL 7 DAY AS e
  FROM range(0, 600) r(i) WHERE TIMESTAMP '1995-01-01' + i * INTERVAL 7 DAY < TIMESTAMP '2001-06-01' - INTERVAL 7 DAY),
fresh AS (SELECT n.*, w.week, w.s, w.e FROM ({DAILY}) n JOIN weeks w ON n.date >= w.s AND n.date < w.e),
done AS (SELECT DISTINCT p.item_id, w.week FROM ({EXISTING}) p JOIN weeks w
  ON p.date > w.s - INTERVAL 1 MINUTE AND p.date < w.e + INTERVAL 1 MINUTE)
SELECT item_id, date, avg, max, min, volume FROM fresh f
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.item_id = f.item_id AND d.week = f.week)""",
)
def backfill_missing(spark, d):
    return r.backfill(t.sales(spark, d), stored_prices(spark, d), "1995-01-01 00:00:00", "2001-06-01 00:00:00")


@query(
    "daily_fill",
    f"""WITH day AS (SELECT * FROM {LIVE} WHERE "end" > '2024-01-15' AND "end" < '2024-01-16' AND highest_bid > 1)
SELECT item_id, date_trunc('day', "end")::TIMESTAMP AS date, avg(unit) AS avg, max(unit) AS max, min(unit) AS min, sum(cnt)::BIGINT AS volume
FROM day WHERE item_id NOT IN (SELECT item_id FROM {LIVE}
  WHERE tier = 'click' AND highest_bid > 1 AND date_trunc('day', "end") BETWEEN '2024-01-15' AND '2024-01-16') GROUP BY ALL""",
)
def daily_fill(spark, d):
    sold = live_sales(spark, d)
    there = r.price_rollup(sold.filter("highest_bid > 1 and tier = 'click'"), ["item_id"])
    return r.daily_fill(sold, there, "2024-01-15 00:00:00", "2024-01-16 00:00:00")


@query("point_retention", f"SELECT * FROM {POINTS} WHERE date >= '2024-01-29 00:00:00'")
def point_retention(spark, d):
    return s.keep_since(r.bazaar_points(t.feed(spark, d)), "2024-01-29 00:00:00")


@query(
    "span_buckets",
    """SELECT TIMESTAMP '0001-01-01' + (date_diff('day', TIMESTAMP '0001-01-01', ts) // 7 * 7) * INTERVAL 1 DAY AS week,
date_trunc('hour', ts) + (extract(minute FROM ts)::INT // 15 * 15) * INTERVAL 1 MINUTE AS quarter, count(*) AS n FROM events GROUP BY ALL""",
)
def span_buckets(spark, d):
    ts = F.col("ts")
    return (
        t.feed(spark, d)
        .groupBy(r.bucket_start(ts, 7 * 86400).alias("week"), r.bucket_start(ts, 900).alias("quarter"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "game_year_rollup",
    f"""SELECT floor((epoch(date_trunc('second', ts)) - 1560275700) / 446400)::BIGINT AS game_year, product_id, count(*) AS n,
max(buy_price) AS max, round(avg((epoch(date_trunc('second', ts)) - 1560275700) / 446400), 6) AS mean_year FROM {FEED} GROUP BY ALL""",
)
def game_year_rollup(spark, d):
    feed = t.feed(spark, d).withColumn("y", s.game_year(F.col("ts")))
    return feed.groupBy(F.floor("y").alias("game_year"), "product_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("buy_price").alias("max"), F.round(F.avg("y"), 6).alias("mean_year")
    )


PRICES = f"""(SELECT item_id, date_diff('day', TIMESTAMP '1970-01-01', "end")::INT AS day, trunc(avg(unit))::BIGINT AS price
FROM {SALES} GROUP BY ALL HAVING avg(unit) IS NOT NULL)"""


@query(
    "centered_median",
    f"""SELECT a.item_id, a.day, a.price, greatest(1, list_sort(list(b.price))[len(list(b.price)) // 2 + 1]) AS smoothed
FROM {PRICES} a JOIN {PRICES} b ON a.item_id = b.item_id AND b.day BETWEEN a.day - 2 AND a.day + 2 GROUP BY a.item_id, a.day, a.price""",
)
def centered_median(spark, d):
    return s.centered_median(s.daily_prices(t.sales(spark, d), "item_id"), "item_id")


GAP_ORACLE = f"""WITH p AS {PRICES},
seed AS (SELECT item_id, list({{'day': day, 'price': price}} ORDER BY day)[1:5] AS seed FROM p GROUP BY item_id),
upto AS (SELECT date_diff('day', TIMESTAMP '1970-01-01', TIMESTAMP '2000-12-31') AS d),
cal AS (SELECT s.item_id, s.seed, r.day::INT AS day FROM seed s, upto, range(upto.d - 400, upto.d + 1) r(day)),
obs AS (SELECT p.*, list({{'day': p.day, 'price': p.price}}) OVER (PARTITION BY item_id ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS last5
  FROM p, upto WHERE p.day BETWEEN upto.d - 400 AND upto.d),
j AS (SELECT c.item_id, c.day, c.seed, o.price, coalesce(last_value(o.last5 IGNORE NULLS) OVER (PARTITION BY c.item_id ORDER BY c.day
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS carried FROM cal c LEFT JOIN obs o ON o.item_id = c.item_id AND o.day = c.day),
m AS (SELECT *, list_sort(list_transform(list_reverse_sort(list_concat(seed, carried))[1:5], lambda x: x.price)) AS buf FROM j)
SELECT item_id, day, price IS NOT NULL AS observed, coalesce(price, greatest(1, buf[len(buf) // 2 + 1])) AS price FROM m"""


@query("gap_filled_price", GAP_ORACLE)
def gap_filled_price(spark, d):
    return s.gap_filled(s.daily_prices(t.sales(spark, d), "item_id"), "item_id", "2000-12-31")


PRICE_AT = f"""WITH p AS {PRICES},
seed AS (SELECT item_id, list({{'day': day, 'price': price}} ORDER BY day)[1:5] AS seed FROM p GROUP BY item_id),
smooth AS (SELECT a.item_id, a.day, greatest(1, list_sort(list(b.price))[len(list(b.price)) // 2 + 1]) AS smoothed
  FROM p a JOIN p b ON a.item_id = b.item_id AND b.day BETWEEN a.day - 2 AND a.day + 2 GROUP BY a.item_id, a.day),
w AS (SELECT l_orderkey AS auction_id, l_linenumber AS line, l_partkey AS item_id,
  date_diff('day', TIMESTAMP '1970-01-01', l_shipdate)::INT + 45 * l_linenumber AS day FROM lineitem),
k AS (SELECT DISTINCT item_id, day FROM w),
o AS (SELECT k.item_id, k.day, coalesce(list({{'day': p.day, 'price': p.price}} ORDER BY p.day DESC) FILTER (WHERE p.day IS NOT NULL), [])[1:5] AS obs
  FROM k LEFT JOIN p ON p.item_id = k.item_id AND p.day < k.day AND p.day >= k.day - 400 GROUP BY k.item_id, k.day),
f AS (SELECT o.item_id, o.day, list_sort(list_transform(list_reverse_sort(list_concat(seed.seed, o.obs))[1:5], lambda x: x.price)) AS buf
  FROM o JOIN seed ON seed.item_id = o.item_id)
SELECT w.auction_id, w.line, w.item_id, w.day, coalesce(smooth.smoothed, greatest(1, f.buf[len(f.buf) // 2 + 1]))::BIGINT AS price
FROM w LEFT JOIN f ON f.item_id = w.item_id AND f.day = w.day LEFT JOIN smooth ON smooth.item_id = w.item_id AND smooth.day = w.day"""


@query("price_at_date", PRICE_AT)
def price_at_date(spark, d):
    sales = t.sales(spark, d)
    asked = sales.select(
        "auction_id", "line", "item_id", (s.day_number(F.col("end")) + 45 * F.col("line")).alias("day")
    )
    parts = spread_tasks(sales, HELD_ROWS)
    return s.price_at(asked, s.daily_prices(sales, "item_id", parts), "item_id", parts=parts)


ARRIVAL = f"""(SELECT event_id, product_id, ts + k * INTERVAL 1 MINUTE AS date FROM {FEED})"""


def event_block():
    return F.floor(F.col("event_id") / 100000)


@query(
    "strictly_newer",
    f"""SELECT event_id, product_id, date FROM (SELECT *, max(date) OVER (PARTITION BY product_id ORDER BY event_id
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM {ARRIVAL}) WHERE newest IS NULL OR date > newest""",
)
def strictly_newer(spark, d):
    arrival = t.feed(spark, d).select(
        "event_id", "product_id", F.expr("ts + make_dt_interval(0, 0, cast(k as int), 0)").alias("date")
    )
    return s.strictly_newer(arrival, ["product_id"], "event_id", event_block())


@query(
    "latest_and_oldest_point",
    f"""SELECT product_id, min(date) AS oldest, max(date) AS youngest, arg_min(avg, date) AS oldest_avg,
arg_max(avg, date) AS youngest_avg FROM {POINTS} GROUP BY product_id""",
)
def latest_and_oldest_point(spark, d):
    return s.latest_and_oldest(r.bazaar_points(t.feed(spark, d)), ["product_id"], "event_id")


@query(
    "order_book_delta",
    f"""WITH b AS (SELECT event_id, product_id, k // 25 AS level, trunc(buy_price / 50)::BIGINT AS price_per_unit, k // 30 AS amount,
  user_id // 60 AS orders FROM {FEED}),
l AS (SELECT *, lag(event_id) OVER w AS pe, lag(amount) OVER w AS pa, lag(price_per_unit) OVER w AS pp, lag(orders) OVER w AS po
  FROM b WINDOW w AS (PARTITION BY product_id, level ORDER BY event_id))
SELECT event_id, product_id, level, amount, price_per_unit, orders, pe IS NULL AS is_first FROM l
WHERE pe IS NULL OR pa <> amount OR pp <> price_per_unit OR po <> orders""",
)
def order_book_delta(spark, d):
    book = t.feed(spark, d).select(
        "event_id",
        "product_id",
        F.expr("k div 25").alias("level"),
        F.expr("k div 30").alias("amount"),
        (F.col("buy_price") / 50).cast("bigint").alias("price_per_unit"),
        F.expr("user_id div 60").alias("orders"),
    )
    return s.order_changes(book, ["product_id", "level"], "event_id", event_block())


BOOK_PRODUCTS = ["IRON", "GOLD", "COAL"]
BOOKS = f"""(SELECT event_id, n, ['{"', '".join(BOOK_PRODUCTS)}'][n + 1] AS product_id, side, i, ((k + i * 7 + o) % 5 + 1)::INT AS amount, (user_id + i * o) % 4 + 0.5::DOUBLE AS price_per_unit, ((k + i) % 3 + 1)::SMALLINT AS orders
  FROM (SELECT event_id, k, user_id, n, side, CASE side WHEN 'buy_summary' THEN n ELSE n + 1 END AS o FROM {FEED}, range(0, {len(BOOK_PRODUCTS)}) x(n), (VALUES ('buy_summary'), ('sell_summary')) y(side)), range(0, 4) r(i)
  WHERE i < (k + o) % 5 AND NOT (side = 'buy_summary' AND k % 7 = n))"""


@query("order_book_rows", f"SELECT event_id, product_id, side, i::INT AS level, amount, price_per_unit, orders FROM {BOOKS}")
def order_book_rows(spark, d):
    return order_rows(pulls_with_books(t.feed(spark, d), BOOK_PRODUCTS)).drop("ts")


@query(
    "order_book_changes",
    f"""WITH p AS (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS before FROM events),
c AS (SELECT event_id, product_id, side, amount, price_per_unit, orders, count(*) AS n FROM {BOOKS} GROUP BY ALL),
d AS (SELECT event_id, product_id, side, amount, price_per_unit, orders, n, 0 AS m FROM c
  UNION ALL SELECT p.event_id, product_id, side, amount, price_per_unit, orders, 0, n FROM c JOIN p ON p.before = c.event_id),
s AS (SELECT event_id, product_id, side, amount, price_per_unit, orders, sum(n) - sum(m) AS diff FROM d GROUP BY ALL)
SELECT event_id, product_id, side, CASE WHEN diff > 0 THEN 'added' ELSE 'gone' END AS change, amount, price_per_unit, orders, abs(diff)::INT AS copies FROM s WHERE diff <> 0""",
)
def order_book_changes(spark, d):
    books = book_rows(pulls_with_books(t.feed(spark, d), BOOK_PRODUCTS)).drop("ts")
    return s.book_changes(books, ["product_id", "side"], "event_id", event_block())


@query(
    "color_consensus",
    f"""WITH c AS (SELECT event_id, user_id, (k // 25)::VARCHAR || ':0:0' AS color FROM {FEED}),
l AS (SELECT *, row_number() OVER w AS rn, lag(color) OVER w AS prev FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, arg_min(color, event_id) AS color, min(event_id) AS event_id FROM l WHERE rn > 3 AND prev = color GROUP BY user_id""",
)
def color_consensus(spark, d):
    seen = t.feed(spark, d).select(
        "event_id", "user_id", F.concat(F.expr("cast(k div 25 as string)"), F.lit(":0:0")).alias("color")
    )
    return s.color_consensus(seen, "user_id", "event_id", event_block())


@query(
    "series_with_live_point",
    f"""WITH h AS (SELECT product_id, date_trunc('hour', date) AS date, round(avg(avg), 6) AS avg, max(max) AS max, min(min) AS min, sum(volume)::BIGINT AS volume
  FROM {POINTS} GROUP BY 1, 2) SELECT * FROM h WHERE date < '2024-01-20' UNION ALL
SELECT product_id, min(date), round(sum(avg) FILTER (WHERE hit) / count(*), 6), max(max) FILTER (WHERE hit), min(min) FILTER (WHERE hit), sum(volume) FILTER (WHERE hit)::BIGINT
FROM (SELECT *, date >= '2024-01-20' AND avg > 0 AS hit FROM {POINTS}) WHERE hit IS NOT NULL GROUP BY product_id HAVING coalesce(sum(volume) FILTER (WHERE hit), 0) <> 0""".replace(
        "SELECT product_id, min(date),", "SELECT product_id, min(date) FILTER (WHERE hit),"
    ),
)
def series_with_live_point(spark, d):
    points = r.bazaar_points(t.feed(spark, d))
    hours = (
        points.groupBy("product_id", F.date_trunc("hour", "date").alias("date"))
        .agg(F.avg("avg").alias("avg"), F.max("max").alias("max"), F.min("min").alias("min"), F.sum("volume").alias("volume"))
        .filter(F.col("date") < "2024-01-20")
    )
    running = r.combine_points(points, ["product_id"], "2024-01-20 00:00:00", "2024-12-31 00:00:00")
    return rounded(r.with_live_point(hours, running), "avg")
