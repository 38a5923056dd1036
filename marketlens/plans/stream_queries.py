"""Registered queries: live jobs over the event table as a file stream, and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens import tables as t
from marketlens.operators import events as e
from marketlens.operators import rollup as r
from marketlens.operators import series as s
from marketlens.operators.dictionaries import attribute_encoder
from marketlens.plans.attribute_queries import ENCODED, named_items
from marketlens.plans.price_queries import FEED, HOURLY, LIVE, POINTS
from marketlens.plans.registry import query
from marketlens.session import new_folder, spread_tasks
from marketlens.streaming import live, state


def event_stream(spark, d) -> DataFrame:
    """The event table as a file stream with a usable event time."""
    schema = t.read(spark, d, "events").schema
    return live.event_time(live.file_events(spark, d, schema, "events.parquet"), "ts")


def feed_stream(spark, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return event_stream(spark, d).select(
        "event_id",
        "ts",
        "user_id",
        F.col("event_type").alias("product_id"),
        F.col("value").alias("buy_price"),
        (F.col("value") * 0.9).alias("sell_price"),
        (k * 100000).alias("sell_moving_week"),
        k.alias("k"),
    )


def drained(spark, query_) -> None:
    query_.awaitTermination()
    if query_.exception() is not None:
        raise query_.exception()


def through_file(spark, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream into a Parquet table until its source is drained and read the table."""
    path = new_folder(spark, name)
    drained(spark, live.file_sink(stream, f"{path}/table", f"{path}/checkpoint"))
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def through_state(spark, stream: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Run a stream that keeps state until its source is drained; gives what it wrote and its checkpoint."""
    path = new_folder(spark, name)
    drained(spark, live.file_sink(stream, f"{path}/table", f"{path}/checkpoint", partition_by))
    return spark.read.schema(stream.schema).parquet(f"{path}/table"), f"{path}/checkpoint"


def through_batches(spark, stream: DataFrame, name: str, writer) -> str:
    """Run a stream into a batch writer until its source is drained; gives the folder."""
    path = new_folder(spark, name)
    drained(spark, live.batch_sink(stream, writer(f"{path}/table"), f"{path}/checkpoint"))
    return f"{path}/table"


@query(
    "stream_hour_close",
    f"""SELECT product_id, hour, min(date) AS date, round(sum(avg) / count(*), 6) AS avg, max(max) AS max, min(min) AS min, sum(volume)::BIGINT AS volume
FROM (SELECT *, date_trunc('hour', date) AS hour FROM {POINTS}) WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE GROUP BY product_id, hour""",
)
def stream_hour_close(spark, d):
    points = r.bazaar_points(feed_stream(spark, d)).drop("event_id", "user_id")
    closed = through_file(spark, live.hour_points(points, ["product_id"]), "hours")
    return closed.withColumn("avg", F.round("avg", 6))


@query("stream_once_each", "SELECT event_id, user_id, ts FROM events")
def stream_once_each(spark, d):
    once = event_stream(spark, d).select("event_id", "user_id", "ts")
    delivered_twice = once.unionByName(event_stream(spark, d).select("event_id", "user_id", "ts"))
    return through_file(spark, live.once_each(delivered_twice, "event_id", "ts", "1 hour"), "once")


def live_sale_stream(spark, d):
    return feed_stream(spark, d).select(
        F.col("user_id").alias("item_id"),
        F.round(F.col("buy_price") * 100).cast("bigint").alias("highest_bid"),
        F.col("k").alias("count"),
        F.col("ts").alias("end"),
    )


@query("stream_hourly_fill", HOURLY)
def stream_hourly_fill(spark, d):
    path = through_batches(spark, live_sale_stream(spark, d), "fill", lambda p: live.hours_upserter(p, ["item_id"], live.DAILY_SPAN))
    return live.hours_table(spark, path, ["item_id"]).fillna({"max": -1, "min": -1})


NEWER_SQL = f"""SELECT event_id, product_id, date, newest IS NULL OR date > newest AS accepted FROM (SELECT *, max(date) OVER (PARTITION BY product_id ORDER BY event_id
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM (SELECT event_id, product_id, ts + k * INTERVAL 1 MINUTE AS date FROM {FEED}))"""


def arrivals(spark, d):
    return feed_stream(spark, d).select("event_id", "product_id", F.expr("ts + make_dt_interval(0, 0, cast(k as int), 0)").alias("date"))


@query("stream_newer_points", NEWER_SQL)
def stream_newer_points(spark, d):
    told, _ = through_state(spark, state.newer_points(arrivals(spark, d), "product_id"), "newer", ["accepted"])
    return told


@query("stream_late_points", f"SELECT event_id, product_id, date FROM ({NEWER_SQL}) WHERE NOT accepted")
def stream_late_points(spark, d):
    """The side table of late points alone: one folder of the sink."""
    told, _ = through_state(spark, state.newer_points(arrivals(spark, d), "product_id"), "late", ["accepted"])
    return told.filter("not accepted").drop("accepted")


@query(
    "stream_sale_hours",
    f"""SELECT item_id, hour, min("end") AS date, avg(highest_bid) AS avg, max(highest_bid) AS max, min(highest_bid) AS min, sum(cnt)::BIGINT AS volume
FROM (SELECT *, date_trunc('hour', "end") AS hour FROM {LIVE}) WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE GROUP BY item_id, hour""",
)
def stream_sale_hours(spark, d):
    return through_file(spark, live.hour_points(r.sale_points(live_sale_stream(spark, d)), ["item_id"]), "sale-hours")


# A live list as of the last event less the grace: the hours closed by then and less than a day old, and the points since.
AS_OF = "((SELECT max(ts) FROM events) - INTERVAL 1 MINUTE)"


@query(
    "stream_live_lists",
    f"""WITH p AS (SELECT item_id, "end" AS date, highest_bid::DOUBLE AS price, cnt::BIGINT AS volume, date_trunc('hour', "end") AS hour FROM {LIVE})
SELECT item_id::VARCHAR AS item_id, 'running' AS list, date, price AS avg, price AS max, price AS min, volume FROM p WHERE hour + INTERVAL 1 HOUR > {AS_OF}
UNION ALL SELECT item_id::VARCHAR, 'day', min(date), avg(price), max(price), min(price), sum(volume)::BIGINT FROM p
WHERE hour + INTERVAL 1 HOUR <= {AS_OF} AND hour + INTERVAL 24 HOUR > {AS_OF} GROUP BY item_id, hour""",
)
def stream_live_lists(spark, d):
    points = r.sale_points(live_sale_stream(spark, d))
    _, checkpoint = through_state(spark, state.live_lists(points, "item_id", F.col("date")), "live-lists")
    running, day = state.lists_now(spark, checkpoint)
    columns = ["item_id", "list", "date", "avg", "max", "min", "volume"]
    return running.withColumn("list", F.lit("running")).select(*columns).unionByName(day.withColumn("list", F.lit("day")).select(*columns))


@query(
    "stream_closed_hours",
    f"""SELECT item_id::VARCHAR AS item_id, hour, min("end") AS date, avg(highest_bid) AS avg, max(highest_bid)::DOUBLE AS max, min(highest_bid)::DOUBLE AS min, sum(cnt)::BIGINT AS volume
FROM (SELECT *, date_trunc('hour', "end") AS hour FROM {LIVE}) WHERE hour + INTERVAL 1 HOUR <= {AS_OF} GROUP BY item_id, hour""",
)
def stream_closed_hours(spark, d):
    """Every hour the live lists closed, from what the job told as it closed them."""
    told, _ = through_state(spark, state.live_lists(r.sale_points(live_sale_stream(spark, d)), "item_id", F.col("date")), "closed-hours")
    return state.merged_hours(told)


CONSENSUS_SQL = f"""WITH c AS (SELECT event_id, user_id, (k // 25)::VARCHAR || ':0:0' AS color FROM {FEED}),
l AS (SELECT *, row_number() OVER w AS rn, lag(color) OVER w AS prev FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, arg_min(color, event_id) AS color, min(event_id) AS event_id FROM l WHERE rn > 3 AND prev = color GROUP BY user_id"""


def agreements(spark, d):
    color = F.concat(F.expr("cast(k div 25 as string)"), F.lit(":0:0"))
    sightings = feed_stream(spark, d).select("event_id", "user_id", color.alias("color"))
    told, _ = through_state(spark, state.color_agreements(sightings, "user_id"), "colors")
    return told.select(F.col("key").cast("bigint").alias("user_id"), "color", "event_id")


@query("stream_color_consensus", CONSENSUS_SQL)
def stream_color_consensus(spark, d):
    return agreements(spark, d)


@query(
    "stream_filled_colors",
    f"""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '1:2:3' ELSE a.color END AS color, p_size % 3 <> 0 AND a.color IS NOT NULL AS was_filled
FROM part LEFT JOIN ({CONSENSUS_SQL}) a ON a.user_id = p_partkey % 200""",
)
def stream_filled_colors(spark, d):
    """The agreed colours written back to the items that have none."""
    items = t.items(spark, d).select("id", (F.col("id") % 200).alias("user_id"), F.when(F.col("hit_count") % 3 == 0, "1:2:3").alias("color"))
    filled = s.fill_colors(items.withColumn("had", F.col("color").isNotNull()), agreements(spark, d), "user_id")
    return filled.select("id", "color", (~F.col("had") & F.col("color").isNotNull()).alias("was_filled"))


KINDS = {"view": "new", "click": "bid", "purchase": "sold", "error": "cancelled", "signup": "ended"}
KIND_SQL = "CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'bid' WHEN 'purchase' THEN 'sold' WHEN 'error' THEN 'cancelled' ELSE 'ended' END"


def market_events(events: DataFrame) -> DataFrame:
    """Events as market events: the auction is the user with the event's number."""
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    uuid = F.concat_ws("-", F.col("user_id").cast("string"), F.get_json_object("props", "$.k"))
    return events.select("event_id", uuid.alias("uuid"), kind.alias("kind"), "ts")


ACTIVE_SQL = f"""SELECT event_id, uuid, kind, ts FROM (SELECT event_id, user_id || '-' || json_extract(props, '$.k') AS uuid, {KIND_SQL} AS kind, ts,
row_number() OVER (PARTITION BY user_id, json_extract(props, '$.k')::BIGINT ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND kind IN ('new', 'bid')"""


@query("active_set", ACTIVE_SQL)
def active_set(spark, d):
    return e.active_set(market_events(t.read(spark, d, "events")), "uuid", ["ts", "event_id"])


@query("stream_active_set", ACTIVE_SQL)
def stream_active_set(spark, d):
    _, checkpoint = through_state(spark, state.active_changes(market_events(event_stream(spark, d))), "active")
    return state.active_now(spark, checkpoint)


@query("stream_encoded_attributes", f"WITH {ENCODED} SELECT auction_id, key_id, value FROM enc")
def stream_encoded_attributes(spark, d):
    """Attributes encoded as they arrive, by dictionaries that grow with each batch."""
    events = event_stream(spark, d).select("event_id", "user_id", "event_type", "props")
    # a batch of few files goes to all cores before its documents are taken apart
    tasks = spread_tasks(t.read(spark, d, "events"))
    documents = t.attribute_documents(events.repartition(tasks))
    path = through_batches(spark, documents, "encoded", lambda p: attribute_encoder(p, named_items(spark, d)))
    return live.batches(spark, f"{path}/encoded")


@query("stream_routing", f"SELECT kind, count(*) AS n FROM (SELECT {KIND_SQL} AS kind FROM events) WHERE kind IN ('sold', 'ended') GROUP BY kind")
def stream_routing(spark, d):
    routed = e.of_kind(market_events(event_stream(spark, d)), "sold", "ended")
    return through_file(spark, routed, "routed").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flip_funnel",
    """SELECT user_id AS auction_uid, """
    + ", ".join(f"sum((k & {flag} <> 0)::INT)::BIGINT AS {name.lower()}" for name, flag in e.FLIP_EVENTS.items())
    + f" FROM {FEED} GROUP BY user_id",
)
def flip_funnel(spark, d):
    return e.flip_funnel(t.feed(spark, d).select(F.col("user_id").alias("auction_uid"), F.col("k").alias("type")))


SUBSCRIPTIONS_SQL = """(SELECT c_custkey AS id, ['view', 'click', 'purchase', 'error', 'signup'][c_custkey % 5 + 1] AS product_id, abs(c_acctbal) / 20 AS price, [1, 2, 33, 34, 8][c_custkey % 5 + 1] AS type,
  TIMESTAMP '2024-01-05' + (c_custkey % 20) * INTERVAL 1 DAY AS nb FROM customer)"""


def subscriptions(spark, d):
    key = F.col("c_custkey")
    since = F.unix_date(F.lit("2024-01-05").cast("date"))
    return t.read(spark, d, "customer").select(
        key.alias("id"),
        t.pick(["view", "click", "purchase", "error", "signup"], key).alias("product_id"),
        (F.abs("c_acctbal") / 20).alias("price"),
        F.element_at(F.array(*[F.lit(n) for n in (1, 2, 33, 34, 8)]), (key % 5 + 1).cast("int")).alias("type"),
        (since + key % 20).alias("not_before_day"),
    )


@query(
    "price_alerts",
    f"""WITH s AS {SUBSCRIPTIONS_SQL},
p AS (SELECT product_id, date_trunc('day', ts) AS day, buy_price, sell_price FROM {FEED})
SELECT s.id, s.product_id, date_diff('day', TIMESTAMP '1970-01-01', min(p.day)::TIMESTAMP)::INT AS day FROM s JOIN p ON p.product_id = s.product_id AND p.day >= s.nb
AND (((type & 1) <> 0 AND CASE WHEN (type & 32) <> 0 THEN sell_price ELSE buy_price END < price) OR ((type & 2) <> 0 AND CASE WHEN (type & 32) <> 0 THEN sell_price ELSE buy_price END > price)) GROUP BY s.id, s.product_id""",
)
def price_alerts(spark, d):
    return e.price_alerts(subscriptions(spark, d), t.feed(spark, d), "product_id").select("id", "product_id", "day")


# Day by day: the first hit, then the first one at least the cool-down later, and so on; the last day is still open.
@query(
    "stream_price_alerts",
    f"""WITH RECURSIVE s AS {SUBSCRIPTIONS_SQL},
p AS (SELECT product_id, date_trunc('day', ts) AS day, min(buy_price) AS lo, max(buy_price) AS hi, min(sell_price) AS slo, max(sell_price) AS shi FROM {FEED} GROUP BY 1, 2),
h AS (SELECT s.id, s.product_id, date_diff('day', TIMESTAMP '1970-01-01', p.day::TIMESTAMP)::INT AS day FROM s JOIN p ON p.product_id = s.product_id AND p.day >= s.nb AND p.day + INTERVAL 1 DAY <= {AS_OF}
  AND (((type & 1) <> 0 AND CASE WHEN (type & 32) <> 0 THEN slo ELSE lo END < price) OR ((type & 2) <> 0 AND CASE WHEN (type & 32) <> 0 THEN shi ELSE hi END > price))),
f AS (SELECT id, product_id, min(day) AS day FROM h GROUP BY ALL UNION ALL
  SELECT f.id, f.product_id, (SELECT min(h.day) FROM h WHERE h.id = f.id AND h.day >= f.day + {state.COOL_DOWN_DAYS}) AS day FROM f
  WHERE EXISTS (SELECT 1 FROM h WHERE h.id = f.id AND h.day >= f.day + {state.COOL_DOWN_DAYS}))
SELECT id, product_id, day FROM f""",
)
def stream_price_alerts(spark, d):
    """Every firing of a subscription, not before its day, which moves on each time."""
    points = feed_stream(spark, d).select("product_id", "ts", "buy_price", "sell_price")
    told, _ = through_state(spark, state.fired_alerts(subscriptions(spark, d), points, "product_id"), "alerts")
    return told.select(F.col("id").cast("bigint").alias("id"), "product_id", "day")


@query(
    "merged_house_state",
    "SELECT user_id::VARCHAR AS tag, count(*) AS item_count FROM events GROUP BY 1",
)
def merged_house_state(spark, d):
    feed = t.feed(spark, d)
    parts = feed.groupBy(F.col("user_id").cast("string").alias("tag"), "product_id").agg(F.count(F.lit(1)).alias("item_count"))
    return r.merge_house_state(parts)
