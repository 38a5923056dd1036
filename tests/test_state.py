"""Jobs with keyed state over many small batches and a restart, against their batch twins."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marketlens.operators import events as e
from marketlens.operators import rollup as r
from marketlens.operators import series as s
from marketlens.streaming import live, state

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, item_id int, highest_bid long, count int, ts timestamp, kind string, color string"
KINDS = ["new", "bid", "sold", "new", "ended", "bid"]
COLORS = ["1:0:0", "2:0:0", "2:0:0"]


def rows_of_file(file):
    out = []
    for i in range(40):
        n = file * 40 + i
        out.append((n, n % 3, 10 + n * 7 % 50, n % 4, START + timedelta(minutes=n * 11, seconds=n), KINDS[n * 5 % 7 % 6], COLORS[n * n % 5 % 3]))
    return out


@pytest.fixture
def feed(spark, tmp_path):
    """Files arrive one by one; ``drain`` runs the job until it has seen all that arrived."""
    folder, checkpoint, table = (str(tmp_path / x) for x in ("in", "checkpoint", "out"))

    class Feed:
        def arrive(self, rows):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

        def stream(self):
            return live.file_events(spark, folder, SCHEMA, files_per_batch=1)

        def drain(self, job, partition_by=None):
            stream = job(self.stream())
            query = live.file_sink(stream, table, checkpoint, partition_by)
            query.awaitTermination()
            assert query.exception() is None
            return spark.read.schema(stream.schema).parquet(table)

        def all(self):
            return spark.read.schema(SCHEMA).parquet(folder)

    out = Feed()
    out.checkpoint, out.table = checkpoint, table
    return out


def keyed_events(events):
    return events.select("event_id", F.concat(F.lit("a"), F.col("event_id") % 25).alias("uuid"), "kind", "ts")


def test_active_set_over_batches_and_a_restart(spark, feed, rows_of):
    for half in ((0, 1, 2), (3, 4, 5)):
        for file in half:
            feed.arrive(rows_of_file(file))
        changes = feed.drain(lambda x: state.active_changes(keyed_events(x)))  # the second half is a restart
        expected = e.active_set(keyed_events(feed.all()), "uuid", ["ts", "event_id"])
        assert rows_of(state.active_now(spark, feed.checkpoint), "uuid", "event_id", "kind", "ts") == rows_of(expected, "uuid", "event_id", "kind", "ts")
    last = changes.groupBy("uuid").agg(F.max_by("active", F.struct("at", "event_id")).alias("active"))
    assert {x.uuid for x in last.filter("active").collect()} == {x.uuid for x in expected.collect()}


def test_a_closed_auction_stays_closed_until_it_is_forgotten(spark, feed):
    def event(n, minute, kind):
        return (n, 0, 1, 1, START + timedelta(minutes=minute), kind, "x")

    job = lambda x: state.active_changes(x.select("event_id", F.col("item_id").cast("string").alias("uuid"), "kind", "ts"), "1 hour", state.HOUR)
    feed.arrive([event(1, 10, "new"), event(2, 20, "sold")])
    feed.drain(job)
    feed.arrive([event(3, 15, "bid")])  # older than the sale, so it must not open the auction again
    feed.drain(job)
    assert state.active_now(spark, feed.checkpoint).count() == 0 and state.kept(spark, feed.checkpoint, "last").count() == 1
    feed.arrive([(9, 1, 1, 1, START + timedelta(days=1), "new", "x")])
    feed.drain(job)
    assert {x.uuid for x in state.kept(spark, feed.checkpoint, "last").collect()} == {"1"}  # the mark is gone, the state is small again
    feed.arrive([event(5, 24 * 60 + 1, "new")])
    feed.drain(job)
    assert {x.uuid for x in state.active_now(spark, feed.checkpoint).collect()} == {"0", "1"}


def test_live_lists_after_each_batch(spark, feed, rows_of):
    """Running points, closed hours and the day list as of every batch's end; hours leave after a day."""
    columns = ["item_id", "date", "avg", "max", "min", "volume"]

    def sales(x):
        return r.sale_points(x.withColumnRenamed("ts", "end"))

    for file in range(6):
        feed.arrive(rows_of_file(file))
        told = feed.drain(lambda x: state.live_lists(sales(x), "item_id", F.col("date")))
        points = sales(feed.all()).withColumn("item_id", F.col("item_id").cast("string"))
        as_of = points.agg(F.max("date")).first()[0] - timedelta(minutes=1)
        hour = F.date_trunc("hour", "date")
        over = hour + F.expr("INTERVAL 1 HOUR") <= F.lit(as_of)
        running, day = state.lists_now(spark, feed.checkpoint)
        typed = [F.col(c).cast("double") if c in ("avg", "max", "min") else F.col(c) for c in columns]
        assert rows_of(running, *typed) == rows_of(points.filter(~over), *typed)
        hours = points.filter(over).groupBy("item_id", hour.alias("hour")).agg(
            F.min("date").alias("date"), F.avg("avg").alias("avg"), F.max("max").cast("double").alias("max"), F.min("min").cast("double").alias("min"), F.sum("volume").alias("volume")
        )
        assert rows_of(day, *columns) == rows_of(hours.filter(F.col("hour") + F.expr("INTERVAL 24 HOURS") > F.lit(as_of)), *columns)
        assert rows_of(state.merged_hours(told), *columns) == rows_of(hours, *columns)
    assert day.count() < hours.count()


def test_points_without_a_price_count_for_the_divisor(spark):
    assert state.folded(0, [(5, 2.0, 3.0, 1.0, 4), (6, None, 9.0, 0.5, 7), (7, 0.0, 9.0, 0.5, 7)]) == (0, 3, 1, 2.0, 3.0, 1.0, 4, 5)
    assert state.folded(0, [(5, None, None, None, None)]) == (0, 1, 0, 0.0, None, None, None, None)
    frame = spark.createDataFrame([("a", 0, 3, 1, 2.0, 3.0, 1.0, 4, 5), ("a", 0, 1, 0, 0.0, None, None, None, None), ("b", 0, 1, 0, 0.0, None, None, None, None)], f"item_id string, {state.CLOSED}")
    assert [(x.item_id, x.avg, x.volume) for x in state.merged_hours(frame).collect()] == [("a", 0.5, 4)]


def test_color_agreement_is_told_once(spark, feed, rows_of):
    for file in range(4):
        feed.arrive(rows_of_file(file))
    told = feed.drain(lambda x: state.color_agreements(x.withColumn("color", F.when(F.col("event_id") % 11 != 0, F.col("color"))), "item_id"))
    sightings = feed.all().withColumn("color", F.when(F.col("event_id") % 11 != 0, F.col("color")))
    expected = s.color_consensus(sightings, "item_id", "event_id", F.floor(F.col("event_id") / 30))
    assert rows_of(told.select(F.col("key").cast("int"), "color", "event_id")) == rows_of(expected, "item_id", "color", "event_id")
    items = spark.createDataFrame([("0", None), ("1", "9:9:9"), ("7", None)], "key string, color string")
    colors = {x.key: x.color for x in s.fill_colors(items, told, "key").collect()}
    agreed = {x.key: x.color for x in told.collect()}
    assert colors == {"0": agreed["0"], "1": "9:9:9", "7": None}


def test_newer_points_and_their_side_table(spark, feed):
    early = F.when(F.col("event_id") % 10 == 9, F.expr("ts - INTERVAL 1 HOUR")).otherwise(F.col("ts"))
    for file in range(4):
        feed.arrive(rows_of_file(file))
    told = feed.drain(lambda x: state.newer_points(x.select("event_id", F.lit("k").alias("key"), early.alias("date")), "key"), ["accepted"])
    assert told.count() == 160 and {x.event_id for x in told.filter("not accepted").collect()} == {n for n in range(160) if n % 10 == 9}
    assert {p.name for p in Path(feed.table).glob("accepted=*")} == {"accepted=true", "accepted=false"}
    dates = {x.event_id: x.date for x in told.collect()}
    assert all(dates[x.event_id] == x.date for x in feed.all().select("event_id", early.alias("date")).collect())


def test_an_alert_fires_again_after_its_cool_down(spark, feed):
    days = [5, 5, 50, 5, 5, 5, 50, 5, 5, 5, 5]  # the price of each day
    for first in (0, 4, 8):
        feed.arrive([(d, 1, days[d], 1, START + timedelta(days=d, hours=3), "x", "x") for d in range(first, min(first + 4, len(days)))])
    day = (START - datetime(1970, 1, 1)).days
    wishes = [(1, 1, 10.0, 1, day + 1), (2, 1, 40.0, 2, day), (3, 1, 10.0, 1, day + 30), (4, 2, 10.0, 1, day), (5, 1, 10.0, 2 + 32, day)]
    subscriptions = spark.createDataFrame(wishes, "id long, item_id int, price double, type int, not_before_day int")
    points = lambda x: x.select("item_id", "ts", F.col("highest_bid").alias("buy_price"), F.lit(1).alias("sell_price"))
    told = feed.drain(lambda x: state.fired_alerts(subscriptions, points(x), "item_id", cool_down=3))
    fired = sorted((x.id, x.day - day) for x in told.collect())
    # day 10 is still open; id 1 fires on 1, not before 4, then 4, 7; id 2 fires on the two dear days
    assert fired == [("1", 1), ("1", 4), ("1", 7), ("2", 2), ("2", 6)]


def test_hour_upserts_touch_their_hours_only(spark, tmp_path, rows_of):
    path = str(tmp_path / "t")
    writer = live.hours_upserter(path, ["item_id"])

    def batch(file):
        return spark.createDataFrame(rows_of_file(file), SCHEMA).withColumnRenamed("ts", "end")

    def files():
        return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}

    writer(batch(0), 0)
    writer(batch(1), 1)
    before = files()
    writer(batch(2), 2)
    hours = {x.h for x in batch(2).select(F.date_format("end", "yyyyMMddHH").alias("h")).distinct().collect()}
    untouched = {p: m for p, m in before.items() if p.split("span=")[1][:10] not in hours}
    assert untouched and all(files()[p] == m for p, m in untouched.items())
    columns = ["item_id", "date", "avg", "max", "min", "volume"]
    expected = r.price_rollup(batch(0).union(batch(1)).union(batch(2)).filter("highest_bid > 1"), ["item_id"], "hour")
    assert rows_of(live.hours_table(spark, path, ["item_id"]), *columns) == rows_of(expected, *columns)
    # the same batch again, and one that adds to hours of all three, twice
    writer(batch(2), 2)
    assert rows_of(live.hours_table(spark, path, ["item_id"]), *columns) == rows_of(expected, *columns)
    more = batch(0).union(batch(2))
    writer(more, 3)
    writer(more, 3)
    writer(batch(1).limit(0), 4)
    writer(batch(1), 5)
    expected = r.price_rollup(batch(0).union(batch(1)).union(batch(2)).union(more).union(batch(1)).filter("highest_bid > 1"), ["item_id"], "hour")
    assert rows_of(live.hours_table(spark, path, ["item_id"]), *columns) == rows_of(expected, *columns)
    versions = [len(list(p.glob("upto=*"))) for p in Path(path).glob("span=*")]
    assert max(versions) <= 2
