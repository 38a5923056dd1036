"""Many small states share a page, so a batch makes few calls to the state store."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from marketlens.operators import events as e
from marketlens.operators import rollup as r
from marketlens.streaming import live, state

START = datetime(2024, 1, 1)


def test_active_set_in_three_pages(spark, tmp_path, rows_of):
    kinds = ["new", "bid", "sold", "ended"]
    columns = ["event_id", "uuid", "kind", "ts"]
    schema = "event_id long, uuid string, kind string, ts timestamp"
    rows = [(n, f"a{n * 7 % 60}", kinds[n * n % 4 if n % 3 else n % 4], START + timedelta(minutes=n * 31 % 200)) for n in range(160)]
    for part in (rows[:90], rows[90:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.file_events(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    query = live.file_sink(state.active_changes(stream, pages=3), str(tmp_path / "t"), str(tmp_path / "c"))
    query.awaitTermination()
    assert query.exception() is None
    assert rows_of(state.active_now(spark, str(tmp_path / "c")), *columns) == rows_of(e.active_set(spark.createDataFrame(rows, schema), "uuid", ["ts", "event_id"]), *columns)
    held = state.kept(spark, str(tmp_path / "c"), "last")
    assert held.count() == 60 and held.select(F.col("page")).distinct().count() == 3


def test_cool_downs_of_a_page_stay_apart(spark, tmp_path):
    """Three batches of one page: each subscription waits for its own cool-down."""
    schema = "product_id string, ts timestamp, buy_price double, sell_price double"
    for first in (0, 3, 6):
        rows = [(p, START + timedelta(days=d, hours=1), 5.0, 1.0) for d in range(first, first + 3) for p in "ab"]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    day = (START - datetime(1970, 1, 1)).days
    wishes = [(n, "ab"[n % 2], 10.0, 1, day + n % 3) for n in range(30)]
    stream = live.file_events(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    fired = state.fired_alerts(spark.createDataFrame(wishes, "id long, product_id string, price double, type int, not_before_day int"), stream, "product_id", cool_down=3)
    query = live.file_sink(fired, str(tmp_path / "t"), str(tmp_path / "c"))
    query.awaitTermination()
    assert query.exception() is None
    got = {(int(x.id), x.day - day) for x in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {(n, d) for n in range(30) for d in range(n % 3, 8, 3)}
    assert "page" in state.kept(spark, str(tmp_path / "c"), "not_before").columns


def test_live_lists_of_many_items_in_eight_pages(spark, tmp_path, rows_of):
    """Sales without a price, an item or a time too; the states are as many as the pages, not as the items."""
    columns = ["item_id", "date", "avg", "max", "min", "volume"]
    schema = "item_id int, highest_bid long, count long, end timestamp"
    rows = [(n * 7 % 60 if n % 59 else None, n % 13 * 10 if n % 17 else None, n % 5 if n % 11 else None, START + timedelta(minutes=n * 8) if n % 50 else None) for n in range(480)]
    for part in (rows[:300], rows[300:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = r.sale_points(live.file_events(spark, str(tmp_path / "in"), schema, files_per_batch=1))
    query = live.file_sink(state.live_lists(stream, "item_id", F.col("date"), pages=8), str(tmp_path / "t"), str(tmp_path / "c"))
    query.awaitTermination()
    assert query.exception() is None

    points = r.sale_points(spark.createDataFrame(rows, schema)).withColumn("item_id", F.col("item_id").cast("string"))
    as_of = F.lit(points.agg(F.max("date")).first()[0] - timedelta(minutes=1))
    hour = F.date_trunc("hour", "date")
    over = hour + F.expr("INTERVAL 1 HOUR") <= as_of
    typed = [F.col(c).cast("double") if c in ("avg", "max", "min") else F.col(c) for c in columns]
    only = {c: F.when(F.col("avg") > 0, F.col(c)) for c in columns[1:]}
    hours = points.filter(over).groupBy("item_id", hour.alias("hour")).agg(
        F.min(only["date"]).alias("date"), (F.sum(only["avg"]) / F.count(F.lit(1))).alias("avg"), F.max(only["max"]).cast("double").alias("max"),
        F.min(only["min"]).cast("double").alias("min"), F.sum(only["volume"]).alias("volume"), F.count(only["avg"]).alias("n")
    ).filter("n > 0")
    told = spark.read.parquet(str(tmp_path / "t"))
    running, day = state.lists_now(spark, str(tmp_path / "c"))
    assert rows_of(state.merged_hours(told), "hour", *columns) == rows_of(hours, "hour", *columns)
    assert rows_of(day, *columns) == rows_of(hours.filter(F.col("hour") + F.expr("INTERVAL 24 HOURS") > as_of), *columns) != []
    assert rows_of(running, *typed) == rows_of(points.filter(~over), *typed) != []
    assert {x.item_id for x in told.collect()} >= {None, "0", "59"}
    assert told.groupBy("item_id", "part", "hour").count().filter("count > 1").isEmpty()
    held = state.kept(spark, str(tmp_path / "c"), "day").select("page", "part").distinct().collect()
    assert {(x.page, x.part) for x in held} == {(page, part) for page in range(2) for part in range(4)}


class FakeState(list):
    """A list of the state store that counts its calls."""

    calls = 0

    def get(self):
        return iter(list(self))

    def appendValue(self, value):
        self.calls += 1
        self.append(value)

    def put(self, values):
        self.calls += 1
        self[:] = values


class FakeHandle(dict):
    def __init__(self):
        self.timers = set()

    def getListState(self, name, schema):
        return self.setdefault(name, FakeState())

    def registerTimer(self, at):
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_page_of_live_lists_makes_few_calls(monkeypatch):
    """A page of 400 items over 50 hours: a call per chunk, one timer at a time; hours leave a day after their start."""
    monkeypatch.setattr(state, "CHUNK_ROWS", 150)
    handle, job = FakeHandle(), state.LiveLists()
    job.init(handle)
    frame = pd.DataFrame({"item_id": [f"i{n % 400}" for n in range(500)], "at": [n * state.HOUR // 10 for n in range(500)]})
    frame = frame.assign(avg=1.0, max=2.0, min=0.5, volume=[None if n % 10 == 1 else 3 for n in range(500)])
    assert not list(job.handleInputRows((0, 1), iter([frame[:200], frame[200:]]), handle))
    assert handle["running"].calls == 4 and handle.timers == {state.HOUR // 1000}
    assert [len(state.unpacked(value)) for (value,) in handle["running"]] == [150, 50, 150, 150]

    handle.now, handle.timers = 30 * state.HOUR // 1000 + 5, set()
    (told,) = job.handleExpiredTimer((0, 1), handle, None)
    assert len(told) == 300 and set(told["part"]) == {1} and told["volume"].isna().sum() == 30 and told["volume"].sum() == 810
    assert sum(len(state.unpacked(value)) for (value,) in handle["running"]) == 200
    assert [hour for hour, _ in handle["day"]] == [h * state.HOUR for h in range(7, 30)] and handle["day"].calls == 1
    assert handle.timers == {31 * state.HOUR // 1000}

    handle.now, handle.timers = 60 * state.HOUR // 1000, set()
    (told,) = job.handleExpiredTimer((0, 1), handle, None)
    assert len(told) == 200 and not handle["running"] and [hour for hour, _ in handle["day"]] == [h * state.HOUR for h in range(37, 50)]
    assert handle.timers == {61 * state.HOUR // 1000}
    assert not list(job.handleExpiredTimer((0, 1), handle, None)) and len(handle["day"]) == 13


def test_chunks_of_an_hour_fold_to_the_same_row():
    points = [(n, None if n % 7 == 0 else float(n % 5), 2.0 * n, -1.0 * n, None if n % 3 else n) for n in range(90)]
    table = pa.Table.from_pylist([dict(zip(state.POINT_ROWS.names, ("a", *p))) for p in points], state.POINT_ROWS)
    chunks = [state.unpacked(state.packed(table.slice(start, 7))) for start in range(0, 90, 7)]
    whole = state.merged_parts(pa.concat_tables([state.closed_hours(c) for c in chunks]))
    assert whole.schema == state.CLOSED_ROWS and whole.to_pylist() == state.closed_hours(table).to_pylist()
    assert tuple(whole.drop_columns("item_id").to_pylist()[0].values()) == state.folded(0, points)
