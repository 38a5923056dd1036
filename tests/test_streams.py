"""Live jobs over several files and batches, against their batch twins; replays must not change anything."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketlens.operators import events as e
from marketlens.operators import rollup as r
from marketlens.streaming import live

START = datetime(2024, 1, 1)
SCHEMA = "seq long, item_id int, highest_bid long, count int, end timestamp, kind string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Six files of sales, in order of time, read two at a time."""
    path = str(tmp_path_factory.mktemp("feed"))
    kinds = ["new", "bid", "sold", "new", "ended"]
    for file in range(6):
        rows = []
        for i in range(40):
            n = file * 40 + i
            rows.append((n, n % 3, 10 + n * 7 % 50, n % 4, START + timedelta(minutes=n * 11), kinds[n * 5 % 7 % 5]))
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder):
    return live.file_events(spark, folder, SCHEMA, files_per_batch=2)


def drain(query):
    query.awaitTermination()
    assert query.exception() is None


def test_closed_hours_equal_the_batch_roll_up(spark, folder, tmp_path, rows_of):
    points = r.sale_points(stream(spark, folder)).withColumnRenamed("end", "date")
    hours = live.hour_points(points, ["item_id"])
    drain(live.file_sink(hours, str(tmp_path / "t"), str(tmp_path / "c")))
    got = spark.read.parquet(str(tmp_path / "t"))
    batch = r.sale_points(spark.read.schema(SCHEMA).parquet(folder))
    last = batch.agg(F.max("date")).first()[0]
    expected = (
        batch.groupBy("item_id", F.date_trunc("hour", "date").alias("hour"))
        .agg(F.avg("avg").alias("avg"), F.max("max").alias("max"), F.min("min").alias("min"), F.sum("volume").alias("volume"))
        .filter(F.col("hour") + F.expr("INTERVAL 1 HOUR") <= F.lit(last - timedelta(minutes=1)))
    )
    columns = ["item_id", "hour", "avg", "max", "min", "volume"]
    assert rows_of(got, *columns) == rows_of(expected, *columns)


def test_hourly_fill_survives_a_replayed_batch(spark, folder, tmp_path, rows_of):
    path = str(tmp_path / "t")
    writer = live.hours_writer(path, ["item_id"])

    def twice(batch, number):
        writer(batch, number)
        writer(batch, number)

    drain(live.batch_sink(stream(spark, folder), twice, str(tmp_path / "c")))
    got = live.merged_hours(live.batches(spark, path), ["item_id"])
    expected = r.price_rollup(spark.read.schema(SCHEMA).parquet(folder).filter("highest_bid > 1"), ["item_id"], "hour")
    columns = ["item_id", "date", "avg", "max", "min", "volume"]
    assert rows_of(got, *columns) == rows_of(expected, *columns)


def test_events_delivered_again_are_dropped(spark, folder, tmp_path):
    doubled = stream(spark, folder).unionByName(stream(spark, folder))
    drain(live.file_sink(live.once_each(doubled, "seq", "end", "1 day"), str(tmp_path / "t"), str(tmp_path / "c")))
    got = spark.read.parquet(str(tmp_path / "t"))
    assert got.count() == 240 and got.select("seq").distinct().count() == 240


def test_newer_points_across_batches(spark, folder, tmp_path):
    """Every 10th point is an hour early, so it is late wherever the batches are cut."""
    early = F.when(F.col("seq") % 10 == 9, F.expr("end - INTERVAL 1 HOUR")).otherwise(F.col("end"))
    points = stream(spark, folder).select("seq", (F.col("item_id") * 0).alias("key"), early.alias("date"))
    path = str(tmp_path / "t")
    drain(live.batch_sink(points, live.newer_points_writer(path, ["key"], "seq"), str(tmp_path / "c")))
    got = live.batches(spark, f"{path}/points")
    late = {x.seq for x in got.filter("not cast(accepted as boolean)").collect()}
    assert late == {n for n in range(240) if n % 10 == 9}
    assert got.count() == 240
    # the same batch again gives the same verdicts
    live.newer_points_writer(path, ["key"], "seq")(spark.read.schema(SCHEMA).parquet(folder).select("seq", F.lit(0).alias("key"), early.alias("date")).filter("seq >= 160"), 2)
    again = {x.seq for x in live.batches(spark, f"{path}/points").filter("not cast(accepted as boolean)").collect()}
    assert again == late


def test_active_set_and_routing(spark, folder, tmp_path, rows_of):
    table = spark.read.schema(SCHEMA).parquet(folder)
    path = str(tmp_path / "t")
    drain(live.batch_sink(stream(spark, folder), live.batch_folder(path), str(tmp_path / "c")))
    keyed = lambda df: df.withColumn("uuid", (F.col("seq") % 50).cast("string"))
    got = e.active_set(keyed(live.batches(spark, path)), "uuid", ["end", "seq"])
    last: dict[str, str] = {}
    for row in sorted(table.collect(), key=lambda x: x.seq):
        last[str(row.seq % 50)] = row.kind
    assert {x.uuid for x in got.collect()} == {k for k, kind in last.items() if kind in ("new", "bid")}
    routed = e.of_kind(stream(spark, folder), "sold")
    drain(live.file_sink(routed, str(tmp_path / "r"), str(tmp_path / "rc"), ["kind"]))
    assert spark.read.parquet(str(tmp_path / "r")).count() == table.filter("kind = 'sold'").count()


def test_a_failing_batch_is_not_committed(spark, folder, tmp_path):
    path, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    write = live.batch_folder(path)

    def breaks(batch, number):
        write(batch, number)
        if number == 1:
            raise ValueError("lost executor")

    query = live.batch_sink(stream(spark, folder), breaks, checkpoint)
    with pytest.raises(Exception):
        query.awaitTermination()
    drain(live.batch_sink(stream(spark, folder), write, checkpoint))
    assert live.batches(spark, path).count() == 240
