"""Roll-ups and series on hand-made rows, against plain Python where a loop says it best."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marketlens.operators import rollup as r
from marketlens.operators import series as s

SALE = "item_id int, highest_bid long, count int, end timestamp"


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def test_window_edges_and_bid_threshold(spark, rows_of):
    times = ["2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-02 00:00:00"]
    rows = [(1, bid, 1, at(x)) for x in times for bid in (0, 1, 2)]
    kept = spark.createDataFrame(rows, SALE).filter(r.when_sold("2024-01-01 00:00:00", "2024-01-02 00:00:00"))
    assert rows_of(kept, "highest_bid", "end") == [(2, at("2024-01-01 00:00:01"))]


def test_unit_price_divides_whole_and_survives_empty_stacks(spark, rows_of):
    rows = [(1, 10, 3, at("2024-01-01 05:00:00")), (1, 50, 0, at("2024-01-01 06:00:00"))]
    df = spark.createDataFrame(rows, SALE)
    assert rows_of(r.price_rollup(df, ["item_id"])) == [(1, at("2024-01-01 00:00:00"), 3.0, 3, 3, 3)]
    assert len(rows_of(r.price_rollup(df, ["item_id"], "hour"))) == 2


def test_combined_point_divides_by_all_points(spark, rows_of):
    rows = [
        (1, at("2024-01-01 10:00:00"), 10.0, 12.0, 8.0, 2),
        (1, at("2024-01-01 11:00:00"), 0.0, 99.0, 0.0, 5),
        (1, at("2024-01-02 11:00:00"), 50.0, 60.0, 40.0, 7),
        (2, at("2024-01-02 11:00:00"), 50.0, 60.0, 40.0, 7),
    ]
    points = spark.createDataFrame(rows, "item_id int, date timestamp, avg double, max double, min double, volume int")
    got = r.combine_points(points, ["item_id"], "2024-01-01 00:00:00", "2024-01-01 23:00:00")
    assert rows_of(got, "item_id", "avg", "max", "min", "volume") == [(1, 10.0 / 3, 12.0, 8.0, 2)]


def test_spike_at_the_limit_is_dropped(spark, rows_of):
    rows = [(1, 1.0, 2000.0), (1, 3.0, 1999.0)]
    points = spark.createDataFrame(rows, "item_id int, min double, max double")
    assert rows_of(r.spike_filter(points, ["item_id"], hot_rows=1), "max") == [(1999.0,)]


def test_backfill_skips_weeks_with_a_price_near_their_edges(spark, rows_of):
    sales = [(1, 100, 1, at(f"2024-01-{d:02d} 00:00:00")) for d in (1, 9, 16, 23, 30)]
    prices = [(1, at("2024-01-15 00:00:30")), (1, at("2024-01-24 00:00:00"))]
    existing = spark.createDataFrame(prices, "item_id int, date timestamp")
    got = r.backfill(spark.createDataFrame(sales, SALE), existing, "2024-01-01 00:00:00", "2024-02-01 00:00:00")
    # week 1 and 2 touch the first price, week 3 holds the second, week 4 began within the last week
    assert rows_of(got, "date") == [(at("2024-01-01 00:00:00"),)]


def test_bucket_start_counts_from_the_year_one(spark):
    got = spark.range(1).select(r.bucket_start(F.lit("2024-01-04 10:07:30").cast("timestamp"), 7 * 86400).alias("w")).first().w
    assert got == at("2024-01-01 00:00:00")


def upper(values):
    ordered = sorted(values)
    middle = ordered[len(ordered) // 2] if ordered else 0
    return middle or 1


def filled_by_hand(history: dict[int, int], day: int, days: int) -> dict[int, int]:
    buffer = sorted(history.items())[:5]
    out = {}
    for d in range(day - days, day + 1):
        if d in history:
            buffer.append((d, history[d]))
            if len(buffer) > 5:
                buffer.remove(min(buffer, key=lambda kv: kv[0]))
            out[d] = history[d]
        else:
            out[d] = upper([v for _, v in buffer])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_gap_filling_follows_the_buffer(spark, seed):
    rng = random.Random(seed)
    end = 19723  # 2024-01-01
    histories = {}
    for item in range(6):
        first = end - rng.choice([5, 30, 60, 450])
        days = sorted(rng.sample(range(first, end + 4), rng.randrange(1, min(40, end + 4 - first))))
        histories[item] = {d: rng.randrange(0, 20) for d in days}
    rows = [(i, d, p) for i, h in histories.items() for d, p in h.items()]
    prices = spark.createDataFrame(rows, "item int, day int, price long")
    got = {(x.item, x.day): x.price for x in s.gap_filled(prices, "item", "2024-01-01 00:00:00").collect()}
    expected = {(i, d): p for i, h in histories.items() for d, p in filled_by_hand(h, end, 400).items()}
    assert got == expected


@pytest.mark.parametrize("seed", range(3))
def test_dated_price_is_smoothed_or_filled(spark, seed):
    rng = random.Random(100 + seed)
    history = {d: rng.randrange(0, 30) for d in rng.sample(range(1000, 2000), 25)}
    asked = sorted(rng.sample(range(900, 2500), 120)) + list(history)[:10]
    prices = spark.createDataFrame([("x", d, p) for d, p in history.items()], "tag string, day int, price long")
    rows = spark.createDataFrame([("x", d) for d in asked] + [("unknown", 5)], "tag string, day int")
    got = {(x.tag, x.day): x.price for x in s.price_at(rows, prices, "tag", hot_rows=10).collect()}
    for day in asked:
        near = [history[d] for d in range(day - 2, day + 3) if d in history]
        want = upper(near) if day in history else filled_by_hand(history, day, 400)[day]
        assert got["x", day] == want, day
    assert got["unknown", 5] == 1


def test_upper_median(spark, rows_of):
    rows = [(1, d, p) for d, p in enumerate([4, 1, 3, 2])] + [(2, 0, 0)]
    got = s.centered_median(spark.createDataFrame(rows, "i int, day int, price long"), "i")
    assert rows_of(got, "i", "day", "smoothed") == [(1, 0, 3), (1, 1, 3), (1, 2, 3), (1, 3, 2), (2, 0, 1)]


def test_strictly_newer_refuses_equal_and_older(spark, rows_of):
    dates = ["2024-01-01", "2024-01-01", "2024-01-03", "2024-01-02", "2024-01-04"]
    rows = [(1, i, at(d)) for i, d in enumerate(dates)]
    points = spark.createDataFrame(rows, "k int, seq long, date timestamp")
    assert rows_of(s.strictly_newer(points, ["k"], "seq", F.col("seq")), "seq") == [(0,), (2,), (4,)]


def test_color_needs_three_sightings_and_a_repeat(spark, rows_of):
    colors = {"a": "xxxx", "b": "xyxyy", "c": "xxx", "d": "yyyzz"}
    rows = [(t, i, c) for t, text in colors.items() for i, c in enumerate(text)]
    got = s.color_consensus(spark.createDataFrame(rows, "tag string, seq long, color string"), "tag", "seq", F.floor(F.col("seq") / 2))
    assert rows_of(got, "tag", "color", "seq") == [("a", "x", 3), ("b", "y", 4), ("d", "z", 4)]
