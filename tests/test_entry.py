"""The driver contract."""

from __future__ import annotations

import importlib.util
from pathlib import Path

from marketlens import tables as t
from marketlens.operators.attributes import enchant_rows, export_features, training_features


def test_entry_gives_rows(spark):
    path = Path(__file__).resolve().parent.parent / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    frame = entry.entry(spark)
    assert frame.columns == ["item_id", "date", "avg", "max", "min", "volume"] and frame.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_feature_export_keeps_every_auction(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    sales = t.feed(spark, sf_dir).selectExpr("event_id as auction_id", "ts as end", "cast(buy_price * 100 as bigint) as highest_bid")
    enchants = enchant_rows(t.attribute_items(spark, sf_dir), t.known_types(spark))
    lookup = spark.createDataFrame([(1, 5, 70), (1, 5, 70), (1, 6, 1), (2, 5, 3)], "auction_id long, key_id long, value long")
    keys = spark.createDataFrame([(5, "hpc"), (6, "not a feature")], "id long, slug string")
    features = training_features(sales, enchants, lookup, keys, "2023-01-01 00:00:00")
    path = str(tmp_path / "features")
    export_features(features, path)
    stored = spark.read.parquet(path)
    assert stored.count() == sales.filter("highest_bid > 0").count()
    first = {r.auction_id: r.attributes for r in stored.filter("auction_id in (1, 2)").collect()}
    assert [(a.value, a.copies) for a in first[1]] == [(70, 2)] and [a.value for a in first[2]] == [3]
