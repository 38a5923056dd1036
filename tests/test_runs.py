"""Dictionaries over runs and paged exports: growing input, failed runs, replays."""

from __future__ import annotations

import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marketlens.operators import dictionaries, export
from marketlens.operators import attributes as a
from marketlens.streaming import live


def words(spark, *values):
    return spark.createDataFrame([("k", v) for v in values], "key string, value string")


def ids(spark, path):
    return {(r.key, r.value): (r.id, r.run) for r in dictionaries.known_ids(spark, path, ["key", "value"]).collect()}


def test_later_runs_keep_all_ids(spark, tmp_path):
    path = str(tmp_path / "d")
    dictionaries.extend_dictionary(path, words(spark, "a", "b", "b", None), ["key", "value"], 0)
    first = ids(spark, path)
    assert sorted(i for i, _ in first.values()) == [1, 2] and {v for _, v in first} == {"a", "b"}
    told = dictionaries.extend_dictionary(path, words(spark, "b", "c", "d"), ["key", "value"], 1)
    second = ids(spark, path)
    assert {k: v for k, v in second.items() if v[1] == 0} == first and sorted(i for i, _ in second.values()) == [1, 2, 3, 4]
    assert {r.value: r.id for r in told.collect()} == {k[1]: i for k, (i, _) in second.items()}
    # the same run again, and one that brings nothing new
    dictionaries.extend_dictionary(path, words(spark, "b", "c", "d"), ["key", "value"], 1)
    dictionaries.extend_dictionary(path, words(spark, "a", "d"), ["key", "value"], 2)
    assert ids(spark, path) == second


def test_a_failed_run_leaves_no_trace(spark, tmp_path):
    path = str(tmp_path / "d")
    dictionaries.extend_dictionary(path, words(spark, "a"), ["key", "value"], 0)
    broken = words(spark, "b", "c").withColumn("value", F.when(F.col("value") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        dictionaries.extend_dictionary(path, broken, ["key", "value"], 1)
    dictionaries.extend_dictionary(path, words(spark, "c", "z"), ["key", "value"], 1)
    got = ids(spark, path)
    assert got["k", "a"] == (1, 0) and sorted(i for i, _ in got.values()) == [1, 2, 3]


def test_encoding_stream_survives_a_replay(spark, tmp_path):
    """Ids decode to the texts they were made from, over batches of which one comes twice."""
    folder, path = str(tmp_path / "in"), str(tmp_path / "t")
    for n in range(3):
        documents = [(n * 10 + i, json.dumps({"id": "X", "note": f"text {(n + i) % 4}", "exp": n, "heldItem": "HAT"})) for i in range(4)]
        spark.createDataFrame(documents, "auction_id long, attributes string").coalesce(1).write.mode("append").parquet(folder)
    items = spark.createDataFrame([(7, "HAT")], "id long, tag string")
    writer = dictionaries.attribute_encoder(path, items)

    def twice(batch, number):
        writer(batch, number)
        if number == 1:
            writer(batch, number)

    query = live.batch_sink(live.file_events(spark, folder, "auction_id long, attributes string", files_per_batch=1), twice, str(tmp_path / "c"))
    query.awaitTermination()
    assert query.exception() is None
    keys = {r.id: r.slug for r in dictionaries.known_ids(spark, f"{path}/keys", ["slug"]).collect()}
    values = {r.id: (r.key, r.value) for r in dictionaries.known_ids(spark, f"{path}/values", ["key", "value"]).collect()}
    rows = live.batches(spark, f"{path}/encoded").collect()
    source = a.routed(a.flat_rows(spark.read.parquet(folder))).collect()
    assert len(rows) == len(source)
    decoded = sorted((r.auction_id, keys[r.key_id], values[r.value][1] if keys[r.key_id] == "note" else r.value) for r in rows)
    assert decoded == sorted((r.auction_id, r.key, r.entry if r.key == "note" else 7 if r.key == "heldItem" else r.number) for r in source)


def test_export_goes_on_after_a_failure(spark, tmp_path, rows_of):
    path = str(tmp_path / "e")
    rows = spark.range(37, 4321, 3).withColumn("x", F.col("id") * 2)
    bad = rows.withColumn("x", F.when(F.col("id") > 3000, F.raise_error(F.lit("lost"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        export.export_pages(bad, "id", path, size=100, steps=4)
    held = {p.name for p in Path(path, "manifest").glob("step=*")}
    assert held and len(held) < 4
    kept = export.exported(spark, path).count()
    assert 0 < kept < rows.count()
    written = {str(p): p.stat().st_mtime_ns for p in Path(path, "pages").rglob("*.parquet")}
    assert export.export_pages(rows, "id", path, size=100, steps=4) == 4 - len(held)
    assert rows_of(export.exported(spark, path), "id", "x") == rows_of(rows)
    first = export.manifest(spark, path).filter("step = 0").collect()
    assert all(Path(p).stat().st_mtime_ns == m for p, m in written.items() if int(p.split("page=")[1].split("/")[0]) in {r.page for r in first})
    assert export.export_pages(rows, "id", path, size=100, steps=4) == 0
    pages = {r.page: (r.rows, r["first"], r["last"]) for r in export.manifest(spark, path).collect()}
    assert sum(n for n, _, _ in pages.values()) == rows.count() and all(f // 100 == p == z // 100 for p, (_, f, z) in pages.items())


def test_a_page_that_was_lost_halfway_is_not_read(spark, tmp_path):
    path = str(tmp_path / "e")
    export.export_pages(spark.range(100), "id", path, size=10, steps=5)
    shutil.rmtree(Path(path, "manifest", "step=1"))
    assert {r.id // 20 for r in export.exported(spark, path).collect()} == {0, 2, 3, 4}
    assert export.export_pages(spark.range(0), "id", str(tmp_path / "none")) == 0
    odd = spark.createDataFrame([(None,), (5,), (None,)], "id long")
    export.export_pages(odd, "id", str(tmp_path / "odd"))
    assert export.exported(spark, str(tmp_path / "odd")).count() == 3


def test_pages_share_folders(spark, tmp_path):
    """The number of folders grows with a hundredth of the pages, and no page is in two of them."""
    path = str(tmp_path / "e")
    export.export_pages(spark.range(0, 10_000).withColumn("x", F.col("id") * 3), "id", path, size=10, steps=3)
    folders = [p for p in Path(path, "pages").iterdir() if p.is_dir()]
    assert len(folders) <= 3 * 4
    got = export.exported(spark, path)
    assert got.columns == ["id", "x", "page"] and got.filter("page = floor(id / 10) and x = id * 3").count() == 10_000
    written = spark.read.parquet(f"{path}/pages")
    assert written.groupBy("page").agg(F.countDistinct("first_page").alias("n")).filter("n > 1").count() == 0
    assert export.manifest(spark, path).count() == 1_000
