"""Toxicity: the held-out rule, what a score may read, odd rows, accuracy on rows that were never learned."""

import shutil
import zlib

import pytest
from pyspark.sql import functions as F

from marketlens.llm.toxicity import CUT, held_out, op9_toxicity, scored, trained

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def found(spark):
    return {r.doc_id: r for r in op9_toxicity(spark, SF_DIR).collect()}


def test_every_document_has_its_row(spark, found):
    ids = [r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()]
    assert len(found) == len(ids) and set(found) == set(ids)
    for r in found.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and CUT == 0.3


def test_accuracy_on_held_out_rows(spark, found):
    labels = [r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect() if found[r.doc_id].held_out and r.toxic is not None]
    toxic, clean = ([found[r.doc_id].predicted for r in labels if r.toxic == v] for v in (1, 0))
    assert len(toxic) >= 5 and sum(toxic) >= 0.5 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_held_out_labels_and_other_columns_are_never_read(spark, found, tmp_path):
    """Held-out labels turned round, languages and sources exchanged: every score stays as it was."""
    folder = str(tmp_path / "sf")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    turned.coalesce(1).write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs.withColumn("lang", F.lit("xx")).withColumn("source", F.reverse("source")).write.parquet(f"{folder}/documents.parquet")
    other = {r.doc_id: r.score for r in op9_toxicity(spark, folder).collect()}
    assert max(abs(other[k] - r.score) for k, r in found.items()) < 1e-9
    shutil.rmtree(folder)


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    scorer = trained(spark, docs, SF_DIR)
    rows = [(None, None), (1, ""), (1, ""), (2, " \n"), (3, "word " * 50_000), (4, "ok. " * 3)]
    out = scored(spark.createDataFrame([(*r, 7.0, "x") for r in rows], "doc_id long, text string, score double, __input string"), scorer).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r["__input"] == "x" for r in out)
    assert len({r.score for r in out if r.doc_id != 3 and r.doc_id != 4}) == 1
    assert scored(spark.createDataFrame([], "doc_id long, text string"), scorer).collect() == []
