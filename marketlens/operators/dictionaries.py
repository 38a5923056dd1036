"""Dictionaries that grow over runs: append-only id tables with a version per run, and a stream that encodes by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from marketlens.operators import attributes as a
from marketlens.operators.dedup import fresh_ids
from marketlens.session import stored
from marketlens.streaming.live import children


def known_ids(spark: SparkSession, path: str, keys: list[str], before: int | None = None) -> DataFrame:
    """(id, keys, run) of the dictionary, or as it was before a run; empty where there is none yet."""
    fields = [StructField("id", LongType()), *[StructField(k, StringType()) for k in keys]]
    runs = sorted(int(name.split("=")[1]) for name in children(spark, path) if name.startswith("run="))
    folders = [f"{path}/run={r}" for r in runs if before is None or r < before]
    schema = StructType([*fields, StructField("run", LongType())])
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders)


def extend_dictionary(path: str, seen: DataFrame, keys: list[str], run: int) -> DataFrame:
    """Give new keys ids above all of earlier runs and keep them as this run's version; returns (id, keys) of all.

    A version is written once and never touched by later runs, so an id stays with its key for good. A run
    that failed is repeated under its number: it reads the versions before it only and overwrites its
    own. Runs must follow each other; a dictionary has a single writer. Keys with a null have no id.
    """
    spark = seen.sparkSession
    known = known_ids(spark, path, keys, run).select("id", *keys)
    whole = seen.select(*[F.col(k).cast("string").alias(k) for k in keys]).dropna()
    fresh_ids(known, whole, keys).select("id", *keys).write.mode("overwrite").parquet(f"{path}/run={run}")
    return known_ids(spark, path, keys, run + 1).select("id", *keys)


def attribute_encoder(path: str, items: DataFrame) -> Callable[[DataFrame, int], None]:
    """Batch writer for item attributes: extends the dictionaries by each batch, then encodes it by them.

    Takes batches of (auction_id, attributes). ``path`` gets ``keys``, ``values`` and ``encoded``; the batch's
    number is the run, so a replay gives the same ids and overwrites the same folders.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = stored(a.routed(a.flat_rows(batch)), "batch-attributes")
        keys = extend_dictionary(f"{path}/keys", rows.select(F.col("key").alias("slug")), ["slug"], number)
        entries = rows.filter("entry is not null").select("key", F.col("entry").alias("value"))
        values = extend_dictionary(f"{path}/values", entries, ["key", "value"], number)
        too_many = F.raise_error(F.lit(f"attribute keys have ids up to {a.MOST_KEYS}")).cast("bigint")
        keys = keys.withColumn("id", F.when(F.col("id") <= a.MOST_KEYS, F.col("id")).otherwise(too_many))
        a.encoded(rows, keys, values, items).write.mode("overwrite").parquet(f"{path}/encoded/batch_id={number}")

    return write
