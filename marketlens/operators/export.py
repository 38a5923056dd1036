"""Export of a table in pages of key ranges, with a manifest to go on from after a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators.listings import pages_by_key
from marketlens.streaming.live import children

PAGES_TOGETHER = 100  # pages in one folder: a file for each would make their number the cost of the export


def export_pages(rows: DataFrame, key: str, path: str, size: int = 1000, steps: int = 8) -> int:
    """Write ``rows`` as pages, N the key divided by ``size``; gives the number of steps done now.

    A folder ``path/pages/first_page=N`` holds the PAGES_TOGETHER pages from N on, or fewer where a step ends, in their
    order, each row with its ``page``. Within a step only whole folders are written.
    The key range is cut into ``steps`` runs of whole pages. Each is one job, reads its own range only and
    enters its pages (page, rows, first, last) into ``path/manifest`` when they stand; a later call with the
    same rows skips the steps that are in the manifest and writes the others anew. Rows without a
    key go to the folder ``__HIVE_DEFAULT_PARTITION__`` of the first step. An empty table has no pages.
    """
    spark = rows.sparkSession
    paged = pages_by_key(rows, key, size)
    first, last, n = paged.agg(F.min("page"), F.max("page"), F.count(F.lit(1))).first()
    if not n:
        return 0
    first, last = (first or 0), (last or 0)
    width = -(-(last - first + 1) // steps)
    done = 0
    for step in range(-(-(last - first + 1) // width)):
        if "_SUCCESS" in children(spark, f"{path}/manifest/step={step}"):
            continue
        low, high = first + step * width, first + (step + 1) * width
        here = F.col(key).between(low * size, high * size - 1)
        part = paged.filter(here | F.col(key).isNull() if step == 0 else here)
        together = (F.lit(low) + F.floor((F.col("page") - low) / PAGES_TOGETHER) * PAGES_TOGETHER).alias("first_page")
        folders = part.select("*", together).repartition("first_page").sortWithinPartitions("first_page", "page", key)
        folders.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("first_page").parquet(f"{path}/pages")
        pages = part.groupBy("page").agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
        pages.write.mode("overwrite").parquet(f"{path}/manifest/step={step}")
        done += 1
    return done


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(page, rows, first, last, step) of the pages that are whole."""
    return spark.read.parquet(f"{path}/manifest")


def exported(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all whole pages; pages of a step that did not end are not read."""
    whole = manifest(spark, path).select(F.col("page").alias("__page"))
    pages = spark.read.parquet(f"{path}/pages").drop("first_page")
    return pages.join(whole, F.col("page").cast("bigint").eqNullSafe(F.col("__page")), "left_semi")
