"""Shared helpers of the subpackage: reading, registering, Arrow batches, words and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.session import configure, stored

#: A word, as every contract of this subpackage has it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table. Arrow batches are kept to 1,000 rows, so that long texts fit a worker's memory."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_column(
    df: DataFrame, column: str, new: list[T.StructField], make: Callable[[], Callable[[list], list[list]]], drop: bool = True
) -> DataFrame:
    """Add columns computed from one column, batch by batch.

    ``make`` runs once in each task and gives a function from the column's values to one
    list for each new column. All other columns pass through as they are (a column with a
    new column's name gives way), ``column`` itself too unless ``drop``.
    """
    names = {f.name for f in new}
    kept = [f for f in df.schema.fields if f.name not in names and not (drop and f.name == column)]
    (given,) = free(df, "__input")
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{column}`").alias(given))
    schema = T.StructType(kept + new)
    kinds = [_arrow(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            out = fn(batch.column(len(kept)).to_pylist())
            arrays = [batch.column(i) for i in range(len(kept))] + [pa.array(v, type=k) for v, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of the frame has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode()


def fingerprint(*columns: Column | str) -> list[Column]:
    """Two 64-bit hashes with different seeds, together a 128-bit key of the columns' values."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list (a, b): one row (node, component), component the smallest node.

    Rounds of large-star and small-star steps; each round is written to the shared folder,
    so lineage stays short and a lost executor costs one round at most. Nodes without an
    edge are not in the result. Ends when a round changes nothing; an empty list gives no rows.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select("b", "a"))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u")
        if large:
            out = out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sums == seen or not sums[0]:
            break
        seen = sums
        now = stored(star(star(now, True), False), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()
