"""Live jobs: event sources, hour windows, and sinks that survive a replayed batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery
from pyspark.sql.types import StructType

from marketlens.operators.skew import earlier_rows, hot_join
from marketlens.session import configure

# Fixed values of the stream contract.
HOUR_GRACE = "1 minute"
# Date patterns of the hourly table's folders.
HOURLY_SPAN, DAILY_SPAN = "yyyyMMddHH", "yyyyMMdd"


def file_events(spark: SparkSession, folder: str, schema: StructType | str, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Events from Parquet files as they arrive in a folder."""
    configure(spark)
    reader: DataStreamReader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def kafka_events(spark: SparkSession, servers: str, topic: str, schema: str, batch_size: int | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """JSON events of a topic from its beginning, all that wait in each trigger unless limited. Needs the Kafka package."""
    limit = {"maxOffsetsPerTrigger": str(batch_size)} if batch_size else {}
    raw = (
        configure(spark)
        .readStream.format("kafka")
        .options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", **limit, **(options or {})})
        .load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e"), "partition", "offset").select("e.*", "partition", "offset")


def kafka_sink(stream: DataFrame, servers: str, topic: str, key: str, checkpoint: str, options: dict[str, str] | None = None) -> StreamingQuery:
    """Rows as JSON under their key, acknowledged by all replicas, LZ4 packed. Needs the Kafka package."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*stream.columns)).alias("value"))
    settings = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.compression.type": "lz4", "kafka.linger.ms": "100"}
    return rows.writeStream.format("kafka").options(**settings, **(options or {})).option("checkpointLocation", checkpoint).start()


def file_sink(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Append rows to a Parquet table, each exactly once, until the source is drained."""
    writer = stream.writeStream.format("parquet").option("compression", "lz4").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.outputMode("append").trigger(availableNow=True).start(path)


def batch_sink(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to a function; its offsets are committed after the function returned.

    A failed batch comes again with the same number and rows, so the function must
    overwrite what it wrote under that number (see :func:`batch_folder`).
    """
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A writer that keeps each batch in a folder of its own and overwrites it on replay."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return write


def event_time(events: DataFrame, column: str) -> DataFrame:
    """Watermarks need a timestamp with time zone; files may hold one without."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def hour_points(points: DataFrame, keys: list[str], grace: str = HOUR_GRACE) -> DataFrame:
    """Fold the points of each closed hour into one, as soon as the hour is over plus a grace time.

    Takes ``date``, ``avg``, ``max``, ``min`` and ``volume``; points without a price
    count only for the average's divisor.
    """
    priced = F.col("avg") > 0

    def only(name: str) -> Column:
        return F.when(priced, F.col(name))

    return (
        points.withWatermark("date", grace)
        .groupBy(F.window("date", "1 hour"), *keys)
        .agg(
            F.count(only("avg")).alias("__n"),
            (F.sum(only("avg")) / F.count(F.lit(1))).alias("avg"),
            F.max(only("max")).alias("max"),
            F.min(only("min")).alias("min"),
            F.sum(only("volume")).alias("volume"),
            F.min(only("date")).alias("date"),
        )
        .filter("__n > 0")
        .select(*keys, F.col("window.start").alias("hour"), "date", "avg", "max", "min", "volume")
    )


def once_each(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Drop events delivered again within the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


# Mergeable hours ------------------------------------------------------------------


def hour_partials(sales: DataFrame, keys: list[str]) -> DataFrame:
    """Sums, counts and extremes per key and hour that can be merged across batches."""
    unit = F.expr("highest_bid div nullif(`count`, 0)")
    return sales.withColumn("__unit", unit).groupBy(*keys, F.date_trunc("hour", F.col("end")).alias("date")).agg(
        F.sum("__unit").alias("total"), F.count("__unit").alias("n"), F.max("__unit").alias("max"), F.min("__unit").alias("min"), F.sum("count").alias("volume")
    )


#: How two partials of the same key and hour become one.
MERGES = {"total": F.sum, "n": F.sum, "max": F.max, "min": F.min, "volume": F.sum}


def hours_writer(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """Batch writer for the hourly table: every batch stores its partials under its number."""
    store = batch_folder(path)

    def write(batch: DataFrame, number: int) -> None:
        store(hour_partials(batch.filter("highest_bid > 1"), keys), number)

    return write


def merged_hours(partials: DataFrame, keys: list[str]) -> DataFrame:
    """The hourly table from the partials of all batches."""
    return partials.groupBy(*keys, "date").agg(
        (F.sum("total") / F.sum("n")).alias("avg"), F.max("max").alias("max"), F.min("min").alias("min"), F.sum("volume").cast("bigint").alias("volume")
    )


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of the shared file system, none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _versions(spark: SparkSession, path: str, span: str) -> list[int]:
    """The batches that left a version of a span, oldest first."""
    return sorted(int(name.split("=")[1]) for name in children(spark, f"{path}/span={span}") if name.startswith("upto="))


def hours_upserter(path: str, keys: list[str], span: str = HOURLY_SPAN) -> Callable[[DataFrame, int], None]:
    """Batch writer that keeps the hourly table up to date at the cost of the hours a batch touches.

    The mergeable sums of an hour stand in ``path/span=H/upto=N``, N the last batch that touched it. Batch N
    reads the version before N of its own hours only, adds its rows and overwrites version N,
    so a replay gives the same files. Versions before that one are of no use any more and
    go: the batch that could ask for them has been committed. ``span`` is the date pattern of a folder;
    a job that fills months in one batch takes DAILY_SPAN, for fewer and larger files.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own_path = f"{path}-incoming/batch_id={number}"
        sums = hour_partials(batch.filter("highest_bid > 1"), keys).withColumn("span", F.date_format("date", span))
        sums.write.mode("overwrite").parquet(own_path)
        own = spark.read.schema(sums.schema).parquet(own_path)
        touched = [row.span for row in own.select("span").distinct().collect()]  # the calendar bounds them
        versions = {part: _versions(spark, path, part) for part in touched}
        before = {part: max((v for v in held if v < number), default=None) for part, held in versions.items()}
        folders = [f"{path}/span={part}/upto={v}" for part, v in before.items() if v is not None]
        both = own
        if folders:
            schema = sums.drop("span").schema.add("span", "string").add("upto", "integer")
            both = own.unionByName(spark.read.schema(schema).option("basePath", path).parquet(*folders).drop("upto"))
        merged = both.groupBy(*keys, "date", "span").agg(*[fold(c).alias(c) for c, fold in MERGES.items()]).withColumn("upto", F.lit(number))
        merged.repartition("span").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("span", "upto").parquet(path)
        for part, held in versions.items():
            for v in held:
                if before[part] is not None and v < before[part]:
                    _delete(spark, f"{path}/span={part}/upto={v}")
        _delete(spark, f"{path}-incoming/batch_id={number - 1}")

    return write


def hours_table(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The hourly table: the newest version of every hour."""
    held = spark.read.option("basePath", path).parquet(path)
    newest = held.groupBy("span").agg(F.max("upto").alias("upto"))  # folder names only, as many as there are spans
    return merged_hours(held.join(newest, ["span", "upto"]), keys)


# Late points ---------------------------------------------------------------------


def newer_points_writer(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """Batch writer that appends points newer than all before them and puts the others aside.

    Keeps per batch: ``accepted``, ``late`` and ``youngest`` (the newest date per key so
    far). A batch starts from the youngest table of the batch before, so a replay
    gives the same result.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = earlier_rows(batch, keys, [order], F.floor(F.col(order) / 100_000), {"__newest": ("max", F.col("date"))})
        if number > 0:
            before = spark.read.parquet(f"{path}/youngest/batch_id={number - 1}")
        else:
            before = batch.limit(0).select(*keys, F.col("date").alias("youngest"))
        known = hot_join(seen, before, keys, "left")
        bar = F.greatest("__newest", "youngest")
        verdict = known.withColumn("accepted", bar.isNull() | (F.col("date") > bar)).drop("__newest", "youngest")
        verdict.write.mode("overwrite").partitionBy("accepted").parquet(f"{path}/points/batch_id={number}")
        newest = batch.groupBy(*keys).agg(F.max("date").alias("__date"))
        youngest = before.join(newest, keys, "full_outer").select(*keys, F.greatest("youngest", "__date").alias("youngest"))
        youngest.write.mode("overwrite").parquet(f"{path}/youngest/batch_id={number}")

    return write


def batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a batch table."""
    return spark.read.parquet(path).drop("batch_id")
