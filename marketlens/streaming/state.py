"""Live jobs that keep state per key: active set, running and closed hours, colour agreement, alerts, newest dates.

State lives in the state store under the query's checkpoint, so a batch costs what the batch
touches, and a restart goes on where the last committed batch ended. What a job
knows is read back with :func:`kept`. Times inside the state are microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketlens.operators.events import ALERT_FLAGS, OPENING
from marketlens.operators.series import COLOR_SIGHTINGS
from marketlens.functions.ids import has_flag
from marketlens.streaming.live import HOUR_GRACE

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR, DAY = 3_600_000_000, 86_400_000_000
#: A key of the live lists is kept in so many parts, so that no item's sales meet in one task.
PARTS = 4
#: Small states are kept together in so many pages, each read and written at once; a call to the state store costs more than many rows.
PAGES = 2_048
#: Marks of closed auctions are taken away at so many times in a horizon.
MARK_STEPS = 24
#: Days before an alert that fired may fire again.
COOL_DOWN_DAYS = 7


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column))


def keyed(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, event_time: bool = False, frames: bool = True) -> DataFrame:
    """Run a processor over the rows of each key of each batch.

    It gets and gives pandas frames or, without ``frames``, plain rows: for a key of a few rows a frame costs more than they do.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    grouped = stream.groupBy(*keys)
    run = grouped.transformWithStateInPandas if frames else grouped.transformWithState
    return run(processor, schema, "append", "eventTime" if event_time else "none")


def paged(*keys: str | Column, pages: int = PAGES) -> Column:
    """The page that holds a key's state; it must not change while a checkpoint lives."""
    return F.pmod(F.xxhash64(*keys), F.lit(pages)).cast("int").alias("page")


def kept(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """The state a job keeps under a name, as of its last committed batch: key columns and value columns."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    value = "list_element" if "list_element" in held.columns else "value"
    return held.select("key.*", f"{value}.*")


def _rows(chunks: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """All rows of a key in one batch, in order; only the columns that were selected for the job."""
    return pd.concat(list(chunks)).sort_values(order, kind="stable")


# Active set ------------------------------------------------------------------------


class ActiveSet(StatefulProcessor):
    """The last event of each auction of a page by (time, number). Closing events stay as a mark until events that old can no longer come."""

    def __init__(self, horizon: int, opening: list[str]):
        self.horizon, self.opening = horizon, opening

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "uuid string, at long, event_id long, kind string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = {}
        for row in rows:  # one row of an auction at a time is kept, however many events it has
            mine = (row["at"], row["event_id"], row["kind"])
            if row["uuid"] not in newest or mine[:2] > newest[row["uuid"]][:2]:
                newest[row["uuid"]] = mine
        last = {held[0]: tuple(held)[1:] for held in self.last.get()}
        newest = {uuid: mine for uuid, mine in newest.items() if uuid not in last or mine[:2] > last[uuid][:2]}
        if newest:
            self._keep({**last, **newest})
        for uuid, (at, number, kind) in newest.items():
            yield Row(uuid=uuid, event_id=number, at=at, kind=kind, active=kind in self.opening)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = {h[0]: tuple(h)[1:] for h in self.last.get()}
        self._keep({uuid: last for uuid, last in held.items() if last[2] in self.opening or last[0] + self.horizon >= now})
        yield from ()

    def _keep(self, last: dict) -> None:
        _replace(self.last, [(uuid, *mine) for uuid, mine in last.items()])
        closed = [at for at, _, kind in last.values() if kind not in self.opening]
        if closed:  # the marks that close in the same part of the horizon go together
            step = max(1, self.horizon // MARK_STEPS)
            self.handle.registerTimer((-(-(min(closed) + self.horizon) // step) * step) // 1000 + 1)


def active_changes(events: DataFrame, delay: str = "1 day", horizon: int = DAY, pages: int = PAGES) -> DataFrame:
    """A change row for every auction that appears, moves or leaves: (uuid, event_id, at, kind, active).

    ``events`` has ``uuid``, ``event_id``, ``kind`` and ``ts``. Events may come out of order by up to
    ``delay``; older ones are late and dropped. A closed auction is forgotten ``horizon``
    microseconds of event time after it closed (up to a 24th later), which must cover the delay. Auctions
    are kept in ``pages``; a batch reads and writes the pages its auctions fall in.
    """
    timed = events.withWatermark("ts", delay).select(paged("uuid", pages=pages), "uuid", "event_id", "kind", "ts", micros("ts").alias("at"))
    return keyed(timed, ["page"], ActiveSet(horizon, OPENING), "uuid string, event_id long, at long, kind string, active boolean", event_time=True, frames=False)


def active_now(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The active set from the job's state, one row per open auction."""
    return kept(spark, checkpoint, "last").filter(F.col("kind").isin(OPENING)).select("event_id", "uuid", "kind", F.timestamp_micros("at").alias("ts"))


# Running hour and day list ------------------------------------------------------------

POINT = "at long, avg double, max double, min double, volume long"
CLOSED = "hour long, n long, priced long, total double, max double, min double, volume long, first long"
ITEM = "item_id string"
#: Points of a chunk of the running list.
CHUNK_ROWS = 10_000

_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
#: How two rows of the same item and hour become one.
_FOLDS = [("n", "sum"), ("priced", "sum"), ("total", "sum"), ("max", "max"), ("min", "min"), ("volume", "sum"), ("first", "min")]


def _arrow(columns: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in columns.split(", "))])


POINT_ROWS, CLOSED_ROWS = _arrow(f"{ITEM}, {POINT}"), _arrow(f"{ITEM}, {CLOSED}")


def packed(rows: pa.Table) -> bytes:
    """Rows as one value of the state store."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes | pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(value).read_all()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column(0):
            yield from unpacked(value.as_buffer()).to_batches()


def hours_of(points: pa.Table) -> np.ndarray:
    """The hour each point falls in, by its start."""
    return points["at"].to_numpy() // HOUR * HOUR


def closed_hours(points: pa.Table) -> pa.Table:
    """One mergeable row per item and hour of points; those without a price count for the divisor only."""
    priced = pc.fill_null(pc.greater(points["avg"], 0.0), False)

    def only(column: str) -> pa.ChunkedArray:
        return pc.if_else(priced, points[column], None)

    one = pa.array(np.ones(len(points), "int64"))
    columns = [points["item_id"], pa.array(hours_of(points)), one, pc.cast(priced, pa.int64()), pc.fill_null(only("avg"), 0.0), *[only(c) for c in ("max", "min", "volume", "at")]]
    return merged_parts(pa.Table.from_arrays(columns, schema=CLOSED_ROWS))


def merged_parts(hours: pa.Table) -> pa.Table:
    """One row per item and hour."""
    merged = hours.group_by(["item_id", "hour"], use_threads=False).aggregate(_FOLDS)
    return merged.rename_columns([c.removesuffix(f"_{fold}") for c, fold in zip(merged.column_names, [""] * 2 + [f for _, f in _FOLDS])]).select(CLOSED_ROWS.names)


class LiveLists(StatefulProcessor):
    """The points of the running hour and, folded to one each, the closed hours of the last day, of the items of a page.

    The points of a batch are appended in chunks, the hours that close lie in one value per hour. A page has
    one timer at its next end of an hour in either list.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("running", "rows binary")
        self.hours = handle.getListState("day", "hour long, rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for chunk in rows:
            points = pa.Table.from_pandas(chunk[POINT_ROWS.names], POINT_ROWS, preserve_index=False)
            self._append(points)
            hour = int(hours_of(points).min())
            first = hour if first is None else min(first, hour)
        self.handle.registerTimer((first + HOUR) // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000  # all that is over by now goes at once
        running, over = [], []
        for (value,) in self.points.get():
            points = unpacked(value)
            is_over = hours_of(points) + HOUR <= now
            running.append(points.filter(pa.array(~is_over)))
            if is_over.any():
                over.append(closed_hours(points.filter(pa.array(is_over))))
        running = pa.concat_tables([POINT_ROWS.empty_table(), *running])
        if over:
            self.points.clear()
            self._append(running)
        closed = merged_parts(pa.concat_tables(over)) if over else CLOSED_ROWS.empty_table()
        starts = closed["hour"].to_numpy()
        day = list(self.hours.get())
        left = [h for h in day if h[0] + DAY > now]
        left += [(int(hour), packed(closed.filter(pa.array(starts == hour)))) for hour in np.unique(starts[starts + DAY > now])]
        if len(closed) or len(left) < len(day):
            _replace(self.hours, left)
        ends = [h[0] + DAY for h in left]  # the hour leaves the day list
        if len(running):
            ends.append(int(hours_of(running).min()) + HOUR)
        if ends:
            self.handle.registerTimer(min(ends) // 1000)
        if len(closed):
            yield closed.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get).assign(part=key[1])

    def _append(self, points: pa.Table) -> None:
        for start in range(0, len(points), CHUNK_ROWS):
            self.points.appendValue((packed(points.slice(start, CHUNK_ROWS)),))


def _replace(state, rows: list) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


def folded(hour: int, points: list) -> tuple:
    """One mergeable row of an hour's points."""
    table = pa.Table.from_pylist([dict(zip(POINT_ROWS.names, (None, *p))) for p in points], POINT_ROWS)
    ((*_, row),) = [closed_hours(table).drop_columns("item_id").to_pylist()]
    return tuple({**row, "hour": hour}.values())


def live_lists(points: DataFrame, key: str, spread: Column, grace: str = HOUR_GRACE, parts: int = PARTS, pages: int = PAGES) -> DataFrame:
    """Keep each item's running hour and day list; gives each closed hour's part once.

    ``points`` has ``key``, ``date``, ``avg``, ``max``, ``min``, ``volume``; those without a date are left out. ``spread`` deals
    the points of an item to ``parts`` states, which :func:`lists_now` puts together again. The items of a part
    are kept in its share of ``pages``. An hour closes when the watermark
    (newest date less ``grace``) reaches its end, and leaves the day list a day after its start.
    """
    dealt = points.withWatermark("date", grace).filter(F.col("date").isNotNull()).select(
        paged(F.col(key).cast("string"), pages=max(1, pages // parts)),
        F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int").alias("part"),
        "date",
        F.col(key).cast("string").alias("item_id"),
        micros("date").alias("at"),
        *[F.col(c).cast("double").alias(c) for c in ("avg", "max", "min")],
        F.col("volume").cast("long").alias("volume"),
    )
    return keyed(dealt, ["page", "part"], LiveLists(), f"{CLOSED}, {ITEM}, part int", event_time=True)


def merged_hours(hours: DataFrame) -> DataFrame:
    """Whole hours from the parts of an item; hours without any price are left out."""
    whole = hours.groupBy("item_id", F.timestamp_micros("hour").alias("hour")).agg(
        F.timestamp_micros(F.min("first")).alias("date"),
        (F.sum("total") / F.sum("n")).alias("avg"),
        F.max("max").alias("max"),
        F.min("min").alias("min"),
        F.sum("volume").alias("volume"),
        F.sum("priced").alias("__priced"),
    )
    return whole.filter("__priced > 0").drop("__priced")


def lists_now(spark: SparkSession, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Running points and day list of all items from the job's state."""
    points = kept(spark, checkpoint, "running").select("rows").mapInArrow(_unpack, f"{ITEM}, {POINT}")
    running = points.select("item_id", F.timestamp_micros("at").alias("date"), "avg", "max", "min", "volume")
    return running, merged_hours(kept(spark, checkpoint, "day").select("rows").mapInArrow(_unpack, f"{ITEM}, {CLOSED}"))


# Colour agreement -------------------------------------------------------------------


class ColorAgreement(StatefulProcessor):
    """Sightings so far and the last colour; the first colour that repeats after enough of them is told once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, color string, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last, told = self.seen.get() or (0, None, False)
        if told:
            return
        frame = _rows(rows, ["event_id"])
        for number, color in zip(frame["event_id"].tolist(), frame["color"].tolist()):
            if n >= COLOR_SIGHTINGS and color == last:
                self.seen.update((n, color, True))
                yield pd.DataFrame({"key": [key[0]], "color": [color], "event_id": [number]})
                return
            n, last = n + 1, color
        self.seen.update((n, last, False))


def color_agreements(sightings: DataFrame, key: str) -> DataFrame:
    """The agreed colour of each key, once: (key, color, event_id), event_id the sighting that settled it.

    ``sightings`` (key, color, event_id) count in the order of batches, then of ``event_id``. A key's
    sightings of one batch, two columns, are sorted in its task until it agrees; afterwards they are skipped.
    """
    narrow = sightings.select(F.col(key).cast("string").alias("key"), "color", "event_id")
    return keyed(narrow, ["key"], ColorAgreement(), "key string, color string, event_id long")


# Newest dates ------------------------------------------------------------------------


class NewestDate(StatefulProcessor):
    """The newest date of each key; tells of each point whether it was newer than all before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _rows(rows, ["event_id"])
        held = self.newest.get()
        bar = frame["at"].cummax().shift(1)
        if held is not None:
            bar = bar.fillna(held[0]).clip(lower=held[0])
        accepted = bar.isna() | (frame["at"] > bar)
        top = int(frame["at"].max())
        if held is None or top > held[0]:
            self.newest.update((top,))
        yield pd.DataFrame({"event_id": frame["event_id"], "key": key[0], "at": frame["at"], "accepted": accepted})


def newer_points(points: DataFrame, key: str) -> DataFrame:
    """Every point with ``accepted``: newer than all points of its key that arrived before it.

    ``points`` (key, event_id, date) arrive in the order of batches, then of ``event_id``. Written
    with ``partition_by=["accepted"]``, late points get a table of their own.
    """
    narrow = points.select(F.col(key).cast("string").alias("key"), "event_id", micros("date").alias("at"))
    told = keyed(narrow, ["key"], NewestDate(), "event_id long, key string, at long, accepted boolean")
    return told.select("event_id", F.col("key").alias(key), F.timestamp_micros("at").alias("date"), "accepted")


# Alerts ------------------------------------------------------------------------------


class CoolDown(StatefulProcessor):
    """The first day each subscription of a page may fire again; hits before it are passed over."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.free = handle.getListState("not_before", "id string, product_id string, day int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        free = {(held[0], held[1]): held[2] for held in self.free.get()}
        fired = []
        for who, day in sorted(((row["id"], row["product_id"]), row["day"]) for row in rows):
            if who not in free or day >= free[who]:
                fired.append((who, day))
                free[who] = day + self.days
        if fired:
            self.free.put([(*who, day) for who, day in free.items()])
        for (id_, product), day in fired:
            yield Row(id=id_, product_id=product, day=day)


def alert_hits(subscriptions: DataFrame, points: DataFrame, key: str, delay: str = "1 minute") -> DataFrame:
    """(id, key, day) of each subscription's closed days whose price range crosses its price, from its own first day on.

    Points fold to one range per key and day before they meet the subscriptions, so the join
    carries days, not points, and only hits go on.
    """
    days = (
        points.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day"), key)
        .agg(
            F.min("buy_price").alias("min_buy"), F.max("buy_price").alias("max_buy"), F.min("sell_price").alias("min_sell"), F.max("sell_price").alias("max_sell")
        )
        .withColumn("day", F.unix_date(F.col("window.start").cast("date")))
    )
    sells = has_flag(F.col("type"), ALERT_FLAGS["USE_SELL_NOT_BUY"])
    least, most = F.when(sells, F.col("min_sell")).otherwise(F.col("min_buy")), F.when(sells, F.col("max_sell")).otherwise(F.col("max_buy"))
    lower = has_flag(F.col("type"), ALERT_FLAGS["PRICE_LOWER_THAN"]) & (least < F.col("price"))
    higher = has_flag(F.col("type"), ALERT_FLAGS["PRICE_HIGHER_THAN"]) & (most > F.col("price"))
    return days.join(subscriptions, [key]).filter((F.col("day") >= F.col("not_before_day")) & (lower | higher)).select(F.col("id").cast("string").alias("id"), F.col(key).cast("string").alias(key), "day")


def fired_alerts(subscriptions: DataFrame, points: DataFrame, key: str, cool_down: int = COOL_DOWN_DAYS, delay: str = "1 minute") -> DataFrame:
    """Every firing (id, key, day): a hit not before the subscription's day, which then moves on by ``cool_down`` days."""
    hits = alert_hits(subscriptions, points, key, delay).withColumnRenamed(key, "product_id")
    hits = hits.select(paged("id", "product_id"), "id", "product_id", "day")
    return keyed(hits, ["page"], CoolDown(cool_down), "id string, product_id string, day int", frames=False).withColumnRenamed("product_id", key)
