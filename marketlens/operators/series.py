"""Price series: smoothing, gap filling, dated prices, and ordered scans of a feed.

Series hold one row per item and day, so a window over one item is bounded by
the calendar, however many sales the item has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators.skew import earlier_rows, hot_join

# Fixed values of the series semantics.
HISTORY_DAYS = 400
NEIGHBOUR_DAYS = 2
LAST_FEW = 5
NO_HISTORY = 1
GAME_EPOCH = 1560275700  # 2019-06-11 17:55 UTC
GAME_YEAR_SECONDS = 446400  # 5 days and 4 hours
COLOR_SIGHTINGS = 3


def day_number(ts: Column) -> Column:
    return F.unix_date(ts.cast("date"))


def with_upper_median(df: DataFrame, values: Column, out: str) -> DataFrame:
    """Add element n/2 of the sorted values, so the upper one of an even count; none or zero becomes one."""
    ordered = df.withColumn("__values", F.sort_array(values))
    middle = F.get("__values", F.floor(F.size("__values") / 2).cast("int"))
    return ordered.withColumn(out, F.greatest(middle, F.lit(1))).drop("__values")


def _dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    return rows if parts is None else rows.repartition(parts, *keys)


def daily_prices(sales: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Whole-coin mean unit price per key and day number.

    Where most sales are alone on their day, combining before the shuffle only fills the memory of the tasks
    that read; with ``parts`` the sales are dealt to that many tasks first.
    """
    unit = F.expr("highest_bid div nullif(`count`, 0)")
    return (
        _dealt(sales.select(key, "highest_bid", "count", day_number(F.col("end")).alias("day")), parts, key, "day")
        .groupBy(key, "day")
        .agg(F.avg(unit).cast("bigint").alias("price"))
        .filter("price is not null")
    )


def centered_median(prices: DataFrame, key: str) -> DataFrame:
    """Median over the prices present from two days before to two days after."""
    around = Window.partitionBy(key).orderBy("day").rangeBetween(-NEIGHBOUR_DAYS, NEIGHBOUR_DAYS)
    return with_upper_median(prices, F.collect_list("price").over(around), "smoothed")


def _first_few(prices: DataFrame, key: str) -> DataFrame:
    """The five oldest prices of a key, as an array."""
    oldest = Window.partitionBy(key).orderBy("day")
    return (
        prices.withColumn("__rn", F.row_number().over(oldest))
        .filter(F.col("__rn") <= LAST_FEW)
        .groupBy(key)
        .agg(F.collect_list(F.struct("day", "price")).alias("__seed"))
    )


def _with_last_few(prices: DataFrame, key: str) -> DataFrame:
    newest = Window.partitionBy(key).orderBy("day").rowsBetween(-(LAST_FEW - 1), 0)
    return prices.withColumn("__last", F.collect_list(F.struct("day", "price")).over(newest))


def _latest(seed: Column, last: Column) -> Column:
    """Prices of the five latest days among the seed and the last observations."""
    latest = F.slice(F.sort_array(F.concat(seed, last), asc=False), 1, LAST_FEW)
    return latest["price"]


def gap_filled(prices: DataFrame, key: str, as_of: str, days: int = HISTORY_DAYS) -> DataFrame:
    """A price for every day of the ``days`` before ``as_of`` and that day itself.

    A day without sales takes the median of the last five observed days of the
    range; the five oldest prices of the whole history stand in until there are five.
    That median changes only with an observed day, so it is computed once per
    observed day and laid out over the gap that follows.
    """
    last_day = day_number(F.lit(as_of).cast("timestamp"))
    first_day = last_day - days
    inside = _with_last_few(prices.filter(F.col("day").between(first_day, last_day)), key)
    seeds = _first_few(prices, key)
    # a row before the range, so days ahead of the first observation are laid out too
    kind = dict(inside.dtypes)
    lead_in = seeds.select(
        key,
        (first_day - 1).alias("day"),
        F.lit(None).cast(kind["price"]).alias("price"),
        F.array().cast(kind["__last"]).alias("__last"),
    )
    following = F.lead("day").over(Window.partitionBy(key).orderBy("day"))
    stretches = (
        inside.unionByName(lead_in)
        .withColumn("__until", F.coalesce(following - 1, last_day))
        .join(seeds, [key])
    )
    stretches = with_upper_median(stretches, _latest(F.col("__seed"), F.col("__last")), "__fill")
    stretches = stretches.select(key, F.col("day").alias("__day"), "price", "__until", "__fill")
    stretches = stretches.withColumn("day", F.explode(F.sequence("__day", "__until")))
    observed = F.col("day") == F.col("__day")
    return stretches.filter(F.col("day") >= first_day).select(
        key, "day", observed.alias("observed"), F.when(observed, F.col("price")).otherwise(F.col("__fill")).alias("price")
    )


def dated_prices(prices: DataFrame, wanted: DataFrame, key: str, days: int = HISTORY_DAYS, parts: int | None = None) -> DataFrame:
    """The market price of each wanted (key, day).

    An observed day gives its smoothed price. Any other day is filled as in
    :func:`gap_filled` with that day as the last of the range: every wanted day
    looks back to the last observation and the five prices it carries, so no
    calendar is laid out. Keys without history have no row. ``parts`` is the number of
    tasks where it must follow the rows.
    """
    asked = _dealt(wanted.select(key, "day"), parts, key, "day").distinct().select(key, "day", F.lit(None).cast(dict(prices.dtypes)["price"]).alias("price"), F.lit(True).alias("__asked"))
    line = prices.select(key, "day", "price", F.lit(False).alias("__asked")).unionByName(asked)
    line = _dealt(line, parts, key).groupBy(key, "day").agg(F.max("price").alias("price"), F.max("__asked").alias("__asked"))  # one row per key and day
    by_day = Window.partitionBy(key).orderBy("day")
    observed = F.col("price").isNotNull()
    point = F.when(observed, F.struct("day", "price"))  # nulls are not collected
    line = line.withColumn("__rank", F.count("price").over(by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    by_rank = Window.partitionBy(key).orderBy("__rank")
    found = line.select(
        key,
        "day",
        "__asked",
        observed.alias("__on_day"),
        F.collect_list("price").over(by_day.rangeBetween(-NEIGHBOUR_DAYS, NEIGHBOUR_DAYS)).alias("__around"),
        F.collect_list(point).over(by_rank.rangeBetween(-(LAST_FEW - 1), 0)).alias("__last"),
        F.collect_list(F.when(F.col("__rank") <= LAST_FEW, point)).over(Window.partitionBy(key)).alias("__seed"),
    ).filter(F.col("__asked") & (F.size("__seed") > 0))
    recent = F.filter("__last", lambda p: p["day"] >= F.col("day") - days)
    # an observed day needs no fill, so only its neighbours are sorted
    values = F.when(F.col("__on_day"), F.col("__around")).otherwise(_latest(F.col("__seed"), recent))
    return with_upper_median(found, values, "__price").select(key, "day", F.col("__price").alias("price"))


def with_price(rows: DataFrame, dated: DataFrame, key: str, hot_rows: int = 1_000_000, parts: int | None = None, few: int = 0) -> DataFrame:
    """Add the price from a table of dated prices to rows with ``key`` and ``day``; without any history it is 1."""
    return hot_join(rows, dated, [key, "day"], "left", hot_rows=hot_rows, parts=parts, few=few).withColumn(
        "price", F.coalesce("price", F.lit(NO_HISTORY)).cast("bigint")
    )


def price_at(rows: DataFrame, prices: DataFrame, key: str, hot_rows: int = 1_000_000, parts: int | None = None) -> DataFrame:
    """Add the dated market price to rows with ``key`` and ``day``."""
    dated = dated_prices(prices, rows, key, parts=parts)
    return with_price(_dealt(rows, parts, key, "day"), dated, key, hot_rows, parts)


def keep_since(points: DataFrame, cut: str) -> DataFrame:
    """Retention: points from ``cut`` on."""
    return points.filter(F.col("date") >= F.lit(cut))


def strictly_newer(points: DataFrame, keys: list[str], order: str, block: Column) -> DataFrame:
    """Points that are newer than every point of their key that arrived before them."""
    seen = earlier_rows(points, keys, [order], block, {"__newest": ("max", F.col("date"))})
    return seen.filter(F.col("__newest").isNull() | (F.col("date") > F.col("__newest"))).drop("__newest")


def latest_and_oldest(points: DataFrame, keys: list[str], tie: str) -> DataFrame:
    position = F.struct("date", tie)
    return points.groupBy(*keys).agg(
        F.min("date").alias("oldest"),
        F.max("date").alias("youngest"),
        F.min_by("avg", position).alias("oldest_avg"),
        F.max_by("avg", position).alias("youngest_avg"),
    )


def game_year(ts: Column) -> Column:
    """Years of the game calendar since its start, with fraction."""
    return (F.unix_timestamp(ts.cast("timestamp")) - F.lit(GAME_EPOCH)) / F.lit(GAME_YEAR_SECONDS)


def order_changes(orders: DataFrame, keys: list[str], order: str, block: Column) -> DataFrame:
    """Orders that differ from the one before them at the same place of the book."""
    state = F.struct("amount", "price_per_unit", "orders")
    seen = earlier_rows(orders, keys, [order], block, {"__before": ("previous", state)})
    return seen.filter(~F.col("__before").eqNullSafe(state)).withColumn("is_first", F.col("__before").isNull()).drop("__before")


def book_changes(books: DataFrame, keys: list[str], order: str, block: Column) -> DataFrame:
    """What changed in each book since the pull before it, as rows (keys, order, change, amount, price_per_unit, orders, copies).

    ``books`` has ``book``, an array of orders. Two orders are the same if amount, price and
    orders are; their place does not count, repeated ones count by number. ``change`` is ``added`` or
    ``gone``; a key's first pull adds everything. Equal books give no row. A book meets only the
    one before it, carried by :func:`earlier_rows`, so no key is sorted as a whole.
    """
    seen = earlier_rows(books, keys, [order], block, {"__before": ("previous", F.col("book"))})
    none = F.slice(F.col("book"), 1, 0)
    sides = F.array(
        F.struct(F.lit("added").alias("change"), F.col("book").alias("mine"), F.coalesce("__before", none).alias("other")),
        F.struct(F.lit("gone").alias("change"), F.coalesce("__before", none).alias("mine"), F.col("book").alias("other")),
    )
    changed = seen.filter(~F.col("__before").eqNullSafe(F.col("book"))).select(*keys, order, F.explode(sides).alias("s"))

    def copies(of: Column, order_: Column) -> Column:
        return F.size(F.filter(of, lambda o: o == order_))

    more = F.transform(F.array_distinct("s.mine"), lambda o: F.struct(o.alias("o"), (copies(F.col("s.mine"), o) - copies(F.col("s.other"), o)).alias("copies")))
    rows = changed.select(*keys, order, "s.change", F.explode(F.filter(more, lambda m: m["copies"] > 0)).alias("m"))
    return rows.select(*keys, order, "change", "m.o.*", "m.copies")


def color_consensus(sightings: DataFrame, key: str, order: str, block: Column) -> DataFrame:
    """The first colour of each key that repeats its predecessor after three earlier sightings."""
    seen = earlier_rows(
        sightings,
        [key],
        [order],
        block,
        {"__seen": ("count", F.lit(1)), "__last": ("previous", F.col("color"))},
    )
    agreed = seen.filter((F.col("__seen") >= COLOR_SIGHTINGS) & (F.col("__last") == F.col("color")))
    return agreed.groupBy(key).agg(F.min_by("color", order).alias("color"), F.min(order).alias(order))


def fill_colors(items: DataFrame, consensus: DataFrame, key: str) -> DataFrame:
    """Give items without a colour the agreed one."""
    found = consensus.select(key, F.col("color").alias("__agreed"))
    return items.join(found, [key], "left").withColumn("color", F.coalesce("color", "__agreed")).drop("__agreed")
