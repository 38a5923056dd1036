"""Joins and ordered scans that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
FEW_ROWS = 250_000  # rows of a narrow table that every task may hold
SALTS = 64
NULL_PARTS = 2**31 - 1  # rows without a key have no partner to copy


def hot_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    spread: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
    parts: int | None = None,
    few: int = 0,
) -> DataFrame:
    """Equi-join of a big ``left`` with a ``right`` whose keys repeat little.

    Keys with at least ``hot_rows`` rows on the left are cut into ``salts`` parts,
    or into more where a part would still hold over ``hot_rows`` rows, and only
    their rows on the right are copied. There are at most ``rows(left) / hot_rows``
    such keys, so the broadcast list of hot keys is small by construction. Rows
    with a null key match nothing and are spread too. ``parts`` is the number of
    tasks where it must follow the rows; else the session's setting holds.

    A right side of at most ``few`` rows goes to every task, and the left is neither counted nor
    shuffled. It is counted first, so where ``few`` is given it should be a stored table.
    """
    if few and right.count() <= few:
        return left.join(F.broadcast(right), on, how)
    spread = spread or [name for name, kind in left.dtypes if "map<" not in kind and "variant" not in kind]
    hot = (
        left.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") >= hot_rows)
        .select(*on, F.greatest(F.lit(salts), F.ceil(F.col("__n") / hot_rows)).cast("int").alias("__parts"))
    )
    null_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    cuts = F.when(null_key, F.lit(NULL_PARTS)).otherwise(F.coalesce("__parts", F.lit(1)))
    salted_left = (
        left.join(F.broadcast(hot), on, "left")
        .withColumn("__salt", F.pmod(F.xxhash64(*spread), cuts).cast("int"))
        .drop("__parts")
    )
    salted_right = (
        right.join(F.broadcast(hot), on, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
        .drop("__parts")
    )
    if parts is not None:
        salted_left, salted_right = (x.repartition(parts, *on, "__salt") for x in (salted_left, salted_right))
    return salted_left.join(salted_right, [*on, "__salt"], how).drop("__salt")


def earlier_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    values: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Add aggregates over the strictly earlier rows of each key, exactly, without one sort per key.

    ``block`` is a coarse, order-preserving bucket of ``order`` (an hour, a range
    of sequence numbers). Rows are sorted inside (key, block) only; one summary
    row per (key, block) carries the earlier blocks in. ``values`` maps an output
    name to ``(kind, expression)`` with kind ``max``, ``sum``, ``count`` or
    ``previous``; ``order`` must be unique within a key.
    """
    tagged = df.withColumn("__b", block)
    before = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    lagged = Window.partitionBy(*keys, "__b").orderBy(*order)
    earlier_blocks = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    previous_block = Window.partitionBy(*keys).orderBy("__b")
    position = F.struct(*order)

    inside, tails, carries, combined = [], [], [], []
    for name, (kind, expr) in values.items():
        i, t, c = f"__i_{name}", f"__t_{name}", f"__c_{name}"
        if kind == "previous":
            boxed = F.struct(expr.alias("v"))
            inside.append(F.lag(boxed).over(lagged).alias(i))
            tails.append(F.max_by(boxed, position).alias(t))
            carries.append(F.lag(t).over(previous_block).alias(c))
            combined.append(F.coalesce(F.col(i), F.col(c))["v"].alias(name))
            continue
        fold = {"max": F.max, "sum": F.sum, "count": F.count}[kind]
        refold = F.max if kind == "max" else F.sum
        inside.append(fold(expr).over(before).alias(i))
        tails.append(fold(expr).alias(t))
        carries.append(refold(t).over(earlier_blocks).alias(c))
        if kind == "max":
            combined.append(F.greatest(F.col(i), F.col(c)).alias(name))
        else:
            combined.append((F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0))).alias(name))

    carried = (
        tagged.groupBy(*keys, "__b")
        .agg(*tails)
        .select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__kb"), *carries)
    )
    match = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__b") == F.col("__kb")]
    return (
        tagged.select("*", *inside)
        .join(carried, reduce(lambda a, b: a & b, match), "left")
        .select(*[F.col(c) for c in df.columns], *combined)
    )
