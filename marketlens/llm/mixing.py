"""Mixing sources to target weights by balanced sampling: the cube method, flown in blocks."""

from __future__ import annotations

import random
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.common import WORD, fingerprint, free, register, table
from marketlens.llm.sharding import prefix_sums
from marketlens.session import stored

#: Units that one task flies together, and blocks whose remainders meet in one block of the next level.
BLOCK = 2_000
FAN_IN = 1_000
#: Source tables up to this many rows are broadcast, longer ones are left to the optimizer.
FEW_SOURCES = 10_000
WEIGHTS = (3, 1, 2)


def flight(pi: np.ndarray, sizes: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """Flight phase: inclusion probabilities move to 0 or 1, but for at most two.

    Each step moves three units along a vector that leaves the sums of ``pi * sizes`` and
    ``pi * counts`` as they are, in one of its two directions, chosen at random so that
    every probability keeps its mean, until a unit lands. Units are taken in their order.
    """
    pi = pi.astype(float).copy()
    rng = random.Random(seed)
    eps = 1e-9
    held: list[int] = []
    p, s, c = pi.tolist(), sizes.tolist(), counts.tolist()

    def move(units: list[int], u: list[float]) -> None:
        up = min((1 - p[i]) / v if v > 0 else -p[i] / v for i, v in zip(units, u) if v)
        down = min(p[i] / v if v > 0 else (p[i] - 1) / v for i, v in zip(units, u) if v)
        step = up if rng.random() * (up + down) < down else -down
        for i, v in zip(units, u):
            x = p[i] + step * v
            p[i] = 0.0 if x < eps else 1.0 if x > 1 - eps else x

    def direction(units: list[int]) -> list[float] | None:
        a, b = [s[i] for i in units], [c[i] for i in units]
        if len(units) == 3:
            u = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
            return u if any(u) else None
        if a[0] * b[1] != a[1] * b[0]:
            return None  # the two sums hold both units
        if any(a):
            return [a[1], -a[0]]
        return [b[1], -b[0]]

    for i in range(len(p)):
        if not eps < p[i] < 1 - eps:
            p[i] = round(p[i])
            continue
        held.append(i)
        while len(held) > 1:
            u = direction(held)
            if u is None and len(held) == 3:  # all three in one line: two of them can move
                for pair in ((0, 1), (0, 2), (1, 2)):
                    two = [held[k] for k in pair]
                    if (u := direction(two)) is not None:
                        move(two, u)
                        break
            elif u is not None:
                move(held, u)
            else:
                break
            held = [k for k in held if 0.0 < p[k] < 1.0]
    return np.array(p)


def landing(pi: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Landing phase: the few units left become 0 or 1 so that the totals change least."""
    left = [i for i in range(len(pi)) if 0 < pi[i] < 1]
    out = pi.copy()
    if left:
        p, s, c = pi[left], sizes[left], counts[left]
        best = min(product((0.0, 1.0), repeat=len(left)), key=lambda x: (abs(((x - p) * s).sum()), abs(((x - p) * c).sum()), x))
        out[left] = best
    return out


def source_targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: ``source``, ``source_size`` and ``target``.

    ``units`` has ``source``, ``size`` and ``count`` (equal rows). Sources in code-point order,
    null last, take the weights in turn and share ``share`` of all sizes by weight; a target
    stops at ``most`` times its source's size, and what is above is shared anew among the
    others until none is above. Each turn is one small aggregation.
    """
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"), F.count("*").alias("units"))
    ranked = prefix_sums(sums.withColumn("__null", F.col("source").isNull()).withColumn("__one", F.lit(1)), ["__null", "source"], "__one")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("before", F.lit(len(weights))) + 1).cast("int"))
    sources = stored(ranked.select("source", "source_size", "units", weight.alias("weight"), F.col("row").alias("source_no")), "sources")
    total, weigh = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return sources.withColumn("target", F.lit(0.0))
    cap, level = F.col("source_size") * most, share * total / weigh
    while True:
        above = F.col("weight") * level > cap
        full, rest = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        raised = (share * total - full) / rest if rest else level
        if raised <= level:
            break
        level = raised
    return sources.withColumn("target", F.least(F.col("weight") * level, cap))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """Add ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` to every document.

    A document's size is its number of words (null text: 0). Where a source's target is r times
    its size, each of its documents is taken floor(r) times, and once more with probability
    r - floor(r), drawn by the cube method balancing words and documents: blocks of a
    source fly on their own, the at most two open units of each block fly on with those of
    other blocks, and the last block of a source lands. Only keys, sizes and source numbers
    are shuffled for it. Equal rows (key, source and text) form one unit: of n of them floor(n p)
    are taken once more, and the draw decides on one further. They can stand for each other, so which
    of them it is, numbered in one sort of the unit's rows, changes no result.

    Draws depend on the rows alone, so reruns agree. Sources without words
    take nothing; an empty table gives no rows; input columns with a new column's name give way, others may have any name.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    mix_size, mix_source, mix_target = free(docs, "__size", "__source_size", "__target")
    base = docs.withColumn(mix_size, F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long"))
    one, two = fingerprint(f"`{key}`", f"`{source}`", f"`{text}`")
    n_one, n_two, t_one, t_two, times, whole, extra, number = free(docs, "__one", "__two", "__t_one", "__t_two", "__times", "__whole", "__extra", "__number")
    base = base.withColumn(n_one, one).withColumn(n_two, two)
    units = stored(
        base.groupBy(F.col(f"`{source}`").alias("source"), F.col(mix_size).alias("size"), F.col(n_one).alias("__one"), F.col(n_two).alias("__two")).agg(F.count("*").alias("count")), "units"
    )
    sources = stored(source_targets(units, weights, share, most), "targets")
    few = sources.count() <= FEW_SOURCES
    rated = units.join(F.broadcast(sources) if few else sources, units["source"].eqNullSafe(sources["source"])).select(
        "source_no", "units", "source_size", "target", units["size"], "count", "__one", "__two"
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shared = F.col("count") * (rate - F.floor(rate))
    rated = rated.withColumn("whole", F.floor(rate)).withColumn("sure", F.floor(shared + 1e-9)).withColumn("pi", shared - F.floor(shared + 1e-9))
    decided = _fly(rated)
    taken = rated.join(decided, ["__one", "__two"], "left").select(
        F.col("__one").alias(t_one), F.col("__two").alias(t_two), F.col("source_size").alias(mix_source), F.col("target").alias(mix_target),
        F.col("count").alias(times), F.col("whole").alias(whole), (F.col("sure") + F.coalesce("extra", F.lit(0))).alias(extra),
    )
    told = base.join(taken, (F.col(n_one) == F.col(t_one)) & (F.col(n_two) == F.col(t_two)))
    single = told.filter(F.col(times) == 1).withColumn(number, F.lit(1))
    repeated = told.filter(F.col(times) > 1).withColumn(number, F.row_number().over(Window.partitionBy(n_one, n_two).orderBy(F.lit(0))))
    copies = (F.col(whole) + F.when(F.col(number) <= F.col(extra), 1).otherwise(0)).cast("int")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    return single.unionByName(repeated).select(
        *kept, F.col(mix_size).alias("size"), F.col(mix_source).alias("source_size"), F.col(mix_target).alias("target"), copies.alias("copies"), (F.col(mix_size) * copies).alias("taken")
    )


def _fly(rated: DataFrame) -> DataFrame:
    """``extra`` (0 or 1) of every unit whose probability lies between 0 and 1."""
    open_units = rated.filter("pi > 1e-9 and pi < 1 - 1e-9").select(
        "source_no", "size", "count", "__one", "__two", "pi", F.ceil(F.col("units") / BLOCK).cast("long").alias("blocks"),
        F.expr(f"pmod(__one, cast(ceil(units / {BLOCK}) as bigint))").alias("block"), F.lit(None).cast("int").alias("extra"),
    )
    kinds = open_units.schema
    done: list[DataFrame] = []
    level = 0
    widest = open_units.agg(F.max("blocks")).first()[0] or 0
    while widest:

        def fly(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["size", "__one", "__two"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            first = group.iloc[0]
            sizes = group["size"].to_numpy(float)
            counts = np.ones(len(group))
            seed = (int(first["source_no"]) * 1_000_003 + int(first["block"]))
            pi = flight(group["pi"].to_numpy(), sizes, counts, seed)
            if first["blocks"] == 1:
                pi = landing(pi, sizes, counts)
            group["pi"] = pi
            group["extra"] = pd.array([int(x) if x in (0.0, 1.0) else None for x in pi], dtype="Int32")
            return group

        flown = stored(open_units.groupBy("source_no", "block").applyInPandas(fly, kinds), "flight")
        done.append(flown.filter("extra is not null").select("__one", "__two", "extra"))
        if widest == 1:
            break
        open_units = flown.filter("extra is null").withColumn("block", F.expr(f"block div {FAN_IN}")).withColumn(
            "blocks", F.ceil(F.col("blocks") / FAN_IN).cast("long")
        )
        widest = -(-widest // FAN_IN)
        level += 1
    if not done:
        return rated.limit(0).select("__one", "__two", F.lit(0).alias("extra"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


@register("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
