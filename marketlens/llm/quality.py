"""Quality rules whose thresholds come from mergeable quantile sketches per language and source."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import free, map_column, register, table
from marketlens.session import stored

SPACE = b"\t\n\x0b\x0c\r "
SYMBOLS = b"#*$%&|<>"
MARKS = b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"  # without comma and full stop
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8

# Relative width of a sketch bucket: a quantile is off by 1% of its value at most.
GAMMA = 1.02
#: A sketch of fewer documents gives way to its language's, and that to the one of all.
LEAST = 100
#: Rows of the threshold table up to which it is broadcast.
FEW = 10_000

#: name: (least spread, whether low values fail too). The fences stand FENCE spreads beyond the quartiles.
SIGNALS = {
    "word_length": (0.3, True),
    "symbol_share": (0.005, False),
    "mark_share": (0.01, False),
    "capital_share": (0.05, False),
    "dup_line_share": (0.1, False),
    "echo_share": (0.02, False),
}
FENCE = 4.0


def echoes(words: list[bytes]) -> int:
    """Words equal to the word before them."""
    return sum(map(bytes.__eq__, words, words[1:]))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that the text holds twice or more, counting the first one too."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    if np.unique(rolled).size == n:
        return 0
    seen: dict[tuple[bytes, ...], int] = {}  # the words themselves decide
    twice = np.zeros(n, bool)
    for i in range(n):
        first = seen.setdefault(tuple(words[i : i + window]), i)
        if first != i:
            twice[first] = twice[i] = True
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def measures(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_marks, n_capitals, n_echoes."""
    if not text:
        return (0,) * 9
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    without = lambda chars: len(data) - len(data.translate(None, chars))
    return (
        len(words), len(text) - without(SPACE), without(SYMBOLS), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), without(MARKS), without(CAPITALS), echoes(words),
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals", "n_echoes"]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by its measures and ``base_failed``."""

    def make():
        def run(values):
            rows = [measures(v) for v in values]
            return [[r[k] for r in rows] for k in range(len(MEASURES))]

        return run

    out = map_column(docs, text, [T.StructField(m, T.LongType()) for m in MEASURES], make)
    return out.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


def signals() -> dict[str, F.Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "capital_share": share("n_capitals", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "echo_share": share("n_echoes", "n_words"),
    }


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Quantile sketches: counts by key, signal and logarithmic bucket.

    Two sketches merge by adding their counts, which is what the map-side and the final
    aggregation do, and again when a language's sketch is made of those of its sources.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), v.alias("value")) for k, v in signals().items()]))
    bucket = F.when(F.col("value") < 1e-6, F.lit(-10_000)).otherwise(F.ceil(F.log("value") / float(np.log(GAMMA)))).cast("int")
    long = rows.select(*keys, each.alias("s")).select(*keys, "s.*")
    return long.groupBy(*keys, "signal", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "signal", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Number of documents, first and third quartile by key and signal. A sketch has some 2,000 buckets at most."""
    up = Window.partitionBy(*keys, "signal").orderBy("bucket")
    value = F.when(F.col("bucket") == -10_000, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    running = sketch.select(
        *keys, "signal", value.alias("value"), F.sum("n").over(up).alias("upto"), F.sum("n").over(Window.partitionBy(*keys, "signal")).alias("docs")
    )
    least = lambda q: F.min(F.when(F.col("upto") >= F.col("docs") * q, F.col("value")))
    return running.groupBy(*keys, "signal").agg(F.max("docs").alias("docs"), least(0.25).alias("low"), least(0.75).alias("high"))


def thresholds(rows: DataFrame, language: str = "lang", source: str = "source") -> DataFrame:
    """One row per language and source with the fences ``<signal>_low`` and ``<signal>_high``.

    ``rows`` are measured documents; those that fail the base rules do not count. A language
    and source with fewer than LEAST documents takes the fences of its language, then of all.
    """
    own = stored(sketches(rows.filter("not base_failed"), [language, source]), "sketches")
    by_language = quartiles(merged(own, [language]), [language])
    by_all = quartiles(merged(own, []), [])

    def fences(q: DataFrame, keys: list[str]) -> DataFrame:
        spread = F.greatest(F.col("high") - F.col("low"), F.element_at(F.create_map(*[F.lit(x) for k, v in SIGNALS.items() for x in (k, v[0])]), F.col("signal")))
        q = q.withColumn("under", F.col("low") - FENCE * spread).withColumn("over", F.col("high") + FENCE * spread)
        columns = [F.max(F.when(F.col("signal") == s, F.struct("docs", "under", "over"))).alias(s) for s in SIGNALS]
        return q.groupBy(*keys).agg(*columns)

    groups = rows.select(language, source).distinct()
    mine, lang, every = fences(quartiles(own, [language, source]), [language, source]), fences(by_language, [language]), fences(by_all, [])
    a, b, c, d = groups.alias("a"), mine.alias("b"), lang.alias("c"), every.alias("d")
    joined = (
        a.join(b, F.col(f"a.{language}").eqNullSafe(F.col(f"b.{language}")) & F.col(f"a.{source}").eqNullSafe(F.col(f"b.{source}")), "left")
        .join(c, F.col(f"a.{language}").eqNullSafe(F.col(f"c.{language}")), "left")
        .join(F.broadcast(d), F.lit(True), "left")  # one row
    )
    enough = lambda s, t: F.when(F.col(f"{t}.{s}.docs") >= LEAST, F.col(f"{t}.{s}"))
    chosen = [F.coalesce(enough(s, "b"), enough(s, "c"), F.col(f"d.{s}")).alias(s) for s in SIGNALS]
    chosen = joined.select(F.col(f"a.{language}").alias(language), F.col(f"a.{source}").alias(source), *chosen)
    return chosen.select(
        language, source, *[F.col(f"{s}.under").alias(f"{s}_low") for s in SIGNALS], *[F.col(f"{s}.over").alias(f"{s}_high") for s in SIGNALS]
    )


def judge(docs: DataFrame, text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """Replace the text by its measures, ``base_failed`` and ``kept``; other columns stay.

    A document is kept if it passes the base rules and each of its signals lies within the
    fences of its language and source (null is a language and a source like others). A null
    or empty text fails the base rules. Input columns with a measure's name give way, others may have
    any name. The measures are written once; they are narrow.
    """
    rows = stored(measure(docs.drop(*MEASURES, "base_failed", "kept"), text), "measures")
    fences = stored(thresholds(rows, language, source), "fences")
    few = fences.count() <= FEW
    sides = [(name, end) for name in SIGNALS for end in ("low", "high")]
    lang, origin, *named = free(rows, "__lang", "__source", *[f"__{name}_{end}" for name, end in sides])
    fence = dict(zip(sides, named))
    t = (F.broadcast(fences) if few else fences).select(
        F.col(f"`{language}`").alias(lang), F.col(f"`{source}`").alias(origin), *[F.col(f"{name}_{end}").alias(c) for (name, end), c in fence.items()]
    )
    inside = F.lit(True)
    for name, value in signals().items():
        fine = value <= F.col(fence[name, "high"])
        if SIGNALS[name][1]:
            fine &= value >= F.col(fence[name, "low"])
        inside &= F.coalesce(fine, F.lit(True))
    joined = rows.join(t, F.col(f"`{language}`").eqNullSafe(F.col(lang)) & F.col(f"`{source}`").eqNullSafe(F.col(origin)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (~F.col("base_failed") & inside).alias("kept"))


@register("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", *MEASURES[:5], "base_failed", "kept", "lang", "source")
