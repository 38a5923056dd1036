"""Line dedup: a segment-partition edit join over all lines, verified by banded bit-parallel edit distance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import components, fingerprint, free, register, table
from marketlens.session import stored

#: Edits that two lines may differ by, and code points from which a line is looked at.
MAX_EDITS = 1
MIN_CHARS = 20

#: Lines that may share a key before the key is cut finer, and the pieces its open part is then cut into.
GROUP_LINES = 32
PIECES = 8


def segments(length: Column, edits: int) -> list[tuple[Column, Column]]:
    """Start (from 1) and length of the edits + 1 segments of a line; the last ones take what is over."""
    parts = edits + 1
    short = F.floor(length / parts).cast("int")
    over = (length % parts).cast("int")
    out = []
    for i in range(parts):
        longer = F.greatest(F.lit(0), F.lit(i) - (F.lit(parts) - over))  # longer segments before this one
        size = short + F.when(F.lit(i) >= F.lit(parts) - over, 1).otherwise(0)
        out.append((short * i + longer + 1, size))
    return out


def index_keys(line: Column, length: Column, edits: int) -> list[Column]:
    """The line's own segments, keyed by length, number and content."""
    return [F.xxhash64(length, F.lit(i), F.substr(line, start, size)) for i, (start, size) in enumerate(segments(length, edits))]


def probe_keys(line: Column, length: Column, edits: int, shortest: int) -> list[Column]:
    """Keys of the segments that an equally long or shorter line within the edits would share with this one.

    For each shorter length and segment only those places are read that an alignment can
    leave the segment at, seen from the line's left end as well as from its right end. The
    line's own segments, which ``index_keys`` gives, are left out.
    """
    keys = []
    for less in range(edits + 1):
        other = length - less
        for i, (start, size) in enumerate(segments(other, edits)):
            right = edits - i
            for shift in range(max(-i, less - right), min(i, less + right) + 1):
                if not less and not shift:
                    continue
                at = start + shift
                fits = (other >= shortest) & (at >= 1) & (at + size - 1 <= length)
                keys.append(F.when(fits, F.xxhash64(other, F.lit(i), F.substr(line, at, size))))
    return keys


def shared(a: Column, b: Column, most: Column, from_left: bool) -> Column:
    """How many characters both texts have in common at one end, ``most`` at most, by halving steps."""
    part = F.left if from_left else F.right

    def step(n: Column, more: Column) -> Column:
        longer = n + more
        return F.when((longer <= most) & (part(a, longer) == part(b, longer)), longer).otherwise(n)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(24, -1, -1)]), F.lit(0), step)


def within_edits(pairs: DataFrame, edits: int, a: str = "a_text", b: str = "b_text") -> DataFrame:
    """The pairs whose texts are at most ``edits`` apart.

    The dynamic-programming table is kept as bits of a band of 2 * edits + 1 diagonals: one
    word holds the vertical differences of a column, and each character of the shorter
    text moves the band one row down and one column on. The distance is read along the
    diagonal that ends in the last cell.
    """
    band, full = 2 * edits + 1, (1 << 2 * edits + 1) - 1
    long, short = F.when(F.length(a) >= F.length(b), F.col(a)).otherwise(F.col(b)), F.when(F.length(a) >= F.length(b), F.col(b)).otherwise(F.col(a))
    rows = pairs.select("*", long.alias("__long"), short.alias("__short")).filter(F.length("__long") - F.length("__short") <= edits)
    x, y = F.col("__long"), F.col("__short")
    rows = stored(rows.repartition("a", "b").withColumn("__left", shared(x, y, F.length(y), True)), "compared")  # ends take no edit
    rows = stored(rows.withColumn("__right", shared(x, y, F.length(y) - F.col("__left"), False)), "compared")
    middle = lambda c: F.substr(c, F.col("__left") + 1, F.length(c) - F.col("__left") - F.col("__right"))
    rows = rows.select(*pairs.columns, middle(x).alias("__long"), middle(y).alias("__short"))
    rows = stored(rows, "compared").repartition("a", "b")
    rows = rows.withColumn("__m", F.split("__long", "")).withColumn("__n", F.split("__short", ""))
    rows = rows.withColumn("__m", F.when(F.length("__long") == 0, F.array().cast("array<string>")).otherwise(F.col("__m")))
    rows = rows.withColumn("__n", F.when(F.length("__short") == 0, F.array().cast("array<string>")).otherwise(F.col("__n")))
    off = F.length("__long") - F.length("__short")

    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def equal(letter: Column, j: Column) -> Column:
        """Which cells of the band meet an equal character in column j."""
        bits = F.lit(0).cast("long")
        for k in range(band):
            bits = bits + F.when(F.coalesce(F.get("__m", j + k - edits) == letter, F.lit(False)), F.lit(1 << k)).otherwise(0)
        return bits

    keep = lambda c: c.bitwiseAND(F.lit(full))

    def moved(state: Column, j: Column) -> Column:
        vp, vn = state["vp"], state["vn"]

        def with_x(x: Column) -> Column:
            return let(keep((x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn)), with_d0)

        def with_d0(d0: Column) -> Column:
            hp = keep(vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))))
            free = F.getbit(d0, off + edits).cast("long")
            return let(hp, lambda hp: F.struct(
                keep(d0.bitwiseAND(vp).bitwiseOR(F.bitwise_not(F.shiftright(d0, 1).bitwiseOR(hp)))).alias("vp"),
                F.shiftright(d0, 1).bitwiseAND(hp).alias("vn"),
                (state["score"] + 1 - free).alias("score"),
            ))

        # Along the diagonal the score never falls: beyond the limit nothing is left to compute.
        return F.when(state["score"] > edits, state).otherwise(
            let(F.get("__n", j), lambda letter: let(equal(letter, j), with_x))
        )

    zero = F.struct(
        F.lit(full & ~((1 << edits) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), off.cast("long").alias("score")
    )
    steps = F.when(F.length("__short") > 0, F.sequence(F.lit(0), F.length("__short") - 1)).otherwise(F.array().cast("array<int>"))
    distance = F.aggregate(steps, zero, moved, lambda s: s["score"])
    return rows.filter(distance <= edits).drop("__long", "__short", "__m", "__n")


def line_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line: the document, the line's number from 0, the line and its two hashes."""
    one, two = fingerprint("line")
    return (
        docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("mark"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
        .withColumn("one", one)
        .withColumn("two", two)
        .withColumn("length", F.length("line"))
    )


def with_sharers(rows: DataFrame) -> DataFrame:
    """The rows whose key several lines share, one of them with a segment of its own, and how many rows share it.

    Both sides are shuffled whatever their size: what shares a key grows with the lines.
    """
    sharers = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("own").alias("indexed")).filter("n > 1 and indexed")
    return rows.join(sharers.select("k", "n").hint("merge"), "k")


def pairs_of(rows: DataFrame) -> DataFrame:
    """Each index row with the other rows of its key, as pairs of lines."""
    a = rows.filter("own").select("k", F.col("one").alias("a"))
    b = rows.select("k", F.col("one").alias("b"), "own")
    pairs = a.join(b, "k").filter("a < b or (a <> b and not own)")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def cut_finer(rows: DataFrame) -> DataFrame:
    """New keys for lines (k, one, own, rest) that agree outside ``rest`` and may differ by one edit inside it.

    The rest is cut into ``PIECES`` by the length of the index line's rest; the edit hits one piece, so
    each new key holds all pieces but one, which is the new rest. A longer line (not ``own``) has one
    character more in that piece.
    """
    more = F.when(F.col("own"), 0).otherwise(1)
    size = F.length("rest") - more
    cuts = []
    for j in range(PIECES):
        begin, end = (F.floor(size * F.lit(i) / F.lit(PIECES)).cast("int") for i in (j, j + 1))
        key = F.xxhash64("k", F.lit(j), F.substr("rest", F.lit(1), begin), F.substr("rest", end + more + 1))
        cuts.append(F.when(end > begin, F.struct(key.alias("k"), F.substr("rest", begin + 1, end - begin + more).alias("rest"))))
    return rows.select("one", "own", F.explode(F.array(*cuts)).alias("c")).filter("c is not null").select("c.k", "one", "own", "c.rest")


def last_links(rows: DataFrame) -> DataFrame:
    """Links of lines whose index rest is one character or none: those index lines are all one edit apart.

    They link to the smallest of their key. A longer line has two characters left, or one: it links to
    the index line that it becomes without one of them.
    """
    index = rows.filter("own")
    middle = index.groupBy("k").agg(F.min("one").alias("b"))
    among = index.join(middle, "k").select(F.col("one").alias("a"), "b")
    rest = F.when(F.length("rest") == 1, F.array(F.lit(""))).otherwise(F.array_distinct(F.array(F.left("rest", F.lit(1)), F.right("rest", F.lit(1)))))
    longer = rows.filter("not own").select("k", F.col("one").alias("a"), F.explode(rest).alias("rest"))
    across = longer.join(index.select("k", "rest", F.col("one").alias("b")), ["k", "rest"]).select("a", "b")
    return among.union(across).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def cut_until_quiet(hot: DataFrame, texts: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Cut keys of over ``most`` lines finer (one edit): candidate pairs, and links that need no more comparing.

    The rests are a ``PIECES``-th as long after each round, so there are as many rounds as the
    longest line has octal digits in its length, at most.
    """
    line, half = F.col("line"), F.col("half")
    first = hot.join(texts, "one").withColumn("half", F.floor((F.length(line) - F.when(F.col("own"), 0).otherwise(1)) / 2).cast("int"))
    left = F.substr(line, F.lit(1), half + F.when(F.col("own"), 0).otherwise(1))
    rest = F.when(F.col("pos") % 2 == 0, F.substr(line, half + 1)).otherwise(left)
    rows = stored(first.select("k", "one", "own", rest.alias("rest")), "open")
    pairs, links = [], []
    while not rows.isEmpty():
        small = F.length("rest") - F.when(F.col("own"), 0).otherwise(1) <= 1
        links.append(last_links(rows.filter(small)))
        shared = stored(with_sharers(cut_finer(rows.filter(~small))), "open")
        pairs.append(pairs_of(shared.filter(F.col("n") <= most)))
        rows = shared.filter(F.col("n") > most).drop("n")
    return pairs, links


def line_links(lines: DataFrame, edits: int, min_chars: int, most: int) -> DataFrame:
    """Links (a, b) between the hashes of different lines that are at most ``edits`` apart.

    With one edit, keys that over ``most`` lines share are cut finer and need not give all their
    links: they give as many as connect the same lines. With more edits they give all pairs.
    """
    own = index_keys(F.col("line"), F.col("length"), edits)
    probes = probe_keys(F.col("line"), F.col("length"), edits, min_chars)
    names = [f"k{i}" for i in range(len(own) + len(probes))]
    held = lines.select("one", *[c.alias(n) for c, n in zip(own + probes, names)])
    held = stored(held.groupBy("one").agg(*[F.first(n).alias(n) for n in names]), "line-keys")  # a copied line once
    rows = held.select("one", F.posexplode(F.array(*names)).alias("pos", "k")).filter("k is not null")
    rows = rows.withColumn("own", F.col("pos") < len(own))
    if edits > 1:  # segments of a line may be alike
        rows = rows.groupBy("k", "one").agg(F.min("pos").alias("pos"), F.max("own").alias("own"))
    shared = stored(with_sharers(rows), "shared-keys")
    texts = lines.select("one", "line").join(shared.select("one").distinct().hint("merge"), "one", "left_semi")
    texts = stored(texts.groupBy("one").agg(F.min("line").alias("line")), "candidate-lines")
    quiet = F.col("n") <= most if edits == 1 else F.lit(True)
    pairs, links = cut_until_quiet(shared.filter(~quiet), texts, most)
    pairs = stored(reduce(DataFrame.union, pairs, pairs_of(shared.filter(quiet))).distinct(), "candidates")
    a, b = texts.select(F.col("one").alias("a"), F.col("line").alias("a_text")), texts.select(F.col("one").alias("b"), F.col("line").alias("b_text"))
    near = within_edits(pairs.join(a, "a").join(b, "b"), edits).select("a", "b")
    return reduce(DataFrame.union, links, near).distinct()


def line_decisions(
    docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, key: str = "doc_id", text: str = "text", most: int = GROUP_LINES
) -> DataFrame:
    """One row (doc, mark, line_no, class_id, near) per line that goes.

    Lines of ``min_chars`` code points or more are compared; shorter ones always stay. Two lines
    link if at most ``edits`` insertions, deletions or replacements part them; a class is
    what links connect, and its first line, by document, text hash and number, stays. ``near``
    says that the line differs from the one that stays. ``class_id`` is the smallest line hash of
    the class. Null keys come first; rows equal in key and text share their lines.
    """
    lines = line_rows(docs, key, text).filter(F.col("length") >= min_chars)
    place = F.struct("doc", "mark", "line_no")
    narrow = stored(lines.select("doc", "mark", "line_no", "one", "two"), "lines")
    firsts = stored(narrow.groupBy("one", "two").agg(F.min(place).alias("first"), F.count("*").alias("copies")), "first-lines")
    classes = components(line_links(lines, edits, min_chars, most))
    own = firsts.join(classes.withColumnRenamed("node", "one"), "one", "left").withColumn("class_id", F.coalesce("component", "one"))
    own = stored(own.select("one", "two", "first", "copies", "class_id", F.col("component").isNotNull().alias("linked")), "line-classes")
    linked = own.filter("linked").groupBy("class_id").agg(F.min(F.struct("first", "one", "two")).alias("head"))
    named = own.join(linked, "class_id", "left").select(
        "one", "two", "class_id", F.coalesce("head.first", "first").alias("stays"),
        F.coalesce((F.col("head.one") != F.col("one")) | (F.col("head.two") != F.col("two")), F.lit(False)).alias("near"),
        "copies", "linked",
    ).filter("copies > 1 or linked")
    gone = narrow.join(named.hint("merge"), ["one", "two"]).filter(~place.eqNullSafe(F.col("stays")))
    return gone.select("doc", "mark", "line_no", "class_id", "near").distinct()


def removed_lines(docs: DataFrame, edits: int, min_chars: int, key: str, text: str) -> DataFrame:
    gone = line_decisions(docs, edits, min_chars, key, text)
    return gone.groupBy("doc", "mark").agg(
        F.array_sort(F.collect_set("line_no")).alias("removed"),
        F.count_if("near").alias("n_near"),
        F.array_sort(F.collect_set("class_id")).alias("classes"),
    )


def dedup_lines(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the lines that go; all columns stay, other lines keep their order.

    A null text stays null; a text that loses all its lines becomes empty. Further columns may have any name.
    """
    doc, mark, own_mark, removed = free(docs, "__doc", "__mark", "__own_mark", "__removed")
    gone = removed_lines(docs, edits, min_chars, key, text).select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.col("removed").alias(removed))
    marked = docs.withColumn(own_mark, F.xxhash64(F.col(f"`{text}`")))
    joined = marked.join(gone, F.col(f"`{key}`").eqNullSafe(F.col(doc)) & (F.col(own_mark) == F.col(mark)), "left")
    left = F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda x, i: ~F.array_contains(removed, i))
    new = F.when(F.col(removed).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(left, "\n"))
    return joined.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


@register("op2_line_dedup")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, the numbers of those that go, how many of them differ from what stays, their classes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = removed_lines(docs, MAX_EDITS, MIN_CHARS, "doc_id", "text")
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["doc"]) & (rows["mark"] == gone["mark"]), "left")
    none = F.array().cast("array<int>")
    return joined.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce("removed", none).alias("removed_lines"),
        F.coalesce("classes", F.array().cast("array<bigint>")).alias("class_ids"),
    )
