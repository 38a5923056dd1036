"""Name search. Many search terms are answered in one job by equi-joins on name prefixes.

An index holds every prefix of a name or tag with its best rows, so a one-letter term does not drag
whole tables along; it is built once, written in order of prefix, and serves any number of searches.
Text is compared without regard to case; wildcards in a search text have no special meaning.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.names import clean_item_name, tag_to_name
from marketlens.operators.listings import top_per
from marketlens.rules.items import HIDDEN_NAMES
from marketlens.session import spread, stored

# Lead of an exact hit, length of result lists, the neutral name and its score.
EXACT = 10_000_000
SEARCH_RESULTS = 5
PET_SCORE = 100
SPECIAL_NAME = 40
LONG_SEARCH, UUID_SEARCH = 15, 30
FUZZY_LENGTHS = range(4, 17)
PLAIN_NUMBERS = 5_000_000_000  # below this a number is no shortened uuid


def best_item_name(names: DataFrame) -> DataFrame:
    """The display name of each item: short, plain and often seen."""
    plain = F.when(F.col("name").rlike("^[a-zA-Z0-9 ]*$"), F.lit(0)).otherwise(F.lit(SPECIAL_NAME))
    score = F.when(F.col("name").isNull() | (F.col("name") == "Pet"), F.lit(PET_SCORE)).otherwise(
        F.length("name") + plain - F.col("occured_times")
    )
    best = F.min(F.struct(score.alias("score"), "name")).alias("b")
    return names.groupBy("item_id").agg(best).select("item_id", "b.name", "b.score")


def _best_candidates(hits: DataFrame, keys: list[str], exact: Column, base: list[Column], n: int) -> DataFrame:
    """The best rows per prefix, exact ones and others apart, before the terms are joined."""
    return top_per(hits.withColumn("__exact", exact), [*keys, "__exact"], base, n).drop("position", "__exact")


#: A uuid is found by its start up to this length: 16 digits of a number and the version.
UUID_DIGITS = 17


def _stored_index(hits: DataFrame, exact: Column, base: list[Column], n: int, name: str) -> DataFrame:
    """The best rows of every (source, prefix), written in order of prefix, so that few prefixes read few row groups."""
    best = _best_candidates(hits, ["source", "prefix"], exact, base, n)
    return stored(best.repartitionByRange("prefix", "source").sortWithinPartitions("prefix", "source"), name)


def player_index(players: DataFrame, n: int = SEARCH_RESULTS) -> DataFrame:
    """Built once for many searches: (source, prefix, uuid, name, hit_count), the best ``n`` per prefix and exact hits apart."""
    rows = spread(players.select("uuid", "name", "hit_count"))  # a row becomes dozens of entries, which a task sorts
    digits = F.least(F.length("uuid"), F.lit(UUID_DIGITS))
    entries = F.concat(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))), lambda i: F.struct(F.lit("name").alias("source"), F.lower(F.left("name", i)).alias("prefix"))),
        F.array(F.struct(F.lit("uuid").alias("source"), F.lower("uuid").alias("prefix"))),
        F.transform(F.sequence(F.lit(1), F.greatest(digits, F.lit(1))), lambda i: F.struct(F.lit("uuid start").alias("source"), F.lower(F.left("uuid", i)).alias("prefix"))),
    )
    named = rows.withColumn("name", F.coalesce("name", F.lit(""))).withColumn("__e", F.explode(entries)).select("uuid", "name", "hit_count", "__e.*")
    exact = (F.lower("name") == F.col("prefix")) | (F.lower("uuid") == F.col("prefix"))
    base = [F.asc(F.length("name") - F.col("hit_count")), F.asc("name"), F.asc("uuid")]
    return _stored_index(named.filter("prefix <> ''"), exact, base, n, "player-index")


def search_players(terms: DataFrame, index: DataFrame, n: int = SEARCH_RESULTS) -> DataFrame:
    """Top ``n`` players per term by name prefix; long terms are also taken as a uuid or its number.

    Terms with a space find nothing. ``index`` is :func:`player_index` of at least ``n`` rows a prefix.
    """
    asked = terms.select("term").filter((F.col("term") != "") & ~F.col("term").contains(" ")).distinct()
    size = F.length("term")
    number = F.when((size > LONG_SEARCH) & (size < UUID_SEARCH), F.col("term").try_cast("bigint"))
    digits = F.lower(F.hex(number))
    versioned = F.concat(F.left(digits, F.lit(12)), F.lit("4"), F.substr(digits, F.lit(13)))
    uuid_start = F.when(number.between(0, PLAIN_NUMBERS - 1), digits).otherwise(versioned)

    def way(source: str, taken: Column, prefix: Column) -> Column:
        return F.when(taken, F.struct(F.lit(source).alias("source"), prefix.alias("prefix")))

    ways = F.array(
        way("name", number.isNull(), F.lower("term")), way("uuid", number.isNull() & (size > LONG_SEARCH), F.lower("term")), way("uuid start", number.isNotNull(), uuid_start)
    )
    patterns = asked.select("term", F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("w")).select("term", "w.*")
    found = index.join(patterns, ["source", "prefix"]).select("term", "uuid", "name", "hit_count").distinct()
    is_term = (F.lower("name") == F.lower("term")) | (F.lower("uuid") == F.lower("term"))
    score = F.length("name") - F.col("hit_count") - F.when(is_term, F.lit(EXACT)).otherwise(F.lit(0))
    return top_per(found.withColumn("score", score), ["term"], [F.asc("score"), F.asc("name"), F.asc("uuid")], n)


def player_search(terms: DataFrame, players: DataFrame, n: int = SEARCH_RESULTS) -> DataFrame:
    """:func:`search_players` over an index built for these terms alone."""
    return search_players(terms, player_index(players, n), n)


def direct_hits(terms: DataFrame, players: DataFrame) -> DataFrame:
    named = players.select(F.col("name").alias("term"), "uuid", (F.col("hit_count") + EXACT).alias("hit_count"))
    return terms.select("term").distinct().join(named, ["term"])


class ItemIndex(NamedTuple):
    """What item searches look up: the best rows per prefix, the items and their names."""

    prefixes: DataFrame
    items: DataFrame
    names: DataFrame


def item_index(items: DataFrame, names: DataFrame, n: int = SEARCH_RESULTS) -> ItemIndex:
    """Built once for many searches, see :func:`search_items`."""
    main = stored(items.select(F.col("id").alias("item_id"), F.col("name").alias("main"), "tag", "hit_count"), "items")
    spelled = stored(names.select("item_id", F.lower("name").alias("low")).filter("low <> ''").distinct(), "names")

    def laid_out(rows: DataFrame, text: str, source: str) -> DataFrame:
        starts = F.explode(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.left(text, i)))
        return rows.select("item_id", starts.alias("prefix"), F.lit(source).alias("source"))

    tags = main.select("item_id", F.lower("tag").alias("low")).filter("low <> ''")
    hits = laid_out(spelled, "low", "name").distinct().unionByName(laid_out(tags, "low", "tag")).join(main, ["item_id"])
    base = [F.asc(_half_length() - F.col("hit_count")), F.asc("main"), F.asc("item_id")]
    return ItemIndex(_stored_index(hits, F.lit(False), base, n, "item-index"), main, spelled)


def _half_length() -> Column:
    return F.expr("length(main) div 2")


def search_items(terms: DataFrame, index: ItemIndex, n: int = SEARCH_RESULTS) -> DataFrame:
    """Top ``n`` items per term: by the start of a name (cleaned, raw or behind "Enchanted ") or of the tag."""
    cleaned = F.lower("cleaned")
    asked = terms.select("term").distinct().withColumn("cleaned", clean_item_name(F.col("term")))
    starts = F.array_distinct(F.array(cleaned, F.lower(F.concat(F.lit("Enchanted "), "cleaned")), F.lower("term")))
    asked = asked.withColumn("__names", F.filter(starts, lambda s: s != "")).withColumn("__tag", F.lower(F.replace("term", F.lit(" "), F.lit("_"))))
    forms = F.concat(
        F.transform("__names", lambda s: F.struct(F.lit("name").alias("source"), s.alias("prefix"))),
        F.filter(F.array(F.struct(F.lit("tag").alias("source"), F.col("__tag").alias("prefix"))), lambda f: f["prefix"] != ""),
    )
    shown = ["term", "cleaned", "item_id", "main", "tag", "hit_count"]
    patterns = asked.select("term", "cleaned", F.explode(forms).alias("p")).select("term", "cleaned", "p.*")
    found = index.prefixes.join(patterns, ["source", "prefix"]).select(*shown)
    # An item of the term's own name counts whichever pattern finds it, so it is not looked up among the best of one.
    own = asked.join(index.items, F.lower("main") == cleaned).join(index.names, ["item_id"], "left")
    by_name = F.exists("__names", lambda s: F.col("low").startswith(s))
    by_tag = (F.col("__tag") != "") & F.lower("tag").startswith(F.col("__tag"))
    own = own.filter(F.coalesce(by_name, F.lit(False)) | F.coalesce(by_tag, F.lit(False)))
    found = found.unionByName(own.select(*shown)).distinct()
    score = _half_length() - F.col("hit_count") - F.when(F.lower("main") == cleaned, F.lit(EXACT)).otherwise(F.lit(0))
    return top_per(found.withColumn("score", score), ["term"], [F.asc("score"), F.asc("main"), F.asc("item_id")], n)


def item_search(terms: DataFrame, items: DataFrame, names: DataFrame, n: int = SEARCH_RESULTS) -> DataFrame:
    """:func:`search_items` over an index built for these terms alone."""
    return search_items(terms, item_index(items, names, n), n)


def shaped_results(found: DataFrame, names: DataFrame) -> DataFrame:
    """What to show for a found item: its name that starts with the text, else its name, else its tag made readable."""
    candidates = names.filter(F.col("name").isNotNull() & ~F.col("name").isin(HIDDEN_NAMES)).select("item_id", "name")
    wanted = found.select("item_id", F.lower("cleaned").alias("prefix")).distinct()
    matching = (
        candidates.join(wanted, ["item_id"]).filter(F.lower("name").startswith(F.col("prefix"))).groupBy("item_id", "prefix").agg(F.min("name").alias("__shown"))
    )
    own = F.when(F.col("main") == F.col("tag"), tag_to_name(F.col("tag"))).otherwise(F.col("main"))
    asked = found.withColumn("prefix", F.lower("cleaned"))
    return asked.join(matching, ["item_id", "prefix"], "left").withColumn("shown", F.coalesce("__shown", own)).drop("__shown", "prefix")


def correction_patterns(text: str) -> list[str]:
    """LIKE patterns for a mistyped text: two neighbours open, one character missing, one too many."""
    size = len(text)
    swapped = [text[: i - 1] + "__" + text[i + 1 :] for i in range(2, size)]
    missing = [text[:i] + "_" + text[i:] for i in range(1, size)]
    extra = [text[:i] + text[i + 1 :] for i in range(1, size)]
    return swapped + missing + extra


def fuzzy_item_search(text: str, items: DataFrame, names: DataFrame, n: int = SEARCH_RESULTS) -> DataFrame:
    """Items of the first correction pattern that hits any name, least looked-up first."""
    patterns = correction_patterns(text) if len(text) in FUZZY_LENGTHS else ["\x00"]
    low = F.lower("name")
    number = F.coalesce(*[F.when(low.like(p.lower() + "%"), F.lit(i)) for i, p in enumerate(patterns)])
    hits = names.withColumn("pattern", number).filter("pattern is not null").groupBy("item_id").agg(F.min("pattern").alias("pattern"))
    main = items.select(F.col("id").alias("item_id"), "name", "hit_count")
    # the best n rows over all patterns hold the best n rows of the first pattern
    top = hits.join(main, ["item_id"]).orderBy("pattern", "hit_count", "item_id").limit(n)
    return top.filter(F.col("pattern") == top.agg(F.min("pattern")).scalar())


def _without(text: Column, first: Column, count: int) -> Column:
    """A text without ``count`` characters after its first ``first`` ones."""
    return F.concat(F.left(text, first), F.substr(text, first + count + 1))


def _numbered(lowest: int, highest: Column, make) -> Column:
    """``make(i)`` for every i from ``lowest`` to ``highest``, none if there is no such i."""
    return F.transform(F.filter(F.sequence(F.lit(lowest), F.greatest(highest, F.lit(lowest))), lambda i: i <= highest), make)


def fuzzy_search(terms: DataFrame, items: DataFrame, names: DataFrame, n: int = SEARCH_RESULTS) -> DataFrame:
    """:func:`fuzzy_item_search` for a table of terms: top ``n`` items per term of its first pattern with a hit.

    A pattern leaves characters open, so term and start of a name are equal once these are taken out of
    both: two neighbours of either, one of the name, or one of the term. Names are laid out
    with every such gap for the lengths in use and meet the terms by equality; wildcards in a
    term are plain characters here. Terms shorter than 4 or longer than 16 find nothing.
    """
    low, size = F.col("__low"), F.col("__size")
    asked = terms.select("term").distinct().select("term", F.lower("term").alias("__low"), F.length("term").alias("__size"))
    asked = asked.filter(size.between(FUZZY_LENGTHS.start, FUZZY_LENGTHS.stop - 1))

    def gap(kind: str, at: Column, length: Column, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), length.cast("int").alias("size"), key.alias("key"))

    tried = F.concat(
        _numbered(2, size - 1, lambda i: gap("swapped", i, size, _without(low, i - 1, 2))),
        _numbered(1, size - 1, lambda i: gap("missing", i, size, low)),
        _numbered(1, size - 1, lambda i: gap("extra", F.lit(0), size, _without(low, i, 1))),
    )
    patterns = asked.select("term", F.posexplode(tried).alias("pattern", "g")).select("term", "pattern", "g.*")
    used = asked.agg(F.collect_set("__size")).scalar()  # thirteen lengths at most

    def of_length(text: Column, length: Column) -> Column:
        start = F.left(text, length)
        return F.concat(
            F.when(F.length(text) >= length, _numbered(2, length - 1, lambda i: gap("swapped", i, length, _without(start, i - 1, 2)))).otherwise(none),
            F.when(F.length(text) > length, _numbered(1, length - 1, lambda i: gap("missing", i, length, _without(F.left(text, length + 1), i, 1)))).otherwise(none),
            F.when(F.length(text) >= length - 1, F.array(gap("extra", F.lit(0), length, F.left(text, length - 1)))).otherwise(none),
        )

    none = F.array().cast("array<struct<kind:string,at:int,size:int,key:string>>")
    spelled = names.select("item_id", F.lower("name").alias("__name")).distinct().withColumn("__n", F.explode(used))
    gaps = spelled.select("item_id", F.explode(of_length(F.col("__name"), F.col("__n"))).alias("g")).select("item_id", "g.*")
    key = ["kind", "at", "size", "key"]
    wanted = gaps.join(patterns.select(*key).distinct(), key, "left_semi").distinct()
    main = items.select(F.col("id").alias("item_id"), "name", "hit_count")
    order = [F.asc("hit_count"), F.asc("item_id")]
    best = top_per(wanted.join(main, ["item_id"]), key, order, n).drop("position")
    hits = best.join(patterns, key).groupBy("term", "item_id", "name", "hit_count").agg(F.min("pattern").alias("pattern"))
    first = F.min("pattern").over(Window.partitionBy("term"))  # of at most n rows a term
    return top_per(hits, ["term"], [F.asc("pattern"), *order], n).withColumn("__first", first).filter("pattern = __first").drop("__first")


def most_popular(players: DataFrame, n: int) -> DataFrame:
    """Players by hits, then by name."""
    return players.orderBy(F.desc("hit_count"), "name").limit(n)
