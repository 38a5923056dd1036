"""Item attributes: nested JSON to flat long rows, and their dictionary encoding.

Flattening works inside the row on arrays of (key, value), so it needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.ids import attribute_id, rgb_packed
from marketlens.functions.names import renamed_enchant
from marketlens.functions.numbers import roman_to_int
from marketlens.operators.dedup import get_or_create_ids
from marketlens.operators.lookups import skin_to_id, tag_to_id
from marketlens.operators.skew import hot_join
from marketlens.rules import properties as rules
from marketlens.rules.enchants import ATTRIBUTE_KEYS
from marketlens.rules.tables import rule_table

MAP = "map<string,variant>"
# Keys not stored, the two renamed ones, list keys, parts, and the slot pattern.
DROPPED_KEYS = ["enchantments", "id", "originTag", "modifier", "timestamp", "anvil_uses", "hotPotatoBonus"]
LIST_KEYS = ["ability_scroll", "mixins", "unlocked_slots"]
ROD_PARTS = ["sinker", "line", "hook"]
NESTED_PARTS = ["fuel_tank", "engine", "upgrade_module"]
SPECIAL_KEYS = ["uuid", "effects", "necromancer_souls", "petInfo", "gems", "runes", *LIST_KEYS, *ROD_PARTS, *NESTED_PARTS]
GEM_SLOT = r"_(\d{1,2})$"
GEM_SLOTS = 20


def parsed(json: Column) -> Column:
    """JSON text as a map from key to variant."""
    return F.from_json(json, MAP)


def _object(value: Column) -> Column:
    return F.try_variant_get(value, "$", MAP)


def _list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _none() -> Column:
    return F.array().cast(f"array<struct<key:string,value:variant>>")


def _entries(value: Column) -> Column:
    return F.coalesce(F.map_entries(_object(value)), _none())


def _unnest(entries: Column) -> Column:
    """Objects give way to their members, one level deep."""
    return F.flatten(
        F.transform(entries, lambda e: F.coalesce(F.map_entries(_object(e["value"])), F.array(e)))
    )


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _kind(value: Column) -> Column:
    """Type name of a variant without its parameters."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def _written(value: Column, kind: Column) -> Column:
    """A value as text: lists join by comma, booleans are written True and False."""
    joined = F.array_join(F.transform(_list(value), _text), ",")
    return F.when(kind == "ARRAY", joined).when(kind == "BOOLEAN", F.when(_text(value) == "true", "True").otherwise("False")).otherwise(_text(value))


def _plain(entries: Column) -> Column:
    """Variants to (key, type, text)."""
    def one(e: Column) -> Column:
        return _once(
            _kind(e["value"]),
            lambda kind: F.struct(e["key"].alias("key"), kind.alias("type"), _written(e["value"], kind).alias("text")),
        )

    return F.filter(F.transform(entries, one), lambda e: e["text"].isNotNull())


def first_wins(entries: Column) -> Column:
    """The first entry of every key."""
    def pick(all_: Column) -> Column:
        return _once(
            F.transform(all_, lambda e: e["key"]),
            lambda keys: F.filter(all_, lambda e, i: F.array_position(keys, e["key"]) == i + 1),
        )

    return _once(entries, pick)


def reduced(attributes: Column) -> Column:
    """Attributes worth storing: without what has a column of its own, potato count under its short key."""
    kept = F.map_filter(attributes, lambda k, v: ~k.isin(DROPPED_KEYS))
    return F.transform_keys(kept, lambda k, v: F.when(k == "hot_potato_count", F.lit("hpc")).otherwise(k))


def _soul_counts(souls: Column) -> Column:
    """(soul, times) for every soul of a list of one-member objects."""
    texts = F.transform(F.flatten(F.transform(_list(souls), lambda s: F.map_values(_object(s)))), _text)

    def counted(all_: Column) -> Column:
        return F.transform(
            F.array_distinct(all_),
            lambda s: F.struct(
                s.alias("key"), F.lit("BIGINT").alias("type"), F.size(F.filter(all_, lambda o: o == s)).cast("string").alias("text")
            ),
        )

    return _once(texts, counted)


def _word(key: Column, text: Column) -> Column:
    return F.struct(key.alias("key"), F.lit("STRING").alias("type"), text.alias("text"))


def _depth(entries: Column) -> Column:
    """Levels of the objects among the entries: how many braces are open at once, at most.

    A brace inside a text may count too, which costs a pass without effect. Runs of plain text go first,
    so an object as wide as it likes is walked once, brace by brace.
    """
    state = "struct<open:int,most:int>"

    def levels(e: Column) -> Column:
        braces = F.regexp_replace(_text(e["value"]), r"[^{}]+", "")
        steps = F.filter(F.split(braces, ""), lambda c: c != "")

        def step(s: Column, c: Column) -> Column:
            now = F.greatest(s["open"] + F.when(c == "{", 1).otherwise(-1), F.lit(0))
            return F.struct(now.alias("open"), F.greatest(s["most"], now).alias("most")).cast(state)

        start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most")).cast(state)
        return F.when(_object(e["value"]).isNotNull(), F.aggregate(steps, start, step, lambda s: s["most"]))

    return F.coalesce(F.array_max(F.transform(entries, levels)), F.lit(0))


def _flat(entries: Column) -> Column:
    """Entries without any object left, however deep: one pass per level of the row's own objects."""
    def all_levels(first: Column) -> Column:
        return F.aggregate(F.array_repeat(F.lit(0), _depth(first)), first, lambda left, _: _unnest(left))

    return _plain(_once(_unnest(entries), all_levels))


def _marked(values: Column, lifted: bool) -> Column:
    return F.transform(
        values,
        lambda v: F.struct(F.lit(lifted).alias("lifted"), v["key"].alias("key"), v["type"].alias("type"), v["text"].alias("text")),
    )


def _placed(values: Column) -> Column:
    """Entries that stand where their attribute stood."""
    return _marked(values, False)


def _lifted(values: Column) -> Column:
    """Entries that are written to the top level of the attributes."""
    return _marked(values, True)


def _parts(key: Column, value: Column, fields: tuple[str, str]) -> Column:
    """The two identifying members of a part, as key.member."""
    members = [_word(F.concat(key, F.lit(f".{f}")), F.try_variant_get(value, f"$.{f}", "string")) for f in fields]
    return F.filter(F.array(*members), lambda m: m["text"].isNotNull())


def _is_gem(g: Column) -> Column:
    slot = F.regexp_extract(g["key"], GEM_SLOT, 1)  # read of objects only
    return _object(g["value"]).isNotNull() & (F.coalesce(slot.try_cast("int"), F.lit(GEM_SLOTS)) < GEM_SLOTS)


def _gems(members: Column) -> Column:
    found = F.flatten(
        F.transform(
            F.filter(members, _is_gem),
            lambda g: F.array(
                _entry(g["key"], F.try_variant_get(g["value"], "$.quality", "variant")),
                _entry(F.concat(g["key"], F.lit(".uuid")), F.try_variant_get(g["value"], "$.uuid", "variant")),
            ),
        )
    )
    return F.concat(_placed(_flat(F.filter(members, lambda g: ~_is_gem(g)))), _lifted(_flat(found)))


def _pet(members: Column) -> Column:
    rest = F.filter(members, lambda p: ~p["key"].isin("uuid", "extraData"))
    extra = F.flatten(F.transform(F.filter(members, lambda p: p["key"] == "extraData"), lambda p: _entries(p["value"])))
    return F.concat(_placed(_flat(rest)), _lifted(_flat(extra)))


def _expand(entry: Column) -> Column:
    """What one top-level attribute turns into. Only the branch of its key is computed."""
    key, value = entry["key"], entry["value"]
    itself = F.array(entry)
    uid = F.array(_word(F.lit("uid"), F.substr(_text(value), F.lit(25))))
    effects = F.flatten(F.transform(F.reverse(_list(value)), _entries))  # the last of a repeated key counts
    words = F.transform(
        _list(value), lambda v: F.replace(F.replace(_text(v), F.lit("TAG_String: "), F.lit("")), F.lit('"'), F.lit(""))
    )
    pet = F.map_entries(F.coalesce(_object(value), F.from_json(_text(value), MAP)))
    part_rest = F.filter(_entries(value), lambda p: ~p["key"].isin("id", "uuid"))
    runes = F.transform(_entries(value), lambda r: _entry(F.concat(F.lit("RUNE_"), r["key"]), r["value"]))
    special = (
        F.when((key == "uuid") & _text(value).isNotNull(), F.concat(_placed(_plain(itself)), _lifted(uid)))
        .when(key == "effects", _lifted(_flat(effects)))
        .when(key == "necromancer_souls", _lifted(_soul_counts(value)))
        .when(key.isin(LIST_KEYS) & _list(value).isNotNull(), _lifted(F.array(_word(key, F.array_join(F.array_sort(words), " ")))))
        .when((key == "petInfo") & pet.isNotNull(), _once(pet, _pet))
        .when(key.isin(ROD_PARTS) & F.try_variant_get(value, "$.uuid", "string").isNotNull(), _lifted(_parts(key, value, ("uuid", "part"))))
        .when(
            key.isin(NESTED_PARTS) & _object(value).isNotNull(),
            F.concat(_placed(_flat(part_rest)), _lifted(_parts(key, value, ("id", "uuid")))),
        )
        .when((key == "gems") & _object(value).isNotNull(), _once(_entries(value), _gems))
        .when(key == "runes", _lifted(_flat(runes)))
    )

    def usual(kind: Column) -> Column:
        scalar = F.struct(F.lit(False).alias("lifted"), key.alias("key"), kind.alias("type"), _written(value, kind).alias("text"))
        return F.when(kind == "OBJECT", _placed(_flat(itself))).otherwise(F.filter(F.array(scalar), lambda e: e["text"].isNotNull()))

    return F.coalesce(F.when(key.isin(SPECIAL_KEYS), special), _once(_kind(value), usual))


def flat_entries(attributes: Column) -> Column:
    """All attributes of an item as an array of (key, type, text), keys unique.

    ``attributes`` is the reduced map. Members of nested objects stand at the place
    of the object; values lifted out of lists, gems, runes, rods and pets replace a
    top-level value of the same key.
    """
    top_level = F.map_keys(attributes)

    def in_order(all_: Column) -> Column:
        def at_top(e: Column) -> Column:
            return F.array_contains(top_level, e["key"])

        replacing = F.filter(all_, lambda e: e["lifted"] & at_top(e))
        body = F.filter(all_, lambda e: ~e["lifted"])
        added = F.filter(all_, lambda e: e["lifted"] & ~at_top(e))
        return F.concat(replacing, body, added)

    expanded = F.flatten(F.transform(F.map_entries(attributes), _expand))
    return first_wins(_once(expanded, in_order))


def flat_rows(items: DataFrame, json: str = "attributes") -> DataFrame:
    """Long rows (…, key, type, text) for every attribute of every item."""
    keep = [c for c in items.columns if c != json]
    # in a select of its own, below the explode: beside it, the text would be carried to and read again in every row made of it
    told = items.select(*keep, json, F.get_json_object(json, "$.petInfo").isNotNull().alias("has_pet"))
    flat = _once(reduced(parsed(F.col(json))), flat_entries)
    return told.select(*keep, "has_pet", F.explode(flat).alias("e")).select(*keep, "has_pet", "e.*")


def soul_rows(items: DataFrame, json: str = "attributes") -> DataFrame:
    """(…, soul, times) of necromancer items."""
    keep = [c for c in items.columns if c != json]
    souls = F.try_element_at(parsed(F.col(json)), F.lit("necromancer_souls"))
    counted = items.select(*keep, F.explode(_soul_counts(souls)).alias("e"))
    return counted.select(*keep, F.col("e.key").alias("soul"), F.col("e.text").cast("int").alias("times"))


def item_tag(attributes: Column) -> Column:
    """Tag of an item: pets, potions, runes and cases carry their kind; at most 40 characters."""
    def at(key: str) -> Column:
        return _text(F.try_element_at(attributes, F.lit(key)))

    value = F.try_element_at(attributes, F.lit("petInfo"))
    pet_type = F.coalesce(
        F.try_variant_get(value, "$.type", "string"), F.get_json_object(_text(value), "$.type"), F.lit("unkown")
    )
    id_ = at("id")
    runes = F.map_keys(_object(F.try_element_at(attributes, F.lit("runes"))))

    def suffixed(part: Column) -> Column:
        return F.coalesce(F.concat(id_, F.lit("_"), part), id_)

    tag = (
        F.when(id_ == "PET", F.concat(F.lit("PET_"), pet_type))
        .when(id_ == "POTION", suffixed(at("potion")))
        .when(id_.endswith("RUNE"), F.concat(id_, F.lit("_"), F.coalesce(F.get(runes, F.lit(0)), F.lit(""))))
        .when(id_ == "ABICASE", suffixed(at("model")))
        .otherwise(id_)
    )
    return F.left(tag, F.lit(40))


def enchant_rows(items: DataFrame, types: DataFrame, json: str = "attributes") -> DataFrame:
    """(…, type, level) of every enchantment of every item.

    ``types`` holds the known type names (at most 255, an enumeration in one byte).
    Renamed ones take their internal name, attribute keys that are no type are
    skipped, an unknown name is tried as an ultimate one and is else "unknown".
    """
    keep = [c for c in items.columns if c != json]
    known = F.broadcast(types.select(F.lower("name").alias("__low"), F.col("name").alias("__type")).dropDuplicates(["__low"]))
    ultimate = known.select(F.col("__low").alias("__ulow"), F.col("__type").alias("__utype"))
    object_ = _object(F.try_element_at(parsed(F.col(json)), F.lit("enchantments")))
    rows = items.select(*keep, F.explode(F.map_entries(object_)).alias("e")).select(
        *keep,
        renamed_enchant(F.col("e.key")).alias("__name"),
        F.try_variant_get("e.value", "$", "int").bitwiseAND(F.lit(255)).alias("level"),
    )
    joined = rows.join(known, F.lower("__name") == F.col("__low"), "left")
    joined = joined.join(ultimate, F.concat(F.lit("ultimate_"), F.lower("__name")) == F.col("__ulow"), "left")
    skipped = F.col("__type").isNull() & F.col("__name").isin(ATTRIBUTE_KEYS)
    return joined.filter(~skipped).select(*keep, F.coalesce("__type", "__utype", F.lit("unknown")).alias("type"), "level")


def single_book_tag(items: DataFrame, enchants: DataFrame, key: str = "auction_id") -> DataFrame:
    """An enchanted book with one enchantment is tagged by it."""
    single = enchants.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("type", "level")).alias("__e")).filter("__n = 1")
    named = F.concat(F.lit("ENCHANTMENT_"), F.upper("__e.type"), F.lit("_"), F.col("__e.level").cast("string"))
    joined = items.join(single, [key], "left")
    use = (F.col("tag") == "ENCHANTED_BOOK") & F.col("__e").isNotNull()
    return joined.withColumn("tag", F.when(use, named).otherwise(F.col("tag"))).drop("__n", "__e")


def book_tags(books: DataFrame, types: DataFrame, name: str = "name") -> DataFrame:
    """Add the tag of an enchanted book read from its display name; names that give none are left null."""
    shown = F.col(name)
    other = (
        shown.isin("§9Stacking Enchants", "§aEnchanted Book")
        | shown.startswith("§a§aBuy §e")
        | shown.startswith("BUY_")
        | shown.startswith("SELL_")
    )
    bare = F.regexp_replace(shown, "§[0-9a-fklmnor]|SELL |BUY |'", "")
    level_text = F.split(F.substring_index(bare, " ", -1), "-")[0]
    level = F.coalesce(level_text.try_cast("int"), roman_to_int(level_text))
    spoken = F.translate(F.trim(F.regexp_extract(bare, r"^(.*) [^ ]*$", 1)), " -", "__")
    known = F.broadcast(types.select(F.lower("name").alias("__low"), F.col("name").alias("__type")).dropDuplicates(["__low"]))
    ultimate = known.select(F.col("__low").alias("__ulow"), F.col("__type").alias("__utype"))
    asked = books.withColumn("__level", F.when(~other & bare.contains(" "), level)).withColumn("__name", F.lower(renamed_enchant(spoken)))
    joined = asked.join(known, F.col("__name") == F.col("__low"), "left")
    joined = joined.join(ultimate, F.concat(F.lit("ultimate_"), F.col("__name")) == F.col("__ulow"), "left")
    type_ = F.upper(F.coalesce("__type", "__utype", F.lit("unknown")))
    tag = F.concat(F.lit("ENCHANTMENT_"), type_, F.lit("_"), F.col("__level").cast("string"))
    return joined.withColumn("book_tag", tag).drop("__level", "__name", "__low", "__type", "__ulow", "__utype")


# Fixed value: attribute keys have 16-bit ids.
MOST_KEYS = 65_535
NUMBERS = ["TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL"]


def routed(flat: DataFrame) -> DataFrame:
    """Decide per attribute how its value becomes a number: itself, an id, a colour, an item or a dictionary entry."""
    key, text, type_ = F.col("key"), F.col("text"), F.col("type")
    route = (
        F.when(type_.isin(NUMBERS), "number")
        .when(key.isin(rules.ID_KEYS) | key.endswith(".uuid"), "id")
        .when(key.isin("hideInfo", "active") & (text == "False"), "drop")
        .when(key.isin("tier", "type"), "drop")
        .when((key == "skin") & F.col("has_pet"), "skin")
        .when(key.isin(rules.ITEM_KEYS), "item")
        .when(key.isin(rules.TEXT_KEYS), "text")
        .when(key == "color", "color")
        .when(key.isin(rules.IGNORED_KEYS), "drop")
        .otherwise("json")
    )
    tagged = flat.withColumn("route", route).filter("route <> 'drop'")
    number = (
        F.when(F.col("route") == "number", F.coalesce(text.try_cast("bigint"), F.bround(text.try_cast("double")).cast("bigint")))
        .when(F.col("route") == "id", attribute_id(text))
        .when(F.col("route") == "color", rgb_packed(text))
    )
    quoted = F.when(type_ == "BOOLEAN", F.lower(text)).otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    owner = F.when(key == "cake_owner", F.replace(text, F.lit("ዞ"), F.lit("H"))).otherwise(text)
    entry = F.when(F.col("route") == "text", owner).when(F.col("route") == "json", quoted)
    return (
        tagged.withColumn("number", number)
        .withColumn("entry", entry)
        .withColumn("item_tag", F.when(F.col("route") == "item", text))
        .withColumn("skin", F.when(F.col("route") == "skin", text))
    )


def key_dictionary(known: DataFrame, flat: DataFrame) -> DataFrame:
    """(id, slug): dictionary of attribute keys. An id beyond 16 bits is an error, so the whole table is small."""
    ids = get_or_create_ids(known, flat.select(F.col("key").alias("slug")), ["slug"])
    too_many = F.raise_error(F.lit(f"attribute keys have ids up to {MOST_KEYS}")).cast("bigint")
    return ids.withColumn("id", F.when(F.col("id") <= MOST_KEYS, F.col("id")).otherwise(too_many))


def value_dictionary(known: DataFrame, routed_rows: DataFrame) -> DataFrame:
    """(id, key, value): dictionary of text values per key."""
    seen = routed_rows.filter("entry is not null").select("key", F.col("entry").alias("value"))
    return get_or_create_ids(known, seen, ["key", "value"])


def reference_table(values: DataFrame, items: DataFrame) -> DataFrame:
    """(kind, key, text, found): what a text stands for. Entries by key, items by tag, skins by PET_SKIN_ and name, then by name.

    A rune's tag stands for its unique form if there is one. Items are read once.
    """
    tag = F.col("tag")
    unique, skin = tag.startswith("UNIQUE_RUNE_"), tag.startswith("PET_SKIN_")

    def said(kind: str, text: Column, rank: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(rank).alias("rank"))

    rune, bare = F.substr(tag, F.lit(len("UNIQUE_") + 1)), F.substr(tag, F.lit(len("PET_SKIN_") + 1))
    ways = F.array(
        F.when(unique, said("item", rune, 0)), said("item", tag, 1), F.when(skin, said("skin", bare, 0)), F.when(unique, said("skin", rune, 1)), said("skin", tag, 2)
    )
    named = items.filter("tag is not null").select(F.col("id").cast("bigint").alias("id"), F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("w"))
    best = named.groupBy("w.kind", "w.text").agg(F.min(F.struct("w.rank", "id")).alias("b"))
    entries = values.select(F.lit("entry").alias("kind"), "key", F.col("value").alias("text"), F.col("id").cast("bigint").alias("found"))
    return entries.unionByName(best.select("kind", F.lit("").alias("key"), "text", F.col("b.id").alias("found")))


def encoded(routed_rows: DataFrame, keys: DataFrame, values: DataFrame, items: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """(auction_id, key_id, value): every attribute as two numbers. All texts meet one table in one join; unknown ones give 0."""
    small = F.broadcast(keys.select(F.col("slug").alias("key"), F.col("id").alias("key_id")))  # 16-bit ids, see key_dictionary
    kind = F.when(F.col("entry").isNotNull(), "entry").when(F.col("route").isin("item", "skin"), F.col("route"))
    # a row that is its own number needs no look-up, and most are: they are not shuffled
    own = routed_rows.filter(kind.isNull()).select("auction_id", "key", F.col("number").alias("value"))
    rows = routed_rows.filter(kind.isNotNull()).select(
        "auction_id",
        F.col("key").alias("__key"),
        kind.alias("kind"),
        F.when(kind == "entry", F.col("key")).otherwise("").alias("key"),
        F.coalesce("entry", "item_tag", "skin").alias("text"),
    )
    told = hot_join(rows, reference_table(values, items), ["kind", "key", "text"], "left", hot_rows=hot_rows)
    found = own.unionByName(told.select("auction_id", F.col("__key").alias("key"), F.coalesce("found", F.lit(0)).alias("value")))
    return found.join(small, ["key"], "left").select("auction_id", F.coalesce("key_id", F.lit(0)).alias("key_id"), "value")


def with_asked_attribute(auctions: DataFrame, attributes: DataFrame, key: str, text: str) -> DataFrame:
    """Auctions that carry one attribute value, straight from routed attributes: only rows of the key are looked at.

    The asked text is compared as the row stores it: a number as a number, else the entry, item tag or skin.
    """
    own = F.coalesce("entry", "item_tag", "skin")
    asked = (F.col("key") == key) & F.coalesce((F.col("number") == F.lit(text).try_cast("bigint")), own.isin(text, f'"{text}"'))
    return auctions.join(attributes.filter(asked).select("auction_id").distinct(), ["auction_id"], "left_semi")


def with_attribute(auctions: DataFrame, lookup: DataFrame, key_id: int | Column, value: int | Column) -> DataFrame:
    """Auctions that carry an attribute value."""
    ids = lookup.filter((F.col("key_id") == key_id) & (F.col("value") == value)).select("auction_id").distinct()
    return auctions.join(ids, ["auction_id"], "left_semi")


def training_features(auctions: DataFrame, enchants: DataFrame, lookup: DataFrame, keys: DataFrame, since: str, feature_keys: list[str] = rules.FEATURE_KEYS) -> DataFrame:
    """Feature rows for sold auctions: scalars plus sorted lists of enchantments and mapped attributes.

    Children are counted per distinct pair before they are collected, so a list is
    bounded by the number of types and keys. Attributes without a mapping are left out.
    """
    from marketlens.operators.lookups import children_lists

    sold = auctions.filter((F.col("end") > F.lit(since)) & (F.col("highest_bid") > 0))
    mapping = rule_table(auctions.sparkSession, [(k, i + 1) for i, k in enumerate(feature_keys)], "slug string, feature int")
    mapped_keys = F.broadcast(keys.join(mapping, ["slug"]).select(F.col("id").alias("key_id"), "feature"))
    counted = lookup.join(mapped_keys, ["key_id"]).groupBy("auction_id", "feature", "value").agg(F.count(F.lit(1)).alias("copies"))
    attributes = counted.groupBy("auction_id").agg(F.sort_array(F.collect_list(F.struct("feature", "value", "copies"))).alias("attributes"))
    return sold.join(children_lists(enchants), ["auction_id"], "left").join(attributes, ["auction_id"], "left")


def export_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").parquet(path)
