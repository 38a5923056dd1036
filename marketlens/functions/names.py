"""Column logic for item, enchantment and player names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.rules.enchants import RENAMED
from marketlens.rules.items import REFORGES, SHARD_TAG_EXCEPTIONS, TIER_COLORS, TIER_WORDS
from marketlens.rules.tables import mapped

_REFORGE_WORDS = sorted({name.lower() for name in REFORGES})


def drop_reforge(name: Column) -> Column:
    """Cut the leading reforge word (kept before "Dragon") or the leading ◆ word."""
    words = F.split(name, " ")
    is_reforge = F.lower(words[0]).isin(_REFORGE_WORDS) & (F.coalesce(F.get(words, F.lit(1)), F.lit("")) != "Dragon")
    space = F.instr(name, " ")
    return F.when((is_reforge | name.startswith("◆")) & (space > 0), F.substr(name, space + 1)).otherwise(name)


def clean_item_name(name: Column) -> Column:
    """The bare item name: no stars, symbols, reforge or pet level."""
    bare = F.translate(F.btrim(name, F.lit("✪")), "⚚✦", "")
    return F.trim(F.regexp_replace(drop_reforge(bare), r"\[Lvl \d{1,3}\] ", ""))


def tag_to_name(tag: Column) -> Column:
    """SOME_TAG_OF_X to "Some Tag of X"; tags of up to two characters stay."""
    def word(w: Column) -> Column:
        return F.when(w.isin("of", "the"), w).otherwise(F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2))))

    words = F.transform(F.split(F.lower(tag), "_"), word)
    return F.when(F.length(tag) <= 2, tag).otherwise(F.trim(F.array_join(words, " ")))


def reforge_of_name(name: Column) -> Column:
    """The reforge a name starts with, by its own spelling, else None."""
    canonical = {word.lower(): word for word in REFORGES}
    return F.coalesce(mapped(canonical, F.lower(F.split(name, " ")[0])), F.lit("None"))


def renamed_enchant(name: Column) -> Column:
    """The internal name of an enchantment shown under its current display name."""
    by_lower = {shown.lower(): internal for shown, internal in RENAMED.items()}
    return F.coalesce(mapped(by_lower, F.lower(name)), name)


def enchant_display_name(key: Column) -> Column:
    shown: dict[str, str] = {}
    for display, internal in RENAMED.items():
        shown.setdefault(internal.lower(), display)
    low = F.lower(key)
    plain = F.when(
        low.startswith("ultimate_") & ~low.isin("ultimate_jerry", "ultimate_wise"),
        F.substr(key, F.lit(len("ultimate_") + 1)),
    ).otherwise(key)
    return tag_to_name(F.lower(F.coalesce(mapped(shown, low), plain)))


def player_name(name: Column) -> Column:
    """A trimmed name of 1 to 16 letters, digits and underscores, else null."""
    trimmed = F.trim(name)
    return F.when(trimmed.rlike("^[A-Za-z0-9_]{1,16}$"), trimmed)


def tier_of_line(line: Column) -> Column:
    first, *rest = TIER_WORDS
    cascade = F.when(line.contains(first[0]), F.lit(first[1]))
    for word, tier in rest:
        cascade = cascade.when(line.contains(word), F.lit(tier))
    return cascade


def tier_of_description(lines: Column, name: Column) -> Column:
    """Tier of the last description line that names one, else by the name's colour code."""
    hits = F.filter(F.transform(F.reverse(lines), tier_of_line), lambda t: t.isNotNull())
    found = F.get(hits, F.lit(0))
    color = F.substr(F.replace(name, F.lit("§f"), F.lit("")), F.lit(1), F.lit(2))
    by_color = F.coalesce(mapped(TIER_COLORS, color), F.lit("UNKNOWN"))
    return F.when(found.isNull() | (found == "UNKNOWN"), by_color).otherwise(found)


def shard_tag(name: Column, known: Column) -> Column:
    """Tag a shard name stands for: its upper-case name, but for the fixed exceptions; null if it is not ``known`` either."""
    exceptions = {k.lower(): v for k, v in SHARD_TAG_EXCEPTIONS.items()}
    plain = F.when(known, F.upper(F.replace(name, F.lit(" "), F.lit("_"))))
    return F.coalesce(mapped(exceptions, F.lower(name)), plain)


def mask_email(text: Column) -> Column:
    """Stars for everything but the first three and last five characters and @."""
    size = F.length(text)
    middle = F.regexp_replace(F.substr(text, F.lit(4), F.greatest(size - 8, F.lit(0))), "[^@]", "*")
    return F.when(size <= 8, text).otherwise(F.concat(F.left(text, F.lit(3)), middle, F.right(text, F.lit(5))))
