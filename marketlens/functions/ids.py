"""Column logic for ids, colours, times and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.rules.items import RECOMB_CATEGORIES, RECOMB_TAG_PARTS

# Fixed value: the written form of a market time.
MARKET_TIME = r"(?i)^(\d{1,2}/\d{1,2}/\d{2}) (\d{1,2}:\d{2})(?: (AM|PM))?$"


def hex_to_long(text: Column) -> Column:
    """A hexadecimal number of up to 16 digits as signed 64-bit."""
    return F.conv(text, 16, -10).cast("bigint")


def uuid_to_long(uuid: Column) -> Column:
    """64-bit surrogate of a uuid: its first 17 digits without the version digit; too short is -1, 0 becomes 1."""
    digits = F.when(F.length(uuid) > 17, F.left(F.replace(uuid, F.lit("-"), F.lit("")), F.lit(17))).otherwise(uuid)
    kept = F.concat(F.left(digits, F.lit(12)), F.substr(digits, F.lit(14)))
    number = hex_to_long(kept)
    return (
        F.when(uuid.isNull() | (F.length(uuid) < 16), F.lit(-1))
        .when(number == 0, F.lit(1))
        .otherwise(number)
        .cast("bigint")
    )


def attribute_id(text: Column) -> Column:
    """64-bit id of an attribute: a whole uuid counts by its part after the last dash."""
    return hex_to_long(F.when(F.length(text) > 16, F.substr(text, F.lit(25))).otherwise(text))


def rgb_text(color: Column) -> Column:
    """0xRRGGBB to "r:g:b"."""
    parts = [F.shiftright(color, n).bitwiseAND(F.lit(255)) for n in (16, 8, 0)]
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def rgb_hex(text: Column) -> Column:
    """ "r:g:b" or "r,g,b" to six hexadecimal digits, null to an empty text."""
    parts = F.transform(F.split(text, "[:,]"), lambda p: F.lpad(F.hex(p.cast("bigint")), 2, "0"))
    return F.coalesce(F.array_join(parts, ""), F.lit(""))


def rgb_packed(text: Column) -> Column:
    """ "r:g:b" to a 32-bit number, moved up a byte after each part, the last one too."""
    def push(acc: Column, part: Column) -> Column:
        return F.shiftleft(acc + F.coalesce(part.try_cast("int"), F.lit(0)), 8)

    return F.aggregate(F.split(text, ":"), F.lit(0), push).cast("bigint")


def market_time(text: Column) -> Column:
    """A time written as "6/3/20 5:07 PM", as "6/3/20 5:07" (before noon) or as epoch milliseconds."""
    day = F.regexp_extract(text, MARKET_TIME, 1)
    clock = F.regexp_extract(text, MARKET_TIME, 2)
    half = F.upper(F.regexp_extract(text, MARKET_TIME, 3))
    read = F.try_to_timestamp(F.concat_ws(" ", F.nullif(day, F.lit("")), clock), F.lit("M/d/yy H:mm"))
    hour, noon = F.hour(read), F.expr("INTERVAL 12 HOUR")
    written = (
        F.when((half == "PM") & (hour < 12), read + noon)
        .when(half == "PM", read)
        .when(hour == 12, read - noon)
        .when(hour < 12, read)
    )
    return F.coalesce(written, F.timestamp_millis(text.try_cast("bigint")))


def has_flag(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def is_pet(tag: Column) -> Column:
    other = tag.startswith("PET_SKIN") | tag.startswith("PET_ITEM") | (tag == "PET_CAKE")
    return F.coalesce(tag.startswith("PET_") & ~other, F.lit(False))


def rarity_upgrade_matters(category: Column, tag: Column) -> Column:
    part = tag.rlike("|".join(RECOMB_TAG_PARTS))
    return category.isin(RECOMB_CATEGORIES) | tag.isNull() | F.coalesce(part, F.lit(False))
