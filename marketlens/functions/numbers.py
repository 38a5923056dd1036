"""Column logic for written amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.rules.tables import mapped

# What a suffix multiplies by, and what a Roman digit stands for.
SUFFIXES = {"t": 1e12, "b": 1e9, "m": 1e6, "k": 1e3}
COIN_SUFFIXES = {"B": 1e9, "M": 1e6, "k": 1e3}
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}


def normalize_amount(text: Column) -> Column:
    """A written amount as double: suffix t/b/m/k, a comma is a decimal point, blank is 0, junk is null."""
    value = F.rtrim(text, F.lit("%"))
    factor = F.coalesce(mapped(SUFFIXES, F.lower(F.right(value, F.lit(1)))), F.lit(1.0))
    digits = F.regexp_replace(F.translate(value, ",", "."), "[^0-9.]", "")
    return F.when(F.trim(text) == "", F.lit(0.0)).otherwise(digits.try_cast("double") * factor)


def normalize_long(text: Column) -> Column:
    """As :func:`normalize_amount`, rounded half to even."""
    return F.bround(normalize_amount(text)).cast("bigint")


def coin_amount(text: Column) -> Column:
    """Coins in tenths: suffix B, M or k in that case, commas group thousands, junk is 0."""
    value = F.trim(text)
    factor = mapped(COIN_SUFFIXES, F.right(value, F.lit(1)))
    number = F.when(factor.isNull(), value).otherwise(F.substr(value, F.lit(1), F.length(value) - 1))
    valid = number.rlike(r"^\s*[+-]?(\d[\d,]*(\.\d*)?|\.\d+)\s*$")
    parsed = F.when(valid, F.translate(F.trim(number), ",", "").try_cast("double"))
    return F.coalesce((parsed * F.coalesce(factor, F.lit(1.0)) * 10).cast("bigint"), F.lit(0).cast("bigint"))


def coins_of_name(name: Column) -> Column:
    """Coins in tenths an item name such as "§67M coins" stands for, 0 for any other item."""
    plain = F.regexp_replace(F.regexp_replace(name, "§.", ""), "(?i) coins$", "")
    return F.when(name.endswith(" coins"), coin_amount(plain)).otherwise(F.lit(0).cast("bigint"))


def stated_coins(description: Column) -> Column:
    """The total a description states: the exact number in brackets, else the line after the header."""
    plain = F.regexp_replace(description, "§.", "")
    exact = F.translate(F.regexp_extract(plain, r"\(([\d,]+)\)", 1), ",", "").try_cast("bigint")
    following = F.regexp_extract(plain, r"Total Coins Offered:[^\n]*\n([^\n]*)", 1)
    has_line = plain.rlike(r"Total Coins Offered:[^\n]*\n")
    rough = F.when(has_line, F.floor(coin_amount(following) / 10))
    return F.when(description.contains("Total Coins Offered:"), F.coalesce(exact, rough))


def roman_to_int(text: Column) -> Column:
    """A Roman number (or a plain one): a digit below its follower counts against the sum."""
    digits = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: mapped(ROMAN, c))
    shifted = F.concat(F.slice(digits, 2, F.greatest(F.size(digits) - 1, F.lit(0))), F.array(F.lit(0)))
    signed = F.zip_with(digits, shifted, lambda d, n: F.when(d < n, -d).otherwise(d))
    total = F.aggregate(signed, F.lit(0), lambda acc, d: acc + d)
    return F.coalesce(text.try_cast("int"), F.when(text.rlike("^[IVXLC]+$"), total))
