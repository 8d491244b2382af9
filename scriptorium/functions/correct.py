"""Repair of recognised field values: one column expression for each kind of field.

A value that the rule can't bring into its form comes back as it was. ``_`` counts as a letter
and stays, so a number grouped by underscores isn't repaired. A date out of range falls back to
a year of 1900 to 2099 in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import digits_for_letters, letters_for_digits, slashes, strip, title_name

_NOT_WORD = r"[^\p{L}\p{N}_]"


def _digits(raw: Column, count: int) -> tuple[Column, Column]:
    number = digits_for_letters(F.regexp_replace(raw, _NOT_WORD, ""))
    return number, number.rlike(rf"^[0-9]{{{count}}}\z")


def correct_uid(raw: Column) -> Column:
    """Twelve digits in groups of four."""
    number, fits = _digits(raw, 12)
    return F.when(fits, F.concat_ws(" ", *(F.substring(number, k, 4) for k in (1, 5, 9)))).otherwise(raw)


def correct_pincode(raw: Column) -> Column:
    """Six digits."""
    number, fits = _digits(raw, 6)
    return F.when(fits, number).otherwise(raw)


def correct_pan(raw: Column) -> Column:
    """Five letters, four digits, a letter; each place repaired towards what it must be."""
    clean = F.upper(F.replace(raw, F.lit(" "), F.lit("")))
    fixed = F.concat(letters_for_digits(F.substring(clean, 1, 5)), digits_for_letters(F.substring(clean, 6, 4)), letters_for_digits(F.substring(clean, 10, 1)))
    return F.when((F.length(clean) == 10) & fixed.rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]\z"), fixed).otherwise(raw)


def correct_date(raw: Column) -> Column:
    """The first dd/mm/yyyy if its parts are in range, else the first year, else as it was."""
    fixed = digits_for_letters(slashes(raw))
    first = F.regexp_extract(fixed, r"([0-9]{2}/[0-9]{2}/[0-9]{4})", 1)
    day, month, year = (F.substring(first, at, n).try_cast("int") for at, n in ((1, 2), (4, 2), (7, 4)))
    in_range = day.between(1, 31) & month.between(1, 12) & year.between(1900, 2100)
    only_year = F.regexp_extract(fixed, r"(?U)\b((?:19|20)[0-9]{2})\b", 1)
    return F.when(F.coalesce(in_range, F.lit(False)), first).when(only_year != "", only_year).otherwise(raw)


def correct_name(raw: Column) -> Column:
    return title_name(raw)


#: Which rule a field takes: the first one with a part of its lower-case name.
RULES = (
    (("uid", "aadhaar"), correct_uid),
    (("pan",), correct_pan),
    (("dob", "date"), correct_date),
    (("name",), correct_name),
    (("pin",), correct_pincode),
)
#: Fields that keep their white space where a rule leaves them as they were.
UNTRIMMED = ("uid", "pan", "dob", "name", "pincode")


def has_part(name: Column, parts: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.lower(name).contains(p) for p in parts))


def correct_field(name: Column, raw: Column) -> Column:
    """The repaired value by the field's name; fields without a rule, or left as they were, are stripped."""
    out = raw
    for parts, rule in reversed(RULES):
        out = F.when(has_part(name, parts), rule(raw)).otherwise(out)
    # an array of one value: its lambda's variable stands for the rules' result, which is made once
    return F.transform(F.array(out), lambda fixed: F.when((fixed == raw) & ~name.isin(*UNTRIMMED), strip(raw)).otherwise(fixed))[0]


def correct_all(fields: DataFrame, name: str = "field_name", raw: str = "raw") -> DataFrame:
    """Add corrected, was_changed and change_description to a table of fields."""
    return (
        fields.withColumn("corrected", correct_field(F.col(name), F.col(raw)))
        .withColumn("was_changed", F.col("corrected") != F.col(raw))
        .withColumn("change_description", F.when(F.col("was_changed"), F.concat(name, F.lit(" correction applied"))).otherwise(""))
    )
