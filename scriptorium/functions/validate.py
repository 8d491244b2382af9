"""Validation of field values. Each rule gives its error message; an empty one means valid.

``today`` is a parameter, so that results repeat. Master tables are optional: without one the
look-up is skipped. The fourth letter of a PAN is one of a fixed list, and the rule for phones
takes any number of 10 to 15 digits that doesn't begin with 0.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checksum import is_checked
from .correct import has_part
from .text import strip

# The forms of each field and its messages.
PAN_FORM = r"^[A-Z]{3}[ABCFGHLJPT][A-Z][0-9]{4}[A-Z]\z"
IFSC_FORM = r"^[A-Z]{4}0[A-Z0-9]{6}\z"
PIN_FORM = r"^[1-9][0-9]{5}\z"
YEAR_FORM = r"^(?:19|20)[0-9]{2}\z"
DATE_FORM = r"^[0-9]{2}/[0-9]{2}/[0-9]{4}\z"
EMAIL_FORM = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+\z"
PHONE_FORM = r"^(?:[6-9][0-9]{9}|\+?[1-9][0-9]{9,14})\z"
PAN_ERROR = "PAN format is invalid or contains an invalid entity code"
IFSC_ERROR, IFSC_UNKNOWN = "IFSC format is invalid", "IFSC not found in master database"
PIN_ERROR, PIN_UNKNOWN = "Pincode format is invalid (must be 6 digits not starting with 0)", "Pincode not found in master database"
EMAIL_ERROR, PHONE_ERROR, EMPTY_ERROR = "Invalid email format", "Invalid phone number format", "Field is empty"


def uid_error(value: Column) -> Column:
    clean = strip(F.replace(value, F.lit(" "), F.lit("")))
    return (
        F.when(~clean.rlike(r"^[0-9]+\z"), "UID contains non-numeric characters")
        .when(F.length(clean) != 12, F.concat(F.lit("UID must be exactly 12 digits (found "), F.length(clean).cast("string"), F.lit(")")))
        .when(clean.rlike("^[01]"), "UID cannot start with 0 or 1")
        .when(is_checked(clean), "")
        .otherwise("Verhoeff checksum failed")
    )


def _form(value: Column, form: str, error: str) -> Column:
    return F.when(value.rlike(form), "").otherwise(error)


def pan_error(value: Column) -> Column:
    return _form(F.upper(strip(value)), PAN_FORM, PAN_ERROR)


def ifsc_error(value: Column, known: Column | None = None) -> Column:
    """known: whether the master has the code; None without a master."""
    return _looked_up(_form(F.upper(strip(value)), IFSC_FORM, IFSC_ERROR), known, IFSC_UNKNOWN)


def pincode_error(value: Column, known: Column | None = None) -> Column:
    return _looked_up(_form(strip(value), PIN_FORM, PIN_ERROR), known, PIN_UNKNOWN)


def _looked_up(error: Column, known: Column | None, unknown: str) -> Column:
    return error if known is None else F.when((error == "") & ~known, unknown).otherwise(error)


def date_error(value: Column, today: datetime.date) -> Column:
    clean = strip(value)
    day, month, year = (F.substring(clean, at, n).try_cast("int") for at, n in ((1, 2), (4, 2), (7, 4)))
    date = F.try_to_date(clean, "dd/MM/yyyy")
    age_by_year = today.year - F.substring(clean, 1, 4).try_cast("int")
    before_birthday = (month * 100 + day > today.month * 100 + today.day).cast("int")
    return (
        F.when(clean.rlike(YEAR_FORM) & age_by_year.between(0, 120), "")
        .when(~clean.rlike(DATE_FORM), "Date must be DD/MM/YYYY or YYYY")
        .when(date.isNull(), "Invalid calendar date")
        .when(year < 1900, "Year before 1900")
        .when(date > F.lit(today), "Date is in the future")
        .when(today.year - year - before_birthday > 120, "Age exceeds 120 years")
        .otherwise("")
    )


def email_error(value: Column) -> Column:
    return _form(strip(value), EMAIL_FORM, EMAIL_ERROR)


def phone_error(value: Column) -> Column:
    return _form(strip(value), PHONE_FORM, PHONE_ERROR)


def field_error(name: Column, value: Column, today: datetime.date, ifsc_known: Column | None = None, pin_known: Column | None = None) -> Column:
    """The message of the first rule that a part of the field's lower-case name selects."""
    return (
        F.when(value == "", EMPTY_ERROR)
        .when(has_part(name, ("uid", "aadhaar")), uid_error(value))
        .when(F.lower(name).contains("pan_number") | (F.lower(name) == "pan"), pan_error(value))
        .when(has_part(name, ("ifsc",)), ifsc_error(value, ifsc_known))
        .when(has_part(name, ("pin",)), pincode_error(value, pin_known))
        .when(has_part(name, ("dob", "date")), date_error(value, today))
        .when(has_part(name, ("email",)), email_error(value))
        .when(has_part(name, ("phone", "mobile")), phone_error(value))
        .otherwise("")
    )


def with_known(fields: DataFrame, key: Column, master: DataFrame | None, flag: str) -> DataFrame:
    """Add whether the master (code) has the key. Spark broadcasts a master below its size threshold and shuffles a larger one."""
    if master is None:
        return fields
    codes = master.select(F.col("code").alias(f"_{flag}")).dropDuplicates().withColumn(flag, F.lit(True))
    return fields.join(codes, key == F.col(f"_{flag}"), "left").drop(f"_{flag}").withColumn(flag, F.coalesce(flag, F.lit(False)))


def validate_all(fields: DataFrame, today: datetime.date, ifsc: DataFrame | None = None, pins: DataFrame | None = None, name: str = "field_name", value: str = "corrected") -> DataFrame:
    """Add is_valid and error_message to a table of fields."""
    own = F.col(value)
    out = with_known(with_known(fields, F.upper(strip(own)), ifsc, "_ifsc_known"), strip(own), pins, "_pin_known")
    known = [F.col(c) if m is not None else None for c, m in (("_ifsc_known", ifsc), ("_pin_known", pins))]
    return out.withColumn("error_message", field_error(F.col(name), own, today, *known)).withColumn("is_valid", F.col("error_message") == "").drop("_ifsc_known", "_pin_known")
