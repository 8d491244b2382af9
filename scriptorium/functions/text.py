"""Scalar text rules as Spark columns: normalisation, substitution, masking, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, inside a character class after ``(?U)``.
SPACE = r"\s\x1c-\x1f"
#: Line ends: the two-character one first.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Characters that recognition takes for digits, and digits that it takes for letters.
DIGIT_FROM, DIGIT_TO = "OoQDIli|ZzSsGbTBgq", "000011112255667899"
ALPHA_FROM, ALPHA_TO = "01586", "OISBG"


def strip(value: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(value, rf"(?U)^[{SPACE}]+|[{SPACE}]+\z", "")


def collapse(value: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(value, rf"(?U)[{SPACE}]+", " ")


def normalise(value: Column) -> Column:
    """The form in which texts are compared: stripped, collapsed, upper case."""
    return F.upper(collapse(strip(value)))


def digits_for_letters(value: Column) -> Column:
    return F.translate(value, DIGIT_FROM, DIGIT_TO)


def letters_for_digits(value: Column) -> Column:
    return F.translate(value, ALPHA_FROM, ALPHA_TO)


def slashes(value: Column) -> Column:
    """Hyphens, dots and backslashes as slashes."""
    return F.translate(value, "-.\\", "///")


def title_name(value: Column) -> Column:
    """ASCII letters and single spaces only, each word capitalised."""
    letters = F.regexp_replace(value, rf"(?U)[^a-zA-Z{SPACE}]", "")
    return F.initcap(strip(collapse(letters)))


def mask_uid(value: Column) -> Column:
    """All but the last four of twelve characters hidden; other lengths as they are."""
    clean = F.replace(value, F.lit(" "))
    return F.when(F.length(clean) == 12, F.concat(F.lit("XXXX XXXX "), F.right(clean, F.lit(4)))).otherwise(value)


def lines(value: Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(value, LINE_END, -1), strip), lambda line: line != "")


def lines_of_words(value: Column, least: int = 4) -> Column:
    """How many lines have so many words."""
    word = rf"(?U)[^{SPACE}]+"
    return F.size(F.filter(F.split(value, LINE_END, -1), lambda line: F.regexp_count(line, F.lit(word)) >= least))


def printable_ratio(value: Column) -> Column:
    """The share of printable ASCII characters; 0 for an empty text."""
    kept = F.length(F.regexp_replace(value, r"[^\x09-\x0D\x20-\x7E]", ""))
    return kept / F.greatest(F.length(value), F.lit(1))


def without(value: Column, part: Column) -> Column:
    """Every occurrence of a part taken out; nothing if it is empty."""
    return F.when(part == "", value).otherwise(F.replace(value, part, F.lit("")))
