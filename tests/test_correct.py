"""Literal cases of correction; where a rule's code and a documented example differ, the code counts."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import correct, text

CASES = [
    ("uid", "8O24 56l2 3847", "8024 5612 3847"),
    ("uid", "1234-5678-9012", "1234 5678 9012"),
    ("uid", "1234 5678", "1234 5678"),
    ("uid", "1234_5678_9012", "1234_5678_9012"),  # an underscore is a letter
    ("uid", "1234 5678 901|", "1234 5678 901|"),  # the bar is dropped before it can pass for a 1
    ("pan", "ABCDE123OF", "ABCDE1230F"),
    ("pan", "ABCDEI234F", "ABCDE1234F"),
    ("pan", "ABCD01234F", "ABCDO1234F"),
    ("pan", "ABCDE12345", "ABCDE1234S"),
    ("pan", "ABCDE1234", "ABCDE1234"),
    ("dob", "O1/O6/1992", "01/06/1992"),
    ("dob", "01-06-1992", "01/06/1992"),
    ("dob", "01.06.1992", "01/06/1992"),
    ("dob", "32/01/1992", "1992"),  # out of range: the year is left
    ("dob", "no date", "no date"),
    ("name", "J0HN D0E", "Jhn De"),
    ("name", "  ravi   KUMAR\t", "Ravi Kumar"),
    ("name_regional", "नाम", ""),
    ("company_name", "ABCDE123OF", "ABCDE1230F"),  # "pan" is in the name
    ("pincode", "11O0OI", "110001"),
    ("pincode", "11000", "11000"),
    ("unrelated", " NOISE ", "NOISE"),
    ("pin_code", " 11000 ", "11000"),  # stripped, as it isn't one of the fixed names
]


def test_cases(spark):
    rows = spark.createDataFrame([(n, r) for n, r, _ in CASES], "field_name string, raw string")
    for r in correct.correct_all(rows).collect():
        want = next(w for n, raw, w in CASES if (n, raw) == (r.field_name, r.raw))
        assert (r.corrected, r.was_changed) == (want, want != r.raw), r
        assert r.change_description == (f"{r.field_name} correction applied" if r.was_changed else "")


@pytest.mark.parametrize("field", ["uid", "pan", "pincode"])
def test_corrected_values_stay(spark, field):
    raws = [f"{k * 7919 % 10**12:012d}" for k in range(50)] + [f"AB{chr(65 + k % 26)}DE{k:04d}O" for k in range(50)] + ["O1234I", "9O0 0ll"]
    once = spark.createDataFrame([(r,) for r in raws], "raw string").select(correct.correct_field(F.lit(field), F.col("raw")).alias("a"))
    assert once.where(correct.correct_field(F.lit(field), F.col("a")) != F.col("a")).count() == 0


def test_every_substitution(spark):
    frame = spark.createDataFrame([(text.DIGIT_FROM, text.ALPHA_FROM)], "d string, a string")
    row = frame.select(text.digits_for_letters(F.col("d")), text.letters_for_digits(F.col("a"))).first()
    assert tuple(row) == (text.DIGIT_TO, text.ALPHA_TO)


def test_text_rules_against_python(spark):
    values = ["  a \t b c  ", "\x1c x \x1f", "", " ", "Straße é", "a b\r\n\x0bc\x85d e f g\n", "123456789012", "1234 5678 9012", "123", "café \x07 ok"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(
        "v", text.strip(F.col("v")).alias("s"), text.normalise(F.col("v")).alias("n"), text.lines(F.col("v")).alias("l"), text.lines_of_words(F.col("v")).alias("w"),
        text.printable_ratio(F.col("v")).alias("p"), text.mask_uid(F.col("v")).alias("m"),
    )
    import string

    for r in rows.collect():
        v = r.v
        assert r.s == v.strip()
        assert r.n == " ".join(v.split()).upper()
        assert r.l == [x.strip() for x in v.splitlines() if x.strip()]
        assert r.w == sum(len(x.split()) >= 4 for x in v.splitlines())
        assert r.p == pytest.approx(sum(c in string.printable for c in v) / max(len(v), 1))
        clean = v.replace(" ", "")
        assert r.m == (f"XXXX XXXX {clean[-4:]}" if len(clean) == 12 else v)
