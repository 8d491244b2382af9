"""Fields from the text layer of a document. A field that isn't found is empty and listed in the warnings.

The years of experience are the count of month-year ranges, as no dates are summed. Of repeated
labels on the second kind of card the last one with a line after it counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import lines, strip

# The patterns of each field.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(\+?[0-9][0-9\s\-]{8,14}[0-9]|[6-9][0-9]{9})"
LINKEDIN = r"(?i)linkedin\.com/in/[\p{L}\p{N}_\-]+"
RANGE = r"(?i)([a-z]{3,}\s+[0-9]{4})\s*[-–]\s*([a-z]{3,}\s+[0-9]{4}|present|current)"
TITLE = r"(?i)\b(engineer|manager|developer|designer|analyst|consultant)\b"
SKILLS = r"(?i)^(skills|technical skills)"
AFTER_SKILLS = r"(?i)^(experience|education|projects|work history)"
EDUCATION = r"(?i)^education"
NAME_LABEL = r"(?i)(?:name|नाम)\s*[:\-]?\s*(.+)"
DOB_LABEL = r"(?i)(?:dob|date of birth|जन्म तिथि)\s*[:\-]?\s*([0-9]{2}/[0-9]{2}/[0-9]{4})"
GENDER_LABEL = r"(?i)(?:gender|लिंग)\s*[:\-]?\s*(male|female|transgender|पुरुष|महिला)"
UID = r"([0-9]{4}\s[0-9]{4}\s[0-9]{4})"
PAN = r"[A-Z]{5}[0-9]{4}[A-Z]"

CV_FIELDS = ("name", "email", "phone", "linkedin", "total_experience_years", "current_title", "skills", "education")
CARD_FIELDS = {"cv": CV_FIELDS, "aadhaar": ("name", "dob", "gender", "uid"), "pan": ("pan_number", "name", "father_name", "dob")}


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match; empty if there is none. A dot stops at a line feed only."""
    return F.regexp_extract(text, "(?d)" + pattern, group)


def skills(own: Column) -> Column:
    """Parts of the lines from the first skills header to the next section; further headers in between are left out."""
    start = F.struct(F.lit(0).alias("state"), F.lit("").alias("text"))

    def step(s: Column, line: Column) -> Column:
        put = lambda state, text: F.struct(state.alias("state"), text.alias("text"))
        return (
            F.when(s["state"] == 2, s)
            .when(line.rlike(SKILLS), put(F.lit(1), s["text"]))
            .when(s["state"] == 0, s)
            .when(line.rlike(AFTER_SKILLS), put(F.lit(2), s["text"]))
            .otherwise(put(s["state"], F.concat(s["text"], line, F.lit(" "))))
        )

    block = F.aggregate(own, start, step, lambda s: s["text"])
    return F.array_join(F.filter(F.transform(F.split(block, "[,|]", -1), strip), lambda p: p != ""), ", ")


def education(own: Column) -> Column:
    """The first line after the first header that isn't a header itself."""
    header = lambda line: line.rlike(EDUCATION)
    first = F.array_position(F.transform(own, header), F.lit(True)).cast("int")
    rest = F.filter(F.slice(own, F.greatest(first, F.lit(1)), F.size(own)), lambda line: ~header(line))
    return F.when(first > 0, F.coalesce(F.get(rest, F.lit(0)), F.lit(""))).otherwise("")


def cv_fields(text: Column, own: Column) -> dict[str, Column]:
    """own: the text's lines, computed once."""
    first = lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit(""))
    return {
        "name": first(own),
        "email": found(text, EMAIL),
        "phone": found(text, PHONE),
        "linkedin": found(text, LINKEDIN),
        "total_experience_years": F.regexp_count(text, F.lit(RANGE)).cast("string"),
        "current_title": first(F.filter(F.slice(own, 1, 10), lambda line: line.rlike(TITLE))),
        "skills": skills(own),
        "education": education(own),
    }


def first_card_fields(text: Column) -> dict[str, Column]:
    return {"name": strip(found(text, NAME_LABEL, 1)), "dob": found(text, DOB_LABEL, 1), "gender": found(text, GENDER_LABEL, 1), "uid": found(text, UID, 1)}


def _label(line: Column) -> Column:
    """Which field's label a line is."""
    low = F.lower(line)
    return (
        F.when(low.contains("name") & ~low.contains("father"), "name")
        .when(low.contains("father"), "father_name")
        .when(low.contains("date of birth") | low.contains("dob"), "dob")
    )


def second_card_fields(text: Column, own: Column) -> dict[str, Column]:
    """The number anywhere; other fields on the line after their last label."""
    followed = F.arrays_zip(F.transform(F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))), _label).alias("label"), F.slice(own, F.lit(2), F.size(own)).alias("value"))

    def last(field: str) -> Column:
        hits = F.filter(followed, lambda x: x["label"] == field)
        return F.when(F.size(hits) > 0, F.element_at(hits, -1)["value"]).otherwise("")

    return {"pan_number": found(text, PAN)} | {f: last(f) for f in ("name", "father_name", "dob")}


def _wide(texts: DataFrame, fields: dict[str, Column]) -> DataFrame:
    out = texts.withColumns(fields).drop("_lines")
    lacks = [F.when(F.col(f) == ("0" if f == "total_experience_years" else ""), F.lit(f"{f} missing")) for f in fields]
    return out.withColumn("warnings", F.array_compact(F.array(*lacks)))


def extract_cv(texts: DataFrame) -> DataFrame:
    """Add a column for each field of a CV, and warnings."""
    return _wide(texts.withColumn("_lines", lines(F.col("text"))), cv_fields(F.col("text"), F.col("_lines")))


def extract_first_card(texts: DataFrame) -> DataFrame:
    return _wide(texts, first_card_fields(F.col("text")))


def extract_second_card(texts: DataFrame) -> DataFrame:
    return _wide(texts.withColumn("_lines", lines(F.col("text"))), second_card_fields(F.col("text"), F.col("_lines")))


def extract(texts: DataFrame) -> DataFrame:
    """(id, doc_type, text) to long form (id, doc_type, ord, field_name, value), with confidence 1. Unknown kinds give no fields."""
    parts = []
    for kind, run in (("cv", extract_cv), ("aadhaar", extract_first_card), ("pan", extract_second_card)):
        wide = run(texts.where(F.col("doc_type") == kind))
        fields = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field_name"), F.col(f).alias("value")) for i, f in enumerate(CARD_FIELDS[kind], 1)))
        parts.append(wide.select("id", "doc_type", F.explode(fields).alias("f")).select("id", "doc_type", "f.*", F.lit(1.0).alias("confidence")))
    return reduce(DataFrame.union, parts)
