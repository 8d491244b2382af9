"""One response for each document from its routed and validated fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import mask_uid

# The fields that each kind of document shows. Other kinds show all of theirs.
SHOWN = {
    "aadhaar": ("name", "name_regional", "dob", "gender", "uid", "address", "pincode", "qr_data"),
    "pan": ("name", "father_name", "dob", "pan_number", "entity_type"),
    "cv": ("name", "email", "phone", "linkedin", "current_title", "total_experience_years", "skills", "education"),
}


def shown_name(name: Column) -> Column:
    return F.when(name == "aadhaar_number", "uid").otherwise(name)


def is_shown(doc_type: Column, name: Column) -> Column:
    out = F.lit(True)
    for kind, names in SHOWN.items():
        out = F.when(doc_type == kind, name.isin(*names)).otherwise(out)
    return out


def shown_fields(routed: DataFrame) -> DataFrame:
    """Fields as they are shown: renamed, masked (the value and what was read), and only those of the document's kind."""
    name = shown_name(F.col("field_name"))
    hide = F.lower(name).contains("uid")
    masked = lambda c: F.when(hide, mask_uid(F.col(c))).otherwise(F.col(c))
    return routed.withColumns({"shown": name, "value": masked("value"), "raw_ocr_value": masked("raw_ocr_value")}).where(is_shown(F.col("doc_type"), F.col("shown")))


def _totals() -> list[Column]:
    checked = F.col("field_name").isin("uid", "pan_number")
    count = lambda c: F.sum(c.cast("int"))
    return [
        F.count("field_name").alias("n_fields"),
        count(F.col("was_corrected")).alias("correction_count"),
        count(F.col("status") == "escalate").alias("escalation_count"),
        count(F.col("status") != "accept").alias("flag_count"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("overall_confidence"),
        F.coalesce(F.every("is_valid"), F.lit(False)).alias("all_fields_valid"),
        F.max_by(F.when(checked, F.col("is_valid")), F.when(checked, F.col("ord"))).alias("checksum_passed"),
    ]


def rollup(routed: DataFrame) -> DataFrame:
    """Counts, mean confidence and validity of each document. The checksum is that of its last uid or pan_number, null without one."""
    return routed.groupBy("id", "doc_type").agg(*_totals())


def flags(routed: DataFrame) -> DataFrame:
    """A row for each field that wasn't accepted."""
    return routed.where("status in ('flag', 'escalate')").select("id", "field_name", "flag_reason", "raw_ocr_value", F.col("value").alias("corrected_value"), "confidence")


def responses(routed: DataFrame) -> DataFrame:
    """One nested row for each document, from one aggregate over its fields; without any shown field, fields is null."""
    name, hide = shown_name(F.col("field_name")), F.lower(shown_name(F.col("field_name"))).contains("uid")
    masked = lambda c: F.when(hide, mask_uid(F.col(c))).otherwise(F.col(c)).alias(c)
    value = F.struct(masked("value"), "confidence", "status", "flag_reason", masked("raw_ocr_value"), "was_corrected")
    shown = F.when(is_shown(F.col("doc_type"), name), F.struct(name.alias("shown"), value.alias("v")))
    problem = F.when(F.col("status") != "accept", F.struct("ord", "field_name", "flag_reason", "confidence"))
    own = routed.groupBy("id", "doc_type").agg(
        *_totals(),
        F.transform(F.array_sort(F.collect_list(problem)), lambda p: p.dropFields("ord")).alias("flags"),
        F.map_from_entries(F.collect_list(F.struct("field_name", F.struct("is_valid", "error_message").alias("v")))).alias("per_field"),
        F.array_sort(F.collect_list(shown)).alias("_shown"),
    )
    return own.withColumn("fields", F.when(F.size("_shown") > 0, F.map_from_entries("_shown"))).drop("_shown")
