"""From fields or documents to routed fields and responses: correct, validate, route, assemble."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.correct import correct_all, correct_field
from scriptorium.functions.validate import validate_all
from scriptorium.operators import documents, extract
from scriptorium.operators.routing import route


def routed_fields(fields: DataFrame, today: datetime.date, ifsc: DataFrame | None = None, pins: DataFrame | None = None) -> DataFrame:
    """Recognised fields (field_name, raw, conf, has_deps, tall, retry_raw, retry_conf) to decisions.

    Only look-ups in master tables join; everything else is a projection. A second reading is
    corrected and validated like the first.
    """
    first = validate_all(correct_all(fields), today, ifsc, pins)
    # what reads the same is corrected the same
    same = F.col("retry_raw") == F.col("raw")
    again = first.withColumns({"retry_corrected": F.when(same, F.col("corrected")).otherwise(correct_field(F.col("field_name"), F.col("retry_raw")))})
    again = again.withColumn("retry_changed", F.col("retry_corrected") != F.col("retry_raw"))
    again = validate_all(again.withColumnsRenamed({"is_valid": "_valid", "error_message": "_error"}), today, ifsc, pins, value="retry_corrected")
    named = again.withColumnsRenamed({"is_valid": "retry_valid", "_valid": "is_valid"}).drop("error_message").withColumnRenamed("_error", "error_message")
    return route(named.withColumn("method", F.lit("ocr"))).drop("change_description")


def text_layer_fields(docs: DataFrame, today: datetime.date, ifsc: DataFrame | None = None, pins: DataFrame | None = None) -> DataFrame:
    """Documents (id, text) that take the text path to decisions: typed, extracted, validated, not corrected."""
    routed = documents.text_route(docs).where("route = 'text'").select("id", "text")
    found = extract.extract(routed.withColumn("doc_type", documents.text_type(F.col("text"))))
    checked = validate_all(found, today, ifsc, pins, value="value")
    ready = checked.select(
        "id", "doc_type", "ord", "field_name", "is_valid", "error_message", F.col("value").alias("raw"), F.col("value").alias("corrected"), F.lit(1.0).alias("conf"),
        F.lit(False).alias("was_changed"), F.lit("text_layer").alias("method"), F.lit(False).alias("has_deps"), F.lit(False).alias("tall"),
        F.lit(None).cast("string").alias("retry_raw"), F.lit(None).cast("double").alias("retry_conf"), F.lit(None).cast("string").alias("retry_corrected"),
        F.lit(None).cast("boolean").alias("retry_changed"), F.lit(None).cast("boolean").alias("retry_valid"),
    )
    return route(ready)
