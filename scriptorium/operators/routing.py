"""The decision for each field: accept, escalate or flag, by confidence, validity and correction.

Input columns: field_name, raw, conf, corrected, was_changed, is_valid, method (text_layer or
ocr), has_deps (whether a crop and an engine are at hand), tall (whether the crop is more than
15 pixels both ways). A second reading, where there was one: retry_raw, retry_conf,
retry_corrected, retry_changed, retry_valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH, LOW = 0.92, 0.70
#: Fields whose valid correction is accepted at any confidence.
STRONG = ("uid", "aadhaar_number", "pan_number")
_FIRST, _AGAIN = ("corrected", "conf", "raw", "was_changed"), ("retry_corrected", "retry_conf", "retry_raw", "retry_changed")


def _decision(status: str, reason: str | None = None, attempts: int | Column = 1, again: bool = False, method: str = "ocr") -> Column:
    value, conf, raw, changed = _AGAIN if again else _FIRST
    return F.struct(
        F.col(value).alias("value"),
        (F.lit(1.0) if method == "text_layer" else F.col(conf)).alias("confidence"),
        F.lit(status).alias("status"),
        F.lit(reason).cast("string").alias("flag_reason"),
        F.col(raw).alias("raw_ocr_value"),
        F.col(value).alias("corrected_value"),
        F.col(changed).alias("was_corrected"),
        (attempts if isinstance(attempts, Column) else F.lit(attempts)).cast("int").alias("attempts"),
        F.lit(method).alias("extraction_method"),
    )


def decide(high: float = HIGH, low: float = LOW) -> Column:
    """The first rule that fits. Without a crop and an engine, medium confidence is flagged even if the value is valid."""
    valid, again, conf = F.col("is_valid"), F.coalesce(F.col("retry_valid"), F.lit(False)), F.col("conf")
    tries = F.when(F.col("tall"), 2).otherwise(1)
    return (
        F.when((F.col("method") == "text_layer") & valid, _decision("accept", method="text_layer"))
        .when(F.col("method") == "text_layer", _decision("flag", "validation_failed_text_layer", method="text_layer"))
        .when(F.col("was_changed") & valid & (F.col("field_name").isin(*STRONG) | (conf >= low)), _decision("accept"))
        .when((conf >= high) & valid, _decision("accept"))
        .when(conf >= high, _decision("escalate", "high_conf_validation_fail"))
        .when(~F.col("has_deps"), _decision("flag", "missing_retry_deps"))
        .when((conf >= low) & valid, _decision("accept"))
        .when((conf >= low) & F.col("tall") & again, _decision("accept", attempts=2, again=True))
        .when(conf >= low, _decision("escalate", "medium_conf_validation_fail", tries))
        .when(again, _decision("accept", attempts=2, again=True))
        .otherwise(_decision("flag", "low_conf_validation_fail", 2, again=True))
    )


def route(fields: DataFrame, high: float = HIGH, low: float = LOW) -> DataFrame:
    """Add the columns of the decision; the input's other columns stay, but for those of the second reading."""
    kept = [c for c in fields.columns if c not in {*_FIRST, *_AGAIN, "retry_valid", "method", "has_deps", "tall"}]
    return fields.withColumn("_d", decide(high, low)).select(*kept, "_d.*")


def problems(decisions: DataFrame) -> DataFrame:
    """Decisions that aren't accepted, as the log has them."""
    return decisions.where("status <> 'accept'")
