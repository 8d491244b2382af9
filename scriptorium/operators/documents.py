"""Which path a document takes, what kind it is, and which template it has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import lines_of_words, printable_ratio, strip

CHARS, RATIO, LINES, WORDS = 100, 0.85, 3, 4


def text_route(docs: DataFrame, text: str = "text", is_pdf: Column | None = None, chars: int = CHARS, ratio: float = RATIO, least: int = LINES, words: int = WORDS) -> DataFrame:
    """Add the three checks, their score, the route and its reason. Whatever isn't a PDF is an image."""
    checks = {
        "min_chars": F.length(strip(F.col(text))) >= chars,
        "printable_ratio": printable_ratio(F.col(text)) >= ratio,
        "min_text_lines": lines_of_words(F.col(text), words) >= least,
    }
    pdf = F.lit(True) if is_pdf is None else is_pdf
    named = {c: F.coalesce(check, F.lit(False)) for c, check in checks.items()}
    out = docs.withColumns(named)
    passed = reduce(Column.__add__, (F.col(c).cast("int") for c in checks))
    failed = F.array_join(F.array_compact(F.array(*(F.when(~F.col(c), F.lit(f"'{c}'")) for c in checks))), ", ")
    return out.withColumns({
        "score": F.when(pdf, passed / 3).otherwise(0.0),
        "route": F.when(pdf & (passed == 3), "text").otherwise("image"),
        "reason": F.when(~pdf, "image_input").when(passed == 3, "all_checks_passed").otherwise(F.concat(F.lit("failed_checks: ["), failed, F.lit("]"))),
    })


def first_pages(pages: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, page, text), pages from 0: the text of the first ones with any, joined by line feeds, and the count of all."""
    kept = F.when((F.col("page") < most) & (F.col("text") != ""), F.struct("page", "text"))
    own = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(kept)).alias("kept"), F.count("page").alias("page_count"))
    return own.select("doc_id", F.array_join(F.transform("kept", lambda p: p["text"]), "\n").alias("text"), "page_count")


def text_type(text: Column) -> Column:
    """cv, pan, aadhaar or unknown, by keywords of a text layer."""
    low = F.lower(text)
    return (
        F.when(low.contains("experience") & (low.contains("skills") | low.contains("education")), "cv")
        .when(low.rlike("[a-z]{5}[0-9]{4}[a-z]") | low.contains("income tax department"), "pan")
        .when(low.contains("aadhaar") | low.contains("unique identification"), "aadhaar")
        .otherwise("unknown")
    )


def _template(kind: str, version: str, confidence: float, method: str) -> Column:
    return F.struct(F.lit(kind).alias("doc_type"), F.lit(version).alias("template_version"), F.lit(confidence).alias("confidence"), F.lit(method).alias("detection_method"))


def template(width: Column, height: Column, text: Column, blue: Column, cream: Column, white: Column, has_qr: Column) -> Column:
    """The first rule that fits: text, shape, colours. An A4 page of up to 0.78 counts as a portrait card, as that rule comes first."""
    aspect = width / F.greatest(height, F.lit(1))
    return (
        F.when(text.rlike("[A-Z]{5}[0-9]{4}[A-Z]"), _template("pan", "pan_v2", 0.99, "text_regex_pan"))
        .when(text.rlike(r"[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}"), _template("aadhaar", "aadhaar_v3", 0.99, "text_regex_aadhaar"))
        .when(F.abs(aspect - 0.63) < 0.15, _template("aadhaar", "aadhaar_v4", 0.9, "aspect_ratio_portrait"))
        .when(aspect.between(0.65, 0.85), _template("cv", "cv_standard", 0.8, "aspect_ratio_a4"))
        .when(~((aspect > 1.4) & (aspect < 1.7)), _template("unknown", "unknown", 0.0, "aspect_ratio_out_of_bounds"))
        .when((blue > 0.05) & has_qr, _template("aadhaar", "aadhaar_v2", 0.8, "hsv_blue_with_qr"))
        .when(blue > 0.05, _template("aadhaar", "aadhaar_v1", 0.7, "hsv_blue_no_qr"))
        .when(cream > 0.1, _template("pan", "pan_v1", 0.7, "hsv_cream"))
        .when((white > 0.1) & has_qr, _template("aadhaar", "aadhaar_v3", 0.8, "hsv_white_with_qr"))
        .when(white > 0.1, _template("pan", "pan_v2", 0.7, "hsv_white_no_qr"))
        .otherwise(_template("aadhaar", "aadhaar_v3", 0.2, "absolute_fallback_guess"))
    )
