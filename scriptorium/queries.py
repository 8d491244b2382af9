"""Queries over the driver's tables by name: (spark, sf_dir) -> DataFrame.

Cards have no table of their own: most queries run over values that ``plans.fixtures`` derives
from customers, parts and orders by formula. ``TODAY`` and ``NOW`` are fixed, so that results repeat.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import correct, validate
from scriptorium.functions.checksum import is_checked
from scriptorium.functions.distance import cer, wer
from scriptorium.functions.text import mask_uid
from scriptorium.operators import documents, extract, imaging, metrics, pixels, response, routing, similarity, spatial
from scriptorium.plans import evaluation, fixtures
from scriptorium.plans.fields import routed_fields, text_layer_fields
from scriptorium.plans.fixtures import read
from scriptorium.sources import documents as sources
from scriptorium.sources import files, records
from scriptorium.streaming import feedback

TODAY = datetime.date(2024, 6, 1)
NOW = datetime.datetime(2024, 1, 20)
# Boxes of two templates, as field: x1, y1, x2, y2; and where the first one's header belongs.
BOXES = {
    "aadhaar_v3": {
        "name": (310, 120, 850, 180), "dob": (310, 180, 700, 235), "gender": (310, 235, 600, 290), "aadhaar_number": (250, 450, 850, 540),
        "address_line1": (310, 300, 950, 340), "address_line2": (310, 340, 950, 380), "address_city": (310, 380, 600, 420),
        "address_state": (610, 380, 950, 420), "address_pincode": (310, 420, 500, 460), "vid": (250, 540, 850, 580), "issuer_text": (0, 580, 1012, 638),
    },
    "pan_v2": {
        "name": (98, 118, 775, 170), "fathers_name": (98, 182, 775, 232), "dob": (98, 245, 355, 293), "pan_number": (98, 315, 495, 368),
        "signature_box": (98, 382, 415, 492), "photo_box": (770, 102, 965, 492), "govt_stamp": (0, 512, 1012, 638),
    },
}
ANCHOR, ANCHOR_Y = "Government of India", 50

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def boxes(spark: SparkSession, version: str) -> DataFrame:
    return spark.createDataFrame([(f, *b) for f, b in BOXES[version].items()], "field_name string, x1 int, y1 int, x2 int, y2 int")


def only(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    return fixtures.fields_long(spark, sf_dir).where(F.col("field_name") == field)


def corrected_only(field: str, rule: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: only(spark, sf_dir, field).select("k", "raw", rule(F.col("raw")).alias("corrected"))


# -- correction ---------------------------------------------------------------------------------

QUERIES["uid_correct"] = corrected_only("uid", correct.correct_uid)
QUERIES["pan_correct"] = corrected_only("pan_number", correct.correct_pan)
QUERIES["pincode_correct"] = corrected_only("pincode", correct.correct_pincode)


@query
def date_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders with other separators, letters for digits and days out of range."""
    k = F.col("o_orderkey")
    plain = F.date_format("o_orderdate", "dd/MM/yyyy")
    raw = (
        F.when(k % 5 == 0, F.translate(plain, "/", "-")).when(k % 5 == 1, F.translate(plain, "/01", ".OI"))
        .when(k % 5 == 2, F.concat(F.lit("4"), F.substring(plain, 2, 9))).when(k % 5 == 3, F.concat(F.lit("on "), plain, F.lit(" x"))).otherwise(F.concat(F.lit("d"), F.right(plain, F.lit(4)), F.lit("/")))
    )
    return read(spark, sf_dir, "orders").select(k.alias("k"), raw.alias("raw")).withColumn("corrected", correct.correct_date(F.col("raw")))


@query
def name_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.upper("p_name")).when(k % 3 == 1, F.concat(F.lit(" 0"), F.replace("p_name", F.lit(" "), F.lit("  1 ")), F.lit(". "))).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select(k.alias("k"), raw.alias("raw")).withColumn("corrected", correct.correct_name(F.col("raw")))


@query
def field_correct_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = fixtures.fields_long(spark, sf_dir).select("id", "ord", "field_name", "raw")
    return correct.correct_all(fields).select("id", "ord", "corrected", "was_changed", "change_description")


@query
def substitution_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits and letters by substitution, and masking, of every uid."""
    from scriptorium.functions.text import digits_for_letters, letters_for_digits

    raw = F.col("raw")
    return only(spark, sf_dir, "uid").select("k", digits_for_letters(raw).alias("digits"), letters_for_digits(raw).alias("letters"), mask_uid(F.col("gt")).alias("masked"), mask_uid(raw).alias("masked_raw"))


# -- validation ---------------------------------------------------------------------------------


@query
def uid_checksum_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as made, and with one digit changed."""
    made = fixtures.customers(spark, sf_dir).withColumn("uid", fixtures.uid(F.col("k")))
    digit = F.substring("uid", 6, 1).cast("int")
    spoiled = F.concat(F.substring("uid", 1, 5), ((digit + 1 + F.col("k") % 9) % 10).cast("string"), F.substring("uid", 7, 8))
    plain = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return made.select("k", "uid", is_checked(plain(F.col("uid"))).alias("good"), is_checked(plain(spoiled)).alias("spoiled_good"), validate.uid_error(F.when(F.col("k") % 2 == 0, F.col("uid")).otherwise(F.lower(fixtures.damaged(F.col("uid"), F.col("k"))))).alias("error"))


@query
def pan_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(spark, sf_dir, "pan_number").select("k", "raw", validate.pan_error(F.col("raw")).alias("error"), (validate.pan_error(F.col("gt")) == "").alias("gt_valid"))


@query
def ifsc_validate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*map(F.lit, (*fixtures.IFSC_CODES, "ABCD0999999", " hdfc0000009", "HDFCO123456")))
    own = read(spark, sf_dir, "supplier").select("s_suppkey", F.get(codes, (F.col("s_suppkey") % 7).cast("int")).alias("corrected"), F.lit("ifsc").alias("field_name"))
    out = validate.validate_all(own, TODAY, ifsc=fixtures.master(spark, fixtures.IFSC_CODES))
    return out.select("s_suppkey", F.col("corrected").alias("ifsc"), "is_valid", "error_message")


@query
def pincode_validate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = only(spark, sf_dir, "pincode").withColumn("corrected", F.col("raw"))
    return validate.validate_all(own, TODAY, pins=fixtures.master(spark, fixtures.PIN_CODES)).select("k", "raw", "is_valid", "error_message")


@query
def date_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders moved by centuries, spoiled days and bare years."""
    k = F.col("o_orderkey")
    plain = F.date_format("o_orderdate", "dd/MM/yyyy")
    year = F.date_format("o_orderdate", "yyyy").cast("int")
    value = (
        F.when(k % 8 == 0, plain).when(k % 8 == 1, F.concat(F.lit("31/04/"), year.cast("string"))).when(k % 8 == 2, F.concat(F.left(plain, F.lit(6)), (year + 30).cast("string")))
        .when(k % 8 == 3, F.concat(F.left(plain, F.lit(6)), (year - 100).cast("string"))).when(k % 8 == 4, (year - k % 150).cast("string")).when(k % 8 == 5, F.concat(F.lit(" 29/02/"), year.cast("string")))
        .when(k % 8 == 6, F.concat(F.lit("01/06/"), (1900 + k % 8 + k % 30).cast("string"))).otherwise(F.translate(plain, "/", "-"))
    )
    return read(spark, sf_dir, "orders").select(k.alias("k"), value.alias("value")).withColumn("error", validate.date_error(F.col("value"), TODAY))


@query
def email_phone_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the extractors find in documents, held against the validators."""
    text = F.col("text")
    out = read(spark, sf_dir, "documents").select("doc_id", extract.found(text, extract.EMAIL).alias("email"), extract.found(text, extract.PHONE).alias("phone"))
    return out.where("email <> '' or phone <> ''").select("doc_id", (validate.email_error(F.col("email")) == "").alias("email_valid"), (validate.phone_error(F.col("phone")) == "").alias("phone_valid"))


@query
def field_validate_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixtures.fields_long(spark, sf_dir).withColumn("corrected", F.when(F.col("k") % 19 == 0, "").otherwise(F.col("raw")))
    out = validate.validate_all(own, TODAY, fixtures.master(spark, fixtures.IFSC_CODES), fixtures.master(spark, fixtures.PIN_CODES))
    return out.select("id", "ord", "is_valid", "error_message")


# -- accuracy -----------------------------------------------------------------------------------


@query
def cer_per_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.fields_long(spark, sf_dir).select("id", "ord", F.round(cer(F.col("raw"), F.col("gt")), 6).alias("cer"))


@query
def wer_per_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against those with words swapped, lost or added."""
    k, name = F.col("p_partkey"), F.col("p_name")
    words = F.split(name, " ")
    other = F.when(k % 4 == 0, F.concat_ws(" ", F.reverse(words))).when(k % 4 == 1, F.get(words, F.lit(0))).when(k % 4 == 2, F.concat(name, F.lit(" "), F.get(words, F.lit(0)))).otherwise(F.lit(""))
    return read(spark, sf_dir, "part").select(k.alias("k"), F.round(wer(other, name), 6).alias("wer"))


def _truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    fields = fixtures.fields_long(spark, sf_dir)
    return fixtures.truth(fields), fixtures.predictions(fields)


@query
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.field_accuracy(*_truth(spark, sf_dir))
    return out.select("id", "ord", "field_name", "exact_match", F.round("cer", 6).alias("cer"), F.round("wer", 6).alias("wer"), "pred", "gt", "missing")


def _summary(accuracy: DataFrame) -> DataFrame:
    out = metrics.accuracy_summary(accuracy)
    return out.select("field_name", "n", *(F.round(c, 6).alias(c) for c in ("exact_match_rate", "mean_cer", "mean_wer", "missing_rate")), metrics.band(F.col("exact_match_rate")).alias("band"))


@query
def field_accuracy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: accuracy of corrected fields by field name."""
    true, found = _truth(spark, sf_dir)
    fixed = found.withColumn("value", correct.correct_field(F.col("field_name"), F.col("value")))
    return _summary(metrics.field_accuracy(true, fixed))


@query
def field_accuracy_raw_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(metrics.field_accuracy(*_truth(spark, sf_dir)))


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    true, found = _truth(spark, sf_dir)
    return metrics.correction_delta(true, found, found.withColumn("value", correct.correct_field(F.col("field_name"), F.col("value"))))


@query
def correction_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta(spark, sf_dir)


def _gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.correction_summary(_delta(spark, sf_dir))


@query
def correction_delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _gain(spark, sf_dir)
    return out.withColumn("arrow", metrics.arrow(F.col("exact_delta")))


@query
def correction_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields as they were read right, of which some names hold a number that the rule for names takes out."""
    numbered = F.when((F.col("field_name") == "name") & (F.col("k") % 3 == 0), F.concat("gt", F.lit(" "), (F.col("k") % 10).cast("string"))).otherwise(F.col("gt"))
    fields = fixtures.fields_long(spark, sf_dir).withColumn("gt", numbered)
    true = fixtures.truth(fields)
    after = true.withColumn("value", correct.correct_field(F.col("field_name"), F.col("value")))
    return metrics.regressions(metrics.correction_summary(metrics.correction_delta(true, true, after))).select("field_name", "degraded_rate")


@query
def global_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.global_rates(*_truth(spark, sf_dir))


@query
def confusion_pairs_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.aligned_pairs(fixtures.fields_long(spark, sf_dir))


@query
def confusion_pairs_editops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.edit_pairs(fixtures.fields_long(spark, sf_dir))


@query
def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's table: the 20 most frequent ones, with bars."""
    return metrics.bars(metrics.top_pairs(metrics.aligned_pairs(fixtures.fields_long(spark, sf_dir)), 20))


@query
def eval_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    true, found = _truth(spark, sf_dir)
    return true.select("id").distinct().join(found.select("id").distinct(), "id", "left_semi")


@query
def eval_unmatched_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    true, found = _truth(spark, sf_dir)
    return metrics.unmatched(found, true)


@query
def eval_unmatched_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.unmatched(*_truth(spark, sf_dir))


@query
def dedupe_last_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, as of records with one id."""
    return records.last_by_id(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


# -- routing and responses ------------------------------------------------------------------------


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, odd = F.col("k"), F.col("k") % 2 == 1
    fields = fixtures.fields_long(spark, sf_dir).where("present").select(
        "k", "id", "ord", "field_name", "raw", "conf", (k % 9 != 0).alias("has_deps"), (k % 7 != 0).alias("tall"),
        F.when(odd, F.col("raw")).otherwise(F.col("gt")).alias("retry_raw"), (17 * k % 100 / 100).alias("retry_conf"), F.when(k % 3 == 0, "aadhaar").when(k % 3 == 1, "pan").otherwise("other").alias("doc_type"),
    )
    return routed_fields(fields, TODAY, pins=fixtures.master(spark, fixtures.PIN_CODES))


@query
def route_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("id", "ord", "value", "confidence", "status", "flag_reason", "raw_ocr_value", "was_corrected", "attempts")


@query
def routing_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems by reason and field."""
    return routing.problems(_routed(spark, sf_dir)).groupBy("status", "flag_reason", "field_name").agg(F.count("id").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query
def response_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response.rollup(_routed(spark, sf_dir)).withColumn("overall_confidence", F.round("overall_confidence", 6))


@query
def response_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response.flags(_routed(spark, sf_dir))


@query
def response_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields as responses show them: renamed, masked, by the kind of document."""
    return response.shown_fields(_routed(spark, sf_dir)).select("id", "doc_type", "shown", "value", "raw_ocr_value", "status")


@query
def text_layer_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CVs by the text path, from the route to the decision."""
    out = text_layer_fields(fixtures.cv_texts(spark, sf_dir), TODAY)
    return out.select("id", "doc_type", "field_name", "value", "status", "flag_reason")


# -- documents ------------------------------------------------------------------------------------


@query
def pdf_text_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents.text_route(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "min_chars", "printable_ratio", "min_text_lines", F.round("score", 6).alias("score"), "route", "reason")


@query
def doc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of documents, pages and card texts."""
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    cards = fixtures.card_texts(spark, sf_dir).select(F.concat(F.lit("k"), F.col("k").cast("string")).alias("id"), "text")
    cvs = fixtures.cv_texts(spark, sf_dir).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("id"), "text")
    return reduce(DataFrame.union, (docs, pages, cards, cvs)).select("id", documents.text_type(F.col("text")).alias("doc_type"))


def _found_in(table: str, key: str, text: str, pattern: str, group: int = 0) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: read(spark, sf_dir, table).select(key, extract.found(F.col(text), pattern, group).alias("found"))


QUERIES["extract_email"] = _found_in("documents", "doc_id", "text", extract.EMAIL)
QUERIES["extract_phone"] = _found_in("documents", "doc_id", "text", extract.PHONE)
QUERIES["extract_phone_pages"] = _found_in("pages", "page_id", "html", extract.PHONE)


@query
def extract_uid_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in groups of four, of card texts."""
    return fixtures.card_texts(spark, sf_dir).select("k", extract.found(F.col("text"), extract.UID, 1).alias("found"))


@query
def extract_cv_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_cv(fixtures.cv_texts(spark, sf_dir)).select("id", *extract.CV_FIELDS, F.array_join("warnings", ";").alias("warnings"))


@query
def extract_card_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixtures.card_texts(spark, sf_dir).where("doc_type = 'aadhaar'")
    return extract.extract_first_card(own).select("k", *extract.CARD_FIELDS["aadhaar"])


@query
def extract_label_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixtures.card_texts(spark, sf_dir).where("doc_type = 'pan'")
    return extract.extract_second_card(own).select("k", *extract.CARD_FIELDS["pan"], F.array_join("warnings", ";").alias("warnings"))


@query
def first_pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as a document's pages."""
    pages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return documents.first_pages(pages).select("doc_id", "text", "page_count")


@query
def template_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 29 == 0, "x ABCPD1234F").when(k % 31 == 0, "1234 56789012").otherwise(F.col("p_name"))
    share = lambda a, m: (a * k % m) / 100
    found = documents.template(300 + 37 * k % 900, 300 + 53 * k % 700, text, share(7, 11), share(11, 23), share(13, 29), k % 3 == 0)
    return read(spark, sf_dir, "part").select(k.alias("k"), found.alias("t")).select("k", "t.*")


@query
def ingest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small byte strings of every kind, with a limit of 40 bytes."""
    k = F.col("p_partkey")
    heads = ("FFD8FFE0", "89504E470D0A1A0A", "255044462D", "FFD8", "424D", "2550")
    head = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (1 + k % 6).cast("int")))
    tail = F.when(k % 4 == 0, F.encode(F.lit("%%EOF"), "UTF-8")).when(k % 4 == 1, F.encode(F.lit("%%Eof\n"), "UTF-8")).otherwise(F.encode(F.lit(""), "UTF-8"))
    content = F.concat(head, F.encode("p_name", "UTF-8"), F.encode(F.repeat(F.lit("x"), (k % 40).cast("int")), "UTF-8"), tail)
    out = sources.checked(read(spark, sf_dir, "part").select(k.alias("k"), content.alias("content")), 40)
    return out.select("k", "mime", "reject_reason", F.octet_length("content").cast("long").alias("size"), F.lower(F.hex(F.substring("content", 1, 8))).alias("magic"))


# -- regions and vectors --------------------------------------------------------------------------


@query
def reading_order_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.reading_order(fixtures.regions(spark, sf_dir)).withColumn("confidence", F.round(F.col("confidence") + 1e-9, 6))


@query
def coord_field_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.assign_fields(fixtures.regions(spark, sf_dir), boxes(spark, "pan_v2"), imaging.CARD_W, imaging.CARD_H)
    return out.where("text <> ''").withColumn("confidence", F.round(F.col("confidence") + 1e-9, 6))


@query
def anchor_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of which some carry the header's words."""
    own = fixtures.regions(spark, sf_dir).withColumn("text", F.when((F.col("doc_id") + F.col("ord")) % 5 == 0, F.concat(F.lit("Govt of India "), F.col("text"))).otherwise(F.col("text")))
    return spatial.anchor_shift(own, ANCHOR, ANCHOR_Y)


@query
def registered_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields by boxes that move with the header where the number came out empty."""
    own = fixtures.regions(spark, sf_dir).withColumn("text", F.when((F.col("doc_id") + F.col("ord")) % 5 == 0, F.concat(F.lit("Govt of India "), F.col("text"))).otherwise(F.col("text")))
    out = spatial.registered_fields(own, boxes(spark, "aadhaar_v3"), imaging.CARD_W, imaging.CARD_H, ANCHOR, ANCHOR_Y)
    return out.where("text <> ''").withColumn("confidence", F.round(F.col("confidence") + 1e-9, 6))


def _anchors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = fixtures.regions(spark, sf_dir)
    return own, spatial.first_region(own, F.col("ord") >= 3_000_000_000)


@query
def nearest_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_above(*_anchors(spark, sf_dir))


@query
def nearest_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_two(*_anchors(spark, sf_dir))


@query
def region_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.hull(fixtures.regions(spark, sf_dir), imaging.CARD_W, imaging.CARD_H)


@query
def card_text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined card text with an address and a PIN, read as recognised text."""
    k = F.col("k")
    tail = F.concat(F.lit(" Address: 12 "), F.lit("Some Road "), F.when(k % 3 == 0, F.lit("1234567 ")).otherwise(""), fixtures.pincode(k))
    own = fixtures.card_texts(spark, sf_dir).where("doc_type = 'aadhaar'").withColumn("text", F.concat(F.translate("text", "\n", " "), tail))
    return spatial.card_fields(own).select("k", "aadhaar_number", "dob", "gender", "address", "pincode")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best admitted vector for every vector, other than itself."""
    own = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    stored = own.select(F.col("vec_id").alias("key"), F.col("vec_id").alias("ord"), "vector", ((F.col("vec_id") % 20 + 81) / 100).alias("confidence"))
    return similarity.best_match(own.select(F.col("vec_id").alias("query_id"), "vector"), similarity.admitted(stored), threshold=0.4, itself=False)


@query
def glyph_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("query_id", "key", F.round("similarity", 4).alias("similarity"), "hit")


@query
def glyph_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cache_stats(_matches(spark, sf_dir)).withColumn("hit_rate", F.round("hit_rate", 6))


# -- feedback -------------------------------------------------------------------------------------


@query
def feedback_pending_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", (F.col("user_id") % 2 == 0).alias("pushed"), (F.col("user_id") % 3 == 0).alias("corrected"))
    return feedback.pending_push(issues, NOW).select("id", "ts", "task_id")


@query
def feedback_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.element_at(F.array(*map(F.lit, feedback.STATES)), (1 + F.col("event_id") % 3).cast("int"))
    return feedback.latest_state(read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), states.alias("state")))


@query
def feedback_apply_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 2 == 0).alias("pushed"), (F.col("user_id") % 3 == 0).alias("corrected"))
    human = issues.where("id % 2 = 0").select("id", F.concat(F.col("id").cast("string"), F.lit("_FIXED")).alias("human_value"))
    return feedback.apply_corrections(issues, human)


@query
def suggested_subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixtures.fields_long(spark, sf_dir).select("raw", F.col("gt").alias("human"))
    return feedback.mined_rules(own)


@query
def annotation_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotation task for each order, with a box and a text for each line."""
    k = F.col("l_linenumber")
    own = F.concat_ws("-", k, "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    box = F.struct(
        own.alias("id"), F.lit("rectanglelabels").alias("type"),
        F.struct(F.when(k % 6 != 0, F.array(F.concat(F.lit("field"), (k % 4).cast("string")))).alias("rectanglelabels"), F.col("l_quantity").cast("double").alias("x"), F.lit(10.0).alias("y"), F.lit(20.0).alias("width"), F.lit(5.0).alias("height"), F.lit(None).cast("array<string>").alias("text")).alias("value"),
    )
    text = F.struct(
        own.alias("id"), F.lit("textarea").alias("type"),
        F.struct(F.lit(None).cast("array<string>").alias("rectanglelabels"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"), F.array("l_returnflag").alias("text")).alias("value"),
    )
    tasks = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.flatten(F.collect_list(F.array(box, text))).alias("r")).select(
        F.struct(F.concat(F.lit("/data/local-files/?d=cards/"), F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("image")).alias("data"),
        F.array(F.struct(F.col("r").alias("result"))).alias("annotations"),
    )
    out = records.flatten_annotations(tasks)
    return out.select("image_path", "field_name", F.round(F.get("bbox", F.lit(0)), 6).alias("x"), F.round(F.get("bbox", F.lit(3)), 6).alias("h"), "text_value", "extraction_method")


# -- images ---------------------------------------------------------------------------------------


@query
def corner_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    at = lambda a, m: (a * k % m).cast("double")
    points = F.array(F.array(100 + at(3, 50), 250 + at(7, 40)), F.array(400 + at(11, 60), 50 + at(5, 30)), F.array(100 + at(13, 70), 50 + at(17, 20)), F.array(400 + at(19, 90), 250 + at(23, 80)))
    own = read(spark, sf_dir, "part").select(k.alias("k"), imaging.ordered_corners(points).alias("c")).withColumn("s", imaging.warped_size(F.col("c")))
    return own.select("k", *(F.get(F.get("c", F.lit(i)), F.lit(j)).alias(f"{n}_{a}") for i, n in enumerate(("tl", "tr", "br", "bl")) for j, a in enumerate("xy")), F.col("s.width").alias("width"), F.col("s.height").alias("height"))


@query
def deskew_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as an image's segments."""
    line = F.col("l_linenumber")
    segments = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), (100 * (line % 3)).alias("x2"), (F.col("l_suppkey") % 5 - 2 + F.when(line == 4, 300).otherwise(0)).alias("y2"))
    return imaging.deskew_angles(segments).withColumn("angle", F.round("angle", 6))


@query
def letterbox_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    w, h = F.when(k % 50 == 0, 1012).otherwise(100 + 37 * k % 3000), F.when(k % 50 == 0, 638).otherwise(100 + 53 * k % 2000)
    return read(spark, sf_dir, "part").select(k.alias("k"), imaging.letterbox(w, h).alias("b")).select("k", "b.*")


@query
def image_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("k"), imaging.wants_contrast((k * 7 % 256).cast("double")).alias("contrast"), imaging.wants_glare_removal((k % 50) / 1000).alias("glare"))


@query
def augment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.augment_plan(read(spark, sf_dir, "documents"), "doc_id", 3).withColumn("applied", F.array_join("applied", ","))


@query
def synthetic_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made numbers, with the verdicts of their validators."""
    own = fixtures.customers(spark, sf_dir)
    k = F.col("k")
    return own.select("k", fixtures.uid(k).alias("uid"), fixtures.pan(k).alias("pan"), fixtures.birth_date(k).alias("dob"), (validate.uid_error(fixtures.uid(k)) == "").alias("uid_valid"), (validate.pan_error(fixtures.pan(k)) == "").alias("pan_valid"))


def _solid(h: int, w: int, *bgr: int) -> np.ndarray:
    return np.tile(np.array(bgr, np.uint8), (h, w, 1))


@query
def image_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNGs by formula through the guard, with the walk over their chunks."""
    own = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), fixtures.png(F.col("p_partkey")).alias("content"))
    return sources.checked(own).select("k", "mime", "reject_reason")


@query
def letterbox_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solid images of many sizes on the canonical card: the pixels of the image and of the frame around it."""

    def paint(k: int) -> np.ndarray:
        return _solid(20 + 53 * k % 200, 20 + 37 * k % 300, 10, 20, 30)

    def count(row, x: np.ndarray) -> tuple:
        out = pixels.letterboxed(x)
        return row.image_id, int((out == (10, 20, 30)).all(2).sum()), int((out == 255).all(2).sum())

    return pixels.each(fixtures.painted(read(spark, sf_dir, "supplier"), "s_suppkey", paint), "image_id bigint, inside bigint, frame bigint", count)


@query
def warped_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A light rectangle at a known place, cut out by its corners."""
    at = lambda k: (10 + k % 20, 15 + 3 * k % 30, 40 + 7 * k % 60, 30 + 5 * k % 40)  # noqa: E731  left, top, width, height

    def paint(k: int) -> np.ndarray:
        x, y, w, h = at(k)
        out = _solid(120, 140, 5, 5, 5)
        out[y : y + h + 1, x : x + w + 1] = (100, 150, 200)
        return out

    def cut(row, image: np.ndarray) -> tuple:
        x, y, w, h = at(int(row.image_id))
        out = pixels.warped(image, np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], np.float64))
        return row.image_id, out.shape[1], out.shape[0], bool((out == (100, 150, 200)).all())

    return pixels.each(fixtures.painted(read(spark, sf_dir, "supplier"), "s_suppkey", paint), "image_id bigint, width int, height int, whole boolean", cut)


@query
def found_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card on a table for each nation: whether its boundary is found, within 2 % of the picture's width. Every fifth picture has none."""

    def paint(k: int) -> np.ndarray:
        out = _solid(300, 480, 40, 45, 50)
        if k % 5:
            out[60 : 220 + k, 70 : 380 + k] = (220, 225, 230)
        return out

    def find(row, x: np.ndarray) -> tuple:
        k, corners = int(row.image_id), pixels.boundary(x)
        if corners is None:
            return k, False, False
        true = np.array([[70, 60], [379 + k, 60], [379 + k, 219 + k], [70, 219 + k]])
        return k, True, bool(np.abs(corners - true).max() <= 0.02 * x.shape[1])

    return pixels.each(fixtures.painted(read(spark, sf_dir, "nation"), "n_nationkey", paint), "image_id bigint, found boolean, near boolean", find)


@query
def clean_up_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat pictures of the canonical size, every other one with a bright patch: the steps that were taken, and whether the patch is gone."""

    def paint(k: int) -> np.ndarray:
        out = _solid(638, 1012, *[20 + 8 * k % 200] * 3)
        if k % 2:
            out[100:400, 200:600] = 255
        return out

    own = fixtures.painted(read(spark, sf_dir, "nation"), "n_nationkey", paint)
    out = pixels.cleaned(own, {"enable_perspective_warp": False})
    bright = lambda row, x: (row.image_id, ",".join(row.steps), bool(pixels.glare_mask(x).any()))
    return pixels.each(out, "image_id bigint, steps string, bright boolean", bright)


@query
def second_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops by formula: which ones are read again, how, and in what size."""
    k = F.col("image_id")
    own = fixtures.painted(read(spark, sf_dir, "supplier"), "s_suppkey", lambda k: _solid(10 + k % 12, 10 + k % 17, 50, 60, 70))
    crops = own.select(k.alias("id"), F.lit("uid").alias("field_name"), (31 * k % 100 / 100).alias("conf"), (k % 3 == 0).alias("is_valid"), "content", "h", "w")
    return pixels.second_views(crops).select("id", "view", "h", "w", F.octet_length("content").alias("size"))


@query
def sharpened_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One brighter pixel in a flat picture, sharpened as for a second reading."""

    def paint(k: int) -> np.ndarray:
        out = _solid(7, 9, *[50 + 7 * k % 150] * 3)
        out[3, 4] += 20
        return out

    def look(row, x: np.ndarray) -> tuple:
        out = imaging.sharpened(x)
        return row.image_id, int(out[3, 4, 0]), int(out[2, 4, 1]), int(out[0, 0, 2])

    return pixels.each(fixtures.painted(read(spark, sf_dir, "supplier"), "s_suppkey", paint), "image_id bigint, spot int, beside int, flat int", look)


@query
def template_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the colours that tell templates apart, of pictures with a band of one."""
    bands = ((255, 200, 150), (225, 245, 255), (255, 255, 255), (0, 0, 0))

    def paint(k: int) -> np.ndarray:
        out = _solid(40, 50, 0, 0, 0)
        out[: 1 + k % 40] = bands[k % 4]
        return out

    out = imaging.statistics(fixtures.painted(read(spark, sf_dir, "supplier"), "s_suppkey", paint))
    return out.select("image_id", *(F.round(c, 6).alias(c) for c in ("blue", "cream", "white", "mean_luminance")))


def _code_like(x: np.ndarray, left: int, top: int, module: int, seed: int) -> None:
    """Draw three position marks and a field of modules."""
    dots = np.random.default_rng(seed).integers(0, 2, (25, 25))
    for y, at in ((0, 0), (0, 18), (18, 0)):
        dots[max(0, y - 1) : y + 8, max(0, at - 1) : at + 8] = 0
        dots[y : y + 7, at : at + 7] = 1
        dots[y + 1 : y + 6, at + 1 : at + 6] = 0
        dots[y + 2 : y + 5, at + 2 : at + 5] = 1
    x[top : top + 25 * module, left : left + 25 * module] = (240 - 220 * dots.repeat(module, 0).repeat(module, 1))[..., None]


@query
def qr_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures with a code at the lower right, at the upper left, or with lines of text only."""

    def paint(k: int) -> np.ndarray:
        out = _solid(240, 400, 240, 240, 240)
        out[20:60:12, 20:180] = 20
        if k % 3 < 2:
            _code_like(out, *((290, 120) if k % 3 == 0 else (20, 70)), 3 + k % 2, k)
        return out

    return pixels.with_qr(fixtures.painted(read(spark, sf_dir, "nation"), "n_nationkey", paint))


@query
def glyph_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ramps across, down and along the diagonal, and flat pictures: how many entries a descriptor has, and in which direction."""

    def paint(k: int) -> np.ndarray:
        y, x = np.indices((32, 32))
        return np.repeat((40 + (x, y, x + y, 0 * x)[k % 4] * (1 + k % 3)).astype(np.uint8)[..., None], 3, 2)

    def look(row, x: np.ndarray) -> tuple:
        v = pixels.oriented_gradients(x).reshape(-1, 8)
        inner = v.reshape(7, 7, 4, 8)[3, 3].sum(0)  # a block away from the edges
        return row.image_id, v.size, int((v > 0).any(1).sum()), int(inner.argmax()) if inner.any() else None, round(float((inner**2).sum()), 6)

    return pixels.each(fixtures.painted(read(spark, sf_dir, "supplier"), "s_suppkey", paint), "image_id bigint, size int, lit int, way int, strength double", look)


@query
def augmented_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of each nation's picture and their log. Its seeds are numpy's, so SQL knows the plan and the sizes only."""
    own = fixtures.painted(read(spark, sf_dir, "nation"), "n_nationkey", lambda k: _solid(90, 130, 60 + k, 90 + k, 120 + k))
    plan = imaging.augment_plan(own, "image_id", 3)
    log = pixels.augmentation_log(plan, 0.5).select("file", F.array_join("augmentations_applied", ",").alias("logged"))
    made = pixels.varied(own, plan).withColumn("file", F.concat(F.lit("image_"), F.col("image_id").cast("string"), F.lit("_v"), F.col("variant").cast("string"), F.lit(".jpg")))
    return made.join(log, "file").select("image_id", "variant", F.array_join("applied", ",").alias("applied"), "logged", F.octet_length("content").alias("size"))


# -- files and streams ----------------------------------------------------------------------------


@query
def documents_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder as documents, with a limit of 60 bytes: kinds, reasons and leading bytes."""
    folder = files.scratch(spark, "documents")
    heads = ("%PDF-1.7 ", "plain text ", "%PDF-")
    for r in read(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():  # a file for each region: five
        files.write_file(spark, f"{folder}/{r.r_regionkey}.bin", heads[r.r_regionkey % 3] + r.r_name + "x" * (15 * r.r_regionkey) + "%%EOF")
    out = sources.checked(sources.read_documents(spark, folder, 60), 60)
    return out.select(F.regexp_extract("path", r"([0-9]+)\.bin$", 1).cast("int").alias("k"), F.col("length").alias("size"), "mime", "reject_reason", sources.described_magic(F.col("content")).alias("magic"))


@query
def records_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record lines with blank and broken ones between them: the last record of each id, and how many lines are broken."""
    k = F.col("c_custkey")
    body = F.concat(F.lit('{"id": "r'), (k % 40).cast("string"), F.lit('", "fields": {"n": "'), k.cast("string"), F.lit('"}}'))
    line = F.when(k % 7 == 0, F.lit("  ")).when(k % 11 == 0, F.lit("{broken")).when(k % 13 == 0, F.lit("[1]")).otherwise(body)
    path = files.scratch(spark, "records")
    read(spark, sf_dir, "customer").orderBy("c_custkey").coalesce(1).select(line.alias("value")).write.text(path)
    good, bad = records.read_records(spark, path)
    last = records.last_by_id(good).select("id", F.col("fields")["n"].alias("n"))
    return last.unionByName(bad.agg(F.lit("broken").alias("id"), F.count("line").cast("string").alias("n")))


@query
def coordinates_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of both templates by way of a coordinate file."""
    lines = [line for version, fields in BOXES.items() for line in (f"{version}:", *(f"  {f}: [{', '.join(map(str, b))}]  # px" for f, b in fields.items()), "  _anchors:")]
    path = files.write_file(spark, files.scratch(spark, "coordinates") + ".yaml", "\n".join(lines) + "\n")
    return records.read_coordinates(spark, path)


@query
def settings_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds and step settings by way of a settings file, merged with the defaults."""
    text = "confidence_high: 0.92   # accept\nconfidence_low:  0.70\nocr_lang: \"en\" # a name\npreprocess:\n  enable_deskew: false\n  clahe_tile_grid: [4, 4]\n  other: 1\n"
    found = files.read_settings(spark, files.write_file(spark, files.scratch(spark, "settings") + ".yaml", text))
    rows = {k: v for k, v in found.items() if not isinstance(v, dict)} | imaging.merged_config(found)
    return spark.createDataFrame([(k, str(v)) for k, v in rows.items()], "setting string, value string")


@query
def decisions_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that weren't accepted, by way of their log in JSON lines."""
    path = files.scratch(spark, "decisions")
    records.write_decisions(_routed(spark, sf_dir), path)
    log = spark.read.schema("field_name string, status string, flag_reason string, attempts int, extraction_method string").json(path)
    return log.groupBy("status", "flag_reason", "field_name").agg(F.count("status").alias("n"))


@query
def truth_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth of made-up cards, by way of record lines."""
    path = files.scratch(spark, "truth")
    records.write_truth(fixtures.fields_long(spark, sf_dir), path)
    found, _ = records.read_records(spark, path)
    return records.long_form(found.select("id", "fields")).select("id", "field_name", "value")


@query
def issues_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that arrive as files, streamed into the tables of issues: one for recognised fields, one for text layers."""
    base = files.scratch(spark, "stream")
    method = F.when(F.col("user_id") % 4 == 0, "text_layer").otherwise("ocr")
    status = F.element_at(F.array(F.lit("accept"), F.lit("flag"), F.lit("escalate")), (1 + F.col("event_id") % 3).cast("int"))
    own = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), status.alias("status"), method.alias("extraction_method"))
    own.repartition(3, "id").write.json(f"{base}/in")
    feedback.stream_issues(spark, f"{base}/in", "id bigint, ts timestamp_ntz, status string, extraction_method string", f"{base}/ocr", f"{base}/text", f"{base}/checkpoint").awaitTermination()
    table = lambda name: spark.read.parquet(f"{base}/{name}").withColumn("table", F.lit(name))
    return table("ocr").union(table("text")).groupBy("table", "status", "date").agg(F.count("id").alias("n"))


@query
def push_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the annotation tool is sent for each pending issue."""
    k = F.col("event_id")
    issues = read(spark, sf_dir, "events").select(
        k.alias("id"), "ts", (F.col("user_id") % 2 == 0).alias("pushed"), (F.col("user_id") % 3 == 0).alias("corrected"),
        F.concat(F.lit("crops/"), (k % 5).cast("string"), F.lit("/x.jpg")).alias("image_crop_path"), F.concat(F.lit("v"), k.cast("string")).alias("corrected_value"), F.col("event_type").alias("field_name"),
    )
    return feedback.pending_push(issues, NOW).select("id", "payload")


# -- compositions ---------------------------------------------------------------------------------


@query
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation run over records: only those with a truth and a prediction count."""
    fields = fixtures.fields_long(spark, sf_dir)
    as_record = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", c))))
    true = fields.groupBy("id").agg(F.min("k").alias("line_no"), as_record("gt").alias("fields"))
    found = fields.where("present").groupBy("id").agg(F.min("k").alias("line_no"), as_record("raw").alias("fields"), as_record("raw").alias("raw_fields"))
    out = evaluation.evaluate(found, true).summary
    return out.select("field_name", "n", *(F.round(c, 6).alias(c) for c in ("exact_match_rate", "mean_cer", "mean_wer", "missing_rate")))


@query
def card_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and date of the second kind of card, from its whole text."""
    return spatial.second_card_numbers(fixtures.card_texts(spark, sf_dir).where("doc_type = 'pan'")).select("k", "pan_number", "dob")


@query
def region_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions joined in the order of recognition, read as a CV: the first line is the name."""
    return extract.extract_cv(spatial.joined_text(fixtures.regions(spark, sf_dir)).withColumnRenamed("doc_id", "id")).select("id", "name", "email", "total_experience_years")


@query
def glyph_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caches that fill themselves, one for each fifth of the vectors. What is stored depends on what was found, so it has no SQL."""
    k = F.col("vec_id")
    reads = read(spark, sf_dir, "embeddings").select((k % 5).alias("session"), k.alias("ord"), F.col("embedding").alias("vector"), k.cast("string").alias("text"), ((k % 20 + 81) / 100).alias("confidence"))
    return similarity.cached_session(reads, least=10, threshold=0.4)
