import datetime
import itertools

from pyspark.sql import functions as F

from scriptorium.operators import response, routing
from scriptorium.plans.fields import routed_fields, text_layer_fields


def plain(method, name, conf, changed, valid, deps, tall, again):
    """status, reason, attempts, whether the second reading counts."""
    if method == "text_layer":
        return ("accept", None, 1, False) if valid else ("flag", "validation_failed_text_layer", 1, False)
    if changed and valid and (name in ("uid", "aadhaar_number", "pan_number") or conf >= 0.7):
        return "accept", None, 1, False
    if conf >= 0.92:
        return ("accept", None, 1, False) if valid else ("escalate", "high_conf_validation_fail", 1, False)
    if not deps:
        return "flag", "missing_retry_deps", 1, False
    if conf >= 0.7:
        if valid:
            return "accept", None, 1, False
        if tall and again:
            return "accept", None, 2, True
        return "escalate", "medium_conf_validation_fail", 2 if tall else 1, False
    return ("accept", None, 2, True) if again else ("flag", "low_conf_validation_fail", 2, True)


def test_truth_table(spark):
    flags = (True, False)
    cases = list(itertools.product(("text_layer", "ocr"), ("uid", "name"), (0.5, 0.7, 0.85, 0.92, 0.95), flags, flags, flags, flags, flags))
    rows = [(k, m, n, c, ch, v, d, t, a) for k, (m, n, c, ch, v, d, t, a) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "k int, method string, field_name string, conf double, was_changed boolean, is_valid boolean, has_deps boolean, tall boolean, retry_valid boolean")
    frame = frame.selectExpr("*", "'raw' as raw", "'fixed' as corrected", "'again' as retry_raw", "0.33D as retry_conf", "'refixed' as retry_corrected", "true as retry_changed")
    got = {r.k: r for r in routing.route(frame).collect()}
    for k, case in enumerate(cases):
        status, reason, attempts, second = plain(*case)
        r = got[k]
        assert (r.status, r.flag_reason, r.attempts) == (status, reason, attempts), case
        assert (r.value, r.raw_ocr_value) == (("refixed", "again") if second else ("fixed", "raw"))
        assert r.confidence == (1.0 if case[0] == "text_layer" else 0.33 if second else case[2])
        assert r.extraction_method == case[0]


def test_routed_fields_correct_and_validate_again(spark):
    rows = [("a", 1, "pan_number", "ABCPE123OF", 0.2, True, True, "x", 0.1), ("a", 2, "pincode", "11", 0.8, True, True, "11O001", 0.6), ("a", 3, "pincode", "11", 0.5, True, True, "zz", 0.9)]
    frame = spark.createDataFrame(rows, "id string, ord int, field_name string, raw string, conf double, has_deps boolean, tall boolean, retry_raw string, retry_conf double")
    got = {r.ord: (r.value, r.status, r.flag_reason, r.confidence, r.attempts, r.is_valid) for r in routed_fields(frame, datetime.date(2024, 6, 1)).collect()}
    assert got[1] == ("ABCPE1230F", "accept", None, 0.2, 1, True)
    assert got[2] == ("110001", "accept", None, 0.6, 2, False)
    assert got[3] == ("zz", "flag", "low_conf_validation_fail", 0.9, 2, False)


def test_text_path(spark):
    cv = "Ann Example\nSenior Engineer in a small team\nmail ann@example.com and more words\nSkills\nSQL, Spark | Python\nExperience\nJan 2015 - Mar 2019 at a place\nEducation\nBSc of something good"
    docs = spark.createDataFrame([("1", cv), ("2", "too short")], "id string, text string")
    got = {r.field_name: (r.value, r.status, r.confidence, r.flag_reason) for r in text_layer_fields(docs, datetime.date(2024, 6, 1)).collect()}
    assert got["email"] == ("ann@example.com", "accept", 1.0, None) and got["skills"][0] == "SQL, Spark, Python"
    assert got["phone"] == ("", "flag", 1.0, "validation_failed_text_layer") and len(got) == 8


DECISIONS = "id string, doc_type string, ord int, field_name string, value string, confidence double, status string, flag_reason string, raw_ocr_value string, was_corrected boolean, is_valid boolean, error_message string"


def test_responses(spark):
    rows = [
        ("d1", "aadhaar", 1, "aadhaar_number", "123456789012", 0.9, "accept", None, "1234 5678 9012", True, True, ""),
        ("d1", "aadhaar", 2, "uidai_banner", "x", 0.5, "flag", "why", "x", False, False, "bad"),
        ("d2", "pan", 1, "pan_number", "ABCPE1234F", 0.8, "escalate", "hm", "ABCPE1234F", False, False, "bad"),
        ("d2", "pan", 2, "fathers_name", "y", 0.6, "accept", None, "y", False, True, ""),
        ("d3", "other", 1, "uid", "123", 1.0, "accept", None, "123", False, True, ""),
    ]
    frame = spark.createDataFrame(rows, DECISIONS)
    got = {r.id: r for r in response.responses(frame).collect()}
    assert got["d1"].fields["uid"].value == "XXXX XXXX 9012" == got["d1"].fields["uid"].raw_ocr_value
    assert set(got["d1"].fields) == {"uid"} and set(got["d2"].fields) == {"pan_number"} and got["d3"].fields["uid"].value == "123"
    assert (got["d1"].correction_count, got["d1"].escalation_count, got["d1"].all_fields_valid, got["d1"].checksum_passed) == (1, 0, False, None)
    assert (got["d2"].escalation_count, got["d2"].checksum_passed, got["d2"].flags[0].flag_reason) == (1, False, "hm")
    assert got["d3"].checksum_passed and got["d3"].all_fields_valid and got["d3"].flags == []
    assert got["d1"].per_field["uidai_banner"].error_message == "bad"
    assert response.flags(frame).count() == 2 and routing.problems(frame).where(F.col("status") == "accept").count() == 0
