import math
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import similarity, spatial

REGION = "doc_id int, ord int, bbox array<array<int>>, text string, confidence double"


def box(x, y, w=100, h=20):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


def regions(spark, *rows):
    return spark.createDataFrame([(d, k, box(x, y), t, c) for k, (d, x, y, t, c) in enumerate(rows)], REGION)


def test_reading_order(spark):
    frame = regions(spark, (1, 0, 50, "DOE", 0.8), (1, 0, 10, "JOHN", 0.9), (2, 200, 10, "b", 0.5), (2, 0, 10, "a", 0.7), (3, 0, 0, "", 0.9))
    got = {r.doc_id: (r.text, round(r.confidence, 3)) for r in spatial.reading_order(frame).collect()}
    assert got == {1: ("JOHN DOE", 0.857), 2: ("a b", 0.6), 3: ("", 0.0)}
    assert {r.doc_id: r.text for r in spatial.joined_text(frame).collect()} == {1: "DOE JOHN", 2: "b a", 3: ""}


BOXES = "field_name string, x1 int, y1 int, x2 int, y2 int"


def test_assignment_and_registration(spark):
    boxes = spark.createDataFrame([("name", 0, 100, 300, 130), ("aadhaar_number", 0, 200, 300, 230), ("none", 5, 5, 5, 9), ("wide", -50, 590, 9999, 9999)], BOXES)
    frame = regions(spark, (1, 0, 105, "ANN", 0.9), (1, 0, 205, "1234", 0.8), (1, 900, 600, "foot", 0.7), (2, 0, 70, "Govt of India", 0.9), (2, 0, 145, "BOB", 0.6), (2, 0, 245, "9999", 0.5), (3, 0, 145, "lost", 0.5))
    got = {(r.doc_id, r.field_name): r.text for r in spatial.assign_fields(frame, boxes, 1012, 638).collect()}
    assert len(got) == 12 and {k: v for k, v in got.items() if v} == {(1, "name"): "ANN", (1, "aadhaar_number"): "1234", (1, "wide"): "foot"}
    assert {r.doc_id: r.dy for r in spatial.anchor_shift(frame, "Government of India", 40).collect()} == {2: 40}
    got = {(r.doc_id, r.field_name): (r.text, r.confidence) for r in spatial.registered_fields(frame, boxes, 1012, 638, "Government of India", 40).collect()}
    assert got[2, "name"] == ("BOB", 0.6) and got[2, "aadhaar_number"] == ("9999", 0.5) and got[1, "name"] == ("ANN", 0.9) and got[3, "name"] == ("", 0.0)


def test_nearest(spark):
    frame = regions(spark, (1, 0, 10, "GOVERNMENT OF INDIA", 1.0), (1, 0, 60, "FIRST", 1.0), (1, 90, 60, "SECOND", 1.0), (1, 0, 95, "too close", 1.0), (1, 0, 100, "DOB 01/01/1990", 1.0), (1, 0, 130, "below", 1.0))
    dob = spatial.first_region(frame, F.col("text").contains("DOB"))
    assert spatial.nearest_above(frame, dob).first().name == "FIRST"  # of two as near the first one
    card = regions(
        spark, (1, 0, 0, "INCOME TAX", 1.0), (1, 0, 40, "Name", 1.0), (1, 0, 60, "Name: ANN EXAMPLE", 1.0), (1, 0, 100, "f Father Name", 1.0), (1, 0, 120, "BOB EXAMPLE", 1.0), (1, 0, 160, "15/08/1990", 1.0), (1, 0, 170, "ABCPE1234F", 1.0), (1, 0, 150, "ab", 1.0)
    )
    anchors = spatial.first_region(card, F.col("text").contains("1990")).selectExpr("*", "'ABCPE1234F' as pan", "'15/08/1990' as dob")
    row = spatial.nearest_two(card, anchors).first()
    assert (row.father_name, row.name) == ("BOB EXAMPLE", "ANN EXAMPLE")


def test_card_text(spark):
    texts = [
        ("x 1234 5678 9012 Year of Birth : 1990 F e m a l e Address: 1 Road 1234567, Town 560001 end", "123456789012", "1990", "Female", "1 Road 1234567, Town 560001", "560001"),
        ("D0B 01-02-1990 MALE", "", "01-02-1990", "Male", "", ""),
        ("", "", "", "", "", ""),
    ]
    frame = spark.createDataFrame([(t[0],) for t in texts], "text string")
    got = {r.text: tuple(r)[1:] for r in spatial.card_fields(frame).collect()}
    assert got == {t[0]: t[1:] for t in texts}
    r = spatial.second_card_numbers(spark.createDataFrame([("a abcpe12O4f 15-08-1990",)], "text string")).first()
    assert (r.pan_number, r.dob) == ("ABCPE12O4F", "15-08-1990")


def test_hull(spark):
    r = spatial.hull(regions(spark, (1, 2, 3, "a", 1.0), (1, 950, 600, "b", 1.0)), 1012, 638).first()
    assert tuple(r)[1:] == (0, 0, 1012, 625)


def test_best_match_against_python(spark):
    rng = random.Random(2)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(5)]
    stored = [(f"k{k}", vec(), 0.95 if k % 2 else 0.94, k) for k in range(120)] + [("zero", [0.0] * 5, 1.0, 200)]
    queries = [(k, vec()) for k in range(30)] + [(99, [0.0] * 5)]
    known = similarity.admitted(spark.createDataFrame(stored, "key string, vector array<float>, confidence double, ord int"))
    asked = spark.createDataFrame(queries, "query_id int, vector array<float>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    got = {r.query_id: r for r in similarity.best_match(asked, known, 50, 0.8).collect()}
    assert set(got) == set(range(30))
    for k, v in queries[:-1]:
        best = max((s for s in stored if s[2] >= 0.95 and s[0] != "zero"), key=lambda s: cos(v, s[1]))
        assert got[k].key == best[0] and got[k].similarity == pytest.approx(cos(v, best[1]), abs=1e-6) and got[k].hit == (got[k].similarity >= 0.8)
    stats = similarity.cache_stats(similarity.best_match(asked, known, 50, 0.8)).first()
    assert stats.cache_hits + stats.cache_misses == 30 and stats.hit_rate == pytest.approx(stats.cache_hits / 30)
    assert similarity.best_match(asked, known, 62).count() == 0  # not enough stored
    assert similarity.cache_stats(similarity.best_match(asked, known, 62)).first().hit_rate == 0


def test_cached_session(spark):
    rows = [("a", 1, [1.0, 0.0], "X", 0.96), ("a", 2, [0.99, 0.05], "Y", 0.96), ("a", 3, [0.0, 1.0], "Z", 0.5), ("a", 4, [0.0, 1.0], "Z", 0.99), ("b", 5, [1.0, 0.0], "Q", 0.99)]
    got = similarity.cached_session(spark.createDataFrame(rows, "session string, ord int, vector array<double>, text string, confidence double"), least=1)
    assert sorted(map(tuple, got.collect())) == [("a", 1, "X", False), ("a", 2, "X", True), ("a", 3, "Z", False), ("a", 4, "Z", False), ("b", 5, "Q", False)]
