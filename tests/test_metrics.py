import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.distance import cer, edit_distance, wer
from scriptorium.operators import metrics
from scriptorium.plans.evaluation import EmptyEvaluation, checked, evaluate


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[-1] + 1))
    return row[-1]


def plain_rate(p, g):
    return (0.0 if not p else 1.0) if not g else plain_distance(p, g) / len(g)


def test_rates_against_python(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aBé中 \t") for _ in range(rng.randint(0, 9)))
    pairs = [(word(), word()) for _ in range(150)] + [("", ""), ("", "ABCD"), ("ABCD", ""), ("ABCE", "ABCD"), ("ABCDEFGHIJ", "AB"), ("  ravi  kumar ", "RAVI KUMAR"), ("RAVI", "RAVI KUMAR")]
    frame = spark.createDataFrame(pairs, "p string, g string").select("p", "g", cer(F.col("p"), F.col("g")).alias("c"), wer(F.col("p"), F.col("g")).alias("w"))
    for r in frame.collect():
        p, g = (" ".join(x.split()).upper() for x in (r.p, r.g))
        assert r.c == pytest.approx(plain_rate(p, g))
        assert r.w == pytest.approx(plain_rate(p.split(), g.split()))


def test_edit_distance_of_arrays(spark):
    rng = random.Random(9)
    rows = [([rng.choice("abc") for _ in range(rng.randint(0, 7))], [rng.choice("abc") for _ in range(rng.randint(0, 7))]) for _ in range(80)]
    for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", edit_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == plain_distance(r.a, r.b)


def table(spark, rows):
    return spark.createDataFrame([(i, k, f, v) for k, (i, f, v) in enumerate(rows)], "id string, ord int, field_name string, value string")


def test_field_accuracy_and_summary(spark):
    truth = table(spark, [("1", "name", "RAVI KUMAR"), ("1", "dob", "01/01/1990"), ("2", "name", "X"), ("3", "name", "")])
    found = table(spark, [("1", "name", " ravi  kumar"), ("2", "name", "Y"), ("1", "extra", "ignored")])
    rows = {(r.id, r.field_name): r for r in metrics.field_accuracy(truth, found).collect()}
    assert len(rows) == 4 and rows["1", "name"].exact_match and not rows["1", "name"].missing
    assert tuple(rows["1", "dob"][3:]) == (False, 1.0, 1.0, "", "01/01/1990", True)
    assert rows["3", "name"].missing and rows["3", "name"].cer == 1.0
    summary = {r.field_name: r for r in metrics.accuracy_summary(metrics.field_accuracy(truth, found)).collect()}
    assert summary["name"].n == 3 and summary["name"].exact_match_rate == pytest.approx(1 / 3) and summary["dob"].missing_rate == 1
    rates = metrics.global_rates(truth, found).first()  # here a missing prediction for an empty truth is right
    assert rates.n == 4 and rates.mean_cer == 0.5


def test_correction_delta(spark):
    truth = table(spark, [("1", "f", "ABCD"), ("2", "f", "ABCD"), ("3", "f", "ABCD"), ("4", "f", "AB")])
    pre = table(spark, [("1", "f", "ABCX"), ("2", "f", "ABCD"), ("3", "f", "XXCD")])
    post = table(spark, [("1", "f", "ABCD"), ("2", "f", "ABXX"), ("3", "f", "ABXX")])
    delta = metrics.correction_delta(truth, pre, post)
    got = {r.id: (r.cer_delta, r.improved, r.degraded, r.unchanged) for r in delta.collect()}
    assert got == {"1": (-0.25, True, False, False), "2": (0.5, False, True, False), "3": (0.0, False, False, True), "4": (0.0, False, False, True)}
    summary = metrics.correction_summary(delta).first()
    assert (summary.n, summary.improved_rate, summary.degraded_rate, summary.exact_delta) == (4, 0.25, 0.25, 0.0)
    assert metrics.regressions(metrics.correction_summary(delta)).count() == 1
    assert metrics.regressions(metrics.correction_summary(delta), 0.3).count() == 0


def test_confusions(spark):
    pairs = spark.createDataFrame([("1O23", "1023"), ("S678", "5678"), ("9O12", "9012"), ("abc", "abc"), ("ab", "abc")], "raw string, gt string")
    for found in (metrics.aligned_pairs(pairs), metrics.edit_pairs(pairs)):
        assert {(r.pred, r.gt): r.n for r in found.collect()} == {("O", "0"): 2, ("S", "5"): 1}
    top = metrics.bars(metrics.top_pairs(metrics.aligned_pairs(pairs), 2)).orderBy(F.desc("n")).collect()
    assert [len(r.bar) for r in top] == [30, 15]


def test_substitutions_are_a_shortest_script():
    rng = random.Random(7)
    for _ in range(200):
        p, g = ("".join(rng.choice("ab1") for _ in range(rng.randint(0, 7))) for _ in "pg")
        found = metrics.substitutions(p, g)
        assert len(found) <= plain_distance(p, g) and all(a != b for a, b in found)
        assert len(p) != len(g) or found or p == g or plain_distance(p, g) > 1


RECORDS = "line_no int, id string, fields map<string,string>, raw_fields map<string,string>"


def test_evaluation_run(spark):
    predictions = spark.createDataFrame([(0, "1", {"name": "old"}, None), (1, "1", {"name": "RAVI", "x": "y"}, {"name": "RAV1"}), (2, "99", {"name": "z"}, None), (3, None, {}, None)], RECORDS)
    truth = spark.createDataFrame([(0, "1", {"name": "Ravi"}, None), (1, "2", {"name": "Uma"}, None)], RECORDS)
    run = evaluate(predictions, truth)
    assert run.rates == {"samples": 1, "mean_cer": 0.0, "mean_wer": 0.0}
    assert [r.id for r in run.unmatched_predictions.collect()] == ["99"] and [r.id for r in run.unmatched_truth.collect()] == ["2"]
    assert run.delta.first().improved_rate == 1.0
    report = run.report("CARD")
    assert "| name | 1 | 100.0% | 0.0000 | 0.0000 | 0.0% | green |" in report and "▲100.0pp" in report
    assert evaluate(predictions, truth, how="left").rates["samples"] == 2
    with pytest.raises(EmptyEvaluation):
        evaluate(predictions.where("id = '99'"), truth)


def test_out_of_range_summaries_fail(spark):
    with pytest.raises(Exception, match="out of range"):
        checked(spark.createDataFrame([(1.5,)], "share double"), ("share",), ()).collect()


def test_edit_script_of_the_library():
    """Examples from the documentation of python-Levenshtein and rapidfuzz, and a plain table for the rest of the rule."""
    assert metrics.substitutions("spam", "park") == [("m", "k")]
    assert metrics.substitutions("qabxcd", "abycdf") == [("x", "y")]
    assert metrics.substitutions("1O23", "1023") == [("O", "0")] and metrics.substitutions("S678", "5678") == [("S", "5")]
    assert metrics.substitutions("", "abc") == metrics.substitutions("abc", "") == metrics.substitutions("ab", "xab") == []
    # never more of them than characters differ, and with nothing else left out as many as the distance
    assert metrics.substitutions("abcd", "wxyz") == [("a", "w"), ("b", "x"), ("c", "y"), ("d", "z")]
