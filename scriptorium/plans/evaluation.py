"""An evaluation run over two record tables: predictions and truth to summaries and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import metrics
from scriptorium.sources.records import last_by_id, long_form, markdown_report


class EmptyEvaluation(ValueError):
    """No prediction has the id of a true record."""


@dataclass
class Evaluation:
    accuracy: DataFrame
    summary: DataFrame
    delta: DataFrame
    confusions: DataFrame
    rates: dict
    unmatched_predictions: DataFrame
    unmatched_truth: DataFrame

    def report(self, title: str) -> str:
        return markdown_report(self.summary, self.delta, self.confusions, self.rates, title)


def evaluate(predictions: DataFrame, truth: DataFrame, how: str = "inner", top: int = 50) -> Evaluation:
    """predictions: (line_no, id, fields, raw_fields), truth: (line_no, id, fields); the last record of an id counts.

    Only records with both are judged; ``how="left"`` takes a missing prediction for one without
    fields. The gain of correction is taken over records whose raw_fields aren't empty.
    """
    p, g = last_by_id(predictions), last_by_id(truth)
    both = g.select("id", F.col("fields").alias("truth")).join(p.select("id", "fields", "raw_fields"), "id", how)
    samples = both.count()
    if not samples:
        raise EmptyEvaluation("no record has both a prediction and a truth")
    true = long_form(both, "truth")
    found = long_form(both)
    corrected = both.where(F.size("raw_fields") > 0)
    rates = metrics.global_rates(true, found).first()
    accuracy = metrics.field_accuracy(true, found)
    values = true.withColumnRenamed("value", "gt").join(found.select("id", "field_name", F.col("value").alias("raw")), ["id", "field_name"]).select("raw", "gt")
    delta = metrics.correction_delta(long_form(corrected, "truth"), long_form(corrected, "raw_fields"), long_form(corrected))
    return Evaluation(
        accuracy,
        checked(metrics.accuracy_summary(accuracy), ("exact_match_rate", "missing_rate"), ("mean_cer", "mean_wer")),
        checked(metrics.correction_summary(delta), ("pre_exact_rate", "post_exact_rate", "improved_rate", "degraded_rate"), ()),
        metrics.top_pairs(metrics.edit_pairs(values), top),
        {"samples": samples, "mean_cer": rates.mean_cer, "mean_wer": rates.mean_wer},
        metrics.unmatched(p, g),
        metrics.unmatched(g, p),
    )


def checked(summary: DataFrame, shares: tuple[str, ...], rates: tuple[str, ...]) -> DataFrame:
    """Fail where a share isn't from 0 to 1 or a rate is negative."""
    for c in (*shares, *rates):
        bad = (F.col(c) < 0) | ((F.col(c) > 1) if c in shares else F.lit(False))
        summary = summary.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{c} is out of range")).cast("double")).otherwise(F.col(c)))
    return summary
