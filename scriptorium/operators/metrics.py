"""Accuracy of extracted fields against the truth, in long form: (id, ord, field_name, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.distance import cer, normal_cer, normal_wer, wer
from scriptorium.functions.text import normalise


def field_accuracy(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per true field: exact, cer, wer, missing. A missing field has rates of 1; extra predictions count for nothing."""
    found = predictions.select("id", "field_name", normalise(F.col("value")).alias("_p"))
    joined = truth.select("id", "ord", "field_name", normalise(F.col("value")).alias("_g")).join(found, ["id", "field_name"], "left")
    missing, p, g = F.col("_p").isNull(), F.col("_p"), F.col("_g")
    exact = p == g
    return joined.select(
        "id", "ord", "field_name",
        F.when(missing, False).otherwise(exact).alias("exact_match"),
        F.when(missing, 1.0).when(exact, 0.0).otherwise(normal_cer(p, g)).alias("cer"),
        F.when(missing, 1.0).when(exact, 0.0).otherwise(normal_wer(p, g)).alias("wer"),
        F.when(missing, "").otherwise(p).alias("pred"),
        g.alias("gt"),
        missing.alias("missing"),
    )


def accuracy_summary(accuracy: DataFrame) -> DataFrame:
    """Rates by field name."""
    return accuracy.groupBy("field_name").agg(
        F.count("id").alias("n"),
        F.avg(F.col("exact_match").cast("int")).alias("exact_match_rate"),
        F.avg("cer").alias("mean_cer"),
        F.avg("wer").alias("mean_wer"),
        F.avg(F.col("missing").cast("int")).alias("missing_rate"),
    )


def band(exact_rate: Column) -> Column:
    """green from 97 %, yellow from 85 %, else red."""
    return F.when(exact_rate * 100 >= 97, "green").when(exact_rate * 100 >= 85, "yellow").otherwise("red")


def correction_delta(truth: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """What correction did to each true field; missing values count as empty ones. The flags use rates before rounding."""
    pre, post = (t.select("id", "field_name", normalise(F.col("value")).alias(c)) for t, c in ((before, "_a"), (after, "_b")))
    own = truth.select("id", "ord", "field_name", normalise(F.col("value")).alias("_g"))
    joined = own.join(pre, ["id", "field_name"], "left").join(post, ["id", "field_name"], "left").fillna("", ["_a", "_b"])
    g, a, b = F.col("_g"), F.col("_a"), F.col("_b")
    delta = F.col("_post_cer") - F.col("_pre_cer")
    return (
        joined.select("id", "ord", "field_name", (a == g).alias("pre_exact"), (b == g).alias("post_exact"), normal_cer(a, g).alias("_pre_cer"), normal_cer(b, g).alias("_post_cer"))
        .withColumns({
            "pre_cer": F.round("_pre_cer", 4), "post_cer": F.round("_post_cer", 4), "cer_delta": F.round(delta, 4),
            "improved": delta < -1e-9, "degraded": delta > 1e-9, "unchanged": F.abs(delta) < 1e-9,
        })
        .drop("_pre_cer", "_post_cer")
    )


def correction_summary(delta: DataFrame) -> DataFrame:
    """Rates by field name, to four places; means are taken over the rounded differences."""
    share = lambda c: F.avg(F.col(c).cast("int"))
    out = delta.groupBy("field_name").agg(
        F.count("id").alias("n"), share("pre_exact").alias("pre_exact_rate"), share("post_exact").alias("post_exact_rate"),
        (share("post_exact") - share("pre_exact")).alias("exact_delta"), F.avg("cer_delta").alias("mean_cer_delta"),
        share("improved").alias("improved_rate"), share("degraded").alias("degraded_rate"),
    )
    return out.select("field_name", "n", *(F.round(c, 4).alias(c) for c in out.columns[2:]))


def regressions(summary: DataFrame, most: float = 0.01) -> DataFrame:
    """Fields of which correction made more than this share worse."""
    return summary.where(F.col("degraded_rate") > most)


def arrow(exact_delta: Column) -> Column:
    """Up or down beyond half a percentage point."""
    return F.when(exact_delta * 100 > 0.5, "▲").when(exact_delta * 100 < -0.5, "▼").otherwise(" ")


def global_rates(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Mean rates over all true fields to six places; a missing prediction counts as an empty one."""
    found = predictions.select("id", "field_name", F.col("value").alias("_p"))
    p, g = F.coalesce("_p", F.lit("")), F.col("value")
    rates = truth.join(found, ["id", "field_name"], "left").select(cer(p, g).alias("c"), wer(p, g).alias("w"))
    return rates.agg(F.count("c").alias("n"), F.round(F.coalesce(F.avg("c"), F.lit(0.0)), 6).alias("mean_cer"), F.round(F.coalesce(F.avg("w"), F.lit(0.0)), 6).alias("mean_wer"))


def aligned_pairs(pairs: DataFrame, raw: str = "raw", truth: str = "gt") -> DataFrame:
    """(pred, gt, n) of differing characters at the same place of texts of one length."""
    a, b = F.col(raw), F.col(truth)
    chars = F.arrays_zip(F.split(a, "").alias("pred"), F.split(b, "").alias("gt"))
    each = pairs.where((F.length(a) == F.length(b)) & (F.length(a) > 0) & (a != b)).select(F.explode(chars).alias("x")).select("x.*")
    return each.where("pred <> gt").groupBy("pred", "gt").agg(F.count("pred").alias("n"))


def substitutions(p: str, g: str) -> list[tuple[str, str]]:
    """Replaced characters of a shortest edit script, the one that the rapidfuzz library picks among several.

    Common ends are left out first. Then from the last characters on: drop the prediction's character wherever that is one
    step less far; else add the truth's, if going on without it is farther for the shorter prediction; else keep or replace.
    """
    a, least = 0, min(len(p), len(g))
    while a < least and p[a] == g[a]:
        a += 1
    b = 0
    while b < least - a and p[-1 - b] == g[-1 - b]:
        b += 1
    p, g = p[a : len(p) - b], g[a : len(g) - b]
    rows = [list(range(len(p) + 1))]  # rows[j][i]: from p[:i] to g[:j]
    for j, y in enumerate(g, 1):
        above, row = rows[-1], [j]
        for i, x in enumerate(p, 1):
            row.append(min(above[i - 1] + (x != y), above[i] + 1, row[-1] + 1))
        rows.append(row)
    i, j, out = len(p), len(g), []
    while i and j:
        if rows[j][i] == rows[j][i - 1] + 1:
            i -= 1
        elif j > 1 and rows[j - 1][i] == rows[j - 1][i - 1] - 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            if p[i] != g[j]:
                out.append((p[i], g[j]))
    return out[::-1]


def edit_pairs(pairs: DataFrame, raw: str = "raw", truth: str = "gt") -> DataFrame:
    """(pred, gt, n) of characters that a shortest edit script replaces; equal texts don't reach Python."""

    @F.pandas_udf("array<struct<pred:string,gt:string>>")
    def replaced(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, g in batches:
            yield pd.Series([[{"pred": x, "gt": y} for x, y in substitutions(a, b)] for a, b in zip(p, g, strict=True)])

    normal = pairs.select(normalise(F.col(raw)).alias("p"), normalise(F.col(truth)).alias("g")).where("p <> g")
    counted = normal.groupBy("p", "g").agg(F.count("p").alias("times"))  # each pair of texts is aligned once
    each = counted.select("times", F.explode(replaced("p", "g")).alias("x")).select("times", "x.*")
    return each.groupBy("pred", "gt").agg(F.sum("times").alias("n"))


def top_pairs(counts: DataFrame, most: int = 50) -> DataFrame:
    """The most frequent ones; equal counts by their characters."""
    return counts.orderBy(F.desc("n"), "pred", "gt").limit(most)


def bars(top: DataFrame, width: int = 30) -> DataFrame:
    """Add a bar for each count of a report table, the longest one ``width`` wide."""
    largest = top.agg(F.max("n").alias("_most"))  # one row
    return top.crossJoin(F.broadcast(largest)).withColumn("bar", F.repeat(F.lit("█"), F.floor(F.col("n") / F.col("_most") * width).cast("int"))).drop("_most")


def unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids of the left table that the right one lacks."""
    return left.select("id").distinct().join(right.select("id").distinct(), "id", "left_anti")
