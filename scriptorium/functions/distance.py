"""Error rates between a recognised text and the truth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalise


def _rate(distance: Column, size: Column, empty_prediction: Column) -> Column:
    return F.when(size == 0, F.when(empty_prediction, 0.0).otherwise(1.0)).otherwise(distance / size)


def cer(prediction: Column, truth: Column) -> Column:
    """Edit distance in characters over the truth's length, of normalised texts; may exceed 1."""
    return normal_cer(normalise(prediction), normalise(truth))


def normal_cer(p: Column, g: Column) -> Column:
    """cer of texts that are normalised already."""
    return _rate(F.levenshtein(p, g), F.length(g), p == "")


def words(normal: Column) -> Column:
    """The words of a normalised text."""
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays, keeping one row of the table at a time."""

    def next_row(row: Column, x: Column) -> Column:
        # out: the new row so far; its last element is the cell to the left
        def cell(out: Column, i: Column) -> Column:
            put = F.get(row, i - 1) + (x != F.get(b, i - 1)).cast("int")
            return F.concat(out, F.array(F.least(put, F.get(row, i) + 1, F.get(out, i - 1) + 1)))

        return F.aggregate(_upto(F.size(b)), F.array(F.get(row, F.lit(0)) + 1), cell)

    start = F.concat(F.array(F.lit(0)), _upto(F.size(b)))
    return F.when(a == b, 0).otherwise(F.element_at(F.aggregate(a, start, next_row), -1))


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def wer(prediction: Column, truth: Column) -> Column:
    """Edit distance in words over the truth's word count, of normalised texts."""
    return normal_wer(normalise(prediction), normalise(truth))


def normal_wer(p: Column, g: Column) -> Column:
    """wer of texts that are normalised already; those of one word each need no table."""
    one = (F.instr(p, " ") == 0) & (F.instr(g, " ") == 0) & (p != "") & (g != "")
    a, b = words(p), words(g)
    return F.when(one, (p != g).cast("double")).otherwise(_rate(edit_distance(a, b), F.size(b), F.size(a) == 0))
