"""The Verhoeff check digit as folds over literal arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _times(a: int, b: int) -> int:
    """The product in the symmetry group of the pentagon: 0-4 turn it, 5-9 turn it over."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


# Fixed value: the permutation of digits from one place to the next.
STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def _permuted() -> list[int]:
    """Eight rows of ten: the permutation applied 0 to 7 times."""
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([rows[-1][STEP[k]] for k in range(10)])
    return [x for row in rows for x in row]


PRODUCT = [_times(a, b) for a in range(10) for b in range(10)]
PERMUTED = _permuted()
INVERSE = [next(b for b in range(10) if _times(a, b) == 0) for a in range(10)]


def _literal(values: list[int]) -> Column:
    return F.array(*map(F.lit, values))


def _fold(digits: Column, shift: int) -> Column:
    """The running product over the digits from the right, whose first place counts as ``shift``."""
    turned = F.reverse(digits)

    def step(c: Column, i: Column) -> Column:
        digit = F.ascii(F.substring(turned, i + 1, F.lit(1))) - 48
        return F.get(_literal(PRODUCT), c * 10 + F.get(_literal(PERMUTED), (i + shift) % 8 * 10 + digit))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)


def is_checked(digits: Column) -> Column:
    """Whether a string of digits ends in its check digit; null if it isn't one of digits."""
    return F.when(digits.rlike(r"^[0-9]+\z"), _fold(digits, 0) == 0)


def check_digit(digits: Column) -> Column:
    """The digit to append, as a string."""
    return F.when(digits.rlike(r"^[0-9]+\z"), F.get(_literal(INVERSE), _fold(digits, 1)).cast("string"))
