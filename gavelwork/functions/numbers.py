"""Rounding, ratios and point scales."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int) -> Column:
    """Round on the decimal text of the value, half away from zero, as double.

    Going through DECIMAL keeps half-cent ties stable: the order of a sum inside an
    aggregate can move a double by one ulp, which would flip a plain ``round``. Values
    that do not fit the DECIMAL (NaN, very large ratios) are rounded as doubles.
    """
    value = value.cast("double")
    return F.coalesce(
        F.round(value.try_cast("decimal(28,10)"), digits).cast("double"), F.round(value, digits)
    )


def ratio(top: Column, bottom: Column) -> Column:
    """NULL instead of an error when the bottom is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def steps(value: Column, scale: Sequence[tuple], otherwise) -> Column:
    """First label whose threshold is reached: ``scale`` is (at_least, label), falling."""
    chain = None
    for at_least, label in scale:
        test = value >= F.lit(at_least)
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def above(value: Column, scale: Sequence[tuple], otherwise, column: int = 1) -> Column:
    """As :func:`steps`, but strictly above the threshold; picks ``column`` of the row."""
    chain = None
    for row in scale:
        test = value > F.lit(row[0])
        label = F.lit(row[column])
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain.otherwise(F.lit(otherwise))


def total(columns: Iterable[Column]) -> Column:
    """Sum of a list of columns."""
    result = None
    for item in columns:
        result = item if result is None else result + item
    return result


def flag(test: Column) -> Column:
    """1 when the test holds, else 0 (NULL counts as 0)."""
    return F.when(test, 1).otherwise(0)
