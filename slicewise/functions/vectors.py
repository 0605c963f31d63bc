"""Array functions on score vectors, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def argmax(v: Column) -> Column:
    """0-based place of the first greatest entry."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def at(v: Column, i: Column) -> Column:
    return F.get(v, i.cast("int"))


def margin(v: Column, label: Column, other: Column) -> Column:
    return at(v, label) - at(v, other)


def softmax(v: Column) -> Column:
    """Computed after taking off the greatest entry; ``v`` should be a column, for it is used twice."""
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / total(e))


def softmax_delta(v: Column, label: Column) -> Column:
    """Softmax less the one-hot vector of the label."""
    return F.transform(softmax(v), lambda x, i: x - F.when(i == label, F.lit(1.0)).otherwise(F.lit(0.0)))


def log_odds(v: Column, label: Column) -> Column:
    """Entry of the label less the log-sum-exp of the others."""
    top = F.array_max(v)
    rest = F.aggregate(F.transform(v, lambda x, i: F.when(i == label, F.lit(0.0)).otherwise(F.exp(x - top))), F.lit(0.0), lambda a, x: a + x)
    return at(v, label) - (top + F.log(rest))


def finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
