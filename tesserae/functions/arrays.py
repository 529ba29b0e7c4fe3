"""Statistics of array columns, on the JVM and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """body(value), with the value worked out once: inside another lambda it would be worked out for every element."""
    return F.transform(F.array(value), body)[0]


def percentile(values: Column, q: float) -> Column:
    """Percentile q (0 to 1) of an array of numbers, linear between neighbours; null for an empty array. NaN sorts last."""
    ordered, at = F.sort_array(values.cast("array<double>")), (F.size(values) - 1) * F.lit(float(q))
    low = F.floor(at).cast("int")
    a, b = F.try_element_at(ordered, low + 1), F.try_element_at(ordered, F.least(low + 2, F.size(values)))
    return F.when(F.size(values) > 0, a + (b - a) * (at - low))


def percentiles(values: Column, *shares: float) -> list[Column]:
    """Several percentiles of an array; Spark sorts it once, since the expressions are equal."""
    return [percentile(values, q) for q in shares]


def mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double"))
    return F.when(F.size(values) > 0, total / F.size(values))


def std(values: Column) -> Column:
    """Population standard deviation, from the squares about the mean."""
    middle = mean(values)
    squares = bound(middle, lambda m: F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)))
    return F.when(F.size(values) > 0, F.sqrt(squares / F.size(values)))


def finite(v: Column) -> Column:
    """Neither null, NaN nor infinite."""
    d = v.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))


def json_number(v: Column) -> Column:
    """The value where it is finite, else null."""
    return F.when(finite(v), v.cast("double"))


def linspace(first: float, last: float, n: Column) -> Column:
    """n values from first to last; one value is 0.5, as a ramp over a single pixel weighs both sides alike."""
    step = F.lit(float(last) - float(first)) / F.greatest(n - 1, F.lit(1))
    many = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lit(float(first)) + i * step)
    return F.when(n == 1, F.array(F.lit(0.5))).when(n > 1, many).otherwise(F.array().cast("array<double>"))


def one_based(first: Column, last: Column) -> Column:
    """first..last with both ends; empty if they cross."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
