"""IEEE-754 results for the operations in which SQL differs: errors and nulls become infinities and NaN, NaN is unordered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def divide(a: Column, b: Column) -> Column:
    """a / b; x / 0 is an infinity of x's sign, 0 / 0 and anything with NaN are NaN."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def log10(a: Column) -> Column:
    """The decimal logarithm; of 0 it is -inf, of less NaN."""
    a = a.cast("double")
    return F.when(F.isnan(a) | (a > 0), F.log10(a)).when(a == 0, F.lit(-INF)).otherwise(F.when(a.isNotNull(), F.lit(NAN)))


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


def compare(op: str, a: Column, b: Column, unordered: list[Column]) -> Column:
    """A comparison in which the ``unordered`` sides may be NaN: then only ``!=`` holds."""
    out = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    for x in unordered:
        out = out | F.isnan(x) if op == "!=" else out & ~F.isnan(x)
    return out


def least(a: Column) -> Column:
    """The minimum, NaN if there is one."""
    return F.when(F.bool_or(F.isnan(a.cast("double"))), F.lit(NAN)).otherwise(F.min(a))
