"""Money as whole öre in bigint columns: checked arithmetic, basis points, ranges. No floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def big(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("bigint")


def add(a: Column, b: Column) -> Column:
    """Sum, null on overflow."""
    return F.try_add(a, b)


def sub(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def mul_bp(of: Column, bp: Column | int) -> Column:
    """``of`` times basis points over 10 000, half away from zero; null where the product overflows."""
    product = F.try_multiply(of, big(bp))
    return F.when(product >= 0, F.call_function("div", F.try_add(product, big(5000)), big(10000))).otherwise(F.call_function("div", F.try_subtract(product, big(5000)), big(10000)))


def least_strict(a: Column, b: Column) -> Column:
    """Least of two, null if either is missing (Spark's least passes over nulls)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def greatest_strict(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def at_least_zero(a: Column) -> Column:
    return greatest_strict(a, big(0))


def money_range(a: Column, b: Column) -> Column:
    """Ordered struct<low, high>; null if a bound is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")))


def midpoint(r: Column) -> Column:
    """Middle of a range, half away from zero."""
    total = r["low"] + r["high"]
    return F.call_function("div", F.when(total >= 0, total + 1).otherwise(total - 1), big(2))


def display(ore: Column) -> Column:
    """As 1 234 567,89 kr with no-break spaces; the sign in front."""
    whole, part = F.call_function("div", F.abs(ore), big(100)), F.abs(ore) % 100
    grouped = F.replace(F.format_number(whole, 0), F.lit(","), F.lit(" "))
    return F.concat(F.when(ore < 0, "-").otherwise(""), grouped, F.lit(","), F.lpad(part.cast("string"), 2, "0"), F.lit(" kr"))
