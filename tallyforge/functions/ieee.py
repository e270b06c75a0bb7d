"""Arithmetic on doubles that gives infinities and NaN where Spark raises, rounds or gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def div(a: Column, b: Column) -> Column:
    zero = F.when((a == 0) | F.isnan(a), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, zero).otherwise(F.try_divide(a, b))


def mod(a: Column, b: Column) -> Column:
    return F.when(b == 0, NAN).otherwise(F.call_function("try_mod", a, b))


def ln(a: Column) -> Column:
    return F.when(a == 0, -INF).when((a < 0) | F.isnan(a), NAN).otherwise(F.log(a))


def sqrt(a: Column) -> Column:
    return F.when(a < 0, NAN).otherwise(F.sqrt(a))


def floor(a: Column) -> Column:
    """Floor as a double; from 2**53 on, numbers are whole."""
    return F.when(F.abs(a) < float(1 << 53), F.floor(a).cast("double")).otherwise(a)


def ceil(a: Column) -> Column:
    return F.when(F.abs(a) < float(1 << 53), F.ceil(a).cast("double")).otherwise(a)


def less(a: Column, b: Column) -> Column:
    """False if either is NaN."""
    return ~F.isnan(a) & ~F.isnan(b) & (a < b)


def equal(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a == b)


def least(a: Column, b: Column) -> Column:
    """NaN is passed over."""
    return F.least(F.nanvl(a, b), F.nanvl(b, a))


def greatest(a: Column, b: Column) -> Column:
    return F.greatest(F.nanvl(a, b), F.nanvl(b, a))


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(less(hi, lo) | F.isnan(x), NAN).otherwise(least(greatest(x, lo), hi))


def truth(x: Column) -> Column:
    """Null for NaN, else whether it is not zero: Spark's three-valued logic then does the rest."""
    return F.when(~F.isnan(x), x != 0)
