"""Budgets: what each call costs, summed up in order, and the moment a limit is reached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import MOST_ROWS, log, scan


def charged(calls: DataFrame, key: str, order: list[str], cost: Column, limit: Column, most: int = MOST_ROWS) -> DataFrame:
    """``calls`` with the columns spent (of this call and all before it; a negative cost counts as none), exceeded (spent has reached
    the limit) and stamped (the call that reached it first). A null cost counts as none; calls without a key share a budget."""
    calls = calls.withColumn("_cost", F.greatest(F.coalesce(cost, F.lit(0)), F.lit(0)).cast("bigint")).withColumn("_limit", limit)
    rows = scan(log(calls, [key], order, most), spent=("sum", F.col("_cost"))).done()
    rows = rows.withColumn("exceeded", F.col("spent") >= F.col("_limit"))
    return rows.withColumn("stamped", F.col("exceeded") & (F.col("spent") - F.col("_cost") < F.col("_limit"))).drop("_cost", "_limit")


def budgets(calls: DataFrame, key: str, order: list[str], cost: Column, limit: Column, most: int = MOST_ROWS) -> DataFrame:
    """One row a key: calls, spent, exceeded_at (the first column of the order when the limit was first reached, null if never).
    Once reached, a limit stays reached, as costs are not negative; so the earliest such call is the one stamp."""
    rows = charged(calls, key, order, cost, limit, most)
    first = F.min(F.when(F.col("exceeded"), F.struct(*order)))
    return rows.groupBy(key).agg(F.count("*").alias("calls"), F.max("spent").alias("spent"), first[order[0]].alias("exceeded_at"))
