"""Operators of a table store: pages by key, folds, guarded updates, idempotent inserts, cascades, arrays as sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def tenant(df: DataFrame, company_id) -> DataFrame:
    """A tenant's rows; none without a tenant, as null equals nothing."""
    return df.where(F.col("company_id") == F.lit(company_id))


def page(df: DataFrame, ts: str, key: str, after: tuple | None = None, limit: int = 50) -> DataFrame:
    """A page, newest first, of the rows before the cursor (ts, key); limit from 1 to 200. One row more shows that a next page exists."""
    if after is not None:
        df = df.where(F.struct(F.col(ts), F.col(key)) < F.struct(F.lit(after[0]).cast(df.schema[ts].dataType), F.lit(after[1]).cast(df.schema[key].dataType)))
    return df.orderBy(F.desc(ts), F.desc(key)).limit(max(1, min(200, limit)) + 1)


def cursor(ts: Column, key: Column) -> Column:
    """URL-safe base64 of time and key."""
    return F.rtrim(F.translate(F.base64(F.concat_ws("|", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), key.cast("string")).cast("binary")), "+/", "-_"), F.lit("="))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a grouped maximum of structs."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("row")).select(*keys, "row.*")


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """``base`` with the last change of each key put in; new keys are added."""
    last = latest(changes, [key], [order]).drop(order).alias("n")
    columns = [c for c in base.columns if c != key]
    joined = base.alias("o").join(last, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    fresh = F.col(f"n.{key}").isNotNull()
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns])


def insert_new(base: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of which no key is there yet, the first of each key."""
    first = W.partitionBy(*keys).orderBy(order)
    return rows.join(base.select(*keys).distinct(), keys, "left_anti").withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def cascade(parents: DataFrame, children: DataFrame, key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Children first, then parents, without those whose key is in ``gone``."""
    ids = gone.select(key).distinct()
    return children.join(ids, key, "left_anti"), parents.join(ids, key, "left_anti")


def bounded_union(a: Column, b: Column, allowed: Column) -> Column:
    return F.array_sort(F.array_intersect(F.array_union(a, b), allowed))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0
