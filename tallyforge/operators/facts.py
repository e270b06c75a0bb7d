"""Facts: many readings per company and kind, one of them canonical."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def canonical(facts: DataFrame) -> DataFrame:
    """Per company and kind the reading of highest confidence; the earliest of equals. A grouped maximum, so combined before it is shuffled."""
    best = F.max_by(F.struct("value_ore", "confidence", "seq"), F.struct("confidence", (-F.col("seq")).alias("s")))
    return facts.groupBy("company_id", "kind").agg(best.alias("b"), F.count("*").alias("n_readings")).select("company_id", "kind", "b.value_ore", "b.confidence", "b.seq", "n_readings")


def all_readings(facts: DataFrame) -> DataFrame:
    """Readings ranked within company and kind: confidence descending, order of arrival among equals."""
    order = W.partitionBy("company_id", "kind").orderBy(F.desc("confidence"), "seq")
    return facts.select("company_id", "kind", "value_ore", "confidence", "seq", F.row_number().over(order).alias("place"))


def contradictions(facts: DataFrame) -> DataFrame:
    """Each later reading that differs from the first inserted one of its kind. The first is a grouped minimum joined back."""
    first = facts.groupBy("company_id", "kind").agg(F.min(F.struct("seq", "value_ore")).alias("f"))
    both = facts.join(first, ["company_id", "kind"]).where((F.col("seq") > F.col("f.seq")) & (F.col("value_ore") != F.col("f.value_ore")))
    return both.select("company_id", "kind", F.col("f.value_ore").alias("first_ore"), F.col("value_ore").alias("other_ore"), "seq")


def wide(best: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per company, a nullable column f_<kind> for each kind: null is a missing fact."""
    return best.groupBy("company_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("value_ore"))).alias(f"f_{k}") for k in kinds])


def missing(row: dict[str, Column]) -> Column:
    """Names of the null columns, in order."""
    named = [F.when(c.isNull(), F.lit(k)) for k, c in row.items()]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def implausible(facts: DataFrame, revenue_kind: str, most_ore: int = 600_000_000_000_000) -> DataFrame:
    """Once per company and kind over all readings: negative revenue, or more than any company has."""
    bad = ((F.col("kind") == revenue_kind) & (F.col("value_ore") < 0)) | (F.abs("value_ore") > most_ore)
    return facts.where(bad).groupBy("company_id", "kind").agg(F.min_by("value_ore", "seq").alias("value_ore"))
