"""From rule evaluations to ranked findings, totals, areas, gaps and an action plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The areas a report always lists.
AREAS = ["tax", "costs", "investments", "personnel", "vat", "rnd", "risk"]
FINDINGS = ("matched", "indeterminate")


def findings(evaluations: DataFrame) -> DataFrame:
    """Evaluations that are findings; a rule that refers to facts of which none is there is passed over."""
    return evaluations.where(F.col("outcome").isin(*FINDINGS) & ((F.col("n_referenced") == 0) | (F.col("n_present") > 0)))


def cleared(evaluations: DataFrame) -> DataFrame:
    """Rules that don't apply though all they refer to is known."""
    return evaluations.where(F.col("outcome").isin("not_applicable", "exception_applies") & (F.col("n_present") == F.col("n_referenced")))


def totals(found: DataFrame) -> DataFrame:
    """Per company the sums of matched reductions and deferrals. Rejected findings and, where there is a column ``actionable``,
    those that are not count nothing; an overflow of either bound makes the whole range nothing."""
    counts = F.col("outcome") == "matched"
    if "status" in found.columns:
        counts &= F.col("status") != "rejected"
    if "actionable" in found.columns:
        counts &= F.coalesce("actionable", F.lit(False))

    def span(effect: str):
        low, high = (F.try_sum(F.when((F.col("effect") == effect) & counts, F.coalesce(bound, F.lit(0))).otherwise(0).cast("bigint")) for bound in ("low", "high"))
        good = low.isNotNull() & high.isNotNull()
        return F.when(good, low).otherwise(0), F.when(good, high).otherwise(0)

    (low, high), (later_low, later_high) = span("reduction"), span("deferral")
    return found.groupBy("company_id").agg(low.alias("low"), high.alias("high"), later_low.alias("deferred_low"), later_high.alias("deferred_high"), F.count("*").alias("n_findings"))


def counts_by_band(found: DataFrame, companies: DataFrame) -> DataFrame:
    """Per company of ``companies`` its presented findings (company_id, band, status) by priority band, and whether there are none."""
    shown = found.where("status <> 'rejected'")
    n = lambda band: F.count_if(F.col("band") == band)
    per = shown.groupBy("company_id").agg(F.count("*").alias("identified"), n("high").alias("high"), n("should_investigate").alias("investigate"), n("needs_more_evidence").alias("lacking"))
    out = companies.select("company_id").join(per, "company_id", "left").na.fill(0, ["identified", "high", "investigate", "lacking"])
    return out.withColumn("found_nothing", F.col("identified") == 0)


def talking_points(found: DataFrame) -> DataFrame:
    """Findings with an amount, the highest first."""
    raised = found.where((F.coalesce("low", F.lit(0)) != 0) | (F.coalesce("high", F.lit(0)) != 0))
    return raised.withColumn("place", F.row_number().over(W.partitionBy("company_id").orderBy(F.desc("high"), "rule_id")))


def ranked(found: DataFrame, score: str = "score", seq: str = "seq") -> DataFrame:
    """Place of each finding of a company: score descending, rule order among equals."""
    return found.withColumn("place", F.row_number().over(W.partitionBy("company_id").orderBy(F.desc(score), seq)))


def covered_areas(evaluations: DataFrame) -> DataFrame:
    """Every area with the number of its rules evaluated and of findings, zeros kept."""
    spark = evaluations.sparkSession
    areas = spark.createDataFrame([(a,) for a in AREAS], "category string")
    counted = evaluations.groupBy("category").agg(F.count("*").alias("n_rules"), F.count_if(F.col("outcome").isin(*FINDINGS)).alias("n_findings"))
    return areas.join(counted, "category", "left").select("category", F.coalesce("n_rules", F.lit(0)).alias("n_rules"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def gaps(found: DataFrame) -> DataFrame:
    """What is missing, the findings of a company that wait for it and their number: most first, then by name."""
    items = found.select("company_id", "rule_id", F.explode(F.array_union("missing", "questions")).alias("item"))
    counted = items.groupBy("company_id", "item").agg(F.countDistinct("rule_id").alias("n_waiting"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    return counted.withColumn("place", F.row_number().over(W.partitionBy("company_id").orderBy(F.desc("n_waiting"), "item")))


def action_plan(actions: DataFrame) -> DataFrame:
    """Blank actions go, of equal ones the first stays; numbered by band, then highest amount."""
    once = W.partitionBy("company_id", "action").orderBy("band_rank", F.desc("high"), "seq")
    kept = actions.where(F.trim("action") != "").withColumn("r", F.row_number().over(once)).where("r = 1").drop("r")
    return kept.withColumn("number", F.row_number().over(W.partitionBy("company_id").orderBy("band_rank", F.desc("high"), "seq")))
