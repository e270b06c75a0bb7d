"""Reports of a company's findings, and the tables they are kept in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import display


def report(found: DataFrame, totals: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """One row per company: its findings in order as JSON and as Markdown. ``found`` has rule_id, category, outcome, low, high, place."""
    line = F.concat(F.lit("- **"), F.col("rule_id"), F.lit("** ("), F.col("outcome"), F.lit(")"), F.when(F.col("high") > 0, F.concat(F.lit(": "), display(F.col("low")), F.lit("–"), display(F.col("high")))).otherwise(""))
    rows = found.withColumn("line", line)
    item = F.struct("place", "rule_id", "category", "outcome", "low", "high", "line")
    per = rows.groupBy("company_id").agg(F.sort_array(F.collect_list(item)).alias("items")).join(totals, "company_id")
    bare = F.transform("items", lambda x: F.struct(x["place"].alias("place"), x["rule_id"].alias("rule_id"), x["category"].alias("category"), x["outcome"].alias("outcome"), x["low"].alias("low"), x["high"].alias("high")))
    body = F.struct("company_id", "low", "high", "deferred_low", "deferred_high", bare.alias("findings"))
    head = F.concat(F.lit("# Company "), F.col("company_id").cast("string"), F.lit("\n\nPossible savings "), display(F.col("low")), F.lit("–"), display(F.col("high")), F.lit("\n\n"))
    return per.select("company_id", F.to_json(body).alias("json"), F.concat(head, F.array_join(F.transform("items", lambda x: x["line"]), "\n")).alias("markdown"))


def control_review(evaluations: DataFrame) -> DataFrame:
    """For accountants, each rule of a company once: must_check, possible, looks_correct or worth_raising."""
    kind = (
        F.when((F.col("category") == "risk") & (F.col("outcome") == "matched"), "must_check").when(F.col("outcome") == "indeterminate", "possible")
        .when(F.col("outcome") == "matched", "worth_raising").when(F.col("outcome").isin("not_applicable", "exception_applies") & (F.col("n_present") == F.col("n_referenced")), "looks_correct")
    )
    return evaluations.select("company_id", "rule_id", kind.alias("review")).where("review is not null")


def write_findings(found: DataFrame, path: str) -> None:
    """Findings, and a row per thing each waits for, as two tables partitioned alike; a rerun replaces both."""
    found.drop("missing", "questions").write.mode("overwrite").parquet(f"{path}/findings")
    waits = found.select("company_id", "rule_id", F.posexplode(F.concat("missing", "questions")).alias("position", "item"))
    waits.write.mode("overwrite").parquet(f"{path}/evidence")
