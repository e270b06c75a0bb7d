"""A finding as one record: its evidence in order, its calculation, what is missing, why, and how sure and urgent it is.

The rules and their sources are small tables; what is joined by company are the readings that a rule refers to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import missing_fact
from . import scoring
from .tables import put

# Rules that are broadcast with their sources.
MOST_RULES = 10_000
# One shape for all kinds of evidence; what a kind does not have is null, and absent in JSON.
ITEM = "kind string, name string, value_ore bigint, fact_id bigint, page int, excerpt string, source string, low bigint, high bigint, statement string, version_id bigint"


def _item(**have: Column) -> Column:
    fields = [x.strip().split() for x in ITEM.split(",")]
    return F.struct(*[have.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])


def cited(rules: DataFrame, sources: DataFrame) -> DataFrame:
    """``rules`` with source (references of its sources in their order, joined by "; ") and source_state (the weakest; a mismatch beats
    all). Sources that are not in the registry are left out of the text and count as not retrieved."""
    named = rules.select("rule_id", F.posexplode_outer("source_ids").alias("place", "source_id")).join(sources.select("source_id", "reference", "state"), "source_id", "left")
    per = named.groupBy("rule_id").agg(
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("place", "reference"))), lambda x: x["reference"].isNotNull()), lambda x: x["reference"]), "; ").alias("source"),
        scoring.weakest_source(F.collect_list(F.coalesce("state", F.lit("unretrieved")))).alias("source_state"),
    )
    return rules.join(per, "rule_id")


def adjacent_once(items: Column) -> Column:
    """An array without the items that equal the one before them."""
    return F.filter(items, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(items, i - 1)))


def records(findings: DataFrame, readings: DataFrame, rules: DataFrame, sources: DataFrame, verdicts: DataFrame, least_confidence: int = 50) -> DataFrame:
    """One row a finding, with its id, status, confidence, priority, evidence, missing and rationale.

    findings: company_id, tax_year, rule_id, category, effect, risk, outcome, low, high, missing, questions. readings (one a company and kind):
    company_id, kind, value_ore, fact_id, page, source_text, and version_id of the document, if there is such a column. rules: rule_id, version, title, description, action, referenced,
    source_ids, method (null without an impact), effort, urgency, relevance, reviewed, note, hints. sources: source_id,
    reference, state. verdicts (one a company and rule, or none): company_id, rule_id, objection, survives, reasoning, lacks,
    corroborated. Findings of rules that are not there have no record.

    Evidence: the readings a rule refers to, in its order; the rule; its calculation, if the range is known; the note of a rule
    awaiting review; the model's judgement, if it pointed there too. A reading counts as traceable with page and text.
    """
    small = cited(rules, sources)
    if small.count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    key = ["company_id", "tax_year", "rule_id"]
    # a company has a reading a kind, so they are one row that its findings pick from
    reading = F.struct("kind", "value_ore", "fact_id", "page", "source_text", (F.col("version_id") if "version_id" in readings.columns else F.lit(None).cast("bigint")).alias("version_id"))
    had = readings.groupBy("company_id").agg(F.sort_array(F.collect_list(reading)).alias("had"))
    rows = findings.join(verdicts, ["company_id", "rule_id"], "left").join(had, "company_id", "left").join(F.broadcast(small), "rule_id")
    rows = rows.withColumn("read", F.coalesce(F.flatten(F.transform("referenced", lambda k: F.filter("had", lambda x: x["kind"] == k))), F.array()))
    value = lambda x: _item(kind=F.lit("document_value"), name=x["kind"], value_ore=x["value_ore"], fact_id=x["fact_id"], page=x["page"], excerpt=x["source_text"], version_id=x["version_id"])
    read = F.transform("read", value)
    has_range, corroborated = F.col("low").isNotNull() & F.col("high").isNotNull(), F.coalesce("corroborated", F.lit(False))
    optional = F.array(
        _item(kind=F.lit("rule"), name=F.col("rule_id"), source=F.col("source"), excerpt=F.col("title"), statement=F.col("version")),
        F.when(has_range, _item(kind=F.lit("calculation"), name=F.col("method"), low=F.col("low"), high=F.col("high"))),
        F.when(~F.col("reviewed") & (F.coalesce("note", F.lit("")) != ""), _item(kind=F.lit("assumption"), statement=F.col("note"))),
        F.when(corroborated, _item(kind=F.lit("model_judgement"), name=F.lit("opportunity_discovery"))),
    )
    evidence = F.concat(read, F.filter(optional, lambda x: x.isNotNull()))
    traceable = F.size(F.filter("read", lambda x: x["page"].isNotNull() & x["source_text"].isNotNull()))
    needed = F.size("referenced")
    factors = scoring.rule_factors(traceable, needed, F.col("outcome"), has_range, F.col("method").isNotNull(), F.size("missing"), F.size("questions"), F.col("objection"), corroborated)
    rows = rows.withColumns({"evidence": evidence, "confidence": scoring.confidence(*factors)})
    zero = ~has_range | ((F.col("low") == 0) & (F.col("high") == 0))
    at_risk = (F.col("category") == "risk") | zero
    middle = (F.col("low") + F.col("high")) / 2.0
    score = F.when(at_risk, scoring.risk_priority(F.col("confidence"), F.col("risk"))).otherwise(scoring.priority(middle, F.col("confidence"), F.col("relevance"), F.col("urgency"), F.col("effort")))
    rows = rows.withColumn("priority", score)
    band = F.when(at_risk, scoring.risk_band(F.col("confidence"), F.col("risk"))).otherwise(scoring.priority_band(F.col("priority"), F.col("confidence")))
    survives = F.coalesce("survives", F.lit(True))
    actionable = F.exists("evidence", lambda e: e["kind"] == "document_value") & (F.col("confidence") >= least_confidence)
    status = scoring.status(survives, F.col("category"), F.col("outcome"), actionable, F.col("source_state"), F.col("reviewed") | (F.col("source_state") == "verified"))
    lacks = F.concat(F.transform("missing", missing_fact), F.coalesce("hints", F.array().cast("array<string>")), F.col("questions"), F.coalesce("lacks", F.array().cast("array<string>")))
    reason = F.when(F.col("outcome") == "indeterminate", F.concat(F.lit(" "), F.concat_ws(", ", "missing", "questions"), F.lit(".")))
    objected = F.when((F.coalesce("objection", F.lit(0.0)) > 0) & survives, F.concat(F.lit(" Invändning att beakta: "), F.coalesce("reasoning", F.lit(""))))
    return rows.select(
        F.sha2(F.concat_ws(":", *key), 256).alias("opportunity_id"), *key, "category", status.alias("status"), "title", F.concat(F.col("description"), F.coalesce(reason, F.lit("")), F.coalesce(objected, F.lit(""))).alias("rationale"),
        F.when(has_range, F.col("low")).otherwise(0).alias("low"), F.when(has_range, F.col("high")).otherwise(0).alias("high"), "effect", "evidence", adjacent_once(lacks).alias("missing"), F.col("action").alias("recommended_action"),
        "confidence", scoring.band(F.col("confidence")).alias("confidence_band"), "risk", "effort", "urgency", "priority", band.alias("band"), F.when(~survives, F.col("reasoning")).alias("rejection_reason"),
    )


def evidence_rows(found: DataFrame) -> DataFrame:
    """A row for each item of each record: opportunity_id, company_id, position, item (JSON without what is null)."""
    return found.select("opportunity_id", "company_id", F.posexplode("evidence").alias("position", "e")).select("opportunity_id", "company_id", "position", F.to_json("e").alias("item"))


def calculation_rows(found: DataFrame) -> DataFrame:
    """A row for each calculation: opportunity_id, company_id, method, inputs (names and values of the readings, in order), low, high."""
    sums = found.select("opportunity_id", "company_id", "evidence", F.explode(F.filter("evidence", lambda e: e["kind"] == "calculation")).alias("c"))
    inputs = F.transform(F.filter("evidence", lambda e: e["kind"] == "document_value"), lambda e: F.struct(e["name"].alias("name"), e["value_ore"].alias("value_ore")))
    return sums.select("opportunity_id", "company_id", F.col("c.name").alias("method"), inputs.alias("inputs"), F.col("c.low").alias("low"), F.col("c.high").alias("high"))


def store(found: DataFrame, path: str, batch: str) -> list[str]:
    """Writes records, their evidence and their calculations under a batch id, each once: a run that was killed between them goes on with
    those that are not there. Returns the tables that this call added to."""
    tables = {"opportunities": found.drop("evidence"), "evidence": evidence_rows(found), "calculations": calculation_rows(found)}
    return [t for t, rows in tables.items() if put(rows, f"{path}/{t}", batch)]
