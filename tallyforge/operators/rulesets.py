"""Rule sets as data: JSON documents taken apart into tables, checked as tables, and compiled to the trees that rules are run from.

A document has version, jurisdiction, rules, sources by id, and constants by year:

    {"version": "1", "jurisdiction": "SE",
     "rules": [{"rule_id": "...", "category": "tax", "jurisdiction": "SE", "tax_year_from": 2023, "tax_year_to": null, "relevance": 0.8,
                "conditions": {...}, "exceptions": [{"id": "...", "when": {...}}], "impact": {"low": {...}, "high": {...}},
                "required_evidence": ["..."], "sources": ["s1"], "effect": "reduction", "risk": "low"}],
     "sources": {"s1": {"locator": "...", "asserted_claim": "...", "state": "verified", "sha256": "...", "at": "..."}},
     "constants": [{"tax_year": 2024, "parameters": {"name": {"amount": 1, "source": "s1"}, "other": {"rate_bp": 2060, "source": "s1"}}}]}

Trees of conditions and amounts are those of ``rules``. Sets may be many and large: nothing but the rules that are compiled
comes to the driver.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variants import leaves
from .ordered import MOST_ROWS, log, scan
from .rules import Rule, RuleFault
from .tables import written

# Rules that are compiled into one plan.
MOST_RULES = 2000
# Names that a tree may use.
OPERATORS = [
    "fact", "fact_or_zero", "amount", "constant", "add", "sub", "mul_bp", "mul_rate", "max0", "min", "max", "abs", "compare", "fact_present",
    "fact_absent", "profile", "profile_number", "accounts_state", "tax_year_at_least", "tax_year_at_most", "all", "any", "not", "always",
]


class RuleSets(NamedTuple):
    """``sets``: set_id, version, jurisdiction. ``rules``: set_id, place, rule_id, years, jurisdiction, relevance, sources, body.
    ``sources``: set_id, source_id, state, sha256, at, asserted_claim, locator. ``parameters``: set_id, tax_year, name, kind, source;
    a year without parameters has one row without a name."""

    sets: DataFrame
    rules: DataFrame
    sources: DataFrame
    parameters: DataFrame


def _of(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def rule_rows(bodies: DataFrame) -> DataFrame:
    """``bodies`` (set_id, place, v as variant) to rows of rules."""
    return bodies.select(
        "set_id", "place", _of("$.rule_id").alias("rule_id"), _of("$.tax_year_from", "int").alias("year_from"), _of("$.tax_year_to", "int").alias("year_to"),
        _of("$.jurisdiction").alias("jurisdiction"), _of("$.relevance", "double").alias("relevance"), _of("$.sources", "array<string>").alias("sources"), F.col("v").alias("body"),
    )


def source_rows(bodies: DataFrame) -> DataFrame:
    """``bodies`` (set_id, source_id, v) to rows of sources."""
    return bodies.select("set_id", "source_id", *[_of(f"$.{c}").alias(c) for c in ("state", "sha256", "at", "asserted_claim", "locator")])


def parameter_rows(bodies: DataFrame) -> DataFrame:
    """``bodies`` (set_id, v), one a year, to rows of parameters."""
    years = bodies.select("set_id", _of("$.tax_year", "int").alias("tax_year"), F.try_variant_get("v", "$.parameters", "map<string,variant>").alias("p"))
    rows = years.select("set_id", "tax_year", F.explode_outer("p").alias("name", "v"))
    kind = F.when(_of("$.rate_bp", "bigint").isNotNull(), "rate").when(_of("$.amount", "bigint").isNotNull(), "constant")
    return rows.select("set_id", "tax_year", "name", kind.alias("kind"), F.coalesce(_of("$.amount", "bigint"), _of("$.rate_bp", "bigint")).alias("value"), _of("$.source").alias("source"))


def read(documents: DataFrame) -> RuleSets:
    """``documents`` (set_id, body): one JSON text a set. Text that is no JSON gives a set without version and rules."""
    spark = documents.sparkSession
    sets = documents.select("set_id", F.try_parse_json("body").alias("v"))
    part = lambda path, kind: F.try_variant_get("v", path, kind)
    rules = sets.select("set_id", F.posexplode(part("$.rules", "array<variant>")).alias("place", "v"))
    sources = sets.select("set_id", F.explode(part("$.sources", "map<string,variant>")).alias("source_id", "v"))
    years = sets.select("set_id", F.explode(part("$.constants", "array<variant>")).alias("v"))
    heads = sets.select("set_id", _of("$.version").alias("version"), _of("$.jurisdiction").alias("jurisdiction"))
    return RuleSets(heads, rule_rows(rules), source_rows(sources), parameter_rows(years))


def names(rules: DataFrame) -> DataFrame:
    """What rules' trees name: set_id, place, rule_id, field (conditions, exceptions, impact), kind (constant, rate, operator), name."""
    trees = F.to_variant_object(F.struct(*[F.coalesce(F.try_variant_get("body", f"$.{c}", "variant"), F.parse_json(F.lit("null"))).alias(c) for c in ("conditions", "exceptions", "impact")]))
    found = leaves(rules.select("set_id", "place", "rule_id", trees.alias("t")), ["set_id", "place", "rule_id"], F.col("t"))
    field, last = F.element_at("keys", 1), F.element_at("keys", -1)
    text = F.when(F.col("kind") == "STRING", F.col("value").cast("string"))
    # {"mul_rate": [amount, name]}: the second place of its list
    rate = last.isNull() & (F.size("keys") > 2) & (F.get("keys", F.size("keys") - 2) == "mul_rate") & (F.element_at("at", -1) == 1)
    used = found.select("set_id", "place", "rule_id", field.alias("field"), F.when(last == "constant", "constant").when(rate, "rate").alias("kind"), text.alias("name")).where("kind is not null")
    # below the field, and an exception's own names, all names are operators
    depth = F.when(field == "conditions", 1).when(field == "impact", 2).otherwise(3)
    own = (field == "exceptions") & ~F.coalesce(F.get("keys", F.lit(2)) == "when", F.lit(False))
    inner = F.when(own, F.array().cast("array<string>")).otherwise(F.filter("keys", lambda k, i: k.isNotNull() & (i >= depth)))
    operators = found.select("set_id", "place", "rule_id", field.alias("field"), F.lit("operator").alias("kind"), F.explode(inner).alias("name"))
    return used.unionByName(operators.where(~F.col("name").isin(OPERATORS))).distinct()


def problems(sets: RuleSets, most: int = MOST_ROWS) -> DataFrame:
    """Everything that makes a set unsafe to run, one row a defect: set_id, subject (a rule's, source's or parameter's id), field, problem,
    detail (the name or year concerned, or null).

    Rules: year_order, jurisdiction, relevance, no_source, unknown_source, unknown_constant and unknown_rate (by each year that the
    rule covers and the set has constants for), unknown_operator, duplicate, overlap (a window that begins before one of the
    same id has ended), no_id. Sources: no_hash and no_time for verified ones, no_claim, no_locator. Parameters: unknown_source. A
    null counts as what is wrong: no relevance is none from 0 to 1. Sets without rows have no defects; set ids are unique.
    """
    spark = sets.rules.sparkSession
    rules, sources, parameters = sets.rules, sets.sources, sets.parameters
    row = lambda df, subject, field, problem, detail=F.lit(None): df.select("set_id", F.col(subject).alias("subject"), F.lit(field).alias("field") if isinstance(field, str) else field.alias("field"), F.lit(problem).alias("problem"), detail.cast("string").alias("detail"))
    joined = rules.join(sets.sets.select("set_id", F.col("jurisdiction").alias("_set")), "set_id")
    own = [
        (F.col("year_to") < F.col("year_from"), "tax_year_to", "year_order", F.concat_ws("-", "year_from", "year_to")),
        (~F.col("jurisdiction").eqNullSafe(F.col("_set")), "jurisdiction", "jurisdiction", F.col("jurisdiction")),
        (~F.coalesce(F.col("relevance").between(0.0, 1.0), F.lit(False)), "relevance", "relevance", F.lit(None)),
        (F.coalesce(F.size("sources"), F.lit(0)) <= 0, "sources", "no_source", F.lit(None)),
        (F.col("rule_id").isNull(), "rule_id", "no_id", F.col("place")),
    ]
    checks = F.array(*[F.when(bad, F.struct(F.lit(f).alias("field"), F.lit(p).alias("problem"), d.cast("string").alias("detail"))) for bad, f, p, d in own])
    out = [joined.select("set_id", F.col("rule_id").alias("subject"), F.inline(F.filter(checks, lambda c: c.isNotNull())))]

    registry = sources.select("set_id", F.col("source_id").alias("source"))
    cited = rules.select("set_id", "rule_id", F.explode("sources").alias("source")).distinct()
    out.append(row(cited.join(registry, ["set_id", "source"], "left_anti"), "rule_id", "sources", "unknown_source", F.col("source")))
    named = parameters.where("name is not null")
    out.append(row(named.join(registry, ["set_id", "source"], "left_anti"), "name", F.concat(F.lit("parameters "), F.col("tax_year").cast("string")), "unknown_source", F.col("source")))

    # each year a rule covers, with the names it uses, less the parameters of that year
    used = names(rules).join(rules.select("set_id", "place", "year_from", "year_to"), ["set_id", "place"])
    inside = (F.col("tax_year") >= F.col("year_from")) & (F.col("year_to").isNull() | (F.col("tax_year") <= F.col("year_to")))
    years = parameters.select("set_id", "tax_year").distinct()
    asked = used.where("kind <> 'operator'").join(years, "set_id").where(inside).select("set_id", "rule_id", "field", "kind", "name", "tax_year").distinct()
    lost = asked.join(parameters.select("set_id", "tax_year", "kind", "name"), ["set_id", "tax_year", "kind", "name"], "left_anti")
    unknown = lost.select("set_id", F.col("rule_id").alias("subject"), "field", F.concat(F.lit("unknown_"), F.col("kind")).alias("problem"), F.concat_ws(" ", "tax_year", "name").alias("detail"))
    out.append(unknown)
    out.append(row(used.where("kind = 'operator'").select("set_id", "rule_id", "field", "name").distinct(), "rule_id", F.col("field"), "unknown_operator", F.col("name")))

    same = rules.where("rule_id is not null").groupBy("set_id", "rule_id").agg(F.count("*").alias("n"))
    out.append(row(same.where("n > 1"), "rule_id", "rule_id", "duplicate", F.col("n")))
    windows = rules.where("rule_id is not null and year_from is not null and coalesce(year_to, 9999) >= year_from")
    ends = scan(log(windows.withColumn("_end", F.coalesce("year_to", F.lit(9999))), ["set_id", "rule_id"], ["year_from", "place"], most), _upto=("max", F.col("_end")))
    ends = scan(ends, _before=("before", F.col("_upto"))).done()
    out.append(row(ends.where(F.col("year_from") <= F.col("_before")), "rule_id", "tax_year_from", "overlap", F.col("year_from")))

    verified = F.col("state") == "verified"
    blank = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) == 0
    faults = [(verified & (F.coalesce(F.col("sha256"), F.lit("")) == ""), "sha256", "no_hash"), (verified & (F.coalesce(F.col("at"), F.lit("")) == ""), "at", "no_time"), (blank("asserted_claim"), "asserted_claim", "no_claim"), (blank("locator"), "locator", "no_locator")]
    checks = F.array(*[F.when(bad, F.struct(F.lit(f).alias("field"), F.lit(p).alias("problem"), F.lit(None).cast("string").alias("detail"))) for bad, f, p in faults])
    out.append(sources.select("set_id", F.col("source_id").alias("subject"), F.inline(F.filter(checks, lambda c: c.isNotNull()))))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def compiled(sets: RuleSets, set_id) -> list[Rule]:
    """The rules of one set in their order, as trees to run. A set with problems, or with over MOST_RULES rules, raises."""
    of = lambda df: df.where(F.col("set_id").eqNullSafe(F.lit(set_id)))
    one = RuleSets(*[of(x) for x in sets])
    found = [f"{p.subject}: {p.field} {p.problem} {p.detail or ''}".strip() for p in problems(one).limit(50).collect()]
    if found:
        raise RuleFault("rule set is not valid:\n" + "\n".join(sorted(found)))
    bodies = one.rules.select("place", F.to_json("body").alias("body")).orderBy("place").limit(MOST_RULES + 1).collect()
    if len(bodies) > MOST_RULES:
        raise RuleFault(f"more than {MOST_RULES} rules")
    out = []
    for b in (json.loads(x.body) for x in bodies):
        impact = b.get("impact")
        out.append(Rule(
            b["rule_id"], b["category"], b["conditions"], (impact["low"], impact["high"]) if impact else None, tuple(x["when"] for x in b.get("exceptions") or ()),
            tuple(b.get("required_evidence") or ()), (b["tax_year_from"], b.get("tax_year_to")), b.get("risk", "low"),
        ))
    return out


def dump(rules: list[Rule], version: str, jurisdiction: str, sources: dict, constants: list[dict], cites: dict[str, list[str]]) -> str:
    """A set as JSON, as ``read`` takes it; ``cites`` has the sources of each rule."""
    body = [
        {
            "rule_id": r.id, "category": r.category, "jurisdiction": jurisdiction, "tax_year_from": r.years[0], "tax_year_to": r.years[1], "relevance": 1.0, "conditions": r.when,
            "exceptions": [{"id": str(i), "when": x} for i, x in enumerate(r.exceptions)], "impact": {"low": r.impact[0], "high": r.impact[1]} if r.impact else None,
            "required_evidence": list(r.evidence), "sources": cites[r.id], "effect": r.effect, "risk": r.risk,
        }
        for r in rules
    ]
    return json.dumps({"version": version, "jurisdiction": jurisdiction, "rules": body, "sources": sources, "constants": constants}, ensure_ascii=False)


def kept(sets: RuleSets, name: str = "ruleset") -> RuleSets:
    """The tables written once, for sets that are read from long documents and checked and compiled more than once."""
    return RuleSets(*[written(x, name) for x in sets])
