"""An analysis as a report for its reader: a private person, a company, or an accountant, who also gets the review of a closing.

A company has at most one record a rule and year, so its records become one row with arrays, and so do its readers. What a
report says are expressions over that row, made once a company, not once a reader: nothing is shuffled after the records, the
cleared checks and the notes meet by company.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import display
from ..functions.text import once
from . import scoring
from .opportunity import MOST_RULES

AUDIENCES = ("private", "company", "accountant")
# How reports name categories, statuses, states of sources, and what they say.
CATEGORY = {"tax": "Skatt", "costs": "Kostnader", "vat": "Moms", "personnel": "Personal", "investments": "Investeringar", "rnd": "FoU", "risk": "Risk"}
STATUS = {"identified": "Identifierad", "investigate": "Undersök", "verify": "Verifiera", "warning": "Varning", "rejected": "Avvisad"}
STATE = {"verified": "källa kontrollerad", "mismatch": "källan motsäger regeln", "unreachable": "källan kunde inte hämtas"}
UNCHECKED = "källa ej kontrollerad"
NO_EFFECT, DEFERRED = "Ingen beräknad ekonomisk effekt", "uppskjuten skatt"
NOTHING = (
    " hittade inga tydliga möjligheter på det underlag vi fått. Det betyder inte att det inte finns möjligheter — det betyder att vi inte har "
    "tillräckligt stark evidens för att flagga dem."
)
ONE, MANY = "sak som kan vara värd att undersöka", "saker som kan vara värda att undersöka"
NO_TOTAL = "Ingen beräknad sänkning av skatten på det underlag som lämnats."
TOTAL = "Ett intervall, inte ett besked. Beloppen bygger på det underlag som lämnats och ska verifieras innan någon åtgärd vidtas."
LATER = (
    "Uppskjuten skatt, inte sänkt skatt. Beloppet betalas senare — en periodiseringsfond ska återföras senast det sjätte året, och en "
    "schablonintäkt tas upp varje år fonden står kvar. Det är därför inte medräknat i beloppet ovan."
)
DISCLAIMER = (
    " är ett analys- och upptäcktsverktyg. Resultaten är preliminära och ska inte betraktas som juridisk rådgivning, revisionsuttalande, "
    "skattebesked eller garanti om skatteåterbäring eller besparing. Identifierade möjligheter bör verifieras mot aktuella regler och företagets "
    "fullständiga underlag innan någon åtgärd vidtas."
)
UNCLEARED = (
    "Ingen regel kunde prövas mot avlästa värden och avfärdas. Det betyder inte att något är fel — det betyder att underlaget inte räckte "
    "för att friskförklara något.\n"
)
BANDS = ("high", "should_investigate", "needs_more_evidence")
TO_CHECK = ("warning", "investigate", "verify")
NOTES = {
    "areas": "array<struct<category:string,n_rules:bigint,n_findings:bigint>>", "warnings": "array<string>",
    "missing": "array<struct<description:string,unlocks:string>>", "next_steps": "array<string>", "limitations": "array<string>",
}


def span_text(low: Column, high: Column) -> Column:
    return F.when(low == high, display(low)).otherwise(F.concat(display(low), F.lit("–"), display(high)))


def _named(key: Column, names: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key), other)


def _none(low: Column, high: Column) -> Column:
    return (low == 0) & (high == 0)


def _of(evidence: Column, kind: str) -> Column:
    return F.filter(evidence, lambda e: e["kind"] == kind)


def highlights(records: DataFrame, states: DataFrame) -> DataFrame:
    """``records`` (see opportunity.records) with a column ``shown``: what a report says of each.

    states: rule_id, states (of the sources a rule cites), at most MOST_RULES rows. The state that is named is the plain
    least of them, so a mismatch can hide behind a source that was not read.
    """
    if states.count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    small = states.select("rule_id", scoring.plain_weakest(F.col("states")).alias("source_state"))
    rows = records.join(F.broadcast(small), "rule_id", "left")
    low, high = F.col("low"), F.col("high")
    amount = F.when(_none(low, high), NO_EFFECT).when(F.col("effect") == "deferral", F.concat(span_text(low, high), F.lit(f" {DEFERRED}"))).otherwise(span_text(low, high))
    values = F.transform(_of(F.col("evidence"), "document_value"), lambda e: F.struct(e["name"].alias("kind"), display(e["value_ore"]).alias("amount"), e["page"].alias("page"), e["excerpt"].alias("excerpt")))
    state = F.coalesce("source_state", F.lit("unretrieved"))
    rules = F.transform(_of(F.col("evidence"), "rule"), lambda e: F.struct(e["name"].alias("rule_id"), e["excerpt"].alias("title"), e["source"].alias("source"), state.alias("source_state")))
    return rows.withColumn("shown", F.struct(
        "title", _named(F.col("category"), CATEGORY, F.col("category")).alias("category"), "status", _named(F.col("status"), STATUS, F.col("status")).alias("status_label"),
        "low", "high", amount.alias("impact_display"), "effect", "confidence", F.col("band").alias("priority_band"), "rationale", "recommended_action",
        F.col("missing").alias("missing_information"), values.alias("supporting_values"), rules.alias("rules"),
    ))


def action_plan(items: Column) -> Column:
    """Highlights in order to numbered steps: by band, then highest amount, then as they were; a step that says the same again goes."""
    rank = lambda x: F.when(x["priority_band"].isin(*BANDS), F.array_position(F.array(*map(F.lit, BANDS)), x["priority_band"])).otherwise(len(BANDS) + 1)
    steps = F.sort_array(F.transform(items, lambda x, i: F.struct(
        rank(x).alias("rank"), (-x["high"]).alias("least"), i.alias("seq"), F.regexp_replace(F.coalesce(x["recommended_action"], F.lit("")), r"(?U)^\s+|\s+$", "").alias("action"),
        x["title"].alias("title"), x["priority_band"].alias("priority_band"), x["low"].alias("low"), x["high"].alias("high"), x["status"].isin("warning", "investigate").alias("is_control"),
    )))
    first = lambda said: once(F.transform(said, lambda y: y["action"]), lambda actions: F.filter(said, lambda x, i: F.array_position(actions, x["action"]) == i + 1))
    kept = once(F.filter(steps, lambda x: x["action"] != ""), first)
    span = lambda x: F.when(~_none(x["low"], x["high"]), F.struct(x["low"].alias("low"), x["high"].alias("high")))
    return F.transform(kept, lambda x, i: F.struct((i + 1).alias("order"), x["action"].alias("action"), x["title"].alias("title"), x["priority_band"].alias("priority_band"), span(x).alias("impact"), x["is_control"].alias("is_control")))


def review(items: Column, correct: Column) -> Column:
    """What an accountant goes through: findings to check first, those to act on, rules that were tried and don't apply, and what is
    worth a call, the highest amount first."""
    with_amount = F.filter(items, lambda x: ~_none(x["low"], x["high"]))
    order = F.sort_array(F.transform(with_amount, lambda x, i: F.struct((-x["high"]).alias("least"), i.alias("seq"), x["category"].alias("area"), x["title"].alias("summary"), x["low"].alias("low"), x["high"].alias("high"))))
    raised = F.transform(order, lambda x: F.struct(x["area"].alias("area"), x["summary"].alias("summary"), x["low"].alias("low"), x["high"].alias("high"), span_text(x["low"], x["high"]).alias("impact_display")))
    return F.struct(
        F.filter(items, lambda x: x["status"].isin(*TO_CHECK)).alias("must_check"), F.filter(items, lambda x: ~x["status"].isin(*TO_CHECK)).alias("possible_improvement"),
        correct.alias("looks_correct"), raised.alias("worth_raising"),
    )


def build(readers: DataFrame, records: DataFrame, states: DataFrame, cleared: DataFrame, notes: DataFrame | None = None, version: str = "1", service: str = "Analysen", least_confidence: int = 50) -> DataFrame:
    """One report a row of ``readers`` (company_id, name, fiscal_year, audience); an unknown or null audience reads as a company.

    records: see opportunity.records, in any order; states: see highlights. cleared: company_id, rule_id, title, category,
    reason. notes: at most one row a company, of those columns in NOTES that it has; what it lacks or leaves null is empty.
    A company without records has a report that says so. Rejected records are not shown and count nothing; sums leave out
    records below ``least_confidence``, and one that overflows makes its whole range nothing.
    """
    rows, shown = highlights(records, states), F.col("status") != "rejected"

    def total(bound: str, deferral: bool) -> Column:
        counts = (F.coalesce("confidence", F.lit(0)) >= least_confidence) & (F.coalesce("effect", F.lit("")) == "deferral" if deferral else F.coalesce("effect", F.lit("")) != "deferral")
        return F.try_sum(F.when(shown & counts, F.col(bound)).otherwise(0).cast("bigint"))

    order = F.struct((-F.coalesce("priority", F.lit(0.0))).alias("least"), "rule_id", "tax_year", "shown", _of(F.col("evidence"), "assumption")["statement"].alias("assumptions"), F.transform(_of(F.col("evidence"), "document_value"), lambda e: e["version_id"]).alias("versions"))
    per = rows.groupBy("company_id").agg(F.sort_array(F.collect_list(F.when(shown, order))).alias("all"), *[total(b, d).alias(f"{'later_' if d else ''}{b}") for d in (False, True) for b in ("low", "high")])
    line = F.struct("rule_id", "title", _named(F.col("category"), CATEGORY, F.col("category")).alias("category"), "reason")
    tried = cleared.groupBy("company_id").agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x.dropFields("rule_id")).alias("correct"))
    reader = F.struct("name", "fiscal_year", F.when(F.col("audience").isin(*AUDIENCES), F.col("audience")).otherwise("company").alias("audience"))
    out = readers.groupBy("company_id").agg(F.collect_list(reader).alias("readers"))
    out = out.join(per, "company_id", "left").join(tried, "company_id", "left")
    if notes is not None:
        out = out.join(notes.select("company_id", *[c for c in NOTES if c in notes.columns]), "company_id", "left")
    empty = lambda c, kind: F.coalesce(F.col(c) if c in out.columns else F.lit(None).cast(kind), F.array().cast(kind))
    kinds = {f.name: f.dataType for f in out.schema}
    whole = lambda low, high, bound: F.when(F.col(low).isNotNull() & F.col(high).isNotNull(), F.col(bound)).otherwise(0)
    out = out.withColumns({
        "all": empty("all", kinds["all"]), "correct": empty("correct", kinds["correct"]), **{c: empty(c, k) for c, k in NOTES.items()},
        "low": whole("low", "high", "low"), "high": whole("low", "high", "high"), "later_low": whole("later_low", "later_high", "later_low"), "later_high": whole("later_low", "later_high", "later_high"),
    })
    out = out.withColumn("opportunities", F.transform("all", lambda x: x["shown"]))
    items = F.col("opportunities")
    count = lambda band: F.size(F.filter(items, lambda x: x["priority_band"] == band))
    found = F.size(items)
    headline = F.when(found == 0, f"{service}{NOTHING}").otherwise(F.concat(F.lit("Vi hittade "), found.cast("string"), F.lit(" "), F.when(found == 1, ONE).otherwise(MANY), F.lit(".")))
    rules = F.sort_array(F.flatten(F.transform(items, lambda x: x["rules"])))
    cited = once(rules, lambda c: F.filter(c, lambda x, i: (i == 0) | (x["rule_id"] != F.get(c, i - 1)["rule_id"])))
    none, no_later = _none(F.col("low"), F.col("high")), _none(F.col("later_low"), F.col("later_high"))
    reviewed = F.when(F.exists("readers", lambda r: r["audience"] == "accountant"), review(items, F.col("correct")))
    out = out.select(
        "company_id", "readers",
        F.struct(headline.alias("headline"), found.alias("found_count"), count("high").alias("high_priority_count"), count("should_investigate").alias("should_investigate_count"), count("needs_more_evidence").alias("needs_more_evidence_count"), F.size("warnings").alias("warnings_count"), F.col("areas").alias("areas_checked")).alias("summary"),
        F.filter(items, lambda x: x["priority_band"] == "high").alias("start_here"), "opportunities", "warnings", F.col("missing").alias("missing_information"),
        F.struct(
            "low", "high", span_text(F.col("low"), F.col("high")).alias("display"), F.when(none, NO_TOTAL).otherwise(TOTAL).alias("note"),
            F.col("later_low").alias("deferred_low"), F.col("later_high").alias("deferred_high"), span_text(F.col("later_low"), F.col("later_high")).alias("deferred_display"), F.when(no_later, "").otherwise(LATER).alias("deferred_note"),
        ).alias("economic_potential"),
        F.struct(
            F.size(F.array_compact(F.array_distinct(F.flatten(F.transform("all", lambda x: x["versions"]))))).alias("document_versions_used"),
            F.aggregate(items, F.lit(0), lambda n, x: n + F.size(x["supporting_values"])).alias("values_cited"), cited.alias("rules_cited"),
            F.array_sort(F.array_distinct(F.flatten(F.transform("all", lambda x: x["assumptions"])))).alias("assumptions"),
        ).alias("evidence"),
        "next_steps", "limitations", action_plan(items).alias("action_plan"), reviewed.alias("control_review"),
    )
    return out.select("*", F.inline("readers")).select(
        "company_id", "name", "fiscal_year", F.lit(version).alias("rule_set_version"), "audience", "summary", "start_here", "opportunities", "warnings", "missing_information", "economic_potential", "evidence",
        "next_steps", "limitations", "action_plan", F.when(F.col("audience") == "accountant", F.col("control_review")).alias("control_review"), F.lit(f"{service}{DISCLAIMER}").alias("disclaimer"),
    )


def as_json(report: DataFrame) -> DataFrame:
    """company_id, audience, json; without what is null, so the review only where there is one."""
    return report.select("company_id", "audience", F.to_json(F.struct(*report.columns)).alias("json"))


def _each(items: Column, line, empty: str = "") -> Column:
    return F.when(F.size(items) == 0, empty).otherwise(F.array_join(F.transform(items, line), ""))


def _text(*parts) -> Column:
    """Parts one after another; what is null is left out."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def as_markdown(report: DataFrame, title: str = "Din rapport") -> DataFrame:
    """company_id, audience, markdown: nine sections, each of which says so where it is empty, and the review after the eighth."""
    c = F.col
    rule = lambda indent: lambda r: _text(f"{indent}- ", r["title"], " — ", r["source"], " (", _named(r["source_state"], STATE, F.lit(UNCHECKED)), ")\n")
    block = lambda head, items, line: F.when(F.size(items) == 0, "").otherwise(_text(f"- {head}:\n", _each(items, line)))
    value = lambda v: _text("  - ", v["kind"], " ", v["amount"], F.when(v["page"].isNotNull(), _text(" (sida ", v["page"], ")")), "\n")
    opening = lambda x: _text("- **", x["title"], "** — ", x["recommended_action"], "\n")
    whole = lambda x: _text(
        "### ", x["title"], " (", x["category"], ")\n\n", x["rationale"], "\n\n- Potentiell ekonomisk påverkan: ", x["impact_display"], "\n- Status: ", x["status_label"], "\n- Confidence: ", x["confidence"], " %\n",
        block("Underlag", x["supporting_values"], value), block("Regler", x["rules"], rule("  ")), block("Saknas", x["missing_information"], lambda m: _text("  - ", m, "\n")),
        "- Rekommenderad åtgärd: ", x["recommended_action"], "\n\n",
    )
    step = lambda s: _text(
        s["order"], ". **", s["title"], "** (", F.when(s["is_control"], "Kontroll").otherwise("Möjlighet"), F.when(s["impact"].isNotNull(), _text(" — ", span_text(s["impact"]["low"], s["impact"]["high"]))), ")\n   ", s["action"], "\n",
    )
    s, e, v, r = c("summary"), c("economic_potential"), c("evidence"), c("control_review")
    checked = _text(
        "## 8b. Kontroll av bokslutet\n\n### Måste kontrolleras (", F.size(r["must_check"]), ")\n\n", _each(r["must_check"], opening, "Inget som måste kontrolleras på det här underlaget.\n"),
        "\n### Möjlig förbättring (", F.size(r["possible_improvement"]), ")\n\n", _each(r["possible_improvement"], lambda x: _text("- **", x["title"], "** — ", x["impact_display"], " (", x["status_label"], ")\n")),
        "\n### Ser korrekt ut (", F.size(r["looks_correct"]), ")\n\n", _each(r["looks_correct"], lambda x: _text("- **", x["title"], "** — ", x["reason"], "\n"), UNCLEARED),
        "\n### Värt att ta upp med kunden (", F.size(r["worth_raising"]), ")\n\n", _each(r["worth_raising"], lambda x: _text("- ", x["summary"], " — ", x["impact_display"], " (", x["area"], ")\n")), "\n",
    )
    return report.select("company_id", "audience", _text(
        f"# {title}\n\n**", c("name"), "** · räkenskapsår ", c("fiscal_year"), " · regelverk ", c("rule_set_version"), "\n\n## 1. Sammanfattning\n\n", s["headline"], "\n\n- ", s["high_priority_count"], " hög prioritet\n- ",
        s["should_investigate_count"], " bör undersökas\n- ", s["needs_more_evidence_count"], " kräver mer underlag\n- ", s["warnings_count"], " varningar\n\n",
        "## 2. Börja här\n\n", _each(c("start_here"), opening, "Inget fynd har nått hög prioritet på det här underlaget.\n\n"), "\n## 3. Potentiella möjligheter\n\n", _each(c("opportunities"), whole, "Inga.\n\n"),
        "## 4. Varningar\n\n", _each(c("warnings"), lambda w: _text("- ", w, "\n"), "Inga.\n\n"),
        "\n## 5. Saknad information\n\n", _each(c("missing_information"), lambda m: _text("- ", m["description"], " — ", m["unlocks"], "\n"), "Inget ytterligare underlag efterfrågas.\n\n"),
        "\n## 6. Ekonomisk potential\n\n**Lägre skatt:** ", e["display"], "\n\n", e["note"], "\n\n", F.when(~_none(e["deferred_low"], e["deferred_high"]), _text("**Uppskjuten skatt:** ", e["deferred_display"], "\n\n", e["deferred_note"], "\n\n")),
        "## 7. Evidens\n\n", v["document_versions_used"], " dokumentversion(er), ", v["values_cited"], " citerade värden, ", F.size(v["rules_cited"]), " regler.\n\n", _each(v["rules_cited"], rule("")),
        F.when(F.size(v["assumptions"]) > 0, _text("\nAntaganden:\n", _each(v["assumptions"], lambda a: _text("- ", a, "\n")))), "\n## 8. Gör detta nu\n\n", _each(c("action_plan"), step, "Inga åtgärder föreslås på det här underlaget.\n\n"), "\n",
        F.when(r.isNotNull(), checked), "## 9. Begränsningar\n\n", _each(c("limitations"), lambda x: _text("- ", x, "\n")), "\n---\n\n_", c("disclaimer"), "_\n",
    ).alias("markdown"))
