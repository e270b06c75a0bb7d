"""Confidence, priority and status of findings. The order of the double operations is kept, so that halves round as published."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of document evidence, rule match, calculation, missing facts, contradiction, agreement.
WEIGHTS = (0.25, 0.25, 0.15, 0.15, 0.10, 0.10)


def unit(x: Column) -> Column:
    """Into [0, 1]; NaN is 0."""
    return F.when(F.isnan(x), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def confidence(evidence: Column, match: Column, calculation: Column, lacking: Column, contradiction: Column, agreement: Column) -> Column:
    """0 to 100. At most 49 without a rule match, without evidence, or with a contradiction of a half or more."""
    e, m, c, x, k, a = map(unit, (evidence, match, calculation, lacking, contradiction, agreement))
    parts = (e, m, c, 1.0 - x, 1.0 - k, a)
    total = parts[0] * F.lit(WEIGHTS[0])
    for w, p in zip(WEIGHTS[1:], parts[1:]):
        total = total + p * F.lit(w)
    score = F.round(total / F.lit(sum(WEIGHTS)) * 100).cast("int")
    return F.when((m < 1e-9) | (k >= 0.5) | (e < 1e-9), F.least(score, F.lit(49))).otherwise(score)


def band(score: Column) -> Column:
    return F.when(score >= 90, "strong").when(score >= 75, "good").when(score >= 50, "moderate").otherwise("weak")


def priority(mid_ore: Column, conf: Column, relevance: Column, urgency: Column, effort: Column) -> Column:
    """Money up to 200 000 kr, times confidence, relevance and urgency (normal 1, soon 1.15, now 1.3), over effort (low 1, medium 1.6, high 2.5)."""
    amount = F.least(F.abs(mid_ore) / F.lit(20_000_000.0), F.lit(1.0))
    pressed = F.when(urgency == "now", 1.3).when(urgency == "soon", 1.15).otherwise(1.0)
    work = F.when(effort == "high", 2.5).when(effort == "medium", 1.6).otherwise(1.0)
    return unit(amount * (conf / 100.0) * relevance * pressed / work)


def risk_priority(conf: Column, risk: Column) -> Column:
    return conf / 100.0 * F.when(risk == "high", 0.9).when(risk == "medium", 0.6).otherwise(0.3)


def status(survives: Column, category: Column, outcome: Column, actionable: Column, source: Column, grounded: Column) -> Column:
    """The first that holds: rejected, warning, investigate, verify, identified."""
    doubtful = (outcome == "indeterminate") | ~actionable | (source == "mismatch")
    return F.when(~survives, "rejected").when(category == "risk", "warning").when(doubtful, "investigate").when(~grounded, "verify").otherwise("identified")


def weakest_source(states: Column) -> Column:
    """Of an array of states the weakest; a mismatch beats all; none is unretrieved."""
    order = F.array(*map(F.lit, ("unretrieved", "unreachable", "verified")))
    least = F.array_min(F.transform(states, lambda s: F.array_position(order, s)))
    return F.when(F.array_contains(states, "mismatch"), "mismatch").otherwise(F.coalesce(F.try_element_at(order, least.cast("int")), F.lit("unretrieved")))


def rule_factors(traceable: Column, needed: Column, outcome: Column, has_calculation: Column, has_impact: Column, n_missing: Column, n_questions: Column, objection: Column, corroborated: Column) -> tuple[Column, ...]:
    """The six factors of a rule's finding: traceable facts of those needed; 1, 0.4 or 0 by outcome; 1 for a figure, 0.7 for a
    rule that has none, 0.2 for one that should have; gaps of what could be lacking; the objection; 1 if corroborated, else 0.5."""
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.greatest(b, F.lit(1)))
    match = F.when(outcome == "matched", 1.0).when(outcome == "indeterminate", 0.4).otherwise(0.0)
    calculation = F.when(has_calculation, 1.0).when(~has_impact, 0.7).otherwise(0.2)
    lacking = (n_missing + n_questions) / (F.greatest(needed, F.lit(1)) + n_questions)
    return share(traceable, needed), match, calculation, lacking, F.coalesce(objection, F.lit(0.0)), F.when(corroborated, 1.0).otherwise(0.5)


def candidate_factors(anchored: Column, supporting: Column, n_missing: Column, objection: Column) -> tuple[Column, ...]:
    """The six factors of a finding that no rule covers: anchored facts of those named, no match and no calculation."""
    return anchored / F.greatest(supporting, F.lit(1)), F.lit(0.0), F.lit(0.0), F.when(n_missing == 0, 0.4).otherwise(0.8), F.coalesce(objection, F.lit(0.0)), F.lit(1.0)


def priority_band(score: Column, conf: Column) -> Column:
    """needs_more_evidence below a confidence of 50; else high from a score of 0.5; else needs_more_evidence below 75."""
    return F.when(conf < 50, "needs_more_evidence").when(score >= 0.5, "high").when(conf < 75, "needs_more_evidence").otherwise("should_investigate")


def risk_band(conf: Column, risk: Column) -> Column:
    return F.when(conf < 50, "needs_more_evidence").when(risk == "high", "high").otherwise("should_investigate")


def plain_weakest(states: Column) -> Column:
    """As reports have it: the least of the order, in which a mismatch stands above what was not read; none is unretrieved."""
    order = F.array(*map(F.lit, ("unretrieved", "unreachable", "mismatch", "verified")))
    least = F.array_min(F.transform(states, lambda s: F.array_position(order, s)))
    return F.coalesce(F.try_element_at(order, least.cast("int")), F.lit("unretrieved"))
