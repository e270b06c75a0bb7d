import json
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import variants
from tallyforge.operators import rules, rulesets
from tallyforge.sources.documents import json_lines

SOURCE = {"locator": "1 kap. 2 §", "asserted_claim": "x", "state": "verified", "sha256": "h", "at": "2024"}
CITES = {r.id: ["a"] for r in rules.RULES}


def sets(spark, *bodies):
    rows = [(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return rulesets.read(spark.createDataFrame(rows, "set_id int, body string"))


def good():
    return json.loads(rulesets.dump(rules.RULES, "1", "SE", {"a": dict(SOURCE)}, [{"tax_year": 2024, "parameters": {"k": {"amount": 5, "source": "a"}, "r": {"rate_bp": 7, "source": "a"}}}], CITES))


def broken():
    """A document for each kind of defect: (change, what is found)."""
    def rule(i, **have):
        return lambda d: d["rules"][i].update(have)

    first, second = rules.RULES[0].id, rules.RULES[1].id
    used = {"all": [{"compare": [{"mul_rate": [{"constant": "k"}, "r"]}, "gt", {"amount": 1}]}]}
    lost = {"all": [{"compare": [{"mul_rate": [{"constant": "no"}, "none"]}, "gt", {"constant": "r"}]}]}
    years = {"tax_year": 2030, "parameters": {}}
    return [
        (rule(0, tax_year_to=2000), {(first, "tax_year_to", "year_order", "2023-2000")}),
        (rule(0, jurisdiction="NO"), {(first, "jurisdiction", "jurisdiction", "NO")}),
        (rule(0, jurisdiction=None), {(first, "jurisdiction", "jurisdiction", None)}),
        (rule(0, relevance=1.01), {(first, "relevance", "relevance", None)}),
        (rule(0, relevance="much"), {(first, "relevance", "relevance", None)}),
        (rule(0, sources=[]), {(first, "sources", "no_source", None)}),
        (rule(0, sources=None), {(first, "sources", "no_source", None)}),
        (rule(0, sources=["a", "zz", "zz"]), {(first, "sources", "unknown_source", "zz")}),
        (rule(0, conditions=used), set()),
        (rule(0, conditions=lost), {(first, "conditions", "unknown_constant", "2024 no"), (first, "conditions", "unknown_constant", "2024 r"), (first, "conditions", "unknown_rate", "2024 none")}),
        (rule(0, exceptions=[{"id": "constant", "when": lost}]), {(first, "exceptions", "unknown_constant", "2024 no"), (first, "exceptions", "unknown_constant", "2024 r"), (first, "exceptions", "unknown_rate", "2024 none")}),
        (rule(0, impact={"low": {"constant": "k"}, "high": {"mul_rate": [{"amount": 1}, "q"]}}), {(first, "impact", "unknown_rate", "2024 q")}),
        (lambda d: (rule(0, conditions=used)(d), d["constants"].append(years)), {(first, "conditions", "unknown_constant", "2030 k"), (first, "conditions", "unknown_rate", "2030 r")}),
        (lambda d: (rule(0, conditions=used, tax_year_to=2029)(d), d["constants"].append(years)), set()),
        (rule(0, conditions={"all": [{"sometimes": [{"fact": "wages"}]}]}), {(first, "conditions", "unknown_operator", "sometimes")}),
        (rule(1, rule_id=first), {(first, "rule_id", "duplicate", "2"), (first, "tax_year_from", "overlap", "2023")}),
        (lambda d: (rule(1, rule_id=first, tax_year_from=2026)(d), rule(0, tax_year_to=2025)(d)), {(first, "rule_id", "duplicate", "2")}),
        (rule(1, rule_id=None), {(None, "rule_id", "no_id", "1")}),
        (lambda d: d["sources"]["a"].update(sha256=""), {("a", "sha256", "no_hash", None)}),
        (lambda d: d["sources"]["a"].update(at=None), {("a", "at", "no_time", None)}),
        (lambda d: d["sources"]["a"].update(at=None, state="mismatch"), set()),
        (lambda d: d["sources"]["a"].update(asserted_claim="  "), {("a", "asserted_claim", "no_claim", None)}),
        (lambda d: d["sources"]["a"].update(locator=""), {("a", "locator", "no_locator", None)}),
        (lambda d: d["constants"][0]["parameters"]["k"].update(source="zz"), {("k", "parameters 2024", "unknown_source", "zz")}),
        (rule(1, description="not looked at"), set()),
    ] + [(lambda d: None, set())] + [(rule(2, rule_id=second), {(second, "rule_id", "duplicate", "2"), (second, "tax_year_from", "overlap", "2023")})]


def test_every_defect_has_its_row(spark):
    cases, bodies = broken(), []
    for change, _ in cases:
        d = good()
        change(d)
        bodies.append(d)
    got = {i: set() for i in range(len(cases))}
    for x in rulesets.problems(sets(spark, *bodies, None, "no json", {}), 5).collect():
        got[x.set_id].add((x.subject, x.field, x.problem, x.detail))
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, i


def test_rules_come_back_from_json(spark):
    s = sets(spark, good(), "no json")
    assert rulesets.compiled(s, 0) == rules.RULES and rulesets.compiled(s, 1) == []
    bad = good()
    bad["rules"][3]["sources"] = ["zz"]
    with pytest.raises(rules.RuleFault, match="unknown_source zz"):
        rulesets.compiled(sets(spark, bad), 0)


def tree(r, depth):
    k = r.randrange(7)
    if not depth or k < 3:
        return r.choice([1, -5, "x", "", None, True, 2.5, "a b", 10**12])
    if k < 5:
        return {r.choice(["a_b", "c", "d_", "Z", "é"]) + str(i): tree(r, depth - 1) for i in range(r.randrange(4))}
    return [tree(r, depth - 1) for _ in range(r.randrange(4))]


def test_flat_lines(spark):
    """As the reader of single files has it, with members in the order of their names; deep trees are taken apart too."""
    r, deep = random.Random(1), 3
    for _ in range(10):
        deep = {"a": [deep]}
    rows = [(i, json.dumps(tree(r, 9))) for i in range(150)] + [(900, None), (901, "{bad"), (902, "[]"), (903, json.dumps(deep)), (904, '{"a": 1, "a": 2}'), (905, "7")]
    got = {x.id: x.lines for x in variants.flat_lines(spark.createDataFrame(rows, "id int, t string"), "id", F.col("t")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = t if t is None or i in (901, 904) else json_lines(json.dumps(json.loads(t), sort_keys=True))
        assert got[i] == want, t


def test_sets_are_made_once(spark):
    """All checks read the sets as they were written, so none makes them from the tables again."""
    from tallyforge.plans import catalog

    made = catalog.QUERIES["rule_set_problems"](spark, "/root/testdata/sf0.001")
    read = made.inputFiles()
    assert read and not [f for f in read if "/testdata/" in f]
