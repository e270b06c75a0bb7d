import json
import random

import pytest

from tallyforge.operators import audiences, opportunity

ITEM = opportunity.ITEM.replace(" ", ":").replace(",:", ",")
RECORD = (
    f"company_id long, tax_year int, rule_id string, category string, status string, title string, rationale string, low long, high long, effect string, evidence array<struct<{ITEM}>>, "
    "missing array<string>, recommended_action string, confidence int, priority double, band string"
)
FIELDS = [f.split()[0] for f in opportunity.ITEM.split(", ")]
LEAST = ["unretrieved", "unreachable", "mismatch", "verified"]


def item(**have):
    return tuple(have.get(f) for f in FIELDS)


def records(r):
    out = []
    for company in range(1, 9):
        for k in r.sample(range(12), r.randrange(0, 9)):
            evidence = [item(kind="document_value", name=f"k{v}", value_ore=v * 101, page=v or None, version_id=r.choice([1, 2, None])) for v in range(r.randrange(3))]
            evidence += [item(kind="rule", name=f"r{k:02}", excerpt=f"T{k}", source=f"Lag {k}")] + [item(kind="assumption", statement=r.choice("xyz")) for _ in range(r.randrange(2))]
            high = r.choice([0, 0, 500, 500, 123_456_789])
            out.append((
                company, 2024, f"r{k:02}", r.choice(["tax", "risk", "new"]), r.choice([*audiences.STATUS]), f"T{k}", "Why.", r.choice([0, high]), high, r.choice(["reduction", "deferral"]), evidence, r.choice([[], ["m"]]),
                r.choice(["Do a.", " Do a. ", "Do b.", " ", None]), r.choice([20, 50, 90]), r.choice([0.1, 0.5, 0.5, 0.9]), r.choice(audiences.BANDS),
            ))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_reports_as_loops(spark, seed):
    r = random.Random(seed)
    rows = records(r)
    states = {f"r{k:02}": r.choices(LEAST, k=r.randrange(3)) for k in range(10)}
    cleared = [(c, f"q{k}", f"Q{k}", "vat", "Ok.") for c in (1, 2, 9) for k in range(r.randrange(3))]
    readers = [(c, f"C{c}", "2024", a) for c in range(1, 11) for a in ("private", "company", "accountant", "other", None)]
    built = audiences.build(
        spark.createDataFrame(readers, "company_id long, name string, fiscal_year string, audience string"), spark.createDataFrame(rows, RECORD).repartition(3),
        spark.createDataFrame(list(states.items()), "rule_id string, states array<string>"), spark.createDataFrame(cleared, "company_id long, rule_id string, title string, category string, reason string"),
        spark.createDataFrame([(1, ["w1", "w2"]), (2, None)], "company_id long, warnings array<string>"),
    )
    got = built.collect()
    assert len(got) == len(readers) and {x.audience for x in got} == set(audiences.AUDIENCES)
    for x in got:
        mine = sorted((y for y in rows if y[0] == x.company_id and y[4] != "rejected"), key=lambda y: (-y[14], y[2]))
        assert [o.title for o in x.opportunities] == [y[5] for y in mine] and x.summary.found_count == len(mine)
        assert [o.title for o in x.start_here] == [y[5] for y in mine if y[15] == "high"] and x.summary.high_priority_count == len(x.start_here)
        assert x.warnings == (["w1", "w2"] if x.company_id == 1 else []) and x.missing_information == [] and x.limitations == []
        for o, y in zip(x.opportunities, mine):
            assert o.rules[0].source_state == min(states.get(y[2]) or ["unretrieved"], key=LEAST.index)
            assert o.category == audiences.CATEGORY.get(y[3], y[3]) and o.impact_display.endswith("uppskjuten skatt") == (y[9] == "deferral" and y[8] > 0)
        sums = {d: tuple(sum(y[b] for y in mine if y[13] >= 50 and y[9] == d) for b in (7, 8)) for d in ("reduction", "deferral")}
        e = x.economic_potential
        assert (e.low, e.high) == sums["reduction"] and (e.deferred_low, e.deferred_high) == sums["deferral"] and (e.deferred_note == "") == (sums["deferral"] == (0, 0))
        said, plan = set(), []
        for y in sorted(mine, key=lambda y: (audiences.BANDS.index(y[15]), -y[8])):
            action = (y[12] or "").strip()
            if action and action not in said:
                said.add(action)
                plan.append((len(plan) + 1, action, y[5], y[15], (y[7], y[8]) if y[8] or y[7] else None, y[4] in ("warning", "investigate")))
        assert [(p.order, p.action, p.title, p.priority_band, p.impact and tuple(p.impact), p.is_control) for p in x.action_plan] == plan
        v = x.evidence
        values = [i for y in mine for i in y[10] if i[0] == "document_value"]
        assert v.values_cited == len(values) and v.document_versions_used == len({i[-1] for i in values} - {None}) and [c.rule_id for c in v.rules_cited] == sorted({y[2] for y in mine})
        assert v.assumptions == sorted({i[FIELDS.index("statement")] for y in mine for i in y[10] if i[0] == "assumption"})
        assert (x.control_review is not None) == (x.audience == "accountant")
        if c := x.control_review:
            assert [o.title for o in c.must_check] == [y[5] for y in mine if y[4] != "identified"] and [o.title for o in c.possible_improvement] == [y[5] for y in mine if y[4] == "identified"]
            assert [o.title for o in c.looks_correct] == [q[2] for q in cleared if q[0] == x.company_id]
            assert [o.summary for o in c.worth_raising] == [y[5] for y in sorted((y for y in mine if y[8] or y[7]), key=lambda y: -y[8])]
    for x in audiences.as_json(built).collect():
        assert ("control_review" in json.loads(x.json)) == (x.audience == "accountant")


def test_markdown_of_nothing_and_of_one(spark):
    record = (1, 2024, "r1", "tax", "verify", "Fond", "Why.", 0, 250_000, "deferral", [item(kind="document_value", name="k", value_ore=100, page=3), item(kind="rule", name="r1", excerpt="Fond", source="Lag")], ["m"], "Do.", 60, 0.4, "high")
    args = spark.createDataFrame([record], RECORD), spark.createDataFrame([("r1", ["mismatch", "verified"])], "rule_id string, states array<string>"), spark.createDataFrame([], "company_id long, rule_id string, title string, category string, reason string")
    readers = spark.createDataFrame([(1, "A", "2024", "accountant"), (2, "B", "2024", "private")], "company_id long, name string, fiscal_year string, audience string")
    text = {x.company_id: x.markdown for x in audiences.as_markdown(audiences.build(readers, *args, service="Tjänsten")).collect()}
    heads = ["1. Sammanfattning", "2. Börja här", "3. Potentiella möjligheter", "4. Varningar", "5. Saknad information", "6. Ekonomisk potential", "7. Evidens", "8. Gör detta nu", "9. Begränsningar"]
    for t in text.values():
        places = [t.index(f"## {h}\n") for h in heads]
        assert places == sorted(places) and t.endswith(f"_Tjänsten{audiences.DISCLAIMER}_\n")
    assert "Vi hittade 1 sak som kan vara värd att undersöka." in text[1] and "## 8b." in text[1] and "**Uppskjuten skatt:**" in text[1] and "(sida 3)" in text[1] and "Fond — Lag (källan motsäger regeln)" in text[1]
    assert "Tjänsten hittade inga tydliga möjligheter" in text[2] and "## 8b." not in text[2] and "Inga åtgärder föreslås" in text[2] and "Uppskjuten" not in text[2] and "Inget fynd har nått hög prioritet" in text[2]


def test_a_sum_that_overflows_is_nothing(spark):
    big = [(1, 2024, f"r{k}", "tax", "verify", "T", "W", 0, 2**62, "reduction", [], [], "Do.", 90, 0.5, "high") for k in range(2)]
    none = spark.createDataFrame([], "rule_id string, states array<string>"), spark.createDataFrame([], "company_id long, rule_id string, title string, category string, reason string")
    x = audiences.build(spark.createDataFrame([(1, "A", "2024", "company")], "company_id long, name string, fiscal_year string, audience string"), spark.createDataFrame(big, RECORD), *none).first()
    assert (x.economic_potential.low, x.economic_potential.high, x.economic_potential.note) == (0, 0, audiences.NO_TOTAL) and x.summary.found_count == 2


def test_sections_are_made_once_a_company(spark):
    """What reports say lies below the step that deals it out to readers, and no step of an action plan sorts and trims all steps again."""
    none = spark.createDataFrame([], "rule_id string, states array<string>"), spark.createDataFrame([], "company_id long, rule_id string, title string, category string, reason string")
    readers = spark.createDataFrame([(c, f"C{c}", "2024", a) for c in (1, 2, None) for a in ("private", "accountant")], "company_id long, name string, fiscal_year string, audience string")
    rejected = (2, 2024, "r1", "tax", "rejected", "T", "W", 0, 500, "reduction", [], [], "Do.", 90, 0.5, "high")
    built = audiences.build(readers, spark.createDataFrame([(1, *rejected[1:4], "verify", *rejected[5:]), rejected], RECORD), *none)
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?U)^\s+") == 1 and plan.index("Generate inline(readers") < plan.index(r"(?U)^\s+")
    got = {(x.company_id, x.audience): x for x in built.collect()}
    assert len(got) == 6 and {k: x.summary.found_count for k, x in got.items() if k[1] == "private"} == {(1, "private"): 1, (2, "private"): 0, (None, "private"): 0}
    assert {k[1] for k, x in got.items() if x.control_review} == {"accountant"} and got[None, "accountant"].name == "CNone" and got[2, "private"].economic_potential.high == 0
