"""Queries over facts, rules, scores and findings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import money
from ..operators import facts as fx
from ..operators import findings as fd
from ..operators import report as rp
from ..operators import rules, scoring
from .adapters import COMPANIES_SQL, FACTS_SQL, PRIORITY_KIND, companies, facts, ore, read
from .catalog import query

KINDS = sorted(PRIORITY_KIND.values())
_BEST = f"best as (select company_id, kind, value_ore, confidence, seq, n_readings from (select *, row_number() over (partition by company_id, kind order by confidence desc, seq) as r, count(*) over (partition by company_id, kind) as n_readings from ({FACTS_SQL})) where r = 1)"
_WIDE = "wide as (select company_id, " + ", ".join(f"max(case when kind = '{k}' then value_ore end) as f_{k}" for k in KINDS) + " from best group by company_id)"
_ROWS = f"{_BEST}, {_WIDE}, rows as (select c.*, " + ", ".join(f"f_{k}" for k in KINDS) + f" from ({COMPANIES_SQL}) c left join wide w on c.company_id = w.company_id)"


def mul(x: str, bp: int) -> str:
    return f"(case when ({x}) * {bp} >= 0 then (({x}) * {bp} + 5000) // 10000 else -((-(({x}) * {bp}) + 5000) // 10000) end)"


@query("canonical_facts", f"with {_BEST} select company_id, kind, value_ore, confidence, seq, n_readings from best")
def canonical_facts(spark, sf):
    return fx.canonical(facts(spark, sf))


@query("all_readings", f"select company_id, kind, value_ore, confidence, seq, row_number() over (partition by company_id, kind order by confidence desc, seq)::int as place from ({FACTS_SQL})")
def all_readings(spark, sf):
    return fx.all_readings(facts(spark, sf))


@query("contradictions", f"select company_id, kind, first_ore, value_ore as other_ore, seq from (select *, first_value(value_ore) over (partition by company_id, kind order by seq) as first_ore from ({FACTS_SQL})) where value_ore <> first_ore")
def contradictions(spark, sf):
    return fx.contradictions(facts(spark, sf))


@query("facts_wide", f"with {_BEST}, {_WIDE} select * from wide")
def facts_wide(spark, sf):
    return fx.wide(fx.canonical(facts(spark, sf)), KINDS)


def _wide_rows(spark, sf):
    wide = fx.wide(fx.canonical(facts(spark, sf)), KINDS)
    return companies(spark, sf).join(wide, "company_id", "left")


@query("missing_facts", f"with {_ROWS} select company_id, array_to_string(list_filter([" + ", ".join(f"case when f_{k} is null then '{k}' end" for k in KINDS) + "], lambda x: x is not null), ',') as missing from rows")
def missing_facts(spark, sf):
    rows = _wide_rows(spark, sf)
    return rows.select("company_id", F.array_join(fx.missing({k: F.col(f"f_{k}") for k in KINDS}), ",").alias("missing"))


@query("balance_check", f"with {_ROWS} select company_id, f_equipment = f_depreciation as balances, f_equipment is not null and f_depreciation is not null as known from rows")
def balance_check(spark, sf):
    a, b = F.col("f_equipment"), F.col("f_depreciation")
    return _wide_rows(spark, sf).select("company_id", (a == b).alias("balances"), (a.isNotNull() & b.isNotNull()).alias("known"))


@query("implausible_facts", f"select company_id, kind, arg_min(value_ore, seq) as value_ore from ({FACTS_SQL}) where abs(value_ore) > 40000000 group by company_id, kind")
def implausible_facts(spark, sf):
    return fx.implausible(facts(spark, sf), "revenue", 40_000_000)


@query("mul_bp_rounding", "select l_orderkey, l_linenumber, l_partkey, l_quantity, v, " + mul("v", 2060) + " as tax, " + mul("-v", 2060) + " as tax_back from (select l_orderkey, l_linenumber, l_partkey, l_quantity, cast(round(l_extendedprice * 100) as bigint) as v from lineitem)")
def mul_bp_rounding(spark, sf):
    v = ore("l_extendedprice")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", v.alias("v"), money.mul_bp(v, 2060).alias("tax"), money.mul_bp(-v, 2060).alias("tax_back"))


@query("money_overflow", "select o_orderkey, try_cast((v::hugeint * 100000000000000)::hugeint as bigint) as product, try_cast(9223372036854775807::hugeint - 1000000 * o_orderkey + v as bigint) as total from (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as v from orders)")
def money_overflow(spark, sf):
    v, key = ore("o_totalprice"), F.col("o_orderkey")
    near = F.lit(9223372036854775807) - F.lit(1_000_000).cast("bigint") * key
    return read(spark, sf, "orders").select("o_orderkey", F.try_multiply(v, F.lit(100_000_000_000_000)).alias("product"), money.add(near, v).alias("total"))


@query("expr_min_max_strict", f"with {_ROWS} select company_id, case when f_equipment is not null and f_depreciation is not null then least(f_equipment, f_depreciation) end as low, case when f_equipment is not null and f_depreciation is not null then greatest(f_equipment, f_depreciation) end as high, case when f_equipment is not null and f_depreciation is not null then greatest(f_equipment - f_depreciation, 0) end as left_over from rows")
def expr_min_max_strict(spark, sf):
    a, b = F.col("f_equipment"), F.col("f_depreciation")
    return _wide_rows(spark, sf).select("company_id", money.least_strict(a, b).alias("low"), money.greatest_strict(a, b).alias("high"), money.at_least_zero(money.sub(a, b)).alias("left_over"))


@query("money_display", "select o_orderkey, case when v < 0 then '-' else '' end || replace(format('{:,}', abs(v) // 100), ',', chr(160)) || ',' || lpad((abs(v) % 100)::varchar, 2, '0') || chr(160) || 'kr' as shown from (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as v from orders)")
def money_display(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", money.display(ore("o_totalprice")).alias("shown"))


@query("kleene_rules", f"select company_id, in_group and ownership_changed as both, in_group or ownership_changed as either, not in_group as no_group, (in_group and not ownership_changed) or owner_count <= 4 as mixed from ({COMPANIES_SQL})")
def kleene_rules(spark, sf):
    names = rules.Names([], rules.PROFILE)
    a, b = {"profile": ["in_group", True]}, {"profile": ["ownership_changed", True]}
    trees = {"both": {"all": [a, b]}, "either": {"any": [a, b]}, "no_group": {"not": a}, "mixed": {"any": [{"all": [a, {"not": b}]}, {"profile_number": ["owner_count", "le", 4]}]}}
    return companies(spark, sf).select("company_id", *[rules.condition(t, names).alias(k) for k, t in trees.items()])


@query("profile_conditions", f"select company_id, has_vehicles = true as vehicles, employee_count >= 20 as large, nullif(accounts_state, 'unknown') = 'final' as final, tax_year >= 2023 and tax_year <= 2025 as in_years from ({COMPANIES_SQL})")
def profile_conditions(spark, sf):
    names = rules.Names([], rules.PROFILE)
    trees = {"vehicles": {"profile": ["has_vehicles", True]}, "large": {"profile_number": ["employee_count", "ge", 20]}, "final": {"accounts_state": "final"}, "in_years": {"all": [{"tax_year_at_least": 2023}, {"tax_year_at_most": 2025}]}}
    return companies(spark, sf).select("company_id", *[rules.condition(t, names).alias(k) for k, t in trees.items()])


@query("unanswered_questions", f"select company_id, array_to_string(list_filter([" + ", ".join(f"case when {k} is null then '{k}' end" for k in rules.PROFILE[:7]) + f"], lambda x: x is not null), ',') as unanswered from ({COMPANIES_SQL})")
def unanswered_questions(spark, sf):
    return companies(spark, sf).select("company_id", F.array_join(fx.missing({k: F.col(k) for k in rules.PROFILE[:7]}), ",").alias("unanswered"))


def evaluated(spark, sf):
    rows = _wide_rows(spark, sf)
    rows = rows.withColumns({f"f_{k}": F.lit(None).cast("bigint") for k in rules.KINDS if f"f_{k}" not in rows.columns})
    return rules.evaluate(rows, rules.RULES, rules.Names(rules.KINDS, rules.PROFILE))


_QUARTER, _HEAD, _LOSS = mul("f_taxable_result", 2500), f"({mul('f_equipment', 3000)} - f_depreciation)", "case when f_carried_forward_loss is not null and f_taxable_result is not null then least(f_carried_forward_loss, f_taxable_result) end"
# Rules of facts that no order stands for: they never apply.
_OTHERS = [r.id for r in rules.RULES if r.referenced() and not set(r.referenced()) & set(KINDS)]
_EVAL = f"""{_ROWS}, ev as (
 select company_id, 'se.tax.periodiseringsfond.outnyttjat_utrymme' as rule_id, case when f_taxable_result is null or not ({_QUARTER} > 0) then 'not_applicable' else 'matched' end as outcome, {mul(f'greatest({_QUARTER}, 0)', 2060)} as high, f_taxable_result is not null as has from rows
 union all select company_id, 'se.tax.underskott.kvittning', case when f_carried_forward_loss is null or coalesce(f_taxable_result <= 0, false) then 'not_applicable' when in_group then 'exception_applies' when ownership_changed then 'exception_applies' when f_taxable_result is null then 'indeterminate' when in_group is null or ownership_changed is null then 'indeterminate' else 'matched' end, {mul(_LOSS, 2060)}, f_carried_forward_loss is not null or f_taxable_result is not null from rows
 union all select company_id, 'se.tax.koncernbidrag', case when f_taxable_result is null or coalesce(not in_group, false) then 'not_applicable' when in_group is null then 'indeterminate' else 'matched' end, null, f_taxable_result is not null from rows
 union all select company_id, 'se.tax.k10.lonekrav', case when f_personnel_costs is null or coalesce(not owners_active, false) or coalesce(owner_count > 4, false) then 'not_applicable' when owners_active is null or owner_count is null then 'indeterminate' else 'matched' end, null, f_personnel_costs is not null from rows
 union all select company_id, 'se.investments.inventarier.avskrivningsutrymme', case when f_equipment is null or f_depreciation is null or coalesce(not ({_HEAD} > 0), false) then 'not_applicable' else 'matched' end, {mul(f'greatest({_HEAD}, 0)', 2060)}, f_equipment is not null or f_depreciation is not null from rows
 union all select company_id, 'se.vat.personbil.leasing', case when has_vehicles is null then 'indeterminate' when has_vehicles then 'matched' else 'not_applicable' end, null, true from rows
 union all select company_id, 'se.rnd.forskningsavdrag', case when f_personnel_costs is null or coalesce(not does_development_work, false) then 'not_applicable' when does_development_work is null then 'indeterminate' else 'matched' end, null, f_personnel_costs is not null from rows
 union all select company_id, unnest([{', '.join(f"'{r}'" for r in _OTHERS)}]), 'not_applicable', null, false from rows
), shown as (select company_id, rule_id, outcome, case when outcome in ('matched', 'indeterminate') then high end as high, has from ev)"""



@query("rule_outcomes", f"with {_EVAL} select company_id, rule_id, outcome from shown")
def rule_outcomes(spark, sf):
    return evaluated(spark, sf).select("company_id", "rule_id", "outcome")


@query("rule_impacts", f"with {_EVAL} select company_id, rule_id, outcome, case when high is not null then 0::bigint end as low, high, row_number() over (partition by company_id order by coalesce(high, 0) desc, rule_id)::int as place from shown where outcome in ('matched', 'indeterminate') and has")
def rule_impacts(spark, sf):
    """From readings to each company's ranked findings, with what each may save."""
    found = fd.findings(evaluated(spark, sf)).withColumn("score", F.coalesce("high", F.lit(0)))
    return fd.ranked(found, "score", "rule_id").select("company_id", "rule_id", "outcome", "low", "high", "place")


@query("rule_outcome_counts", f"with {_EVAL} select rule_id, outcome, count(*) as n from shown group by rule_id, outcome")
def rule_outcome_counts(spark, sf):
    return evaluated(spark, sf).groupBy("rule_id", "outcome").agg(F.count("*").alias("n"))


@query("summary_totals", f"with {_EVAL} select company_id, 0::bigint as low, coalesce(sum(case when outcome = 'matched' and not contains(rule_id, 'periodiseringsfond') then high end), 0)::bigint as high, coalesce(sum(case when outcome = 'matched' and contains(rule_id, 'periodiseringsfond') then high end), 0)::bigint as deferred_high, count(*) as n_findings from shown where outcome in ('matched', 'indeterminate') and has group by company_id")
def summary_totals(spark, sf):
    found = fd.findings(evaluated(spark, sf))
    return fd.totals(found).drop("deferred_low")


@query("covered_areas", f"with {_EVAL}, n as (select case split_part(rule_id, '.', 2) when 'tax' then 'tax' else split_part(rule_id, '.', 2) end as category, count(*) as r, count(*) filter (where outcome in ('matched', 'indeterminate')) as f from shown group by 1) select a as category, coalesce(r, 0) as n_rules, coalesce(f, 0) as n_findings from (select unnest(['tax', 'costs', 'investments', 'personnel', 'vat', 'rnd', 'risk']) as a) left join n on a = category")
def covered_areas(spark, sf):
    return fd.covered_areas(evaluated(spark, sf))


def _lacks(rule) -> str:
    """SQL list of what a rule lacks in a row: required facts, then unanswered questions."""
    facts_ = [f"case when f_{k} is null then '{k}' end" if k in KINDS else f"'{k}'" for k in rule.required()]
    asked = [f"case when {q} is null then '{q}' end" for q in rule.questions()]
    return f"case rule_id when '{rule.id}' then list_filter([{', '.join(facts_ + asked) or 'null'}], lambda x: x is not null) end"


_GAPS = f"{_EVAL}, g as (select company_id, rule_id, unnest(coalesce({', '.join(_lacks(r) for r in rules.RULES)})) as item from shown join rows using (company_id) where outcome in ('matched', 'indeterminate') and has)"


@query("missing_information", f"with {_GAPS}, n as (select company_id, item, count(distinct rule_id) as n_waiting, array_to_string(list_sort(list(distinct rule_id)), ',') as rules from g group by company_id, item) select *, row_number() over (partition by company_id order by n_waiting desc, item)::int as place from n")
def missing_information(spark, sf):
    return fd.gaps(fd.findings(evaluated(spark, sf))).withColumn("rules", F.array_join("rules", ","))


@query("talking_points", f"with {_EVAL} select company_id, rule_id, high, row_number() over (partition by company_id order by high desc, rule_id)::int as place from shown where outcome in ('matched', 'indeterminate') and has and high <> 0")
def talking_points(spark, sf):
    return fd.talking_points(fd.findings(evaluated(spark, sf))).select("company_id", "rule_id", "high", "place")


def _counted(rule) -> str:
    """SQL of (facts present, facts named, facts missing, questions open, has an impact) of a rule in a row."""
    n = lambda names, test: "(" + (" + ".join(f"(f_{k} is {test})::int" if k in KINDS else str(int(test == "null")) for k in names) or "0") + ")"
    asked = "(" + (" + ".join(f"({q} is null)::int" for q in rule.questions()) or "0") + ")"
    return f"when '{rule.id}' then [{n(rule.referenced(), 'not null')}, {len(rule.referenced())}, {n(rule.required(), 'null')}, {asked}, {int(rule.impact is not None)}]"


_FACT = f"{_EVAL}, n as (select company_id, rule_id, outcome, high, case rule_id {' '.join(_counted(r) for r in rules.RULES)} end as n from shown join rows using (company_id) where outcome in ('matched', 'indeterminate') and has), x as (select company_id, rule_id, case when n[2] = 0 then 0.0::double else n[1] / n[2]::double end as e, case outcome when 'matched' then 1.0::double else 0.4::double end as m, case when high is not null then 1.0::double when n[5] = 0 then 0.7::double else 0.2::double end as c, (n[3] + n[4])::double / (greatest(n[2], 1) + n[4]) as x from n), s as (select *, round((e * 0.25::double + m * 0.25::double + c * 0.15::double + (1 - least(x, 1)) * 0.15::double + 1.0::double * 0.1::double + 0.5::double * 0.1::double) / {sum(scoring.WEIGHTS)}::double * 100)::int as score from x)"


@query("finding_confidence", f"with {_FACT} select company_id, rule_id, case when e < 1e-9 then least(score, 49) else score end as confidence from s")
def finding_confidence(spark, sf):
    """Confidence of every finding from the facts it rests on."""
    impact = F.col("rule_id").isin(*[r.id for r in rules.RULES if r.impact])
    found = fd.findings(evaluated(spark, sf))
    f = scoring.rule_factors(F.col("n_present"), F.col("n_referenced"), F.col("outcome"), F.col("high").isNotNull(), impact, F.size("missing"), F.size("questions"), F.lit(None).cast("double"), F.lit(False))
    return found.select("company_id", "rule_id", scoring.confidence(*f).alias("confidence"))


@query("cleared_checks", f"with {_EVAL} select company_id, rule_id from shown s join rows using (company_id) where outcome in ('not_applicable', 'exception_applies') and has is not null and case when rule_id in (" + ", ".join(f"'{r}'" for r in _OTHERS) + f") then false when true then case rule_id when 'se.vat.personbil.leasing' then true when 'se.tax.koncernbidrag' then f_taxable_result is not null when 'se.tax.underskott.kvittning' then f_carried_forward_loss is not null and f_taxable_result is not null when 'se.investments.inventarier.avskrivningsutrymme' then f_equipment is not null and f_depreciation is not null when 'se.tax.periodiseringsfond.outnyttjat_utrymme' then false else f_personnel_costs is not null end end")
def cleared_checks(spark, sf):
    return fd.cleared(evaluated(spark, sf)).select("company_id", "rule_id")


@query("rule_year_join", "with r(rule_id, first_year, last_year) as (values ('a', 1992, 1995), ('b', 1994, null), ('c', 1996, 1996)) select rule_id, year(o_orderdate)::int as tax_year, count(*) as n from orders join r on first_year <= year(o_orderdate) and (last_year is null or year(o_orderdate) <= last_year) group by 1, 2")
def rule_year_join(spark, sf):
    """Rules against companies by year: the few rules are broadcast, counts are summed per year before the range join."""
    windows = spark.createDataFrame([("a", 1992, 1995), ("b", 1994, None), ("c", 1996, 1996)], "rule_id string, first_year int, last_year int")
    years = read(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("tax_year")).agg(F.count("*").alias("n"))
    inside = (F.col("first_year") <= F.col("tax_year")) & (F.col("last_year").isNull() | (F.col("tax_year") <= F.col("last_year")))
    return years.join(F.broadcast(windows), inside).select("rule_id", "tax_year", "n")


def _factors():
    key = F.col("o_orderkey")
    return [((key * m) % 101) / 100.0 for m in (3, 7, 11, 13, 17, 19)]


_FACTORS = [f"((o_orderkey * {m}) % 101) / 100.0::double" for m in (3, 7, 11, 13, 17, 19)]
_UNIT = lambda x: f"least(greatest({x}, 0.0::double), 1.0::double)"
_PARTS = [_UNIT(_FACTORS[0]), _UNIT(_FACTORS[1]), _UNIT(_FACTORS[2]), f"(1.0::double - {_UNIT(_FACTORS[3])})", f"(1.0::double - {_UNIT(_FACTORS[4])})", _UNIT(_FACTORS[5])]
_CONF = f"round(({' + '.join(f'{p} * {w}::double' for p, w in zip(_PARTS, scoring.WEIGHTS))}) / {sum(scoring.WEIGHTS)}::double * 100)::int"
_CONF = f"(case when {_UNIT(_FACTORS[1])} < 1e-9 or {_UNIT(_FACTORS[4])} >= 0.5 or {_UNIT(_FACTORS[0])} < 1e-9 then least({_CONF}, 49) else {_CONF} end)"


@query("confidence_score", f"select o_orderkey, {_CONF} as confidence, case when {_CONF} >= 90 then 'strong' when {_CONF} >= 75 then 'good' when {_CONF} >= 50 then 'moderate' else 'weak' end as band from orders")
def confidence_score(spark, sf):
    c = scoring.confidence(*_factors())
    return read(spark, sf, "orders").select("o_orderkey", c.alias("confidence"), scoring.band(c).alias("band"))


_PRIO = f"least(abs(round(o_totalprice * 100)) / 20000000.0::double, 1.0::double) * ({_CONF} / 100.0::double) * 0.8::double * (case o_orderstatus when 'O' then 1.3::double when 'P' then 1.15::double else 1.0::double end) / (case o_orderpriority when '1-URGENT' then 1.0::double when '2-HIGH' then 1.6::double else 2.5::double end)"


@query("priority_score", f"select o_orderkey, round(least(greatest({_PRIO}, 0), 1), 6) as priority, round({_CONF} / 100.0::double * case o_orderstatus when 'F' then 0.9::double when 'P' then 0.6::double else 0.3::double end, 6) as risk_priority from orders")
def priority_score(spark, sf):
    c = scoring.confidence(*_factors())
    urgency = F.when(F.col("o_orderstatus") == "O", "now").when(F.col("o_orderstatus") == "P", "soon").otherwise("normal")
    effort = F.when(F.col("o_orderpriority") == "1-URGENT", "low").when(F.col("o_orderpriority") == "2-HIGH", "medium").otherwise("high")
    risk = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "P", "medium").otherwise("low")
    p = scoring.priority(ore("o_totalprice").cast("double"), c, F.lit(0.8), urgency, effort)
    return read(spark, sf, "orders").select("o_orderkey", F.round(p, 6).alias("priority"), F.round(scoring.risk_priority(c, risk), 6).alias("risk_priority"))


@query("status_ladder", "select o_orderkey, case when o_orderkey % 11 = 0 then 'rejected' when o_orderpriority = '1-URGENT' then 'warning' when o_orderstatus = 'P' or o_orderkey % 3 = 0 or o_orderkey % 7 = 0 then 'investigate' when o_orderkey % 2 = 0 then 'verify' else 'identified' end as status from orders")
def status_ladder(spark, sf):
    k = F.col("o_orderkey")
    s = scoring.status(k % 11 != 0, F.when(F.col("o_orderpriority") == "1-URGENT", "risk").otherwise("tax"), F.when(F.col("o_orderstatus") == "P", "indeterminate").otherwise("matched"), k % 3 != 0, F.when(k % 7 == 0, "mismatch").otherwise("verified"), k % 2 != 0)
    return read(spark, sf, "orders").select("o_orderkey", s.alias("status"))




@query("source_state_combine", "select s_nationkey, case when max(s_suppkey % 9 = 3) then 'mismatch' when min(st) = 0 then 'unretrieved' when min(st) = 1 then 'unreachable' else 'verified' end as combined, ['unretrieved', 'unreachable', 'mismatch', 'verified'][min(case when s_suppkey % 9 = 3 then 2 when st = 2 then 3 else st end) + 1] as plain_weakest from (select *, case when s_suppkey % 5 = 0 then 1 when s_suppkey % 13 = 0 then 0 else 2 end as st from supplier) group by s_nationkey")
def source_state_combine(spark, sf):
    k = F.col("s_suppkey")
    state = F.when(k % 9 == 3, "mismatch").when(k % 5 == 0, "unreachable").when(k % 13 == 0, "unretrieved").otherwise("verified")
    base = F.when(k % 5 == 0, "unreachable").when(k % 13 == 0, "unretrieved").otherwise("verified")
    order = F.array(*map(F.lit, ("unretrieved", "unreachable", "mismatch", "verified")))
    per = read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.collect_set(base).alias("b"), F.max(k % 9 == 3).alias("bad"), F.min(F.array_position(order, state)).alias("least"))
    return per.select("s_nationkey", scoring.weakest_source(F.when(F.col("bad"), F.array_append("b", F.lit("mismatch"))).otherwise(F.col("b"))).alias("combined"), F.element_at(order, F.col("least").cast("int")).alias("plain_weakest"))


@query("live_overrides_shipped", "select n_nationkey, coalesce(max(case when s_suppkey % 10 = n_nationkey % 10 then 'live' || (s_suppkey % 3)::varchar end), case when n_nationkey % 2 = 0 then 'shipped' end, 'unretrieved') as state from nation left join supplier on s_nationkey = n_nationkey group by n_nationkey")
def live_overrides_shipped(spark, sf):
    live = read(spark, sf, "supplier").join(read(spark, sf, "nation").select("n_nationkey"), F.col("s_nationkey") == F.col("n_nationkey")).where("s_suppkey % 10 = n_nationkey % 10").groupBy("n_nationkey").agg(F.max(F.concat(F.lit("live"), (F.col("s_suppkey") % 3).cast("string"))).alias("live"))
    return read(spark, sf, "nation").join(live, "n_nationkey", "left").select("n_nationkey", F.coalesce("live", F.when(F.col("n_nationkey") % 2 == 0, "shipped"), F.lit("unretrieved")).alias("state"))


@query("top3_actions", "select o_custkey, o_orderkey, place from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as place from orders where o_orderstatus <> 'F') where place <= 3")
def top3_actions(spark, sf):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf, "orders").where("o_orderstatus <> 'F'").withColumn("place", F.row_number().over(w)).where("place <= 3").select("o_custkey", "o_orderkey", "place")


@query("action_plan", "with a as (select o_custkey as company_id, case when o_orderkey % 13 = 0 then ' ' else o_orderpriority end as action, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as band_rank, cast(round(o_totalprice * 100) as bigint) as high, o_orderkey as seq from orders), k as (select *, row_number() over (partition by company_id, action order by band_rank, high desc, seq) as r from a where trim(action) <> '') select company_id, action, seq, row_number() over (partition by company_id order by band_rank, high desc, seq)::int as number from k where r = 1")
def action_plan(spark, sf):
    a = read(spark, sf, "orders").select(F.col("o_custkey").alias("company_id"), F.when(F.col("o_orderkey") % 13 == 0, " ").otherwise(F.col("o_orderpriority")).alias("action"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("band_rank"), ore("o_totalprice").alias("high"), F.col("o_orderkey").alias("seq"))
    return fd.action_plan(a).select("company_id", "action", "seq", "number")


@query("constants_by_year", "with c(tax_year, rate_bp) as (values (1992, 2200), (1995, 2140), (1998, 2060)) select o_orderkey, " + mul("v", 1).replace("* 1 ", "* coalesce(rate_bp, 2000) ").replace("* 1)", "* coalesce(rate_bp, 2000))") + " as tax from (select o_orderkey, year(o_orderdate) as y, cast(round(o_totalprice * 100) as bigint) as v from orders) left join c on y = tax_year")
def constants_by_year(spark, sf):
    rates = spark.createDataFrame([(1992, 2200), (1995, 2140), (1998, 2060)], "tax_year int, rate_bp bigint")
    rows = read(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("tax_year"), ore("o_totalprice").alias("v"))
    return rows.join(F.broadcast(rates), "tax_year", "left").select("o_orderkey", money.mul_bp(F.col("v"), F.coalesce("rate_bp", F.lit(2000))).alias("tax"))


@query("precision_recall", "select precision_, recall_ from (select case when tp + fp = 0 then 1.0::double else tp / (tp + fp)::double end as precision_, case when tp + fn = 0 then 1.0::double else tp / (tp + fn)::double end as recall_ from (select count(*) filter (where quality = 1 and toxic = 0) as tp, count(*) filter (where quality = 1 and toxic = 1) as fp, count(*) filter (where quality = 0 and toxic = 0) as fn from labels))")
def precision_recall(spark, sf):
    c = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    n = read(spark, sf, "labels").agg(c(1, 0).alias("tp"), c(1, 1).alias("fp"), c(0, 0).alias("fn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.try_divide(F.col(a), F.col(a) + F.col(b)))
    return n.select(share("tp", "fp").alias("precision_"), share("tp", "fn").alias("recall_"))


_REVIEW = "case when outcome = 'indeterminate' then 'possible' when outcome = 'matched' then 'worth_raising' end"


@query("control_review", f"with {_EVAL} select company_id, rule_id, {_REVIEW} as review from shown where outcome in ('matched', 'indeterminate')")
def control_review(spark, sf):
    rows = rp.control_review(evaluated(spark, sf))
    return rows.where("review <> 'looks_correct'")


@query("company_reports")
def company_reports(spark, sf):
    found = fd.findings(evaluated(spark, sf))
    return rp.report(fd.ranked(found.withColumn("score", F.coalesce("high", F.lit(0))), "score", "rule_id"), fd.totals(found))


_BAND = f"case when {_CONF} < 50 then 'needs_more_evidence' when least(greatest({_PRIO}, 0), 1) >= 0.5 then 'high' when {_CONF} < 75 then 'needs_more_evidence' else 'should_investigate' end"


@query("summary_counts", f"with f as (select o_custkey, {_BAND} as band from orders where o_orderstatus <> 'F') select c_custkey as company_id, count(band) as identified, count(*) filter (where band = 'high') as high, count(*) filter (where band = 'should_investigate') as investigate, count(*) filter (where band = 'needs_more_evidence') as lacking, count(band) = 0 as found_nothing from customer left join f on o_custkey = c_custkey group by c_custkey")
def summary_counts(spark, sf):
    """Findings by priority band; those of status F are rejected."""
    c = scoring.confidence(*_factors())
    urgency = F.when(F.col("o_orderstatus") == "O", "now").when(F.col("o_orderstatus") == "P", "soon").otherwise("normal")
    effort = F.when(F.col("o_orderpriority") == "1-URGENT", "low").when(F.col("o_orderpriority") == "2-HIGH", "medium").otherwise("high")
    score = scoring.priority(ore("o_totalprice").cast("double"), c, F.lit(0.8), urgency, effort)
    found = read(spark, sf, "orders").select(F.col("o_custkey").alias("company_id"), F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("identified").alias("status"), scoring.priority_band(score, c).alias("band"))
    return fd.counts_by_band(found, read(spark, sf, "customer").select(F.col("c_custkey").alias("company_id")))
