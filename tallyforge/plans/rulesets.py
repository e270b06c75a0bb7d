"""Queries of rule sets as data: two sets with a rule for each part, sources from suppliers, years from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules, rulesets
from .adapters import read
from .catalog import ORACLES, query
from .statement import KINDS, _wide_rows

_RULE = """'{"rule_id": "' || rule_id || '", "category": "tax", "jurisdiction": "' || jurisdiction || '", "tax_year_from": ' || year_from ||
  ', "tax_year_to": ' || coalesce(cast(year_to as string), 'null') || ', "relevance": ' || relevance || ', "sources": [' || cited ||
  '], "conditions": {"all": [{"fact_present": "equipment"}, {"compare": [{"mul_rate": [{"fact": "equipment"}, "rate_' || rate ||
  '"]}, "gt", {"constant": "c_' || constant || '"}]}]}, "exceptions": [' ||
  case when p_size % 3 = 0 then '{"id": "x", "when": {"compare": [{"constant": "c_' || other || '"}, "lt", {"amount": 1}]}}' else '' end ||
  '], "impact": {"low": {"amount": 0}, "high": {"max0": {"mul_rate": [{"fact": "equipment"}, "rate_' || other || '"]}}}}'"""
_RULE_COLUMNS = """p_partkey, p_partkey % 2 as set_id, p_size, 'r.' || p_type || '.' || (p_partkey % 701) as rule_id, 2020 + p_size % 6 as year_from,
  case when p_size % 4 <> 0 then 2018 + p_size % 9 end as year_to, case when p_partkey % 11 <> 0 then 'SE' else 'NO' end as jurisdiction,
  (p_partkey % 130) / {} as relevance, p_size % 8 as rate, p_size % 6 as constant, p_partkey % 10 as other"""


def sets(spark, sf) -> rulesets.RuleSets:
    """The driver's tables as bodies of JSON, one a rule, source and year, and these as rule sets."""
    cited = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct().groupBy("l_partkey").agg(F.array_join(F.transform(F.collect_list("l_suppkey"), lambda s: F.concat(F.lit('"s'), s.cast("string"), F.lit('"'))), ", ").alias("cited"))
    parts = read(spark, sf, "part").selectExpr(*[x.strip() for x in _split(_RULE_COLUMNS.format("100"))])
    bodies = parts.join(cited, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("cited", F.coalesce("cited", F.lit("")))
    rule = rulesets.rule_rows(bodies.selectExpr("set_id", "p_partkey as place", f"parse_json({_RULE}) as v"))
    s = read(spark, sf, "supplier").selectExpr(
        "explode(case s_suppkey % 3 when 0 then array(0, 1) when 1 then array(0) else array(1) end) as set_id", "'s' || s_suppkey as source_id",
        "to_variant_object(named_struct('state', if(s_acctbal > 5000, 'verified', 'unretrieved'), 'sha256', if(s_suppkey % 4 <> 0, md5(s_name), ''), 'at', if(s_suppkey % 6 <> 0, '2024-01-01', ''),"
        " 'asserted_claim', if(s_suppkey % 7 <> 0, s_name, ' '), 'locator', if(s_suppkey % 5 <> 0, '1 kap. 2 §', ''))) as v",
    )
    years = read(spark, sf, "orders").select((F.year("o_orderdate") + 29).alias("tax_year")).distinct()
    named = "case when (tax_year + i) % 5 <> 0 then '\"c_' || i || '\": {\"amount\": ' || (i * 100) || ', \"source\": \"s' || (tax_year % 7 * i) || '\"}, \"rate_' || i || '\": {\"rate_bp\": ' || i || ', \"source\": \"s0\"}' end"
    parameters = years.selectExpr("explode(array(0, 1)) as set_id", f"parse_json('{{\"tax_year\": ' || tax_year || ', \"parameters\": {{' || array_join(transform(sequence(0, 8), i -> {named}), ', ') || '}}}}') as v")
    heads = spark.createDataFrame([(0, "1", "SE"), (1, "1", "SE")], "set_id int, version string, jurisdiction string")
    as_int = lambda df: df.withColumn("set_id", F.col("set_id").cast("int"))
    return rulesets.RuleSets(heads, as_int(rule), as_int(rulesets.source_rows(s)), as_int(rulesets.parameter_rows(parameters)))


def _split(columns: str) -> list[str]:
    """Select items, cut at commas outside brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


@query("rule_set_problems", f"""
with r as (
  select {_RULE_COLUMNS.format('100.0::double')} from part),
c as (
  select distinct r.set_id, p_partkey, rule_id, 's' || l_suppkey as source from r join lineitem on l_partkey = p_partkey),
s as (
  select x.set_id, 's' || s_suppkey as source, * from supplier, (values (0), (1)) x(set_id) where s_suppkey % 3 = 0 or s_suppkey % 3 = x.set_id + 1),
y as (select distinct year(o_orderdate) + 29 as tax_year from orders),
p as (
  select x.set_id, tax_year, k.kind, k.kind_name || i as name, case k.kind when 'rate' then 's0' else 's' || (tax_year % 7 * i) end as source
  from y, range(9) t(i), (values (0), (1)) x(set_id), (values ('constant', 'c_'), ('rate', 'rate_')) k(kind, kind_name)
  where (tax_year + i) % 5 <> 0),
n as (
  select set_id, rule_id, year_from, year_to, 'conditions' as field, 'rate' as kind, 'rate_' || rate as name from r
  union select set_id, rule_id, year_from, year_to, 'conditions', 'constant', 'c_' || constant from r
  union select set_id, rule_id, year_from, year_to, 'exceptions', 'constant', 'c_' || other from r where p_size % 3 = 0
  union select set_id, rule_id, year_from, year_to, 'impact', 'rate', 'rate_' || other from r),
w as (
  select *, max(coalesce(year_to, 9999)) over (
    partition by set_id, rule_id order by year_from, p_partkey rows between unbounded preceding and 1 preceding) as upto
  from r where coalesce(year_to, 9999) >= year_from),
found as (
  select set_id, rule_id as subject, 'tax_year_to' as field, 'year_order' as problem, year_from || '-' || year_to as detail from r where year_to < year_from
  union all select set_id, rule_id, 'jurisdiction', 'jurisdiction', jurisdiction from r where jurisdiction <> 'SE'
  union all select set_id, rule_id, 'relevance', 'relevance', null from r where relevance > 1
  union all select set_id, rule_id, 'sources', 'no_source', null from r where p_partkey not in (select p_partkey from c)
  union all select distinct c.set_id, rule_id, 'sources', 'unknown_source', source from c anti join s using (set_id, source)
  union all select set_id, name, 'parameters ' || tax_year, 'unknown_source', source from p anti join s using (set_id, source)
  union all (
    select distinct n.set_id, rule_id, field, 'unknown_' || kind, tax_year || ' ' || name
    from n join y on tax_year >= year_from and (year_to is null or tax_year <= year_to) anti join p using (set_id, tax_year, kind, name))
  union all select set_id, rule_id, 'rule_id', 'duplicate', count(*)::varchar from r group by set_id, rule_id having count(*) > 1
  union all select set_id, rule_id, 'tax_year_from', 'overlap', year_from::varchar from w where year_from <= upto
  union all select set_id, source, 'sha256', 'no_hash', null from s where s_acctbal > 5000 and s_suppkey % 4 = 0
  union all select set_id, source, 'at', 'no_time', null from s where s_acctbal > 5000 and s_suppkey % 6 = 0
  union all select set_id, source, 'asserted_claim', 'no_claim', null from s where s_suppkey % 7 = 0
  union all select set_id, source, 'locator', 'no_locator', null from s where s_suppkey % 5 = 0)
select set_id::int as set_id, subject, field, problem, detail from found""")
def rule_set_problems(spark, sf):
    """All defects of two sets with a rule a part."""
    return rulesets.problems(rulesets.kept(sets(spark, sf)))


@query("rule_outcomes_json", ORACLES["rule_outcomes"])
def rule_outcomes_json(spark, sf):
    """The fourteen rules, written as JSON, read back, checked and compiled, over all companies."""
    source = {"a": {"locator": "1 kap. 2 §", "asserted_claim": "x", "state": "unretrieved"}}
    body = rulesets.dump(rules.RULES, "1", "SE", source, [{"tax_year": 2024, "parameters": {}}], {r.id: ["a"] for r in rules.RULES})
    loaded = rulesets.compiled(rulesets.read(spark.createDataFrame([(1, body)], "set_id int, body string")), 1)
    rows = _wide_rows(spark, sf)
    rows = rows.withColumns({f"f_{k}": F.lit(None).cast("bigint") for k in rules.KINDS if k not in KINDS})
    return rules.evaluate(rows, loaded, rules.Names(rules.KINDS, rules.PROFILE)).select("company_id", "rule_id", "outcome")
