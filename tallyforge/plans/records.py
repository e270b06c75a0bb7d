"""Queries of whole records and of what guards them: opportunities with evidence, purges, classified lines, permissions, channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classified, variants
from ..operators import audiences, decisions, opportunity, retention, rules
from ..operators import facts as fx
from ..operators import findings as fd
from .adapters import facts, read
from .catalog import ORACLES, query
from .statement import _FACT, evaluated

_NOTE = "Regeln är inte granskad."


def rule_table(spark):
    """The rules as the small table that records take: what they cite, ask for and say."""
    rows = [
        (r.id, "1", r.id.rpartition(".")[2], f"Regel {r.id}.", f"Granska {r.category}.", r.referenced(), ["s1"] + (["s2"] if r.category == "tax" else []), "formula" if r.impact else None,
         "low", "normal", 0.8, r.category != "vat", _NOTE, [])
        for r in rules.RULES
    ]
    return spark.createDataFrame(rows, "rule_id string, version string, title string, description string, action string, referenced array<string>, source_ids array<string>, method string, effort string, urgency string, relevance double, reviewed boolean, note string, hints array<string>")


def opportunities(spark, sf):
    found = fd.findings(evaluated(spark, sf))
    best = fx.canonical(facts(spark, sf))
    readings = best.select("company_id", "kind", "value_ore", F.col("seq").alias("fact_id"), F.lit(1).alias("page"), F.concat(F.lit("order "), F.col("seq").cast("string")).alias("source_text"), F.col("seq").alias("version_id"))
    sources = spark.createDataFrame([("s1", "Lag 1", "verified"), ("s2", "Lag 2", "unretrieved")], "source_id string, reference string, state string")
    # no model has been asked for these tables
    verdicts = found.limit(0).select("company_id", "rule_id", F.lit(0.0).alias("objection"), F.lit(True).alias("survives"), F.lit("").alias("reasoning"), F.array().cast("array<string>").alias("lacks"), F.lit(False).alias("corroborated"))
    return opportunity.records(found, readings, rule_table(spark), sources, verdicts)


@query("opportunity_records", f"""
with {_FACT}, z as (
  select s.company_id, s.rule_id, s.outcome, s.high, x.n, case when p.e < 1e-9 then least(p.score, 49) else p.score end as confidence
  from (select * from shown where outcome in ('matched', 'indeterminate') and has) s
  join (select company_id, rule_id, n from n) x on x.company_id = s.company_id and x.rule_id = s.rule_id
  join s p on p.company_id = s.company_id and p.rule_id = s.rule_id)
select company_id, rule_id,
  case when split_part(rule_id, '.', 2) = 'risk' then 'warning' when outcome = 'indeterminate' or n[1] = 0 or confidence < 50 then 'investigate'
    when split_part(rule_id, '.', 2) = 'vat' then 'verify' else 'identified' end as status,
  confidence, n[1]::int as n_values, (n[1] + 1 + (high is not null)::int + (split_part(rule_id, '.', 2) = 'vat')::int)::int as n_items,
  (n[3] + n[4])::int as n_missing, coalesce(high, 0)::bigint as high,
  case split_part(rule_id, '.', 2) when 'tax' then 'Lag 1; Lag 2' else 'Lag 1' end as source
from z""".replace("join s p on", "join s as p on"))
def opportunity_records(spark, sf):
    """Every finding as a record; of the evidence how much there is, and what the rule's item cites."""
    of = lambda kind: F.filter("evidence", lambda e: e["kind"] == kind)
    rows = opportunities(spark, sf)
    return rows.select(
        "company_id", "rule_id", "status", "confidence", F.size(of("document_value")).alias("n_values"), F.size("evidence").alias("n_items"), F.size("missing").alias("n_missing"), "high",
        F.get(of("rule"), 0)["source"].alias("source"),
    )


_RISK = " ".join(f"when '{r.id}' then {dict(high=0.9, medium=0.6).get(r.risk, 0.3)}::double" for r in rules.RULES)


@query("audience_reports", f"""
with z as ({ORACLES["opportunity_records"]}),
a as (select *, split_part(rule_id, '.', 2) as category, case rule_id {_RISK} end as risk, status = 'warning' or high = 0 as at_risk from z),
p as (
  select *, case when at_risk then confidence / 100.0::double * risk
    else least(greatest(least(high / 2.0::double / 20000000.0::double, 1.0::double) * (confidence / 100.0::double) * 0.8::double, 0), 1) end as priority from a),
b as (
  select *, split_part(rule_id, '.', -1) as title, case when confidence < 50 then 3 when at_risk then case when risk = 0.9::double then 1 else 2 end
    when priority >= 0.5 then 1 when confidence < 75 then 3 else 2 end as band from p),
o as (select *, row_number() over (partition by company_id order by priority desc, rule_id) as pos from b),
f as (select *, row_number() over (partition by company_id, category order by band, high desc, pos) as r from o),
s as (select *, row_number() over (partition by company_id order by band, high desc, pos) as step from f where r = 1),
plan as (select company_id, string_agg(step::varchar || ' ' || category || ' ' || title, '; ' order by step) as plan from s group by 1),
n as (
  select company_id, count(*) as n_found, count(*) filter (where band = 1) as n_high, count(*) filter (where band = 2) as n_investigate, count(*) filter (where band = 3) as n_lacking,
    sum(case when confidence >= 50 and not contains(rule_id, 'periodiseringsfond') then high else 0 end) as high, sum(case when confidence >= 50 and contains(rule_id, 'periodiseringsfond') then high else 0 end) as later,
    sum(n_values) as n_values, max((category = 'vat')::int) as n_assumptions, string_agg(title, ',' order by pos) as titles,
    count(*) filter (where status <> 'identified') as n_must_check, count(*) filter (where status = 'identified') as n_possible,
    string_agg(title, ',' order by high desc, pos) filter (where high <> 0) as worth from o group by 1),
c as (select company_id, count(*) as n_correct from ({ORACLES["cleared_checks"]}) group by 1)
select c_custkey as company_id, audience, coalesce(n_found, 0)::int as n_found, coalesce(n_high, 0)::int as n_high, coalesce(n_investigate, 0)::int as n_investigate, coalesce(n_lacking, 0)::int as n_lacking,
  coalesce(high, 0)::bigint as high, coalesce(later, 0)::bigint as later, coalesce(n_values, 0)::int as n_values, coalesce(n_found, 0)::int as n_rules, coalesce(n_assumptions, 0)::int as n_assumptions,
  coalesce(titles, '') as titles, coalesce(plan, '') as plan,
  case when audience = 'accountant' then coalesce(n_must_check, 0)::int end as n_must_check, case when audience = 'accountant' then coalesce(n_possible, 0)::int end as n_possible,
  case when audience = 'accountant' then coalesce(n_correct, 0)::int end as n_correct, case when audience = 'accountant' then coalesce(worth, '') end as worth
from customer cross join (values ('private'), ('company'), ('accountant')) x(audience)
  left join n on n.company_id = c_custkey left join plan on plan.company_id = c_custkey left join c on c.company_id = c_custkey""")
def audience_reports(spark, sf):
    """The report of every company for each of three readers; of its sections how much they hold, and the order of what they list."""
    r = reports(spark, sf)
    titles = lambda items, name="title": F.array_join(F.transform(items, lambda x: x[name]), ",")
    step = lambda x: F.concat_ws(" ", x["order"].cast("string"), F.regexp_extract(x["action"], r"^Granska (.*)\.$", 1), x["title"])
    s, v, e, c = (F.col(n) for n in ("summary", "evidence", "economic_potential", "control_review"))
    size = lambda name: F.when(c.isNotNull(), F.size(c[name]))
    return r.select(
        "company_id", "audience", s["found_count"].alias("n_found"), s["high_priority_count"].alias("n_high"), s["should_investigate_count"].alias("n_investigate"), s["needs_more_evidence_count"].alias("n_lacking"),
        e["high"].alias("high"), e["deferred_high"].alias("later"), v["values_cited"].alias("n_values"), F.size(v["rules_cited"]).alias("n_rules"), F.size(v["assumptions"]).alias("n_assumptions"),
        titles(F.col("opportunities")).alias("titles"), F.array_join(F.transform("action_plan", step), "; ").alias("plan"),
        size("must_check").alias("n_must_check"), size("possible_improvement").alias("n_possible"), size("looks_correct").alias("n_correct"), titles(c["worth_raising"], "summary").alias("worth"),
    )


def reports(spark, sf):
    rules_ = rule_table(spark)
    cleared = fd.cleared(evaluated(spark, sf)).select("company_id", "rule_id", "category").join(F.broadcast(rules_.select("rule_id", "title", "description")), "rule_id")
    cleared = cleared.select("company_id", "rule_id", "title", "category", F.col("description").alias("reason"))
    states = rules_.select("rule_id", F.transform("source_ids", lambda s: F.when(s == "s1", "verified").otherwise("unretrieved")).alias("states"))
    who = F.explode(F.array(*map(F.lit, audiences.AUDIENCES))).alias("audience")
    readers = read(spark, sf, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"), F.lit("2025").alias("fiscal_year"), who)
    return audiences.build(readers, opportunities(spark, sf), states, cleared)


TABLES = {"jobs": "id", "opportunities": "id", "evidence": "id", "calculations": "id", "model_runs": "id", "budgets": "id"}
LINKS = [
    retention.Link("evidence", "opportunity_id", "opportunities"), retention.Link("calculations", "job_id", "jobs"), retention.Link("opportunities", "job_id", "jobs"),
    retention.Link("model_runs", "job_id", "jobs"), retention.Link("budgets", "job_id", "jobs"),
]


def _linked(spark, sf):
    lines, orders, events = (read(spark, sf, t) for t in ("lineitem", "orders", "events"))
    line = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id")
    made = {
        "jobs": orders.select(F.col("o_orderkey").alias("id"), "o_orderdate"),
        "opportunities": lines.select(line, F.col("l_orderkey").alias("job_id"), "l_shipdate"),
        "evidence": lines.select(line, (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("opportunity_id")),
        "calculations": lines.where("l_returnflag = 'R'").select(line, F.col("l_orderkey").alias("job_id")),
        "model_runs": events.select(F.col("event_id").alias("id"), F.col("event_id").alias("job_id")),
        "budgets": orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("job_id")),
    }
    return {t: made[t] for t in ("evidence", "calculations", "opportunities", "model_runs", "budgets", "jobs")}


_OLD_JOB, _OLD_LINE = "o_orderdate < timestamp{} '1995-01-01'", "l_shipdate < timestamp{} '1994-06-01'"


@query("purge_graph", f"""
with j as (select o_orderkey as id, {_OLD_JOB.format('')} as gone from orders),
o as (select l_orderkey * 100 + l_linenumber as id, coalesce(j.gone, false) or {_OLD_LINE.format('')} as gone from lineitem left join j on l_orderkey = j.id),
og as (select distinct id from o where gone),
e as (select og.id is not null as gone from lineitem left join og on l_orderkey * 100 + l_linenumber = og.id),
c as (select coalesce(j.gone, false) as gone from lineitem left join j on l_orderkey = j.id where l_returnflag = 'R'),
m as (select coalesce(j.gone, false) as gone from events left join j on event_id = j.id),
t as (
  select 0 as place, 'evidence' as tab, gone from e union all select 1, 'calculations', gone from c union all select 2, 'opportunities', gone from o
  union all select 3, 'model_runs', gone from m union all select 4, 'budgets', gone from j union all select 5, 'jobs', gone from j)
select place::int as place, tab, count(*) filter (where not gone) as n_kept, count(*) filter (where gone) as n_gone from t group by 1, 2""")
def purge_graph(spark, sf):
    """Six linked tables without old jobs and old opportunities, in the order in which rows would be deleted."""
    return retention.summary(retention.purge(_linked(spark, sf), TABLES, LINKS, {"jobs": F.expr(_OLD_JOB.format("_ntz")), "opportunities": F.expr(_OLD_LINE.format("_ntz"))}))


CLASSES = {"event.**": "internal", "event.user.*": "confidential", "props.*": "public", "tags": "public", "event.secret.**": "highly_confidential", "**.type": "public"}


@query("classified_lines", """
with e as (
  select *, case event_id % 4 when 0 then 0 when 1 then 1 when 2 then 2 else 3 end as c, case when user_id % 2 = 0 then 'even' else 'odd' end as half from events)
select event_id,
  'event.secret.value=' || case when c >= 3 then cast(round(value * 100) as bigint)::varchar else '[redacted]' end ||
  ' event.type=' || case when c >= 1 then event_type else '[redacted]' end || ' event.user.id=' || case when c >= 2 then user_id::varchar else '[redacted]' end ||
  ' other=' || case when c >= 2 then 'null' else '[redacted]' end || ' props.k=' || json_extract(props, '$.k')::varchar || ' tags=' || event_type || ' tags=' || half as line
from e""")
def classified_lines(spark, sf):
    """Nested log records of all events for four sinks."""
    e = read(spark, sf, "events")
    event = F.struct(
        F.struct(F.col("event_type").alias("type"), F.struct(F.col("user_id").alias("id")).alias("user"), F.struct(F.round(F.col("value") * 100).cast("bigint").alias("value")).alias("secret")).alias("event"),
        F.parse_json("props").alias("props"), F.array("event_type", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")).alias("tags"), F.parse_json(F.lit("null")).alias("other"),
    )
    sink = F.get(F.array(*map(F.lit, ("metric_label", "log", "error_body", "model_request"))), (F.col("event_id") % 4).cast("int"))
    rows = e.select("event_id", F.to_variant_object(event).alias("tree"), sink.alias("sink"))
    return classified.rendered(rows, ["event_id"], F.col("tree"), CLASSES, F.col("sink"))


@query("json_flat", "select event_id, 'k   ' || json_extract(props, '$.k')::varchar as lines from events")
def json_flat(spark, sf):
    return variants.flat_lines(read(spark, sf, "events"), "event_id", F.col("props"))


_ROLE = "case c_mktsegment when 'BUILDING' then 'owner' when 'FURNITURE' then 'member' when 'MACHINERY' then 'advisor' else 'guest' end"
_HELD = "case when c_acctbal < 0 then 'unverified' when c_acctbal < 5000 then 'two_factor' when c_acctbal < 9000 then 'strong' end"
_ADVISOR = ", ".join(f"'{p}'" for p in decisions.ADVISOR)
_ALL = ", ".join(f"'{p}'" for p in decisions.PERMISSIONS)


@query("permission_decisions", f"""
with r as (
  select o_orderkey, {_ROLE} as role, {_HELD} as held, [{_ALL}][1 + (floor(o_totalprice)::bigint % {len(decisions.PERMISSIONS)})] as permission,
    case o_orderstatus when 'F' then 'unverified' when 'O' then 'two_factor' else 'strong' end as required
  from orders join customer on o_custkey = c_custkey)
select o_orderkey, permission,
  case when not (role = 'owner' or (role in ('member', 'advisor') and permission in ({_ADVISOR})) or (role = 'member' and permission in ('update_company', 'delete_document')))
      then 'role_insufficient'
    when coalesce(list_position(['unverified', 'two_factor', 'strong'], held), 1) < list_position(['unverified', 'two_factor', 'strong'], required)
      then 'verification_insufficient' else 'allowed' end as decision
from r""")
def permission_decisions(spark, sf):
    """Every order as a request of its customer, with a role by market, a level by balance, and the level that its state asks for."""
    pick = F.get(F.array(*map(F.lit, decisions.PERMISSIONS)), F.pmod(F.floor("o_totalprice"), F.lit(len(decisions.PERMISSIONS))).cast("int"))
    required = F.when(F.col("o_orderstatus") == "F", "unverified").when(F.col("o_orderstatus") == "O", "two_factor").otherwise("strong")
    people = read(spark, sf, "customer").selectExpr("c_custkey", f"{_ROLE} as role", f"{_HELD} as held")
    requests = read(spark, sf, "orders").select("o_orderkey", "o_custkey", pick.alias("permission"), required.alias("required")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    grants = spark.createDataFrame([(r, p) for r, ps in decisions.GRANTS.items() for p in ps], "role string, permission string")
    inherits = spark.createDataFrame([(r, p) for r, ps in decisions.INHERITS.items() for p in ps], "role string, parent string")
    return decisions.decided(requests, decisions.closed_grants(grants, inherits, decisions.PERMISSIONS)).select("o_orderkey", "permission", "decision")


_KIND = "case event_type when 'signup' then 'member_invited' when 'purchase' then 'analysis_completed' when 'error' then 'security_alert' when 'view' then 'document_processed' else 'analysis_failed' end"
_WISH = "case when c_acctbal < 0 then '' when c_acctbal < 3000 then 'email' when c_acctbal < 6000 then 'in_app,fax' else 'push,in_app,email' end"


@query("channel_choices", f"""
with p as (
  select c_custkey, k, {_WISH} as wish from customer, (values ('member_invited'), ('analysis_completed'), ('security_alert')) x(k) where c_nationkey < 20),
n as (select event_id, case when event_id % 10 <> 0 then user_id end as user_id, {_KIND} as kind from events)
select event_id, case when kind = 'security_alert' then 'email,push' when wish is not null then replace(wish, ',fax', '')
    when kind in ('analysis_completed', 'analysis_failed') then 'push,email' when kind = 'document_processed' then 'in_app' else 'email' end as channels,
  kind <> 'security_alert' and coalesce(wish = '', false) as suppressed
from n left join p on n.user_id = c_custkey and kind = k""")
def channel_choices(spark, sf):
    """Every event as a notice; customers of some nations have preferences for three kinds, one of which they can't turn off."""
    wish = F.filter(F.split(F.expr(_WISH), ","), lambda c: c != "")
    kinds = F.explode(F.array(*map(F.lit, ("member_invited", "analysis_completed", "security_alert")))).alias("kind")
    preferences = read(spark, sf, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("user_id"), kinds, wish.alias("channels"))
    notices = read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("user_id")).alias("user_id"), F.expr(_KIND).alias("kind"))
    defaults = spark.createDataFrame(list(decisions.CHANNELS.items()), "kind string, channels array<string>")
    out = decisions.channels(notices, defaults, preferences, ["email", "push", "in_app"])
    return out.select("event_id", F.array_join("channels", ",").alias("channels"), "suppressed")
