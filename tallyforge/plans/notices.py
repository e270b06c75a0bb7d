"""Queries of warnings, limits, schemas and answers, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import content as ct
from ..operators import notices as nt
from ..operators import schemas
from .adapters import FACTS_SQL, facts, ore, read
from .catalog import query
from .content import _KINDS, _list

_WHITE = r"[\s\v\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_PAGES = "pages_ as (select doc_id % 100 as company_id, doc_id as doc, k as page, p[k] as text from (select doc_id, p, unnest(range(1, len(p) + 1)) as k from (select doc_id, string_split(coalesce(text, ''), chr(10)) as p from documents)))"
_BLANK = f"trim(regexp_replace(text, '{_WHITE}', ' ', 'g')) = ''"


def pages(spark, sf):
    """A page per line of every document."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return read(spark, sf, "documents").select((F.col("doc_id") % 100).alias("company_id"), F.col("doc_id").alias("doc"), F.posexplode(lines).alias("page", "text")).withColumn("page", F.col("page") + 1)


@query("readable_pages", f"with {_PAGES} select doc, round(avg((not ({_BLANK}))::int), 9) as readable from pages_ group by doc")
def readable_pages(spark, sf):
    return nt.readable_fraction(pages(spark, sf), "doc").select("doc", F.round("readable", 9).alias("readable"))


_MIME = "case doc_id % 8 when 0 then 'image/png' when 1 then 'application/zip' when 2 then 'application/x-ole' when 3 then 'application/x-elf' when 4 then 'application/pdf' else 'text/plain' end"
_COUNTS = ", ".join(f"sum(len(list_filter({_list(p)}, lambda p: contains(lower(text), p)))) as {n}" for n, p in (("i", ct.INSTRUCTIONS), ("r", ct.ROLES)))
_WARN = f"""with {_PAGES}, f as ({FACTS_SQL}), first as (select company_id, kind, arg_min(value_ore, seq) as v from f group by all), w as (
  select company_id, 'unreadable_page' as code, doc || '/' || page as subject from pages_ where {_BLANK}
  union all select doc_id % 100, 'document_not_read', doc_id::varchar from documents where doc_id % 8 < 4
  union all select doc_id % 100, 'document_truncated', doc_id::varchar from documents where n_chars * 10000 > {nt.MOST_BYTES}
  union all select f.company_id, 'conflicting_values', f.kind || '/' || seq from f join first using (company_id, kind) where value_ore <> v
  union all select distinct company_id, 'implausible_value', kind from f where abs(value_ore) > 40000000
  union all select company_id, 'instruction_like_content', doc::varchar from (select company_id, doc, {_COUNTS}, sum((contains(lower(text), '{ct.OPEN.lower()}') or contains(lower(text), '{ct.CLOSE.lower()}'))::int) as d from pages_ group by all) where d > 0 or r > 0 or i >= 2
  union all select o_custkey, 'rule_error', 'r' || o_orderkey from orders where o_orderkey % 50 = 0
)"""


@query("analysis_warnings", _WARN + " select company_id, code, subject from w")
def analysis_warnings(spark, sf):
    """All seven kinds of warnings over documents, their pages, and the readings of orders."""
    k = F.col("doc_id") % 8
    mime = F.when(k == 0, "image/png").when(k == 1, "application/zip").when(k == 2, "application/x-ole").when(k == 3, "application/x-elf").when(k == 4, "application/pdf").otherwise("text/plain")
    files = read(spark, sf, "documents").select((F.col("doc_id") % 100).alias("company_id"), F.col("doc_id").alias("doc"), mime.alias("mime"), (F.col("n_chars") * 10_000).alias("size"))
    evaluations = read(spark, sf, "orders").select(F.col("o_custkey").alias("company_id"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("rule_id"), F.when(F.col("o_orderkey") % 50 == 0, "rule_error").otherwise("matched").alias("outcome"))
    return nt.warnings(files, pages(spark, sf), facts(spark, sf), evaluations, most_ore=40_000_000).select("company_id", "code", "subject")


@query("analysis_limits", "select c_custkey, 'rests_on_documents:' || (c_custkey % 5) || ',no_legal_decision' || case when c_custkey % 2 = 0 then ',rules_await_review' else '' end || case when c_custkey % 3 = 0 then ',accounts_are_preliminary' else '' end as limits, c_custkey % 4 >= 2 as grounded from customer")
def analysis_limits(spark, sf):
    """What a report says about itself, and whether its evidence (a value, a rule, both or none) passes the gate."""
    k = F.col("c_custkey")
    limits = nt.limitations(k % 5, k % 2 == 0, F.when(k % 3 == 0, "draft").otherwise("final"))
    item = lambda c: F.struct(F.lit(c).alias("kind"))
    evidence = F.when(k % 4 >= 2, F.array(item("document_value"), item("rule"))).when(k % 4 == 1, F.array(item("document_value"))).otherwise(F.array().cast("array<struct<kind:string>>"))
    return read(spark, sf, "customer").select("c_custkey", F.array_join(limits, ",").alias("limits"), nt.grounded(evidence).alias("grounded"))


@query("uncovered_years", "select distinct o_custkey as company_id, year(o_orderdate)::int as tax_year from orders where year(o_orderdate) not in (1993, 1994, 1995)")
def uncovered_years(spark, sf):
    """Companies and years that no constants hold for."""
    years = spark.createDataFrame([(1993,), (1994,), (1995,)], "tax_year int")
    companies = read(spark, sf, "orders").select(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("tax_year")).distinct()
    return nt.uncovered_years(companies, years).select("company_id", "tax_year")


SCHEMA = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer"}, "s": {"type": "string", "enum": ["a", "b"]}, "l": {"type": "array", "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "number"}}}}}}
_TEXTS = {
    1: ('{"k": "x"}', [("$.k", "expected integer, found string")]), 2: ('{"j": 1, "s": "c"}', [("$.k", "required field is missing"), ("$.s", 'value "c" is not one of the permitted options'), ("$.j", "unexpected field")]),
    3: ("[1]", [("$", "expected object, found array")]), 4: ('{"k": 1, "l": [{"n": 1.5}, {"m": 2}, 7]}', [("$.l[1].n", "required field is missing"), ("$.l[2]", "expected object, found number")]), 5: ("{oops", [("$", "not JSON")]),
}


@query("schema_paths", "select event_id, unnest(case event_id % 6 " + " ".join(f"when {k} then [" + ", ".join(f"'{p}: {m}'" for p, m in found) + "]" for k, (_, found) in _TEXTS.items()) + " else [] end) as violation from events")
def schema_paths(spark, sf):
    """Violations of a schema by path, over the props of all events and five broken forms of them."""
    text = F.col("props")
    for k, (broken, _) in _TEXTS.items():
        text = F.when(F.col("event_id") % 6 == k, broken).otherwise(text)
    rows = read(spark, sf, "events").select("event_id", F.explode(schemas.violations(text, SCHEMA)).alias("v"))
    return rows.select("event_id", F.concat_ws(": ", "v.path", "v.message").alias("violation"))


_GOOD = '{"title": "T", "category": "tax", "observation": "o", "question": "q?", "supporting_facts": ["wages", "depreciation"]}'


@query("candidate_findings", "select o_orderkey, 'T' as title, case when o_orderkey % 2 = 0 then 49 else 43 end as confidence, case when o_orderkey % 3 = 0 then 'rejected' else 'investigate' end as status, 0::bigint as high from orders where o_orderkey % 5 in (0, 1)".replace("case when o_orderkey % 2 = 0 then 49 else 43 end", "case when o_orderkey % 2 = 0 then 54 else 42 end::int").replace("54", "49"))
def candidate_findings(spark, sf):
    """Findings of a model's answers that no rule covers: well formed ones only, without money, never above a confidence of 49."""
    k = F.col("o_orderkey")
    bad = '{"title": null, "category": "tax", "observation": "o", "question": "q?"}'
    other = _GOOD.replace("tax", "weather")
    answer = F.when(k % 5 == 2, "no json").when(k % 5 == 3, '{"candidates": [' + bad + "]}").when(k % 5 == 4, '{"candidates": [' + other + "]}").otherwise('{"candidates": [' + _GOOD + ", " + bad + "]}")
    said = F.when(k % 3 == 0, '{"verdicts": [{"title": "T"}]}').otherwise('{"verdicts": [{"title": "T", "survives": true, "reasoning": "fine"}, {"survives": true}]}')
    rows = read(spark, sf, "orders").select("o_orderkey", F.explode(schemas.candidates(answer, ["tax", "costs"])).alias("c"), schemas.verdicts(said).alias("v"))
    verdict = F.get(F.filter("v", lambda v: v["title"] == F.col("c.title")), F.lit(0))
    anchored = F.when(k % 2 == 0, F.size("c.supporting_facts")).otherwise(F.lit(1))
    from ..operators import scoring

    conf = scoring.confidence(*scoring.candidate_factors(anchored, F.size("c.supporting_facts"), F.size("c.missing_information"), verdict["objection_strength"]))
    status = F.when(F.coalesce(verdict["survives"], F.lit(True)), "investigate").otherwise("rejected")
    return rows.select("o_orderkey", "c.title", conf.alias("confidence"), status.alias("status"), F.lit(0).cast("bigint").alias("high"))
