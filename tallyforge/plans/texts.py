"""Queries of the text functions and of documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from ..sources import documents as src
from .adapters import read
from .catalog import query


@query("fold_text", "select doc_id, trim(regexp_replace(lower(translate(text, chr(160) || chr(8239) || chr(8201) || chr(8209) || chr(8211) || chr(8212) || chr(8722), '   ----')), '\\s+', ' ', 'g')) as folded from documents")
def fold_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.fold(F.col("text")).alias("folded"))


@query("injection_scan", "select conv_id, turn, len(list_filter([" + ", ".join(f"'{p}'" for p in tx.INJECTION) + "], lambda p: contains(lower(text), p)))::int as hits from conversations")
def injection_scan(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", tx.injection_hits(F.col("text")).alias("hits"))


@query("html_strip")
def html_strip(spark, sf):
    return read(spark, sf, "pages").select("page_id", tx.strip_markup(F.col("html")).alias("text"))


@query("page_title", "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, strlen(html)::int as size from pages")
def page_title(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.octet_length("html").alias("size"))


@query("source_check_sha", "select page_id, sha256(html) as sha, case when contains(lower(html), 'charset') and contains(lower(html), 'nav') then 'verified' else 'mismatch' end as state from pages")
def source_check_sha(spark, sf):
    """State of a source: all that it must contain is there after folding, and the digest of what was read."""
    needles = F.array(F.lit("charset"), F.lit("nav"))
    ok = F.forall(needles, lambda n: F.contains(F.lower("html"), n))
    return read(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("sha"), F.when(ok, "verified").otherwise("mismatch").alias("state"))


@query("locator_present")
def locator_present(spark, sf):
    return read(spark, sf, "pages").select("page_id", tx.locator_present(F.col("html"), 30, 5).alias("present"))


@query("find_amounts", "select o_orderkey, sign * (replace(digits, ' ', '')::bigint + case when dec >= '5' then 1 else 0 end) as amount from (select o_orderkey, case when o_orderkey % 3 = 0 then -1 else 1 end as sign, trim(format('{:,}', o_orderkey * 7919).replace(',', ' ')) as digits, (o_orderkey % 10)::varchar as dec from orders)")
def find_amounts(spark, sf):
    """First amounts of lines with grouped digits, decimals and signs."""
    k = F.col("o_orderkey")
    number = F.replace(F.format_number(k * 7919, 0), F.lit(","), F.lit(" "))
    line = F.concat(F.lit("Summa "), F.when(k % 3 == 0, "-").otherwise(""), number, F.lit(","), (k % 10).cast("string"), F.lit("0 kr"))
    return read(spark, sf, "orders").select("o_orderkey", tx.first_amount(line).alias("amount"))


@query("label_match", "select o_orderkey, case o_orderkey % 4 when 0 then 'profit_before_tax' when 1 then 'depreciation' when 2 then null else 'wages' end as kind from orders")
def label_match(spark, sf):
    k = F.col("o_orderkey")
    line = F.when(k % 4 == 0, "Resultat efter  finansiella poster 850").when(k % 4 == 1, "Avskrivningar 1 200").when(k % 4 == 2, "Ackumulerade avskrivningar 9").otherwise("Löner och ersättningar 12")
    return read(spark, sf, "orders").select("o_orderkey", tx.match_label(line).alias("kind"))


@query("scale_detect", "select doc_id, contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '(tkr') or contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 'belopp i tkr') as thousands from (select doc_id, case when doc_id % 5 = 0 then 'Belopp  i tkr' || chr(10) else '' end || text as text from documents)")
def scale_detect(spark, sf):
    marked = F.concat(F.when(F.col("doc_id") % 5 == 0, "Belopp  i tkr\n").otherwise(""), F.col("text"))
    return read(spark, sf, "documents").select("doc_id", tx.in_thousands(marked).alias("thousands"))


@query("statement_facts")
def statement_facts(spark, sf):
    """Facts read from statement text: a page per customer with labels, amounts and a following line."""
    k = F.col("c_custkey")
    line = lambda name, m: F.concat(F.lit(name + " "), F.replace(F.format_number(k * m + 1000, 0), F.lit(","), F.lit(" ")))
    text = F.concat_ws("\n", F.when(k % 2 == 0, "Belopp i tkr").otherwise("Belopp i kr"), line("Nettoomsättning", 37), line("Personalkostnader -", 11), F.lit("Avskrivningar"), line("  ", 3), F.lit("Sida 3"))
    # a row of few bytes is much work, so rows are dealt out to all tasks, not by the bytes of the file
    keys = read(spark, sf, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    pages = keys.select(k.alias("company_id"), F.lit("annual").alias("doc"), F.lit(1).alias("page"), text.alias("text"))
    return src.statement_facts(pages).select("company_id", "kind", "value_ore", "seq", "source_text")


@query("page_split", "select doc_id, i::int as page, strlen(p[i])::bigint as size from (select doc_id, string_split(text, chr(10)) as p from documents), range(1, 100000) t(i) where i <= len(p)")
def page_split(spark, sf):
    pages = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "p"))
    return pages.select("doc_id", (F.col("page") + 1).alias("page"), F.octet_length("p").cast("bigint").alias("size"))


@query("char_budget", "select conv_id, turn, left(text, greatest(0, least(length(text), 600 - before))::int) as kept from (select *, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as before from conversations) where before < 600")
def char_budget(spark, sf):
    """Texts of a conversation cut where together they reach the budget."""
    before = F.coalesce(F.sum(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = read(spark, sf, "conversations").withColumn("before", before).where("before < 600")
    return rows.select("conv_id", "turn", F.left("text", (F.lit(600) - F.col("before")).cast("int")).alias("kept"))


@query("delimited_sniff", "select event_id, case event_id % 3 when 0 then true else false end as delimited from events")
def delimited_sniff(spark, sf):
    k = F.col("event_id")
    t = F.when(k % 3 == 0, "a;b;c\n1;2;3\n\n4;5;6").when(k % 3 == 1, "a;b;c\n1;2").otherwise("one line")
    return read(spark, sf, "events").select("event_id", tx.looks_delimited(t).alias("delimited"))


@query("json_props", "select event_id, json_extract(props, '$.k')::int as k from events")
def json_props(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("schema_violations", "select event_id, case when json_extract(props, '$.k')::int > 50 then 'k' end as violation from events where json_extract(props, '$.k')::int > 50")
def schema_violations(spark, sf):
    """Rows whose JSON breaks a schema: k is a whole number up to 50."""
    k = F.from_json("props", "k int")["k"]
    return read(spark, sf, "events").select("event_id", F.when(k.isNull() | (k > 50), "k").alias("violation")).where("violation is not null")


@query("luhn_org_numbers", "select c_custkey, case when (s1 + s2) % 10 = 0 then left(d, 6) || '-' || right(d, 4) end as org from (select c_custkey, d, list_sum(list_transform([1, 3, 5, 7, 9], lambda i: case when substring(d, i, 1)::int * 2 > 9 then substring(d, i, 1)::int * 2 - 9 else substring(d, i, 1)::int * 2 end)) as s1, list_sum(list_transform([2, 4, 6, 8, 10], lambda i: substring(d, i, 1)::int)) as s2 from (select c_custkey, lpad((5560000000 + c_custkey * 7)::varchar, 10, '0') as d from customer))")
def luhn_org_numbers(spark, sf):
    raw = (F.lit(5_560_000_000) + F.col("c_custkey") * 7).cast("string")
    return read(spark, sf, "customer").select("c_custkey", tx.org_number(F.concat(F.left(raw, F.lit(6)), F.lit("-"), F.right(raw, F.lit(4)))).alias("org"))


@query("tax_year_label", "select o_orderkey, year(o_orderdate)::int as tax_year, strftime(o_orderdate, '%Y-%m-%d') as label, month(o_orderdate) = 12 and day(o_orderdate) = 31 as calendar_year, ((year(o_orderdate) - 1990) * 12 + month(o_orderdate) - 1)::int as months from orders")
def tax_year_label(spark, sf):
    d = F.col("o_orderdate")
    return read(spark, sf, "orders").select("o_orderkey", F.year(d).alias("tax_year"), F.date_format(d, "yyyy-MM-dd").alias("label"), ((F.month(d) == 12) & (F.day(d) == 31)).alias("calendar_year"), ((F.year(d) - 1990) * 12 + F.month(d) - 1).alias("months"))


@query("idempotency_key", "select o_orderkey, 'k:' || o_orderstatus || ':' || array_to_string(list_sort([left(md5(o_orderkey::varchar), 8), left(md5(o_custkey::varchar), 8)]), '-') as key from orders")
def idempotency_key(spark, sf):
    ids = F.array(F.md5(F.col("o_orderkey").cast("string")), F.md5(F.col("o_custkey").cast("string")))
    return read(spark, sf, "orders").select("o_orderkey", tx.idempotency_key(F.lit("k"), F.col("o_orderstatus"), ids).alias("key"))


@query("citations", "select n_nationkey, case when n_nationkey % 2 = 0 then n_name || ' 5 §' else n_name || ' — bilaga' end as cited from nation")
def citations(spark, sf):
    where = F.when(F.col("n_nationkey") % 2 == 0, "5 §").otherwise("bilaga")
    return read(spark, sf, "nation").select("n_nationkey", tx.citation(F.col("n_name"), where).alias("cited"))


@query("traceparents", "select event_id, case when event_id % 4 <> 0 then md5(event_id::varchar) end as trace_id, case when event_id % 4 <> 0 then event_id % 2 = 1 end as sampled from events")
def traceparents(spark, sf):
    k = F.col("event_id")
    header = F.concat_ws("-", F.when(k % 4 == 0, "ff").otherwise("00"), F.md5(k.cast("string")), F.lit("00f067aa0ba902b7"), F.when(k % 2 == 1, "01").otherwise("00"))
    t = tx.traceparent(header)
    return read(spark, sf, "events").select("event_id", t["trace_id"].alias("trace_id"), t["sampled"].alias("sampled"))


@query("redacted_fields", "select event_id, case when event_id % 3 = 2 then '[redacted]' else event_type end as event_type, case when event_id % 3 >= 1 then '[redacted]' else user_id::varchar end as user from events")
def redacted_fields(spark, sf):
    """Log fields above the ceiling of their sink are hidden: levels 0, 1, 2."""
    ceiling = F.lit(2) - F.col("event_id") % 3
    show = lambda level, c: F.when(F.lit(level) <= ceiling, c).otherwise("[redacted]")
    return read(spark, sf, "events").select("event_id", show(1, F.col("event_type")).alias("event_type"), show(2, F.col("user_id").cast("string")).alias("user"))
