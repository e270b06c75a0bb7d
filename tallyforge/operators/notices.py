"""What an analysis must say beside its findings: warnings, limitations, what it could not read, and what it refuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content as ct
from ..functions.money import display
from .facts import contradictions, implausible
from .tables import put

# The most bytes of a file that are read, and why some types are not read.
MOST_BYTES = 64 << 20
WHY_UNREADABLE = {
    "application/zip": "The file is an archive. What it holds is listed but not read.", "application/x-empty": "The file is empty.",
    "application/x-ole": "The file is an old office document. Save it as .docx, .xlsx or PDF.",
}


def why_unreadable(mime: Column) -> Column:
    """Why a type has no text; null for those that are read."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in WHY_UNREADABLE.items() for x in kv]), mime)
    picture = F.when(mime.startswith("image/"), "The file is a picture; text is not read from pictures.")
    readable = mime.startswith("text/") | mime.isin("application/pdf", "application/docx", "application/xlsx", "application/rtf", "application/json")
    return F.when(~readable, F.coalesce(known, picture, F.concat(F.lit("The file is of the type "), mime, F.lit(", which has no text."))))


def truncated_after(size: Column, most: int = MOST_BYTES) -> Column:
    """Bytes that are read of a file that is too large; null for one that is read whole."""
    return F.when(size > most, F.lit(most).cast("bigint"))


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(text, r"\p{IsWhite_Space}+", " ")) == "", F.lit(True))


def readable_fraction(pages: DataFrame, *by: str) -> DataFrame:
    """Share of the pages (``by``, text) that are not blank."""
    return pages.groupBy(*by).agg(F.avg((~blank(F.col("text"))).cast("double")).alias("readable"))


def traceable(facts: DataFrame) -> DataFrame:
    """Facts with a page and the text they were read from."""
    return facts.where("page is not null and source_text is not null")


def presented(findings: DataFrame) -> DataFrame:
    return findings.where("status <> 'rejected'")


def warnings(documents: DataFrame, pages: DataFrame, facts: DataFrame, evaluations: DataFrame, revenue: str = "revenue", most_ore: int = 600_000_000_000_000) -> DataFrame:
    """company_id, code, subject, message: all that went wrong on the way, once per company, code and subject.

    ``documents``: company_id, doc, mime, size; ``pages``: company_id, doc, page, text; ``facts``: company_id, kind, value_ore,
    seq, confidence; ``evaluations``: company_id, rule_id, outcome. Each kind of warning is a filter of its own table; only
    what is warned of is shuffled.
    """
    row = lambda code, subject, message: [F.lit(code).alias("code"), subject.cast("string").alias("subject"), message.alias("message")]
    page = F.concat(F.col("doc").cast("string"), F.lit("/"), F.col("page").cast("string"))
    why, cut = why_unreadable(F.col("mime")), truncated_after(F.col("size"))
    mega = lambda n: F.floor(n / (1 << 20)).cast("string")
    out = [
        pages.where(blank(F.col("text"))).select("company_id", *row("unreadable_page", page, F.lit("The page has no text."))),
        documents.where(why.isNotNull()).select("company_id", *row("document_not_read", F.col("doc"), why)),
        documents.where(cut.isNotNull()).select("company_id", *row("document_truncated", F.col("doc"), F.concat(F.lit("The file has "), mega(F.col("size")), F.lit(" MB, of which the first "), mega(cut), F.lit(" were read.")))),
        contradictions(facts).select("company_id", *row("conflicting_values", F.concat_ws("/", "kind", F.col("seq").cast("string")), F.concat(F.lit("Two values: "), display(F.col("first_ore")), F.lit(" and "), display(F.col("other_ore"))))),
        implausible(facts, revenue, most_ore).select("company_id", *row("implausible_value", F.col("kind"), display(F.col("value_ore")))),
    ]
    kinds = ("instruction_like", "role_impersonation", "capability_probes", "delimiter_attempts")
    scans = pages.select("company_id", "doc", ct.injection(F.col("text")).alias("s")).groupBy("company_id", "doc").agg(*[F.sum(f"s.{k}").alias(k) for k in kinds])
    out.append(scans.where(ct.suspicious(F.struct(*kinds))).select("company_id", *row("instruction_like_content", F.col("doc"), F.lit("The document speaks to an automated reader."))))
    out.append(evaluations.where("outcome = 'rule_error'").select("company_id", *row("rule_error", F.col("rule_id"), F.lit("The rule could not be evaluated."))))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


def limitations(n_documents: Column, awaiting_review: Column, accounts_state: Column) -> Column:
    """Codes of what every report must say about itself, in order."""
    codes = F.array(
        F.concat(F.lit("rests_on_documents:"), n_documents.cast("string")), F.lit("no_legal_decision"),
        F.when(awaiting_review, "rules_await_review"), F.when(accounts_state == "draft", "accounts_are_preliminary"),
    )
    return F.filter(codes, lambda c: c.isNotNull())


def grounded(evidence: Column) -> Column:
    """Evidence gate: of an array of structs with ``kind`` at least one document value and one rule."""
    has = lambda k: F.exists(evidence, lambda e: e["kind"] == k)
    return F.coalesce(has("document_value") & has("rule"), F.lit(False))


def uncovered_years(companies: DataFrame, constants: DataFrame) -> DataFrame:
    """Companies whose year has no constants: their analysis is refused, as no rule set holds for it."""
    years = constants.select("tax_year").distinct()
    return companies.join(F.broadcast(years), "tax_year", "left_anti")


def append(rows: DataFrame, path: str, batch: str, *by: str) -> bool:
    """Adds rows to a table that is only ever appended to (facts, audit), partitioned ``by``, once for each batch id; False if they are
    there already. ``tables.rows_of`` reads them."""
    return put(rows, path, batch, *by)


def audit(spark: SparkSession, path: str, events: DataFrame, batch: str) -> bool:
    """Adds events (actor, event, subject, detail) to the audit log with the time and the day they are kept under, once for each batch id."""
    at = events.select("actor", "event", "subject", "detail", F.current_timestamp().alias("at"))
    return append(at.withColumn("day", F.to_date("at")), path, batch, "day")
