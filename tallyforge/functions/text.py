"""Text functions of statements, sources and logs, as columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spaces that separate groups of digits, and signs.
SPACES = "   "
DASHES = "‑–—−"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once a row, however often ``f`` names it: a lambda's variable holds it."""
    return F.transform(F.array(value), f)[0]


def fold(text: Column) -> Column:
    """For comparison: special spaces and dashes made plain, lower case, white space collapsed and trimmed."""
    plain = F.translate(text, SPACES + DASHES, " " * len(SPACES) + "-" * len(DASHES))
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


AMOUNT = r"^([^0-9]*)([0-9]+(?:[ \x{A0}\x{202F}.][0-9]{3}(?![0-9]))*)(?:,([0-9]+))?([-\x{2212}]?)"


def first_amount(line: Column) -> Column:
    """First amount of a line as bigint whole units; null without one or on overflow.

    A space or point groups digits only before exactly three; decimals round half up in magnitude; a minus or an open
    parenthesis before (one space between at most for - and parenthesis), or a minus after, makes it negative.
    """
    g = lambda k: F.regexp_extract(line, AMOUNT, k)

    def amount(digits: Column) -> Column:
        size = F.try_add(digits.try_cast("bigint"), F.when(F.left(g(3), F.lit(1)) >= "5", 1).otherwise(0).cast("bigint"))
        negative = g(1).rlike(r"[-\x{2212}(]$|[-(][ \x{A0}]$") | (g(4) != "")
        return F.when(digits == "", None).otherwise(once(size, lambda n: F.when(negative, -n).otherwise(n)))

    return once(F.regexp_replace(g(2), r"[^0-9]", ""), amount)


# Statement labels and the kind each names; among labels in a line the longest wins.
LABELS = [
    ("nettoomsättning", "revenue"), ("rörelsens intäkter", "revenue"), ("övriga rörelseintäkter", "other_operating_income"), ("råvaror och förnödenheter", "external_costs"),
    ("övriga externa kostnader", "external_costs"), ("handelsvaror", "external_costs"), ("personalkostnader", "personnel_costs"), ("löner och andra ersättningar", "wages"),
    ("löner och ersättningar", "wages"), ("löner, andra ersättningar och sociala kostnader", "personnel_costs"), ("av- och nedskrivningar", "depreciation"), ("avskrivningar", "depreciation"),
    ("avskrivningar av materiella och immateriella anläggningstillgångar", "depreciation"), ("avskrivningar av materiella anläggningstillgångar", "depreciation"),
    ("rörelseresultat", "operating_profit"), ("ränteintäkter", "interest_income"), ("räntekostnader", "interest_expense"), ("resultat efter finansiella poster", "profit_before_tax"),
    ("resultat före skatt", "profit_before_tax"), ("skatt på årets resultat", "tax_expense"), ("årets resultat", "net_profit"), ("immateriella anläggningstillgångar", "intangible_assets"),
    ("materiella anläggningstillgångar", "fixed_assets"), ("inventarier, verktyg och installationer", "equipment"), ("maskiner och inventarier", "equipment"),
    ("maskiner och andra tekniska anläggningar", "equipment"), ("inventarier", "equipment"), ("varulager", "inventory"), ("kundfordringar", "receivables"), ("kassa och bank", "cash"),
    ("summa tillgångar", "total_assets"), ("summa eget kapital och skulder", "total_equity_and_liabilities"), ("summa eget kapital", "equity"), ("obeskattade reserver", "untaxed_reserves"),
    ("avsättningar", "provisions"), ("långfristiga skulder", "long_term_liabilities"), ("kortfristiga skulder", "current_liabilities"), ("periodiseringsfond", "tax_allocation_reserve"),
    ("årets avsättning till periodiseringsfond", "tax_allocation_this_year"), ("ackumulerade överavskrivningar", "excess_depreciation"), ("outnyttjat underskott", "carried_forward_loss"),
    ("skattemässigt resultat", "taxable_result"), ("ej avdragsgilla kostnader", "non_deductible_costs"), ("ej skattepliktiga intäkter", "non_taxable_income"),
    ("koncernbidrag", "group_contribution"), ("pensionskostnader", "pension_costs"), ("sociala avgifter", "payroll_tax"), ("ingående moms", "input_vat"), ("utgående moms", "output_vat"),
]
NOT_A_FACT = ["ackumulerade avskrivningar", "ackumulerade nedskrivningar", "ingående avskrivningar", "utgående avskrivningar", "årets avskrivningar enligt plan på"]
THOUSANDS = ["belopp i tkr", "belopp i tusental", "tkr)", "(tkr", "belopp anges i tusental kronor"]


def match_label(line: Column) -> Column:
    """Kind of the longest label (in bytes) that the line holds, the later entry on ties; null for none."""
    labels = sorted(enumerate(LABELS), key=lambda x: (len(x[1][0].encode()), x[0]), reverse=True)

    def kind(low: Column) -> Column:
        found = F.when(reduce(or_, [F.contains(low, F.lit(p)) for p in NOT_A_FACT]), None)
        for _, (label, name) in labels:
            found = found.when(F.contains(low, F.lit(label)), name)
        return found

    return once(fold(line), kind)


def in_thousands(text: Column) -> Column:
    """Whether a text says that its amounts are in thousands."""
    return once(fold(text), lambda low: reduce(or_, [F.contains(low, F.lit(mark)) for mark in THOUSANDS]))


def strip_markup(html: Column) -> Column:
    """HTML to text: scripts and styles go, block ends become line ends, cells gaps, other tags spaces; entities are decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|tr|li|ul|ol|h[1-6]|table|section|article|header|footer|nav)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?i)</(td|th)\s*>", "   ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&sect;", "§"), ("&aring;", "å"), ("&auml;", "ä"), ("&ouml;", "ö"), ("&ndash;", "-"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(t, r"[ \t\r]+", " ")
    return F.trim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"))


def locator_present(text: Column, chapter: int, section: int) -> Column:
    """Whether 'N kap.' is followed by 'M §' within 400 characters, both numbers whole."""
    return fold(text).rlike(rf"(?<![0-9]){chapter}[ .]*kap.{{0,400}}(?<![0-9]){section}[ .]*§")


# Phrases that speak to a model instead of stating facts.
INJECTION = ["ignore previous", "ignore all", "disregard", "system prompt", "you are now", "new instructions", "override", "<|im_start|>", "act as", "developer mode"]


def injection_hits(text: Column) -> Column:
    """How many of the phrases occur."""
    low = F.lower(text)
    return F.size(F.filter(F.array(*map(F.lit, INJECTION)), lambda p: F.contains(low, p)))


def org_number(raw: Column) -> Column:
    """Digits as NNNNNN-NNNN if they are ten, or twelve from 16, and pass Luhn; else null."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    ten = F.when(F.length(digits) == 10, digits).when((F.length(digits) == 12) & digits.startswith("16"), F.right(digits, F.lit(10)))
    return F.when(F.call_function("luhn_check", ten), F.concat(F.left(ten, F.lit(6)), F.lit("-"), F.right(ten, F.lit(4))))


def citation(title: Column, locator: Column) -> Column:
    return F.when(locator.rlike("§|kap"), F.concat_ws(" ", title, locator)).otherwise(F.concat_ws(" — ", title, locator))


def idempotency_key(kind: Column, scope: Column, ids: Column) -> Column:
    short = F.array_sort(F.transform(ids, lambda x: F.left(x, F.lit(8))))
    return F.concat_ws(":", kind, scope, F.array_join(short, "-"))


def key_is_valid(key: Column) -> Column:
    return key.rlike("^[A-Za-z0-9:_-]{8,200}$")


def looks_delimited(text: Column) -> Column:
    """Of the first five lines at least two aren't blank, and all those have the same count, two or more, of ; or of ,."""
    lines = F.filter(F.slice(F.split(text, "\n"), 1, 5), lambda x: F.trim(x) != "")
    count = lambda x: F.greatest(F.length(x) - F.length(F.replace(x, F.lit(";"), F.lit(""))), F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))))
    counts = F.transform(lines, count)
    return (F.size(lines) >= 2) & F.forall(counts, lambda c: (c >= 2) & (c == counts[0]))


def label_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def traceparent(header: Column) -> Column:
    """struct<trace_id, span_id, sampled>; null if the header is not well formed or an id is all zeros."""
    shape = r"^00-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"
    trace, span, flags = (F.regexp_extract(header, shape, k) for k in (1, 2, 3))
    ok = (trace != "") & (trace != "0" * 32) & (span != "0" * 16)
    return F.when(ok, F.struct(trace.alias("trace_id"), span.alias("span_id"), (F.conv(flags, 16, 10).cast("int") % 2 == 1).alias("sampled")))
