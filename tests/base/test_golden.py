"""Eleven statements from text to findings: precision, recall and warnings against what is expected of them."""

from pyspark.sql import functions as F

from tallyforge.operators import facts as fx
from tallyforge.operators import findings as fd
from tallyforge.operators import notices, rules
from tallyforge.sources import documents

# The statements' labels by column, then amounts in kronor of each case (None: no such line), and rule names.
LABELS = [
    "Nettoomsättning", "Övriga externa kostnader", "Handelsvaror", "Personalkostnader", "Löner och andra ersättningar", "Av- och nedskrivningar", "Räntekostnader", "Skattemässigt resultat", "Outnyttjat underskott", "Periodiseringsfond",
    "Årets avsättning till periodiseringsfond", "Obeskattade reserver", "Materiella anläggningstillgångar", "Inventarier, verktyg och installationer", "Summa tillgångar", "Summa eget kapital och skulder",
]
CASES = {
    1: [4_200_000, -650_000, None, -2_100_000, -1_540_000, -40_000, None, 850_000, None, None, None, None, 180_000, 180_000, 2_400_000, 2_400_000],
    2: [28_400_000, -6_200_000, None, -11_500_000, -8_400_000, -900_000, -210_000, 3_700_000, None, None, None, None, 9_400_000, 9_400_000, 18_200_000, 18_200_000],
    3: [16_900_000, None, -9_100_000, -3_400_000, -2_480_000, -120_000, None, 2_750_000, None, None, None, None, 560_000, 560_000, 9_100_000, 9_100_000],
    4: [19_200_000, -3_100_000, None, -10_800_000, -7_900_000, -260_000, None, 4_400_000, None, None, None, None, 1_300_000, 1_300_000, 11_400_000, 11_400_000],
    5: [9_800_000, -2_400_000, None, -2_900_000, -2_120_000, -1_000_000, None, 3_100_000, None, None, None, None, 12_000_000, 12_000_000, 21_500_000, 21_500_000],
    6: [3_100_000, -1_900_000, None, -2_400_000, -1_750_000, -70_000, None, -1_400_000, 2_000_000, None, None, None, 310_000, None, 1_900_000, 1_900_000],
    7: [14_600_000, -3_300_000, None, -6_100_000, -4_450_000, -190_000, None, 2_000_000, None, 1_200_000, 300_000, 1_500_000, 840_000, 840_000, 10_300_000, 10_300_000],
    8: [42_000_000, -9_800_000, None, -17_200_000, -12_560_000, -1_100_000, -320_000, 11_900_000, 3_500_000, None, None, None, 14_600_000, 14_600_000, 38_400_000, 38_400_000],
    9: [300_000, None, None, None, None, None, None, -50_000, None, None, None, None, None, None, 200_000, 200_000],
    10: [8_400_000, -2_100_000, None, -3_300_000, -2_410_000, None, None, None, None, None, None, 900_000, None, None, 6_200_000, 5_400_000],
    11: [4_000_000, -900_000, None, -1_200_000, -880_000, -250_000, None, 900_000, None, None, None, None, 10_200_000, 200_000, 11_150_000, 11_150_000],
}
FUND, BACK, LOSS, EBITDA, GROUP, K10 = "tax.periodiseringsfond.outnyttjat_utrymme", "tax.periodiseringsfond.aterforing", "tax.underskott.kvittning", "tax.ranteavdrag.ebitda", "tax.koncernbidrag", "tax.k10.lonekrav"
REPR, SMALL, EQUIP, PENSION, CAR, RND = "costs.representation", "costs.inventarier.mindre_varde", "investments.inventarier.avskrivningsutrymme", "personnel.pension.avdragsutrymme", "vat.personbil.leasing", "rnd.forskningsavdrag"
BALANCE, RESERVES = "risk.balansrakning_stammer_inte", "risk.obeskattade_reserver_utan_specifikation"
USUAL = {FUND, EQUIP, SMALL, PENSION, REPR, K10}
MUST = {
    1: USUAL, 2: USUAL | {CAR}, 3: USUAL, 4: USUAL | {RND}, 5: USUAL, 6: {SMALL, PENSION, REPR, K10}, 7: USUAL | {BACK}, 8: USUAL | {GROUP, CAR, RND}, 9: set(),
    10: {BALANCE, RESERVES, PENSION, REPR, K10}, 11: {FUND, PENSION},
}
NEVER = {LOSS, GROUP, CAR, RND, BALANCE, RESERVES}
MUST_NOT = {
    1: NEVER | {EBITDA}, 2: NEVER - {CAR} | {EBITDA}, 3: NEVER, 4: NEVER - {RND}, 5: NEVER | {EBITDA}, 6: NEVER | {FUND}, 7: NEVER, 8: {LOSS, EBITDA, BALANCE, RESERVES},
    9: {FUND, BACK, LOSS, EQUIP, SMALL, EBITDA, GROUP, PENSION, CAR, REPR, RND, K10, BALANCE, RESERVES}, 10: {FUND, LOSS, GROUP, CAR, RND}, 11: {EQUIP, LOSS, GROUP, CAR, RND, BALANCE},
}
OWNERS = {1: 2, 2: 3, 3: 1, 4: 3, 5: 2, 6: 2, 7: 2, 8: 4, 9: 1, 10: 2, 11: 2}


def line(label, amount):
    gap = " " if label.startswith(("Löner", "Inventarier")) else " "
    return f"{label:<46}{amount:,}".replace(",", gap) if "," not in label else f"{label}".ljust(46) + f"{amount:,}".replace(",", gap)


def test_golden_cases(spark):
    pages = [(k, "d1", 1, "\n".join(line(n, v) for n, v in zip(LABELS, values) if v is not None)) for k, values in CASES.items()]
    pages += [(10, "d2", 1, line("Nettoomsättning", 7_900_000)), (10, "d3", 1, "   ")]
    pages = spark.createDataFrame(pages, "company_id long, doc string, page int, text string")
    facts = documents.statement_facts(pages)
    wide = fx.wide(fx.canonical(facts), rules.KINDS)
    profile = [(k, 2025, k == 8, False if k == 11 else None, k != 9, k in (2, 8), k in (4, 8), None, OWNERS[k], "final" if k == 11 else "draft") for k in CASES]
    companies = spark.createDataFrame(profile, "company_id long, tax_year int, " + ", ".join(f"{p} {t}" for p, t in zip(rules.PROFILE, ["boolean"] * 5 + ["int", "int", "string"])))
    evaluations = rules.evaluate(companies.join(wide, "company_id", "left"), rules.RULES, rules.Names(rules.KINDS, rules.PROFILE))
    found = {k: set() for k in CASES}
    for r in fd.findings(evaluations).collect():
        found[r.company_id].add(r.rule_id.removeprefix("se."))
    good = sum(len(found[k] & MUST[k]) for k in CASES)
    wrong = {k: found[k] & MUST_NOT[k] for k in CASES if found[k] & MUST_NOT[k]}
    assert not wrong and not found[9]
    assert good / sum(map(len, MUST.values())) >= 0.8 and good / (good + sum(map(len, wrong.values()))) >= 0.95
    assert not {k: MUST[k] - found[k] for k in CASES if MUST[k] - found[k]}
    files = pages.select("company_id", "doc", F.lit("text/plain").alias("mime"), F.length("text").cast("bigint").alias("size"))
    warned = {(w.company_id, w.code) for w in notices.warnings(files, pages, facts, evaluations).collect()}
    assert warned == {(10, "conflicting_values"), (10, "unreadable_page")}
