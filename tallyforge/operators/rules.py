"""Rules as data, compiled to Catalyst columns.

A rule's condition is three-valued: null is unknown, as SQL has it. Amounts are bigint öre, null is a missing fact.
What a name can't resolve is found here, on the driver, before any row is read.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money
from .facts import missing

_COMPARE = {"lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge, "eq": operator.eq, "ne": operator.ne}


class RuleFault(ValueError):
    """A rule names what does not exist."""


@dataclass
class Names:
    """What rules may name: fact kinds (columns f_<kind>), profile columns, and per-year constants (columns c_<name>)."""

    facts: list[str]
    profile: list[str]
    constants: list[str] = field(default_factory=list)

    def fact(self, kind: str) -> Column:
        if kind not in self.facts:
            raise RuleFault(f"unknown fact {kind}")
        return F.col(f"f_{kind}")

    def constant(self, name: str) -> Column:
        if name not in self.constants:
            raise RuleFault(f"unknown constant {name}")
        return F.col(f"c_{name}")

    def answer(self, name: str) -> Column:
        if name not in self.profile:
            raise RuleFault(f"unknown profile field {name}")
        return F.col(name)


def amount(e: dict | list, names: Names) -> Column:
    """An expression tree, written as {operator: arguments}, to öre."""
    ((op, args),) = e.items()
    sub = lambda x: amount(x, names)
    match op:
        case "fact":
            return names.fact(args)
        case "fact_or_zero":
            return F.coalesce(names.fact(args), money.big(0))
        case "amount":
            return money.big(int(args) * 100)
        case "constant":
            return names.constant(args)
        case "add":
            return reduce(money.add, map(sub, args))
        case "sub":
            return money.sub(sub(args[0]), sub(args[1]))
        case "mul_bp":
            return money.mul_bp(sub(args[0]), int(args[1]))
        case "mul_rate":
            return money.mul_bp(sub(args[0]), names.constant(args[1]))
        case "max0":
            return money.at_least_zero(sub(args))
        case "min":
            return reduce(money.least_strict, map(sub, args))
        case "max":
            return reduce(money.greatest_strict, map(sub, args))
        case "abs":
            return F.abs(sub(args))
    raise RuleFault(f"unknown operator {op}")


def condition(c: dict, names: Names) -> Column:
    """A condition tree to a nullable boolean."""
    ((op, args),) = c.items()
    sub = lambda x: condition(x, names)
    match op:
        case "compare":
            return _COMPARE[args[1]](amount(args[0], names), amount(args[2], names))
        case "fact_present":
            return names.fact(args).isNotNull()
        case "fact_absent":
            return names.fact(args).isNull()
        case "profile":
            return names.answer(args[0]) == F.lit(bool(args[1]))
        case "profile_number":
            return _COMPARE[args[1]](names.answer(args[0]), F.lit(int(args[2])))
        case "accounts_state":
            return F.nullif(names.answer("accounts_state"), F.lit("unknown")) == F.lit(args)
        case "tax_year_at_least":
            return F.col("tax_year") >= int(args)
        case "tax_year_at_most":
            return F.col("tax_year") <= int(args)
        case "all":
            return reduce(operator.and_, map(sub, args), F.lit(True))
        case "any":
            return reduce(operator.or_, map(sub, args), F.lit(False))
        case "not":
            return ~sub(args)
        case "always":
            return F.lit(True)
    raise RuleFault(f"unknown condition {op}")


def walk(tree, wanted: tuple[str, ...]) -> list:
    """Arguments of the wanted operators anywhere in a tree, in order, neighbours of the same value once."""
    out: list = []

    def go(x) -> None:
        if isinstance(x, dict):
            for op, args in x.items():
                if op in wanted:
                    out.append(args[0] if isinstance(args, list) and op in ("profile",) else args)
                else:
                    go(args)
        elif isinstance(x, list):
            for y in x:
                go(y)

    go(tree)
    return [v for i, v in enumerate(out) if i == 0 or v != out[i - 1]]


FACTS = ("fact", "fact_or_zero", "fact_present", "fact_absent")


@dataclass
class Rule:
    """id, category, years [first, last or None], condition; impact: (low, high) expressions or None; exceptions in order; evidence: fact kinds."""

    id: str
    category: str
    when: dict
    impact: tuple[dict, dict] | None = None
    exceptions: tuple[dict, ...] = ()
    evidence: tuple[str, ...] = ()
    years: tuple[int, int | None] = (2023, None)
    risk: str = "low"

    @property
    def effect(self) -> str:
        return "deferral" if "periodiseringsfond" in self.id else "reduction"

    def referenced(self) -> list[str]:
        return list(dict.fromkeys(walk([self.when, list(self.impact or ()), list(self.exceptions)], FACTS) + list(self.evidence)))

    def required(self) -> list[str]:
        return list(dict.fromkeys(walk(list(self.impact or ()), ("fact",)) + list(self.evidence)))

    def questions(self) -> list[str]:
        return list(dict.fromkeys(walk([self.when, list(self.exceptions)], ("profile",))))


def evaluation(rule: Rule, names: Names) -> Column:
    """One rule over one wide row: struct of rule_id, category, effect, outcome, low, high, missing, questions, present, referenced.

    outcome: out_of_scope, not_applicable, exception_applies (the first that is true), indeterminate (condition unknown, impact
    or evidence missing, or an exception unknown), rule_error (the impact overflows though its facts are there), matched.
    """
    cond = condition(rule.when, names)
    excepted = [condition(x, names) for x in rule.exceptions]
    in_year = (F.col("tax_year") >= rule.years[0]) & (F.lit(rule.years[1] is None) | (F.col("tax_year") <= (rule.years[1] or 0)))
    lacking = missing({k: names.fact(k) for k in rule.required()}) if rule.required() else F.array().cast("array<string>")
    open_ = missing({k: names.answer(k) for k in rule.questions()}) if rule.questions() else F.array().cast("array<string>")
    if rule.impact:
        low, high = (amount(x, names) for x in rule.impact)
        span = money.money_range(low, high)
    else:
        span = F.lit(None).cast("struct<low:bigint,high:bigint>")
    overflow = (F.size(lacking) == 0) & span.isNull() if rule.impact else F.lit(False)
    out = F.when(~in_year, "out_of_scope").when(cond == F.lit(False), "not_applicable")
    for x in excepted:
        out = out.when(x, "exception_applies")
    out = out.when(cond.isNull() | (F.size(lacking) > 0), "indeterminate").when(overflow, "rule_error")
    for x in excepted:
        out = out.when(x.isNull(), "indeterminate")
    out = out.otherwise("matched")
    shown = F.when(out.isin("matched", "indeterminate"), span)
    present = [F.when(names.fact(k).isNotNull(), 1).otherwise(0) for k in rule.referenced()]
    return F.struct(
        F.lit(rule.id).alias("rule_id"), F.lit(rule.category).alias("category"), F.lit(rule.effect).alias("effect"), F.lit(rule.risk).alias("risk"),
        out.alias("outcome"), shown["low"].alias("low"), shown["high"].alias("high"), lacking.alias("missing"), open_.alias("questions"),
        reduce(operator.add, present, F.lit(0)).alias("n_present"), F.lit(len(rule.referenced())).alias("n_referenced"),
    )


def evaluate(companies: DataFrame, rules: list[Rule], names: Names) -> DataFrame:
    """company_id, tax_year and one row per rule: all rules in one projection over the wide rows, then inline. Nothing is shuffled."""
    ids = [r.id for r in rules]
    if len(set(ids)) != len(ids):
        raise RuleFault("rule ids are not unique")
    # a column first: what rules share is made once a row there, and a generator would interpret them
    return companies.select("company_id", "tax_year", F.array(*[evaluation(r, names) for r in rules]).alias("evaluations")).select("company_id", "tax_year", F.inline("evaluations"))


# Fact kinds, profile fields and the rule set, reconstructed from published cases and amounts.
KINDS = [
    "taxable_result", "tax_allocation_this_year", "tax_allocation_reserve", "carried_forward_loss", "interest_expense", "personnel_costs", "external_costs",
    "fixed_assets", "equipment", "depreciation", "wages", "total_assets", "total_equity_and_liabilities", "untaxed_reserves",
]
PROFILE = ["in_group", "ownership_changed", "owners_active", "has_vehicles", "does_development_work", "employee_count", "owner_count", "accounts_state"]
_QUARTER = {"mul_bp": [{"fact": "taxable_result"}, 2500]}
_HEADROOM = {"sub": [{"mul_bp": [{"fact": "equipment"}, 3000]}, {"fact": "depreciation"}]}
_ZERO = {"amount": 0}


def _taxed(of: dict) -> tuple[dict, dict]:
    """From nothing to the tax of 20.6 % on an amount."""
    return _ZERO, {"mul_bp": [of, 2060]}


RULES = [
    Rule("se.tax.periodiseringsfond.outnyttjat_utrymme", "tax", {"all": [{"fact_present": "taxable_result"}, {"compare": [_QUARTER, "gt", {"fact_or_zero": "tax_allocation_this_year"}]}]}, _taxed({"max0": {"sub": [_QUARTER, {"fact_or_zero": "tax_allocation_this_year"}]}})),
    Rule("se.tax.periodiseringsfond.aterforing", "tax", {"fact_present": "tax_allocation_reserve"}),
    Rule("se.tax.underskott.kvittning", "tax", {"all": [{"fact_present": "carried_forward_loss"}, {"compare": [{"fact": "taxable_result"}, "gt", _ZERO]}]}, _taxed({"min": [{"fact": "carried_forward_loss"}, {"fact": "taxable_result"}]}), ({"profile": ["in_group", True]}, {"profile": ["ownership_changed", True]})),
    Rule("se.tax.ranteavdrag.ebitda", "tax", {"all": [{"fact_present": "interest_expense"}, {"compare": [{"fact": "interest_expense"}, "gt", {"amount": 5_000_000}]}]}, risk="high"),
    Rule("se.tax.koncernbidrag", "tax", {"all": [{"fact_present": "taxable_result"}, {"profile": ["in_group", True]}]}),
    Rule("se.tax.k10.lonekrav", "tax", {"all": [{"fact_present": "personnel_costs"}, {"profile": ["owners_active", True]}, {"profile_number": ["owner_count", "le", 4]}]}, risk="high"),
    Rule("se.costs.representation", "costs", {"fact_present": "external_costs"}, risk="medium"),
    Rule("se.costs.inventarier.mindre_varde", "costs", {"fact_present": "fixed_assets"}),
    Rule("se.investments.inventarier.avskrivningsutrymme", "investments", {"all": [{"fact_present": "equipment"}, {"fact_present": "depreciation"}, {"compare": [_HEADROOM, "gt", _ZERO]}]}, _taxed({"max0": _HEADROOM})),
    Rule("se.personnel.pension.avdragsutrymme", "personnel", {"fact_present": "wages"}),
    Rule("se.vat.personbil.leasing", "vat", {"profile": ["has_vehicles", True]}, risk="medium"),
    Rule("se.rnd.forskningsavdrag", "rnd", {"all": [{"fact_present": "personnel_costs"}, {"profile": ["does_development_work", True]}]}, risk="medium"),
    Rule("se.risk.balansrakning_stammer_inte", "risk", {"all": [{"fact_present": "total_assets"}, {"fact_present": "total_equity_and_liabilities"}, {"compare": [{"fact": "total_assets"}, "ne", {"fact": "total_equity_and_liabilities"}]}]}, risk="high"),
    Rule("se.risk.obeskattade_reserver_utan_specifikation", "risk", {"all": [{"fact_present": "untaxed_reserves"}, {"fact_absent": "tax_allocation_reserve"}]}, risk="medium"),
]
