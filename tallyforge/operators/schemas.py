"""JSON texts against a schema, and answers of a model read tolerantly."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "array<struct<path:string,message:string>>"
_VARIANT = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}


def _kind(v: Column) -> Column:
    """JSON type of a variant: object, array, string, boolean, integer, number or null."""
    name = F.schema_of_variant(v)
    out = F.when(v.isNull(), None).when(F.is_variant_null(v), "null")
    for kind, word in _VARIANT.items():
        out = out.when(name.startswith(word), kind)
    return out.when(name.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer").when(name.rlike(r"^DECIMAL\([0-9]+,0\)$"), "integer").otherwise("number")


def _problem(path: Column, message: Column | str) -> Column:
    return F.struct(path.alias("path"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _check(v: Column, schema: dict, path: Column) -> list[Column]:
    """Arrays of problems of a variant that is there."""
    kind, out = _kind(v), []
    right = F.lit(True)
    if want := schema.get("type"):
        right = (kind == want) | ((F.lit(want) == "number") & (kind == "integer"))
        found = F.when(kind == "integer", "number").otherwise(kind)
        out.append(F.when(~right, F.array(_problem(path, F.concat(F.lit(f"expected {want}, found "), found)))))
    if "enum" in schema:
        text = F.to_json(v)
        allowed = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in schema["enum"]]
        out.append(F.when(right & ~text.isin(*allowed), F.array(_problem(path, F.concat(F.lit("value "), text, F.lit(" is not one of the permitted options"))))))
    if "required" in schema or "properties" in schema:
        keys = F.when(right & (kind == "object"), F.json_object_keys(F.to_json(v)))
        lacking = F.filter(F.array(*map(F.lit, schema.get("required", []))).cast("array<string>"), lambda k: ~F.array_contains(keys, k))
        out.append(F.transform(lacking, lambda k: _problem(F.concat(path, F.lit("."), k), "required field is missing")))
        known = list(schema.get("properties", {}))
        for name in known:
            child = F.variant_get(v, f"$['{name}']", "variant")
            for part in _check(child, schema["properties"][name], F.concat(path, F.lit(f".{name}"))):
                out.append(F.when(F.array_contains(keys, name), part))
        if schema.get("additionalProperties") is False:
            extra = F.filter(keys, lambda k: ~F.array_contains(F.array(*map(F.lit, known)).cast("array<string>"), k))
            out.append(F.transform(extra, lambda k: _problem(F.concat(path, F.lit("."), k), "unexpected field")))
    if "items" in schema:
        items = F.when(right & (kind == "array"), F.variant_get(v, "$", "array<variant>"))
        each = F.transform(items, lambda x, i: _joined(_check(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        out.append(F.flatten(each))
    return out


def _joined(parts: list[Column]) -> Column:
    none = F.array().cast(_NONE)
    return F.concat(none, *[F.coalesce(p.cast(_NONE), none) for p in parts])


def violations(text: Column, schema: dict) -> Column:
    """All violations of a JSON text against a schema (type, enum, required, properties, additionalProperties false, items) as
    array<struct<path, message>>, paths from $. A value of the wrong type is not looked into. A text that is no JSON, or
    null, breaks it at the root."""
    v = F.try_parse_json(text)
    return F.when(v.isNull(), F.array(_problem(F.lit("$"), "not JSON")).cast(_NONE)).otherwise(_joined(_check(v, schema, F.lit("$"))))


CANDIDATES = "candidates array<struct<title:string,category:string,observation:string,question:string,supporting_facts:array<string>,missing_information:array<string>,suggested_rule_ids:array<string>>>"
VERDICTS = "verdicts array<struct<title:string,survives:boolean,reasoning:string,objection_strength:double,missing_information:array<string>>>"


def candidates(text: Column, categories: list[str]) -> Column:
    """Candidates of a model's answer: those with title, known category, observation and question; absent lists are empty."""
    none = F.array().cast("array<string>")
    got = F.coalesce(F.from_json(text, CANDIDATES)["candidates"], F.array().cast(CANDIDATES.partition(" ")[2]))
    good = F.filter(got, lambda c: c["title"].isNotNull() & c["category"].isin(*categories) & c["observation"].isNotNull() & c["question"].isNotNull())
    lists = ("supporting_facts", "missing_information", "suggested_rule_ids")
    return F.transform(good, lambda c: F.struct(*[c[k].alias(k) for k in ("title", "category", "observation", "question")], *[F.filter(F.coalesce(c[k], none), lambda x: x.isNotNull()).alias(k) for k in lists]))


def verdicts(text: Column) -> Column:
    """Verdicts of a model's answer: those with a title; without its word nothing survives, and objections are 0."""
    got = F.coalesce(F.from_json(text, VERDICTS)["verdicts"], F.array().cast(VERDICTS.partition(" ")[2]))
    good = F.filter(got, lambda v: v["title"].isNotNull())
    return F.transform(good, lambda v: F.struct(
        v["title"].alias("title"), F.coalesce(v["survives"], F.lit(False)).alias("survives"), F.coalesce(v["reasoning"], F.lit("")).alias("reasoning"),
        F.coalesce(v["objection_strength"], F.lit(0.0)).alias("objection_strength"), F.coalesce(v["missing_information"], F.array().cast("array<string>")).alias("missing_information"),
    ))
