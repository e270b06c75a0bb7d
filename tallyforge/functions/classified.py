"""Log lines and labels in which nothing shows that its sink may not hold."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .variants import leaves

# Levels from open to closed, and the highest that each sink may show.
LEVELS = ["public", "internal", "confidential", "highly_confidential"]
CEILINGS = {"metric_label": "public", "log": "internal", "trace": "internal", "error_body": "confidential", "model_request": "highly_confidential"}
REDACTED = "[redacted]"
# Labels whose values have no bound.
UNBOUNDED = ["user_id", "company_id", "document_id", "analysis_id", "request_id", "email", "ip", "path", "trace_id", "span_id"]


def pattern(path: str) -> str:
    """A path of names joined by dots as a regular expression: * stands for one name, ** for any number of them. Positions in arrays are
    not part of a path."""
    parts = [re.escape(p) if p not in ("*", "**") else p for p in path.split(".")]
    out = ""
    for i, p in enumerate(parts):
        if p == "**":
            out += r"(?:[^.]+(?:\.|$))*"
        else:
            out += (r"[^.]+" if p == "*" else p) + (r"\." if i < len(parts) - 1 and parts[i + 1] != "**" else r"(?:\.|$)" if i < len(parts) - 1 else "")
    return f"^{out}$"


def level(path: Column, classes: dict[str, str], default: str = "confidential") -> Column:
    """The number of a path's level: the highest of all patterns that match it, or the default's where none does. Patterns are one
    expression a level, put together once."""
    out, by = F, {}
    for p, name in classes.items():
        by.setdefault(LEVELS.index(name), []).append(pattern(p))
    for n in sorted(by, reverse=True):
        out = out.when(path.rlike("|".join(by[n])), n)
    return out.otherwise(LEVELS.index(default)) if by else F.lit(LEVELS.index(default))


def rendered(rows: DataFrame, ids: list[str], tree: Column, classes: dict[str, str], sink: Column, default: str = "confidential") -> DataFrame:
    """(ids, line): 'path=value' for each leaf of a variant, in order and one space apart; a value above the ceiling of the row's ``sink``
    is [redacted]. An unknown or null sink shows public fields only; null trees have the line null. Ids are unique. Names keep
    their dots, so a field can't take another's path by holding one: its dots are shown as underscores."""
    held = rows.select(*ids, F.coalesce(F.element_at(F.create_map(*[F.lit(x) for s, c in CEILINGS.items() for x in (s, LEVELS.index(c))]), sink), F.lit(0)).alias("_ceiling"), tree.alias("_tree"))
    found = leaves(held, [*ids, "_ceiling"], F.col("_tree"))
    path = F.array_join(F.transform(F.filter("keys", lambda k: k.isNotNull()), lambda k: F.replace(k, F.lit("."), F.lit("_"))), ".")
    shown = F.when(level(path, classes, default) <= F.col("_ceiling"), F.coalesce(F.col("value").cast("string"), F.lit("null"))).otherwise(REDACTED)
    lines = found.groupBy(*ids).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat(path, F.lit("="), shown).alias("t")))), lambda x: x["t"]), " ").alias("line"))
    # a tree has a leaf at least, so only rows without one are missing; a join would broadcast lines whose files are small
    return lines.unionByName(held.where("_tree is null").select(*ids, F.lit(None).cast("string").alias("line")))


def admitted(name: Column, of_level: Column) -> Column:
    """Whether a metric may carry a label: its level is public and its values are bounded. A null name is not admitted."""
    return F.coalesce((of_level <= LEVELS.index(CEILINGS["metric_label"])) & ~name.isin(UNBOUNDED), F.lit(False))
