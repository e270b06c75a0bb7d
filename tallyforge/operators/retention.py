"""Purges of linked tables: what is too old goes, with all that hangs on it, and nothing is left without its parent."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Link(NamedTuple):
    """``child.column`` names a row of ``parent`` by its key."""

    child: str
    column: str
    parent: str


def deletion_order(tables: list[str], links: list[Link]) -> list[str]:
    """Tables so that every child comes before its parents; of several that could come next, the first as given. A cycle raises."""
    left, out = list(tables), []
    while left:
        free = [t for t in left if not any(x.parent == t and x.child in left and x.child != t for x in links)]
        if not free:
            raise ValueError(f"tables hang on each other: {', '.join(left)}")
        out.append(free[0])
        left.remove(free[0])
    return out


class Purge(NamedTuple):
    """``kept`` and ``gone`` rows by table, in the order of deletion."""

    kept: dict[str, DataFrame]
    gone: dict[str, DataFrame]


def purge(tables: dict[str, DataFrame], keys: dict[str, str], links: list[Link], expired: dict[str, Column]) -> Purge:
    """``expired`` says which rows of a table go by themselves; with them go the rows of all tables that hang on them, over any number of
    links. Only keys of rows that go are joined, once for each link, so a table that loses little joins with little. A null
    link hangs on nothing; a null condition keeps a row. Keys may repeat: rows of one key stay or go by their own condition,
    and their children go if any of them goes."""
    order = deletion_order(list(tables), links)
    marked: dict[str, DataFrame] = {}
    for t in reversed(order):
        rows = tables[t].withColumn("_gone", F.coalesce(expired.get(t, F.lit(False)), F.lit(False)))
        for i, x in enumerate(x for x in links if x.child == t and x.parent != t):
            ids = marked[x.parent].where("_gone").select(F.col(keys[x.parent]).alias(f"_k{i}")).distinct()
            rows = rows.join(ids, F.col(x.column) == F.col(f"_k{i}"), "left").withColumn("_gone", F.col("_gone") | F.col(f"_k{i}").isNotNull()).drop(f"_k{i}")
        marked[t] = rows
    side = lambda t, gone: marked[t].where(F.col("_gone") if gone else ~F.col("_gone")).drop("_gone")
    return Purge({t: side(t, False) for t in order}, {t: side(t, True) for t in order})


def orphans(kept: dict[str, DataFrame], keys: dict[str, str], links: list[Link]) -> DataFrame:
    """child, column, n: rows whose link names no row that is kept; all 0 after a purge of tables that had none."""
    out = None
    for x in links:
        parents = kept[x.parent].select(F.col(keys[x.parent]).alias("_k")).distinct()
        lost = kept[x.child].where(F.col(x.column).isNotNull()).join(parents, F.col(x.column) == F.col("_k"), "left_anti")
        n = lost.agg(F.count("*").alias("n")).select(F.lit(x.child).alias("child"), F.lit(x.column).alias("column"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def summary(done: Purge) -> DataFrame:
    """place (in the order of deletion), tab, n_kept, n_gone."""
    out = None
    for i, t in enumerate(done.kept):
        a, b = done.kept[t].select(F.lit(0).alias("g")), done.gone[t].select(F.lit(1).alias("g"))
        n = a.unionByName(b).agg(F.count_if(F.col("g") == 0).alias("n_kept"), F.count_if(F.col("g") == 1).alias("n_gone"))
        n = n.select(F.lit(i).alias("place"), F.lit(t).alias("tab"), "n_kept", "n_gone")
        out = n if out is None else out.unionByName(n)
    return out
