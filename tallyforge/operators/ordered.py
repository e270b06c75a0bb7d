"""Running values over ordered logs of keys of any size.

A window over a key puts all of the key's rows into one task. Here the log of a key with very many rows is cut into pieces
of about equal size, by quantiles of its order; a window runs within each piece, and what the pieces before have added
comes by a join with one row a piece. Keys of common size are one piece, so they cost a plain window. There are at most
MOST_CUTS keys that need cutting, by arithmetic: a key is cut only if it has that share of all rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# A key is cut from so many rows on, or sooner or later if that gave over MOST_CUTS cuts in all.
MOST_ROWS, MOST_CUTS = 1_000_000, 100_000


class Log(NamedTuple):
    """Rows with the columns _piece and _hot; ``cut`` tells whether any key has more than one piece."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    cut: bool

    def done(self) -> DataFrame:
        return self.rows.drop("_piece", "_hot")

    def pieces(self) -> DataFrame:
        """The pieces' rows in groups: keys and piece."""
        return self.rows.groupBy(*self.keys, "_piece")


def _number(rows: DataFrame, name: str) -> Column:
    kind = rows.schema[name].dataType.typeName()
    return F.unix_micros(F.col(name).cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else F.col(name)


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return out


def log(rows: DataFrame, keys: list[str], order: list[str], most: int = MOST_ROWS) -> Log:
    """The log of each key (null is a key), in the order of columns of which the first is a time or a number and decides the cuts:
    rows of a key that are equal in it stay in one piece."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total, largest = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    most = max(most, -(-2 * total // MOST_CUTS))
    if largest <= most:
        return Log(rows.withColumn("_piece", F.lit(0)).withColumn("_hot", F.lit(False)), keys, order, False)
    grid = -(-largest // most)
    hot = F.broadcast(sizes.where(F.col("_n") > most).withColumnsRenamed({k: f"_r_{k}" for k in keys}))
    at = _number(rows, order[0])
    shares = [i / grid for i in range(1, grid)]
    cuts = rows.join(hot, _same(keys)).groupBy(*[f"_r_{k}" for k in keys]).agg(F.max("_n").alias("_n"), F.percentile_approx(at, shares, 100 * grid).alias("_all"))
    # as many cuts as the key's own size asks for
    want = F.ceil(F.col("_n") / most).cast("int")
    picked = F.transform(F.sequence(F.lit(1), F.greatest(want - 1, F.lit(1))), lambda i: F.element_at("_all", F.greatest(F.lit(1), F.floor(i * grid / want).cast("int"))))
    cuts = F.broadcast(cuts.select(*[f"_r_{k}" for k in keys], F.array_distinct(picked).alias("_cuts")))
    piece = F.coalesce(F.size(F.filter("_cuts", lambda c: c < at)), F.lit(0))
    dealt = rows.join(cuts, _same(keys), "left").withColumn("_hot", F.col("_cuts").isNotNull()).withColumn("_piece", F.when(F.col("_hot"), piece).otherwise(0))
    return Log(dealt.drop("_cuts", *[f"_r_{k}" for k in keys]), keys, order, True)


def _plus(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


# How a piece is summed up, how pieces before are, and how both go together; all but "before" skip nulls.
_RUNNING = {"sum": (F.sum, _plus), "max": (F.max, lambda a, b: F.greatest(a, b)), "min": (F.min, lambda a, b: F.least(a, b))}


def scan(of: Log, **columns: tuple[str, Column]) -> Log:
    """``of`` with columns name=(kind, value): the running "sum", "max" or "min" up to and with each row, or the value "before" it
    (null on a key's first row)."""
    inside = W.partitionBy(*of.keys, "_piece").orderBy(*of.order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    rows = of.rows
    local = {n: F.lag(F.struct(v.alias("v"))).over(inside) if kind == "before" else _RUNNING[kind][0](v).over(upto) for n, (kind, v) in columns.items()}
    if not of.cut:
        return of._replace(rows=rows.withColumns({n: c["v"] if columns[n][0] == "before" else c for n, c in local.items()}))
    whole = [(F.max_by(F.struct(v.alias("v")), F.struct(*of.order)) if kind == "before" else _RUNNING[kind][0](v)).alias(f"_c_{n}") for n, (kind, v) in columns.items()]
    pieces = rows.where("_hot").groupBy(*of.keys, "_piece").agg(*whole)
    by_piece = W.partitionBy(*of.keys).orderBy("_piece")
    earlier = by_piece.rowsBetween(W.unboundedPreceding, -1)
    carry = [(F.lag(f"_c_{n}").over(by_piece) if kind == "before" else _RUNNING[kind][0](f"_c_{n}").over(earlier)).alias(f"_c_{n}") for n, (kind, _) in columns.items()]
    carry = pieces.select(*[F.col(k).alias(f"_r_{k}") for k in of.keys], F.col("_piece").alias("_r__piece"), *carry)
    # one row a piece of a cut key: MOST_CUTS at most, and as many keys
    rows = rows.withColumns({f"_l_{n}": c for n, c in local.items()}).join(F.broadcast(carry), _same([*of.keys, "_piece"]), "left")
    done = {}
    for n, (kind, _) in columns.items():
        a, b = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        done[n] = F.when(a.isNull(), b["v"]).otherwise(a["v"]) if kind == "before" else _RUNNING[kind][1](a, b)
    drop = [f"_r_{k}" for k in [*of.keys, "_piece"]] + [f"{p}_{n}" for n in columns for p in ("_l", "_c")]
    return of._replace(rows=rows.withColumns(done).drop(*drop))
