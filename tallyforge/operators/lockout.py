"""Runs of failed attempts: the longest, the open one, and when an account is first locked.

A stretch of attempts is summed up by four numbers: how many it has, the failures it begins with, those it ends with, and its
longest run. Two neighbouring stretches have a summary that follows from theirs, so stretches can be summed up anywhere
(pieces of a log, batches of a stream) and put together in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ordered import MOST_ROWS, log


class Stretch(NamedTuple):
    n: int = 0
    prefix: int = 0
    suffix: int = 0
    best: int = 0

    def then(self, b: Stretch) -> Stretch:
        return Stretch(
            self.n + b.n, self.prefix + b.prefix if self.prefix == self.n else self.prefix,
            b.suffix + self.suffix if b.suffix == b.n else b.suffix, max(self.best, b.best, self.suffix + b.prefix),
        )


def _then(a: Column, b: Column) -> Column:
    """Two summaries as structs: ``Stretch.then`` in columns."""
    return F.struct(
        (a["n"] + b["n"]).alias("n"), F.when(a["prefix"] == a["n"], a["prefix"] + b["prefix"]).otherwise(a["prefix"]).alias("prefix"),
        F.when(b["suffix"] == b["n"], b["suffix"] + a["suffix"]).otherwise(b["suffix"]).alias("suffix"),
        F.greatest(a["best"], b["best"], a["suffix"] + b["prefix"]).alias("best"),
    )


def attempts(rows: DataFrame, key: str, order: list[str], failed: Column, limit: int, most: int = MOST_ROWS) -> DataFrame:
    """One row a key: n, longest, open_run (failures since the last success), locked, locked_at (the first column of the order at the
    attempt with which a run first reached ``limit``; null if none did). A null outcome is a success. A key's log may be of any size:
    within pieces runs are counted by windows, across pieces summaries are put together, one a piece."""
    of = log(rows.withColumn("_bad", F.coalesce(failed, F.lit(False)).cast("int")), [key], order, most)
    inside = W.partitionBy(key, "_piece").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    # runs are told apart by the successes before them
    run = of.rows.withColumn("_run", F.sum(1 - F.col("_bad")).over(upto))
    within = W.partitionBy(key, "_piece", "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    run = run.withColumn("_k", F.sum("_bad").over(within))
    pieces = run.groupBy(key, "_piece").agg(
        F.count("*").cast("bigint").alias("n"), F.max("_k").alias("best"), F.max(F.when(F.col("_run") == 0, F.col("_k"))).alias("prefix"),
        F.max_by("_k", F.struct(*order)).alias("suffix"),
        # the first attempt with which a run of the piece itself reaches the limit, and those of the run it begins with, by length
        F.min(F.when(F.col("_k") == limit, F.struct(*order))).alias("own"),
        F.array_sort(F.collect_list(F.when((F.col("_run") == 0) & (F.col("_bad") == 1) & (F.col("_k") <= limit), F.struct("_k", F.struct(*order).alias("o"))))).alias("heads"),
    )
    summary = F.struct("_piece", "n", F.coalesce("prefix", F.lit(0)).alias("prefix"), "suffix", "best", "own", "heads")
    keys = pieces.groupBy(key).agg(F.array_sort(F.collect_list(summary)).alias("p"))
    order_type = F.lit(None).cast(pieces.schema["own"].dataType)
    none = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("n", "prefix", "suffix", "best")], order_type.alias("at"))

    def step(a: Column, b: Column) -> Column:
        # failures before and those the piece begins with may reach the limit together; that is earlier than a run of its own
        together = F.get(F.transform(F.filter(b["heads"], lambda h: h["_k"] + a["suffix"] == limit), lambda h: h["o"]), 0)
        reached = F.when(a["suffix"] > 0, together)
        at = F.coalesce(a["at"], F.least(reached, b["own"]))
        return F.struct(*[_then(a, b)[c].alias(c) for c in ("n", "prefix", "suffix", "best")], at.alias("at"))

    done = keys.withColumn("s", F.aggregate("p", none, step))
    return done.select(key, F.col("s.n").alias("n"), F.col("s.best").alias("longest"), F.col("s.suffix").alias("open_run"), (F.col("s.best") >= limit).alias("locked"), F.col(f"s.at.{order[0]}").alias("locked_at"))


OUT = "{key} bigint, n bigint, longest bigint, open_run bigint, locked boolean, locked_at timestamp"


class _Attempts(StatefulProcessor):
    """The summary of all attempts of an account so far, and when it was first locked."""

    def __init__(self, key: str, limit: int):
        self.key, self.limit = key, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("attempts", "n long, prefix long, suffix long, best long, locked_at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *before, locked_at = self.state.get() if self.state.exists() else (0, 0, 0, 0, None)
        now = Stretch(*before)
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for ts, failed in zip(batch["ts"], batch["failed"]):
            now = now.then(Stretch(1, 1, 1, 1) if failed else Stretch(1))
            if locked_at is None and now.suffix >= self.limit:
                locked_at = ts.to_pydatetime()
        self.state.update((*now, locked_at))
        yield pd.DataFrame({self.key: [key[0]], "n": [now.n], "longest": [now.best], "open_run": [now.suffix], "locked": [now.best >= self.limit], "locked_at": pd.to_datetime([locked_at])})

    def close(self) -> None:
        pass


def watch(events: DataFrame, key: str, limit: int) -> DataFrame:
    """A stream of attempts (key, ts, event_id, failed) to each account's summary after every batch; batches come in order of time."""
    rows = events.select(key, F.col("ts").cast("timestamp").alias("ts"), "event_id", "failed")
    return rows.groupBy(key).transformWithStateInPandas(_Attempts(key, limit), OUT.format(key=key), "update", "none")
