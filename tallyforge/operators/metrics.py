"""Metrics from an event log: buckets, quantiles of buckets, text exposition, growth and absence of counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import label_escape
from .ordered import MOST_ROWS, log, scan


def buckets(events: DataFrame, by: str, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative counts per bound, the last bound infinite: all in one aggregate, then a row per bound."""
    ends = [*bounds, float("inf")]
    wide = events.groupBy(by).agg(*[F.count_if(F.col(value) <= x).alias(f"b{i}") for i, x in enumerate(ends)], F.sum(value).alias("sum"))
    return wide.select(by, F.inline(F.array(*[F.struct(F.lit(float(x)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, x in enumerate(ends)])), "sum")


def quantile(counts: DataFrame, by: str, q: float) -> DataFrame:
    """Quantile by linear interpolation within the bucket that reaches it; in the infinite bucket, the highest finite bound."""
    order = W.partitionBy(by).orderBy("le")
    rows = counts.withColumn("below", F.coalesce(F.lag("cumulative").over(order), F.lit(0))).withColumn("from_", F.coalesce(F.lag("le").over(order), F.lit(0.0)))
    rank = F.max("cumulative").over(W.partitionBy(by)) * F.lit(q)
    hit = rows.withColumn("rank", rank).where((F.col("cumulative") >= F.col("rank")) & (F.col("below") < F.col("rank")))
    inside = F.col("from_") + (F.col("le") - F.col("from_")) * (F.col("rank") - F.col("below")) / (F.col("cumulative") - F.col("below"))
    return hit.select(by, F.when(F.col("le") == float("inf"), F.col("from_")).otherwise(inside).alias("value"))


def exposition(samples: DataFrame, name: Column, labels: dict[str, Column], value: Column) -> DataFrame:
    """Lines name{label="value",...} number, labels in order of their names."""
    pairs = [F.concat(F.lit(f'{k}="'), label_escape(v), F.lit('"')) for k, v in sorted(labels.items())]
    number = F.when(value == value.cast("bigint"), value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return samples.select(F.concat(name, F.lit("{"), F.concat_ws(",", *pairs), F.lit("} "), number).alias("line"))


def deltas(samples: DataFrame, series: list[str], order: list[str], value: Column, most: int = MOST_ROWS) -> DataFrame:
    """``samples`` of counters with delta: how much each has grown since the sample before it in its series, null for the first. A value
    below the one before means the counter began again at nothing, so the whole value is growth. Samples without a value are
    left out."""
    rows = samples.withColumn("_v", value).where(F.col("_v").isNotNull())
    rows = scan(log(rows, series, order, most), _p=("before", F.col("_v"))).done()
    grown = F.when(F.col("_v") < F.col("_p"), F.col("_v")).otherwise(F.col("_v") - F.col("_p"))
    return rows.withColumn("delta", grown).drop("_v", "_p")


def increase(samples: DataFrame, series: list[str], order: list[str], value: Column, step: str, most: int = MOST_ROWS) -> DataFrame:
    """Growth of each series in each step that has samples: series, step_start, n, increase, rate (a second). Growth between two samples
    counts for the step of the later one; nothing is extrapolated to a step's edges. ``order`` begins with the time."""
    rows = deltas(samples, series, order, value, most)
    w = F.window(F.col(order[0]).cast("timestamp"), step)
    out = rows.groupBy(*series, w.alias("_w")).agg(F.count("*").alias("n"), F.coalesce(F.sum("delta"), F.lit(0)).alias("increase"))
    seconds = F.unix_timestamp("_w.end") - F.unix_timestamp("_w.start")
    return out.select(*series, F.col("_w.start").alias("step_start"), "n", "increase", (F.col("increase") / seconds).alias("rate"))


def absent(samples: DataFrame, series: list[str], ts: str, step: str) -> DataFrame:
    """Steps between a table's first and last sample in which a series has none: series, step_start. The steps are made for each
    series' own row, so as many as there are series and steps, and those with samples are taken away."""
    w = F.window(F.col(ts).cast("timestamp"), step)["start"]
    there = samples.where(F.col(ts).isNotNull()).select(*series, w.alias("step_start")).distinct()
    a, b = there.agg(F.min("step_start"), F.max("step_start")).first()
    if a is None:
        return there
    steps = F.sequence(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp"), F.expr(f"interval {step}"))
    spine = there.select(*series).distinct().withColumn("step_start", F.explode(steps))
    same = F.lit(True)
    for c in [*series, "step_start"]:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    return spine.alias("s").join(there.alias("t"), same, "left_anti")


def clamp_min(x: Column, least: float) -> Column:
    """``x``, or ``least`` where that is more; null stays null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(least)))
