"""Statistics of simulated outputs: exact percentiles, shape, sensitivity, convergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import written

# Rows that one task sorts: more rows take more tasks. Wanted ranks that are broadcast; more are joined by a shuffle.
ROWS = 1 << 20
MOST_WANTED = 200_000
PERCENTS = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def _held(df: DataFrame) -> DataFrame:
    """``df`` computed once, so that its partition numbers are the same for every reader."""
    return df.checkpoint() if df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir") else df.persist()


def _placed(samples: DataFrame, by: list[str], x: str) -> tuple[DataFrame, DataFrame]:
    """Distinct values in a range sort over all groups: (by, x, c, below), c rows each and ``below`` rows of the group before
    them, with the partition; and each group's first rank and rows per partition. No group meets in one task."""
    counts = samples.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("_x")).agg(F.count("*").alias("_c"))
    counts = _held(counts.repartitionByRange(*by, "_x").withColumn("_part", F.spark_partition_id()))
    rows = counts.groupBy(*by, "_part").agg(F.sum("_c").alias("_size"))
    before = F.sum("_size").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    parts = rows.withColumn("_base", F.coalesce(before, F.lit(0))).withColumn("_n", F.sum("_size").over(W.partitionBy(*by)))
    inside = F.sum("_c").over(W.partitionBy(*by, "_part").orderBy("_x").rowsBetween(W.unboundedPreceding, -1))
    values = _same(counts.withColumn("_inside", F.coalesce(inside, F.lit(0))), parts.drop("_size"), [*by, "_part"])
    return values.withColumn("_below", F.col("_base") + F.col("_inside")), parts


def _same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join that takes null keys as equal and keeps the left ones."""
    right = right.withColumnsRenamed({c: f"{c}__r" for c in on})
    cond = [F.col(c).eqNullSafe(F.col(f"{c}__r")) for c in on]
    return left.join(right, cond, how).drop(*[f"{c}__r" for c in on])


def _sorted(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` sorted over as many tasks as they need and written once, with the part and the place in it from 0. Rows that are equal
    in ``order`` are spread, so they need not meet in one part; no task holds more than what it sorts."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS + 1)
    ranged = rows.withColumn("_tie", F.rand(0)).repartitionByRange(tasks, *order, "_tie").sortWithinPartitions(*order).drop("_tie")
    at = F.monotonically_increasing_id()
    return written(ranged.select("*", F.shiftrightunsigned(at, 33).cast("int").alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_place")), "sorted")


def percentiles(samples: DataFrame, by: list[str], x: str, percents: tuple[float, ...]) -> DataFrame:
    """(by, q): exact type-7 percentiles per group as an array, from places in a distributed sort; null for groups without values."""
    rows = _sorted(samples.where(F.col(x).isNotNull()).select(*by, (F.col(x).cast("double") + 0.0).alias("_x")), [*by, "_x"])
    parts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_size"), F.min("_place").alias("_first"))
    few = parts.count() * 2 * len(percents) <= MOST_WANTED
    before = F.sum("_size").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("_base", F.coalesce(before, F.lit(0))).withColumn("_n", F.sum("_size").over(W.partitionBy(*by)))
    at = F.lit(1.0) * (F.col("_n") - 1)
    want = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(p) * at).alias("at")) for i, p in enumerate(percents)])
    wanted = parts.withColumn("w", F.explode(want)).withColumn("_below", F.explode(F.array_distinct(F.array(F.floor("w.at"), F.ceil("w.at")))))
    wanted = wanted.where((F.col("_below") >= F.col("_base")) & (F.col("_below") < F.col("_base") + F.col("_size")))
    wanted = wanted.select(*by, "_part", (F.col("_below") - F.col("_base") + F.col("_first")).alias("_place"), "_below", "w")
    found = _same(rows.withColumnRenamed("_x", "v"), F.broadcast(wanted) if few else wanted, [*by, "_part", "_place"])
    ends = found.groupBy(*by, F.col("w.i").alias("_i"), F.col("w.at").alias("_p")).agg(F.min_by("v", "_below").alias("a"), F.max_by("v", "_below").alias("b"))
    share = F.col("_p") - F.floor("_p")
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - share) * F.col("a") + share * F.col("b"))
    q = ends.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", value.alias("v")))).alias("q"))
    return _same(samples.select(*by).distinct(), q.select(*by, F.col("q.v").alias("q")), by, "left")


def block(samples: DataFrame, by: str, x: str, target: float, direction: str = "at_least") -> DataFrame:
    """One row per output: range, mean, spread, exact percentiles (type 7), probabilities, interval of the mean from 30 samples on."""
    v = F.col(x)
    hit = v >= target if direction == "at_least" else v <= target
    share = lambda c: F.avg(c.cast("double"))
    n, mean, sd = F.count(v), F.avg(v), F.sqrt(F.coalesce(F.var_samp(v), F.lit(0.0)))
    half = 1.96 * sd / F.sqrt(n)
    rows = samples.groupBy(by).agg(
        n.alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), mean.alias("mean"), sd.alias("sd"), share(hit).alias("p_target"), share(v < 0).alias("p_loss"),
        F.when(n >= 30, mean - half).alias("ci_low"), F.when(n >= 30, mean + half).alias("ci_high"),
    )
    return _same(rows, percentiles(samples, [by], x, PERCENTS), [by]).select(by, "n", "least", "most", "mean", "sd", *[F.col("q")[i].alias(f"p{int(p * 100)}") for i, p in enumerate(PERCENTS)], "p_target", "p_loss", "ci_low", "ci_high")


def percentiles_by_rank(samples: DataFrame, x: str, percents: tuple[float, ...] = PERCENTS) -> DataFrame:
    """(percent, value): exact type-7 percentiles of a very long column; no rows for one without values. Nulls are left out."""
    q = percentiles(samples.select(F.lit(0).alias("_all"), F.col(x)), ["_all"], x, percents)
    rows = q.select(F.posexplode("q").alias("i", "value")).where("value is not null")
    return rows.select(F.get(F.array(*map(F.lit, percents)), F.col("i")).alias("percent"), F.col("value").cast("double").alias("value"))


def cdf(samples: DataFrame, by: str, x: str, points: int = 201) -> DataFrame:
    at = [i / (points - 1) for i in range(points)]
    q = percentiles(samples, [by], x, tuple(at))
    return q.select(by, F.posexplode("q").alias("point", "value"))


def histogram(samples: DataFrame, by: str, x: str, bins: int = 48) -> DataFrame:
    """Equal bins per output, empty ones too; the top edge belongs to the last bin and a constant has one bin."""
    bins = max(4, min(512, bins))
    ends = samples.groupBy(by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    ends = ends.withColumn("bins", F.when(F.col("hi") > F.col("lo"), bins).otherwise(1)).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    bin_ = F.when(F.col("width") > 0, F.least(F.floor((F.col(x) - F.col("lo")) / F.col("width")), F.col("bins") - 1)).otherwise(0)
    counts = samples.join(ends, by).groupBy(by, bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    spine = ends.select(by, "lo", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return spine.join(counts, [by, "bin"], "left").select(by, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def density(samples: DataFrame, by: str, x: str, bins: int = 48, most: int = 20_000) -> DataFrame:
    """Gaussian kernel density at bin centres, by every k-th value in order (at most about ``most``), Silverman's width, cut at 4."""
    stats = samples.groupBy(by).agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    stats = _same(stats, percentiles(samples, [by], x, (0.25, 0.75)), [by])
    spread = F.least(F.col("sd"), (F.col("q")[1] - F.col("q")[0]) / 1.349)
    stats = stats.withColumn("h", 0.9 * spread * F.pow("n", F.lit(-0.2))).withColumn("width", (F.col("hi") - F.col("lo")) / bins).withColumn("step", F.greatest(F.ceil(F.col("n") / most), F.lit(1))).where("h > 0")
    # of a value's ranks below .. below + c - 1, the multiples of the step
    times = F.ceil((F.col("_below") + F.col("_c")) / F.col("step")) - F.ceil(F.col("_below") / F.col("step"))
    values = _placed(samples, [by], x)[0].select(by, F.col("_x").alias("x"), "_c", "_below")
    taken = _same(values, F.broadcast(stats), [by]).withColumn("times", times).where("times > 0")
    # a value reaches only the bins within 4 widths of it
    lo = F.greatest(F.floor((F.col("x") - 4 * F.col("h") - F.col("lo")) / F.col("width") - 0.5), F.lit(0))
    hi = F.least(F.ceil((F.col("x") + 4 * F.col("h") - F.col("lo")) / F.col("width") - 0.5), F.lit(bins - 1))
    near = taken.withColumn("bin", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
    z = (F.col("lo") + (F.col("bin") + 0.5) * F.col("width") - F.col("x")) / F.col("h")
    total = taken.groupBy(by).agg(F.sum("times").alias("m"))
    summed = near.where(F.abs(z) <= 4).groupBy(by, "bin", "h", "width").agg(F.sum(F.col("times") * F.exp(-0.5 * z * z)).alias("s"))
    return summed.join(total, by).select(by, "bin", (F.col("s") / (F.col("m") * F.col("h") * 2.5066282746310002) * F.col("width")).alias("density"))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation, null for fewer than two samples or none spread, within [-1, 1]."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when((F.count(x) >= 2) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _ranks(df: DataFrame, by: list[str], x: str, out: str) -> DataFrame:
    values = _placed(df, by, x)[0]
    return values.select(*by, F.col("_x").alias(x), (F.col("_below") + (F.col("_c") + 1) / 2.0).cast("double").alias(out))


def ranks(df: DataFrame, by: str, x: str, out: str) -> DataFrame:
    """(by, x, out): rank of each value with ties at their mean. Values are counted, then placed by a range sort over all groups,
    so neither ties nor a group of many values meet in one task."""
    return _ranks(df, [by], x, out)


def average_rank(df: DataFrame, by: str, x: str, out: str) -> DataFrame:
    return df.join(ranks(df, by, x, out), [by, x])


def sensitivity(samples: DataFrame, by: str, output: str, inputs: list[str]) -> DataFrame:
    """Per output and input: Pearson, Spearman, share of the squared rank correlations, place.

    Inputs are turned into rows once and ranked together, so there is one join for all of them and one for the output.
    """
    samples = samples.where(F.col(by).isNotNull() & F.col(output).isNotNull())
    ranked = samples.join(ranks(samples, by, output, "_r_out"), [by, output])
    rows = F.inline(F.array(*[F.struct(F.lit(i).alias("input"), F.col(i).cast("double").alias("_v")) for i in inputs]))
    long = ranked.select(by, F.col(output).alias("_out"), "_r_out", rows).where("_v is not null")
    # every sample is ranked, so the inputs are ranked from the samples and not from their join
    values = samples.select(by, rows).where("_v is not null")
    both = _same(long, _ranks(values, [by, "input"], "_v", "_r"), [by, "input", "_v"])
    rows = both.groupBy(by, "input").agg(pearson(F.col("_v"), F.col("_out")).alias("pearson"), pearson(F.col("_r"), F.col("_r_out")).alias("spearman"))
    square = F.coalesce(F.col("spearman") * F.col("spearman"), F.lit(0.0))
    total = F.sum(square).over(W.partitionBy(by))
    rows = rows.withColumn("share", F.when(total > 0, square / total).otherwise(0.0))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(F.desc("share"), "input")))


def numbered(samples: DataFrame, order: list[str], out: str) -> DataFrame:
    """Rows of the columns ``order`` with their number from 0 in that order, without a sort in one task; equal rows follow each other.
    The number of parts, which is broadcast, is one for a million rows."""
    rows = _sorted(samples.select(*order), order)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    bases = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), "_part").select(*order, (F.col("_base") + F.col("_place")).alias(out))


def checkpoints(n: int) -> list[int]:
    """1000, 5000, 10 000, 50 000 and so on below n, then n."""
    out, step = [], 1000
    while step < n:
        out.append(step)
        if 5 * step < n:
            out.append(5 * step)
        step *= 10
    return [*out, n]


def convergence(samples: DataFrame, by: str, iteration: str, x: str, n: int | None = None) -> DataFrame:
    """Statistics of the first samples at each checkpoint and the change from the one before. Iterations count from 0; without
    ``n``, the last checkpoint holds them all."""
    if n is None:
        n = (samples.agg(F.max(iteration)).first()[0] or 0) + 1
    cps = checkpoints(n)
    marks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(cp).cast("bigint").alias("checkpoint")) for i, cp in enumerate(cps)])
    spine = samples.select(by).distinct().select(by, F.inline(marks))
    prefixes = samples.select(by, F.col(iteration).alias("_at"), F.col(x).alias("_v"), F.inline(marks)).where("_at < checkpoint")
    rows = prefixes.groupBy(by, "i").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"))
    rows = _same(rows, percentiles(prefixes, [by, "i"], "_v", (0.1, 0.5, 0.9)), [by, "i"])
    rows = _same(spine, rows, [by, "i"], "left").select(by, "i", "checkpoint", F.coalesce("n", F.lit(0)).alias("n"), "mean", *[F.get("q", F.lit(k)).alias(c) for k, c in enumerate(("p10", "median", "p90"))])
    order = W.partitionBy(by).orderBy("i")

    def change(c: str) -> Column:
        before = F.lag(c).over(order)
        scale = F.greatest(F.abs(before), F.abs(F.col(c)), F.col("p90") - F.col("p10"))
        return F.when(before.isNull(), None).when(scale > 0, F.abs(F.col(c) - before) / scale).otherwise(0.0)

    rows = rows.withColumns({f"d_{c}": change(c) for c in ("mean", "median", "p10", "p90")})
    steady = (F.greatest("d_mean", "d_median") <= 0.01) & (F.greatest("d_p10", "d_p90") <= 0.03)
    return rows.withColumn("stable", F.coalesce(steady, F.lit(False))).drop("i")
