"""Queries of the statistics and the simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import simulate
from ..operators import statistics as st
from .adapters import outputs, read
from .catalog import query

_P = ", ".join(f"round(quantile_cont(x, {p}), 6) as p{int(p * 100)}" for p in st.PERCENTS)
_X = "(select l_returnflag as output, l_extendedprice as x, l_quantity as quantity, l_discount as discount, l_tax as tax, l_orderkey, l_linenumber from lineitem)"


def rounded(df, keep: tuple[str, ...], digits: int = 6):
    return df.select(*[F.col(c) if c in keep else F.round(c, digits).alias(c) for c in df.columns])


@query("stats_block", f"select output, count(*) as n, min(x) as least, max(x) as most, round(avg(x), 6) as mean, round(sqrt(var_samp(x)), 6) as sd, {_P}, round(avg((x >= 50000)::int), 6) as p_target, round(avg((x < 0)::int), 6) as p_loss, round(avg(x) - 1.96 * sqrt(var_samp(x)) / sqrt(count(*)), 6) as ci_low, round(avg(x) + 1.96 * sqrt(var_samp(x)) / sqrt(count(*)), 6) as ci_high from {_X} group by output")
def stats_block(spark, sf):
    return rounded(st.block(outputs(spark, sf), "output", "x", 50_000.0), ("output", "n", "least", "most"))


@query("percentile_type7", "select p::double as percent, round(quantile_cont(l_extendedprice, 0.05), 6) as value from lineitem, (values (0.05)) v(p) group by p " + "".join(f"union all select {p}::double, round(quantile_cont(l_extendedprice, {p}), 6) from lineitem " for p in st.PERCENTS[1:]))
def percentile_type7(spark, sf):
    """The way for columns of any length: ranks in a distributed sort."""
    return rounded(st.percentiles_by_rank(read(spark, sf, "lineitem"), "l_extendedprice"), ("percent",))


@query("cdf_201", f"select output, i::int as point, round(q[i + 1], 6) as value from (select output, quantile_cont(x, {[i / 200 for i in range(201)]}) as q from {_X} group by output), range(201) t(i)")
def cdf_201(spark, sf):
    return rounded(st.cdf(outputs(spark, sf), "output", "x"), ("output", "point"))


@query("histogram_48", f"with e as (select output, min(x) as lo, max(x) as hi from {_X} group by output), c as (select output, least(floor((x - lo) / ((hi - lo) / 48)), 47)::int as bin, count(*) as n from {_X} join e using (output) group by 1, 2) select e.output, b::int as bin, round(lo + b * ((hi - lo) / 48), 6) as left_edge, coalesce(n, 0) as n from e cross join range(48) t(b) left join c on c.output = e.output and c.bin = b")
def histogram_48(spark, sf):
    return rounded(st.histogram(outputs(spark, sf), "output", "x"), ("output", "bin", "n"))


@query("kde_density", f"with s as (select output, count(*) as n, stddev_samp(x) as sd, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3, min(x) as lo, max(x) as hi from {_X} group by output), h as (select *, 0.9 * least(sd, (q3 - q1) / 1.349) * pow(n, -0.2) as h, (hi - lo) / 48 as width, greatest(ceil(n / 20000.0), 1) as step from s), t as (select output, x from (select output, x, row_number() over (partition by output order by x) - 1 as r from {_X}) join h using (output) where r % step = 0), m as (select output, count(*) as m from t group by output) select output, b::int as bin, round(sum(exp(-0.5 * pow((lo + (b + 0.5) * width - x) / h, 2))) / (any_value(m) * any_value(h) * 2.5066282746310002) * any_value(width), 7) as density from t join h using (output) join m using (output) cross join range(48) r(b) where abs((lo + (b + 0.5) * width - x) / h) <= 4 group by output, b")
def kde_density(spark, sf):
    return rounded(st.density(outputs(spark, sf), "output", "x"), ("output", "bin"), 7)


@query("target_probabilities", f"select output, round(avg((x <= 30000)::int), 9) as p_le, round(avg((x < 30000)::int), 9) as p_lt, round(avg((x >= 30000)::int), 9) as p_ge from {_X} group by output")
def target_probabilities(spark, sf):
    share = lambda c: F.round(F.avg(c.cast("double")), 9)
    return outputs(spark, sf).groupBy("output").agg(share(F.col("x") <= 30_000).alias("p_le"), share(F.col("x") < 30_000).alias("p_lt"), share(F.col("x") >= 30_000).alias("p_ge"))


_R = lambda c: f"(rank() over (partition by output order by {c}) + (count(*) over (partition by output, {c}) - 1) / 2.0::double)"
_SENS = f"with r as (select *, {_R('x')} as rx, {_R('quantity')} as rq, {_R('discount')} as rd, {_R('tax')} as rt from {_X}), c as (" + " union all ".join(f"select output, '{n}' as input, corr({n}, x) as pearson, corr({k}, rx) as spearman from r group by output" for n, k in (("quantity", "rq"), ("discount", "rd"), ("tax", "rt"))) + ")"


@query("pearson_spearman", _SENS + " select output, input, round(pearson, 6) as pearson, round(spearman, 6) as spearman from c")
def pearson_spearman(spark, sf):
    return rounded(st.sensitivity(outputs(spark, sf), "output", "x", ["quantity", "discount", "tax"]).drop("share", "place"), ("output", "input"))


@query("spearman_ties", f"select output, l_orderkey, l_linenumber, x, {_R('quantity')} as r from {_X}")
def spearman_ties(spark, sf):
    return st.average_rank(outputs(spark, sf), "output", "quantity", "r").select("output", "l_orderkey", "l_linenumber", "x", "r")


@query("influence_rank", _SENS + " select output, input, round(spearman * spearman / sum(spearman * spearman) over (partition by output), 6) as share, row_number() over (partition by output order by spearman * spearman desc, input)::int as place from c")
def influence_rank(spark, sf):
    return rounded(st.sensitivity(outputs(spark, sf), "output", "x", ["quantity", "discount", "tax"]).drop("pearson", "spearman"), ("output", "input", "place"))


_LINES = "(select l_extendedprice as x, row_number() over (order by l_orderkey, l_linenumber, l_extendedprice) - 1 as iteration from lineitem)"
_STEPS = "(select unnest(list_transform(range(12), lambda k: 1000 * (10 ** k)::bigint)) as k)"
_CONV = (
    f"with it as {_LINES}, c as (select count(*) as n from it), "
    f"cps as (select k as checkpoint from {_STEPS}, c where k < n union all select 5 * k from {_STEPS}, c where 5 * k < n union all select n from c), "
    "s as (select row_number() over (order by checkpoint) as i, checkpoint::bigint as checkpoint, count(*) as n, avg(x) as mean, quantile_cont(x, 0.1) as p10, quantile_cont(x, 0.5) as median, "
    "quantile_cont(x, 0.9) as p90 from it join cps on iteration < checkpoint group by checkpoint)"
)
_D = lambda c: f"abs({c} - lag({c}) over (order by i)) / greatest(abs(lag({c}) over (order by i)), abs({c}), p90 - p10)"
_STABLE = f"coalesce(greatest({_D('mean')}, {_D('median')}) <= 0.01 and greatest({_D('p10')}, {_D('p90')}) <= 0.03, false) as stable"
_AT = "checkpoint, n, round(mean, 6) as mean, round(p10, 6) as p10, round(median, 6) as median, round(p90, 6) as p90"


def _converged(spark, sf):
    """Checkpoints over all lines in order of their keys."""
    lines = st.numbered(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_extendedprice"], "iteration")
    return st.convergence(lines.select(F.lit("all").alias("output"), "iteration", F.col("l_extendedprice").alias("x")), "output", "iteration", "x")


@query("convergence_checkpoints", _CONV + f" select {_AT} from s")
def convergence_checkpoints(spark, sf):
    return rounded(_converged(spark, sf).select("checkpoint", "n", "mean", "p10", "median", "p90"), ("checkpoint", "n"))


@query("convergence_stable", _CONV + f" select checkpoint, {_STABLE} from s")
def convergence_stable(spark, sf):
    return _converged(spark, sf).select("checkpoint", "stable")


@query("convergence_whole", _CONV + f" select {_AT}, {_STABLE} from s")
def convergence_whole(spark, sf):
    """Checkpoints and their stability together."""
    return rounded(_converged(spark, sf).select("checkpoint", "n", "mean", "p10", "median", "p90", "stable"), ("checkpoint", "n", "stable"))


_U = "((p_partkey * 7919) % 10007 + 0.5::double) / 10007::double"


@query("inverse_draws", f"select p_partkey, round(case when u < 0.3::double then 10 + sqrt(u * 100 * 30) else 110 - sqrt((1 - u) * 100 * 70) end, 6) as triangular, round(-ln(u) / 0.5::double, 6) as exponential, case when u < 0.2::double then 1 when u < 0.7::double then 5 else 9 end as discrete, round(case when u < 0.5::double then 20 * u else 10 + (u - 0.5::double) * 80 end, 6) as custom, (u < 0.35::double)::int as bernoulli from (select p_partkey, {_U} as u from part)")
def inverse_draws(spark, sf):
    """Draws by inverse distribution functions of a uniform column: triangular, exponential, discrete, piecewise linear, Bernoulli."""
    u = ((F.col("p_partkey") * 7919) % 10_007 + 0.5) / 10_007.0
    rows = read(spark, sf, "part").select("p_partkey", u.alias("u"))
    tri = F.when(F.col("u") < 0.3, 10 + F.sqrt(F.col("u") * 100 * 30)).otherwise(110 - F.sqrt((1 - F.col("u")) * 100 * 70))
    custom = F.when(F.col("u") < 0.5, 20 * F.col("u")).otherwise(10 + (F.col("u") - 0.5) * 80)
    return rows.select(
        "p_partkey", F.round(tri, 6).alias("triangular"), F.round(-F.log("u") / 0.5, 6).alias("exponential"), F.when(F.col("u") < 0.2, 1).when(F.col("u") < 0.7, 5).otherwise(9).alias("discrete"),
        F.round(custom, 6).alias("custom"), (F.col("u") < 0.35).cast("int").alias("bernoulli"),
    )


@query("analytic_moments", "select p_partkey, round((a + b) / 2, 6) as uniform_mean, round((b - a) * (b - a) / 12, 6) as uniform_var, round((a + b + c) / 3, 6) as tri_mean, round((a * a + b * b + c * c - a * b - a * c - b * c) / 18, 6) as tri_var, round(1 / a, 6) as exp_mean, round(1 / (a * a), 6) as exp_var from (select p_partkey, p_size::double as a, p_size * 3::double as b, p_size * 2::double as c from part where p_size > 0)")
def analytic_moments(spark, sf):
    a, b, c = F.col("p_size").cast("double"), F.col("p_size") * F.lit(3.0), F.col("p_size") * F.lit(2.0)
    r = lambda x, n: F.round(x, 6).alias(n)
    return read(spark, sf, "part").where("p_size > 0").select(
        "p_partkey", r((a + b) / 2, "uniform_mean"), r((b - a) * (b - a) / 12, "uniform_var"), r((a + b + c) / 3, "tri_mean"),
        r((a * a + b * b + c * c - a * b - a * c - b * c) / 18, "tri_var"), r(1 / a, "exp_mean"), r(1 / (a * a), "exp_var"),
    )


# A model with eight inputs and three outputs.
MODEL = simulate.Spec(
    [
        simulate.Input("price", "normal", {"mean": 100.0, "sd": 10.0}, low=0.0), simulate.Input("volume", "lognormal", {"log_mean": 6.0, "log_sd": 0.3}),
        simulate.Input("cost", "triangular", {"low": 40.0, "mode": 55.0, "high": 90.0}), simulate.Input("share", "beta", {"alpha": 2.0, "beta": 5.0, "low": 0.0, "high": 1.0}),
        simulate.Input("delay", "exponential", {"rate": 0.5}), simulate.Input("claims", "poisson", {"lambda": 3.0}),
        simulate.Input("won", "bernoulli", {"p": 0.6}), simulate.Input("rate", "uniform", {"low": 0.01, "high": 0.05}),
    ],
    [("revenue", "price * volume * (0.5 + won / 2)"), ("profit", "revenue - cost * volume - 1000 * claims"), ("value", "profit * exp(-rate * delay) * (1 - share)")],
)


@query("sim_run")
def sim_run(spark, sf):
    """Statistics of 100 000 iterations of the model."""
    df = simulate.samples(spark, MODEL, 42, 100_000)
    return st.block(simulate.long_form(df, [o for o, _ in MODEL.outputs]), "output", "value", 0.0)


@query("sim_sensitivity")
def sim_sensitivity(spark, sf):
    df = simulate.samples(spark, MODEL, 42, 20_000)
    return st.sensitivity(simulate.long_form(df, [o for o, _ in MODEL.outputs]), "output", "value", [i.name for i in MODEL.inputs])
