import math

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import simulate as sm
from tallyforge.operators import statistics as st

INPUTS = [
    sm.Input("a", "normal", {"mean": 3.0, "sd": 2.0}), sm.Input("b", "lognormal", {"log_mean": 0.1, "log_sd": 0.4}), sm.Input("c", "uniform", {"low": -1.0, "high": 5.0}),
    sm.Input("d", "triangular", {"low": 0.0, "mode": 1.0, "high": 4.0}), sm.Input("e", "beta", {"alpha": 2.0, "beta": 3.0, "low": 1.0, "high": 2.0}), sm.Input("f", "exponential", {"rate": 2.0}),
    sm.Input("g", "poisson", {"lambda": 12.0}), sm.Input("h", "bernoulli", {"p": 0.3}), sm.Input("i", "binomial", {"trials": 200, "p": 0.1}),
    sm.Input("j", "discrete", {"values": [1, 2, 9], "weights": [1, 0, 3]}), sm.Input("k", "custom", {"points": [[0, 0], [0.5, 2], [1, 10]]}),
]


def test_moments_of_all_kinds(spark):
    n = 100_000
    df = sm.samples(spark, sm.Spec(INPUTS), 7, n)
    got = df.agg(*[F.avg(i.name).alias(f"m_{i.name}") for i in INPUTS], *[F.var_samp(i.name).alias(f"v_{i.name}") for i in INPUTS]).first()
    for i in INPUTS:
        mean, var = i.moments()
        assert got[f"m_{i.name}"] == pytest.approx(mean, abs=5 * math.sqrt(var / n))
        assert got[f"v_{i.name}"] == pytest.approx(var, rel=0.05)


def test_same_seed_same_rows_however_split_and_inputs_apart(spark):
    one = sm.samples(spark, sm.Spec(INPUTS[:2]), 1, 70_000, 1).agg(F.sum("a"), F.sum("b")).first()
    many = sm.samples(spark, sm.Spec(INPUTS[:3]), 1, 70_000, 8).agg(F.sum("a"), F.sum("b")).first()
    assert one[0] == pytest.approx(many[0], rel=1e-12) and one[1] == pytest.approx(many[1], rel=1e-12)


def test_bounds_outputs_and_failures(spark):
    spec = sm.Spec([sm.Input("a", "normal", {"mean": 0.0, "sd": 1.0}, low=0.0), sm.Input("b", "uniform", {"low": 0.0, "high": 1.0}, low=0.5, clamp=True)], [("x", "a + b"), ("y", "if(iteration = 500, 0 / 0D * 1, x * 2)")])
    df = sm.samples(spark, sm.Spec(spec.inputs, [("x", "a + b"), ("y", "if(iteration = 500, double('NaN'), x * 2)")]), 1, 1000)
    r = df.agg(F.min("a").alias("a"), F.min("b").alias("b"), F.sum("redrawn").alias("n")).first()
    assert r.a >= 0 and r.b == 0.5 and r.n > 300
    assert [(f.output, f.iteration) for f in sm.failures(df, ["x", "y"]).collect()] == [("y", 500)]


@pytest.mark.parametrize("bad", [sm.Input("x", "normal", {"mean": 0.0}), sm.Input("x", "uniform", {"low": 2.0, "high": 1.0}), sm.Input("x", "cauchy", {}), sm.Input("x", "discrete", {"values": [1], "weights": [0]}), sm.Input("x", "lognormal", {"log_mean": 700.0, "log_sd": 2.0})])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        sm.Spec([bad]).check()


def test_statistics_vectors(spark):
    df = spark.createDataFrame([("o", float(x)) for x in (1, 2, 3, 10)], "output string, x double")
    r = st.block(df, "output", "x", 3.0).first()
    assert r.p90 == pytest.approx(7.9) and r.p_target == 0.5 and r.ci_low is None
    assert {x.percent: x.value for x in st.percentiles_by_rank(df, "x", (0.9, 0.5)).collect()} == pytest.approx({0.9: 7.9, 0.5: 2.5})
    h = {x.bin: x.n for x in st.histogram(spark.createDataFrame([("o", float(x)) for x in range(5)], "output string, x double"), "output", "x", 4).collect()}
    assert h == {0: 1, 1: 1, 2: 1, 3: 2}
    flat = spark.createDataFrame([("o", 7.0)] * 5, "output string, x double")
    assert st.histogram(flat, "output", "x").count() == 1 and st.density(flat, "output", "x").count() == 0
    assert sorted(x.r for x in st.average_rank(spark.createDataFrame([("o", float(x)) for x in (1, 2, 2, 3)], "output string, x double"), "output", "x", "r").collect()) == [1, 2.5, 2.5, 4]


def test_sensitivity(spark):
    rows = [("o", float(x), 3.0 * x + 7, 5.0, float(x) ** 5) for x in range(-20, 40)]
    df = spark.createDataFrame(rows, "output string, x double, y double, flat double, fifth double")
    r = {x.input: x for x in st.sensitivity(df, "output", "y", ["x", "flat", "fifth"]).collect()}
    assert r["x"].pearson == pytest.approx(1) and r["flat"].pearson is None and r["fifth"].spearman == pytest.approx(1) and r["fifth"].pearson < 0.99
    assert r["x"].share == pytest.approx(0.5) and r["flat"].share == 0


def test_checkpoints(spark):
    assert st.checkpoints(2000) == [1000, 2000] and st.checkpoints(500) == [500] and st.checkpoints(1_000_000)[0] == 1000
    flat = spark.range(20_000).select(F.lit("o").alias("output"), F.col("id").alias("iteration"), F.lit(0.0).alias("x"))
    rows = st.convergence(flat, "output", "iteration", "x", 20_000).orderBy("checkpoint").collect()
    assert rows[-1].stable and rows[-1].d_mean == 0 and not rows[0].stable
