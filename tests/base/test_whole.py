"""Queries over whole tables, where ids are not those of a prefix or a residue."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import statistics as st
from tallyforge.plans import catalog
from tallyforge.streaming import jobs


def test_evidence_of_all_ids(spark, tmp_path):
    r = random.Random(5)
    lines = [(r.randrange(1, 300), r.choice([3, 7, 90]), r.choice([5, 399, 400, 8000, 9001])) for _ in range(60)]
    orders = [(k, 1000 + k % 13) for k in range(1, 300)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    to = {}
    for o, s, p in lines:
        to.setdefault(f"s{s}", set()).add(f"p{p}")
        to.setdefault(f"p{p}", set()).add(f"o{o}")
    for o, c in orders:
        to.setdefault(f"o{o}", set()).add(f"c{c}")
    want = set()
    for start in [n for n in to if n[0] == "s"]:
        todo = [start]
        while todo:
            for n in to.get(todo.pop(), ()):
                if (start, n) not in want:
                    want.add((start, n))
                    todo.append(n)
    got = [tuple(x) for x in catalog.QUERIES["evidence_closure"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
    got = [x.node for x in catalog.QUERIES["affected_findings"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(n for s, n in want if s == "s3" and n[0] == "c")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_groups_do_not_meet_in_one_buffer(spark):
    r = random.Random(6)
    rows = [(k % 5000, "all" if k % 20 else r.choice(["a", None]), r.choice([r.random(), 0.5, float(k % 7)]) if k % 31 else None) for k in range(5000)]
    df = spark.createDataFrame(rows, "iteration long, output string, x double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert st._placed(df, ["output"], "x")[1].where("output = 'all'").count() > 1
        got = {x.output: x.q for x in st.percentiles(df, ["output"], "x", (0.0, 0.05, 0.5, 0.77, 1.0)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = df.groupBy("output").agg(F.percentile("x", F.array(*map(F.lit, (0.0, 0.05, 0.5, 0.77, 1.0)))).alias("q")).collect()
    assert got == {x.output: pytest.approx(x.q, abs=1e-12) for x in want}
    for made in (st.block(df, "output", "x", 1.0), st.cdf(df, "output", "x"), st.density(df, "output", "x"), st.convergence(df, "output", "iteration", "x", 5000)):
        assert "percentile(" not in plan(made) and "row_number(" not in plan(made).replace(" ", "")


def test_more_rows_take_more_tasks(spark, monkeypatch):
    """No task sorts many more rows than it should, ties included, and places, numbers and percentiles hold over all parts."""
    monkeypatch.setattr(st, "ROWS", 100)
    df = spark.range(3000).selectExpr("cast(id % 2 as string) as output", "if(id % 3 = 0, 7.5, id * 31 % 1009) as x", "id % 5 as y")
    sizes = [x["count"] for x in st._sorted(df.select("x"), ["x"]).groupBy("_part").count().collect()]
    assert len(sizes) > 20 and sum(sizes) == 3000 and max(sizes) < 400
    got = [tuple(x) for x in st.numbered(df, ["x", "y"], "n").orderBy("n").collect()]
    assert [x[2] for x in got] == list(range(3000)) and [x[:2] for x in got] == sorted(tuple(x) for x in df.select("x", "y").collect())
    at = (0.0, 0.1, 0.333, 0.5, 1.0)
    want = {x.output: x.q for x in df.groupBy("output").agg(F.percentile("x", F.array(*map(F.lit, at))).alias("q")).collect()}
    for most in (st.MOST_WANTED, 0):
        monkeypatch.setattr(st, "MOST_WANTED", most)
        assert {x.output: x.q for x in st.percentiles(df, ["output"], "x", at).collect()} == {k: pytest.approx(q, abs=1e-9) for k, q in want.items()}


def test_thinned_density_as_by_rows(spark):
    r = random.Random(7)
    xs = sorted(r.choice([r.random(), 0.25, 0.5]) for _ in range(1000))
    got = {x.bin: x.density for x in st.density(spark.createDataFrame([("o", x) for x in xs], "output string, x double"), "output", "x", 12, 300).collect()}
    n, q = len(xs), lambda p: xs[int(p * 999)] + (p * 999 % 1) * (xs[int(p * 999) + 1] - xs[int(p * 999)])
    mean = sum(xs) / n
    h = 0.9 * min((sum((x - mean) ** 2 for x in xs) / (n - 1)) ** 0.5, (q(0.75) - q(0.25)) / 1.349) * n**-0.2
    width, taken = (xs[-1] - xs[0]) / 12, xs[::4]
    for b, d in got.items():
        z = [(xs[0] + (b + 0.5) * width - x) / h for x in taken]
        assert d == pytest.approx(sum(math.exp(-0.5 * v * v) for v in z if abs(v) <= 4) / (len(taken) * h * 2.5066282746310002) * width, rel=1e-9)


def test_hot_log_is_folded_in_pieces(spark):
    r = random.Random(9)
    events = sorted({e for _, e, _ in jobs.TRANSITIONS}) + ["other", None]
    rows = [(7 if k % 3 else r.choice([1, 2, None]), r.randrange(500), k, r.choice(events)) for k in range(4000)]
    df = spark.createDataFrame(rows, "job_id long, ts long, event_id long, event string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = jobs.fold(df, "job_id", ["ts", "event_id"])
        assert "RepartitionByExpression" in plan(made)
        got = {x.job_id: tuple(x)[1:] for x in made.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    to, want = {(a, e): b for a, e, b in jobs.TRANSITIONS}, {}
    for job, _, _, e in sorted(rows, key=lambda x: (x[1], x[2])):
        s, legal, n = want.get(job, ("queued", 0, 0))
        want[job] = (to.get((s, e), s), legal + ((s, e) in to), n + 1)
    assert got == want


def test_last_checkpoint_holds_all_lines(spark, tmp_path):
    lines = [(k * 37 + 100_000, 1 + k % 3, float(k)) for k in range(2500)] + [(100_000, 1, 0.0)] * 2
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_extendedprice double").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = catalog.QUERIES["convergence_checkpoints"](spark, str(tmp_path)).orderBy("checkpoint").collect()
    assert rows == catalog.QUERIES["convergence_whole"](spark, str(tmp_path)).orderBy("checkpoint").drop("stable").collect()
    assert [(x.checkpoint, x.n) for x in rows] == [(1000, 1000), (2502, 2502)]
    # the first 1000 are three zeros and 1 to 997
    assert rows[0].mean == pytest.approx(497.503) and rows[1].mean == pytest.approx(2499 * 2500 / 2 / 2502)


def test_inputs_are_ranked_without_the_join_of_the_output(spark, monkeypatch):
    from tallyforge.operators import statistics as st

    plans = []

    def ranked(df, by, x, out, plain=st._ranks):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, by, x, out)

    monkeypatch.setattr(st, "_ranks", ranked)
    rows = [("a", 1.0, 10, 5), ("a", 2.0, 30, 5), ("a", 3.0, 20, None), ("a", None, 99, 1), (None, 4.0, 1, 2), ("a", 2.0, None, 7)]
    got = st.sensitivity(spark.createDataFrame(rows, "o string, x double, i int, j int"), "o", "x", ["i", "j"]).collect()
    assert len(plans) == 2 and not any("Join" in p for p in plans)
    # i: ranks 1, 3, 2 against output ranks 1, 2.5, 4; the row without an output and that without a group count nowhere
    assert {(r.o, r.input) for r in got} == {("a", "i"), ("a", "j")}
    one = next(r for r in got if r.input == "i")
    assert abs(one.spearman - 0.5) < 1e-9 and abs(one.pearson - 0.5) < 1e-9
