import hashlib

import numpy as np
import pytest

from tallyforge.llm import balls


def brute(rows, k, rounds=3, dims=64, scale=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(y is not None and np.isfinite(y) for y in v):
            kept.append((i, [int(np.floor(scale * float(y))) for y in v]))
    name = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    at = [x for _, x in sorted((name(i), x) for i, x in kept)[:k]]
    sq = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for step in range(rounds + 1):
        own = [min(range(len(at)), key=lambda j: (sq(x, at[j]), j)) for _, x in kept]
        if step < rounds:
            at = [[sum(y) // len(y) for y in zip(*m)] if (m := [x for (_, x), o in zip(kept, own) if o == j]) else at[j] for j in range(len(at))]
    d = [sq(x, at[o]) for (_, x), o in zip(kept, own)]
    of = lambda j: sum(e for e, o in zip(d, own) if o == j)
    return [(i, o, e, of(o), sum(d), hashlib.sha256(",".join(map(str, at[o])).encode()).hexdigest()) for (i, _), o, e in zip(kept, own, d)]


def key(x):
    return tuple((y is None, y if y is not None else 0) for y in x)


@pytest.mark.parametrize("seed, n, spread", [(1, 400, 0.5), (2, 300, 0.02), (3, 9, 1.0)])
def test_as_brute_force(spark, seed, n, spread):
    r = np.random.default_rng(seed)
    middles = r.standard_normal((7, 64))
    rows = [(int(i), [float(np.float32(y)) for y in middles[r.integers(7)] + spread * r.standard_normal(64)]) for i in range(n)]
    rows += rows[:5] + [(n, rows[0][1]), (None, rows[1][1])] + [(n + 1 + j, rows[2][1]) for j in range(40)]
    rows += [(n + 90, None), (n + 91, []), (n + 92, [1.0] * 63), (n + 93, [None] + [1.0] * 63), (n + 94, [float("nan")] * 64), (n + 95, [float("inf")] * 64), (n + 96, [0.0] * 64)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<float>, cluster int, label int").repartition(3)
    got = [tuple(x) for x in balls.cluster(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 16), key=key)


def test_ties_go_to_the_smaller_number(spark):
    """Few whole points on a line, so that many are as far from one centroid as from another."""
    rows = [(i, [(i * 7 % 5) / 64] + [0.0] * 63) for i in range(60)]
    got = [tuple(x) for x in balls.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=4).collect()]
    assert sorted(got) == sorted(brute(rows, 4))


def test_balls_spare_comparisons():
    """Exact all the same, members of tight far balls meet no centroid but their own, and those of near ones only neighbours."""
    r = np.random.default_rng(4)
    at = r.integers(-1000, 1000, (16, 64))
    own = r.integers(0, 16, 4000)
    x = at[own] + r.integers(-9, 10, (4000, 64))
    c = balls.surroundings(at, [80] * 16)
    best, least, compared = balls.nearest(x, own, c)
    assert (best == own).all() and (least == ((x - at[own]) ** 2).sum(axis=1)).all() and compared == 4000 and not c.reach.any()
    x = at[own] + r.integers(-900, 900, (4000, 64))
    best, least, compared = balls.nearest(x, own, balls.surroundings(at, [None] * 16))
    all_d = ((x[:, None] - at[None]) ** 2).sum(axis=2)
    assert (best == all_d.argmin(axis=1)).all() and (least == all_d.min(axis=1)).all() and compared <= 16 * 4000


def test_huge_components_and_empty(spark):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]
    got = {x.vec_id: x for x in balls.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2).collect()}
    assert len(got) == 3 and all(0 <= x.distance < 1 << 63 for x in got.values())
    assert balls.cluster(spark.createDataFrame(rows[:0], "vec_id long, embedding array<float>")).count() == 0
    assert balls.cluster(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0
