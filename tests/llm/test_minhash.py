import random
from itertools import combinations

import numpy as np
import pytest

from tallyforge.llm import common, minhash


def shingles(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=4):
    sets = [shingles(t, k) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (x, a), (y, b) in combinations([(i, s) for (i, _), s in zip(rows, sets) if s and i is not None], 2):
        if 100 * len(a & b) >= 80 * len(a | b):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(root(i) if i is not None else None)) for (i, _), s in zip(rows, sets))


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    bases = [[r.choice(vocab) for _ in range(r.choice([1, 3, 6, 30, 80, 200]))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i * 3 % 1009, r.choice([" ", "\n", "\t "]).join(w).upper() if r.random() < 0.2 else " ".join(w)))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, ""), (None, rows[0][1]), (5, rows[3][1]), rows[7], (2010, "x y " * 20000), (2011, "x y " * 20000 + "z")]


@pytest.mark.parametrize("seed", [1, 2])
def test_as_all_pairs(spark, seed):
    rows = corpus(seed, 240)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, kept string, id int")
    got = minhash.near_duplicates(df, shingle=4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("shared", [0, 8])
def test_large_group_over_several_parts(spark, monkeypatch, shared):
    """Without shared members, pieces must find each other by their signatures."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "SET_BLOCK", 12)
    monkeypatch.setattr(minhash, "SHARED", shared)
    r = random.Random(5)
    base = [f"w{r.randrange(300)}" for _ in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.choice([1, 2, 4])):
            w[r.randrange(150)] = f"n{r.random()}"
        if i % 4 == 0:  # a second family, near the first but not linked with it
            w[40:70] = [f"v{k}" for k in range(30)]
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows)


@pytest.mark.parametrize("hub", [2, 1000])
def test_components_with_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(common, "HUB", hub)
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(7, 1000 + k) for k in range(50)] + [(5000, k) for k in range(2000, 2040)] + [(None, 3), (3, None), (9, 9)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b and a is not None and b is not None for x in (a, b)}
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in linked)


@pytest.mark.parametrize("most", [0, 1 << 19])
def test_components_with_and_without_broadcasts(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_LOW", most, raising=False)
    monkeypatch.setattr(common, "HUB", 20)
    r = random.Random(11)
    order = r.sample(range(1, 300), 60)
    edges = [*zip(order, order[1:]), *((900, k) for k in range(500, 560)), (900, 3000), (2, 2), (None, 5)]
    exchanges = []

    def written(df, name, plain=common.written):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return plain(df, name)

    monkeypatch.setattr(common, "written", written)
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {x: min(order) for x in order} | {x: 500 for x in (900, 3000, *range(500, 560))}
    assert dict(map(tuple, got)) == want and len(got) == len(want)
    # two readings of one grouped minimum, one of the other, and the distinct edges
    assert not most or max(exchanges) <= 4


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert minhash.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].kept


def test_keys_miss_no_signature_within_the_radius():
    r = np.random.default_rng(1)
    for _ in range(300):
        a = r.integers(0, 1 << 16, minhash.SYMBOLS, dtype=np.uint16)
        b = a.copy()
        b[r.choice(minhash.SYMBOLS, minhash.RADIUS, replace=False)] ^= 1
        k = minhash.keys(np.stack([a, b]))
        assert (k[0] == k[1]).any()
