import numpy as np

from tallyforge.llm import vectors


def brute(rows):
    ok = [(i, np.asarray(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = {i: i for i, _, _ in rows if i is not None}
    links = {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ok)):
        for b in range(len(ok)):
            (i, u, x), (j, w, y) = ok[a], ok[b]
            if a != b and x == y and len(u) == len(w) and u @ w / np.linalg.norm(u) / np.linalg.norm(w) >= 0.98:
                links[a] = links.get(a, 0) + 1
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    at = {id(v): n for n, (_, v, _) in enumerate(ok)}
    return ok, links, {i: root(i) for i in parent}, at


def test_as_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 20)
    r = np.random.default_rng(1)
    rows = []
    for _ in range(30):
        c = r.standard_normal(24)
        label = int(r.integers(0, 3))
        for _ in range(int(r.choice([1, 2, 3, 5, 60]))):
            rows.append((len(rows), [float(np.float32(x)) for x in c + r.standard_normal(24) * r.choice([0.02, 0.1, 0.14])], label))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(5)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 24, 1), (n + 3, [float("nan")] + [1.0] * 23, 1), (n + 4, [None] + [1.0] * 23, 1), (n + 5, rows[0][1], None), (n + 6, rows[0][1][:12], rows[0][2]), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*x, 7) for x in rows], "vec_id long, embedding array<float>, label int, id int")
    got = {x.vec_id: x for x in vectors.near_vectors(df).collect()}
    ok, links, comp, _ = brute(rows)
    n_links = {ok[a][0]: k for a, k in links.items()}
    assert len(got) == len(rows)
    for i, v, _ in rows:
        assert got[i].n_links == n_links.get(i, 0)
        assert got[i].component_id == comp.get(i) and got[i].kept == (i is None or comp[i] == i)


def test_whole_table(spark):
    from tallyforge.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(x.vec_id, list(x.embedding), x.label) for x in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ok, links, comp, _ = brute(rows)
    got = {x.vec_id: x for x in queries.op2_vector_dedup(spark, sf).collect()}
    assert sum(got[ok[a][0]].n_links == k for a, k in links.items()) == len(links) and sum(x.n_links for x in got.values()) == sum(links.values())
    assert all(got[i].component_id == c for i, c in comp.items())


def test_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_label_with_a_common_direction(spark):
    r = np.random.default_rng(4)
    common = r.standard_normal(32) * 5
    base = common + r.standard_normal((20_000, 32))
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    assert (unit.mean(axis=0) ** 2).sum() > 0.95
    low = base.astype(np.float32).astype(float)
    u = low / np.linalg.norm(low, axis=1)[:, None]
    links = np.concatenate([(u[k : k + 1000] @ u.T >= 0.994).sum(axis=1) - 1 for k in range(0, len(u), 1000)])
    assert 50 < (links > 0).sum() < 20_000
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(low.tolist())], "vec_id long, embedding array<float>, label int")
    got = {x.vec_id: x.n_links for x in vectors.near_vectors(df, 0.994).collect()}
    assert sum(got[k] != n for k, n in enumerate(links.tolist())) == 0


def test_borders_of_many_partitions(spark):
    """Pairs just over the threshold, with few rows a partition: windows that end at borders would lose some."""
    r = np.random.default_rng(9)
    rows = []
    for k in range(600):
        c = r.standard_normal(48)
        c /= np.linalg.norm(c)
        other = r.standard_normal(48)
        other -= (other @ c) * c
        other /= np.linalg.norm(other)
        rows += [(2 * k, c.tolist(), 1), (2 * k + 1, (0.981 * c + np.sqrt(1 - 0.981**2) * other).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        got = {x.vec_id: x for x in vectors.near_vectors(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(got[2 * k + 1].component_id == 2 * k and got[2 * k].n_links == 1 for k in range(600))


def test_rounding_errors_bound_the_cosine():
    r = np.random.default_rng(2)
    x = r.standard_normal((200, 64)) * r.choice([0.01, 1, 30], (200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    import pyarrow as pa

    small, error = vectors._unrounded(pa.array(vectors._rounded(x), pa.binary()))
    assert (np.abs(x @ x.T - small @ small.T) <= error[:, None] + error[None, :] + error[:, None] * error[None, :] + 1e-5).all()
