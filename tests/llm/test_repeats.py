import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import repeats, suffixes


def common(b, i, j, depth):
    k = 0
    while k < depth and i + k < len(b) and j + k < len(b) and b[i + k] == b[j + k]:
        k += 1
    return k


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abc", max_size=80), st.integers(1, 3))
def test_suffixes_in_order_with_prefixes(text, times):
    b = (text * times).encode()
    order, prefix = suffixes.suffix_array(np.frombuffer(b, np.uint8), 20)
    assert sorted(order.tolist()) == list(range(len(b)))
    assert all(b[i : i + 20] <= b[j : j + 20] for i, j in zip(order, order[1:]))
    assert prefix.tolist() == [0] * bool(len(b)) + [common(b, i, j, 20) for i, j in zip(order, order[1:])]


def test_spilled_queues_change_nothing(monkeypatch):
    b = np.frombuffer(("abcab" * 300 + "xyz" * 100).encode(), np.uint8)
    want = suffixes.suffix_array(b, 200)
    monkeypatch.setattr(suffixes, "SPILL", 64)
    got = suffixes.suffix_array(b, 200)
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("numbers", [1, 7])
def test_texts_that_share_a_number_stay_apart(spark, numbers):
    """All texts have one of few numbers at first; only equal ones may go as copies."""
    r = random.Random(numbers)
    text = lambda n: "".join(r.choice("abcdé") for _ in range(n))
    shared = text(350)
    texts = [text(r.choice([0, 20, 250, 600])) + r.choice(["", shared]) + text(r.choice([0, 90])) for _ in range(25)]
    texts += [texts[3], texts[4], texts[4], None, ""]
    rows = [(i % 20, t) for i, t in enumerate(texts)]
    got = repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), number=lambda body: F.pmod(F.xxhash64(body), F.lit(numbers))).collect()
    want = [(i, *w) for (i, _), w in zip(rows, brute(texts))]
    assert sorted(tuple(x)[:5] for x in got) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_all_windows(spark, seed, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", 3000)
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdeé \n") for _ in range(n))
    shared = [text(r.choice([150, 199, 200, 201, 260, 400, 900])) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = [text(r.choice([0, 1, 30, 300]))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a, b = sorted((r.choice([0, 0, r.randrange(len(s))]), r.choice([len(s), len(s), r.randrange(len(s))])))
            parts += [s[a:b], text(r.choice([0, 5, 100]))]
        texts.append("".join(parts))
    texts += [None, "", "short", "short", "ab" * 400, "x" * 5000, "x" * 199, texts[0], texts[0], text(300)]
    rows = [(i if i % 9 else 7, t, "c") for i, t in enumerate(texts)] + [(None, texts[5], "c"), (None, text(20), "c")]
    got = repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    want = brute([t for _, t, _ in rows])
    assert sorted(map(str, [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got])) == sorted(map(str, [(r[0], *w) for r, w in zip(rows, want)]))
    assert all(sum(s.end - s.start for s in x.spans) == x.n_removed for x in got)


@pytest.mark.parametrize("most", [repeats.MOST_BROADCAST, 0])
def test_rows_without_ids_do_not_multiply(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_BROADCAST", most)
    met, join = [], repeats._with_texts

    def counted(*given):
        met.append(join(*given))
        return met[-1]

    monkeypatch.setattr(repeats, "_with_texts", counted)
    r = random.Random(12)
    text = lambda n: "".join(r.choice("abcdeé \n") for _ in range(n))
    shared = text(260)
    texts = [text(40) + shared[: r.choice([210, 260])] + text(40) for _ in range(90)]
    rows = [(None if i % 3 else i, t) for i, t in enumerate(texts)]
    got = repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == sorted(brute(texts))
    assert len(met) >= 2 and all(m.count() <= len(texts) for m in met)


def test_hot_copies_are_not_joined_by_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HUB", 5)
    test_as_all_windows(spark, 5, monkeypatch)
    texts = ["y" * 300] * 9 + ["z" * 20] * 9 + [None] * 9 + ["y" * 250, "y" * 230] * 2
    got = repeats.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == dict(enumerate(brute(texts)))


def test_empty(spark):
    assert repeats.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    from tallyforge.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in queries.op6_repeated_passages(spark, sf).collect()}
    assert got == {d.doc_id: w for d, w in zip(docs, brute([d.text for d in docs]))}


def _texts_of_one_anchor(n):
    r = random.Random(8)
    text = lambda k: "".join(r.choice("abcdeé \n") for _ in range(k))
    shared = text(150)
    texts = [text(120) + shared + text(120) for _ in range(n)]
    # some share more than the passage, so that windows with its anchor recur
    return texts + [texts[k][60:] + text(90) for k in range(0, n, 9)] + [text(5) + texts[k][:300] for k in range(0, n, 11)]


def test_hot_anchor_is_no_shard(spark, monkeypatch):
    texts = _texts_of_one_anchor(2500)
    sort = repeats._sorted_shards

    def small_only(batches):
        def seen():
            sizes = {}
            for b in batches:
                for a, raw in zip(b.column(0).to_pylist(), b.column(5).to_pylist()):
                    sizes[a] = sizes.get(a, 0) + len(raw)
                assert max(sizes.values(), default=0) <= 300_000
                yield b

        yield from sort(seen())

    monkeypatch.setattr(repeats, "_sorted_shards", small_only)
    got = repeats.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == dict(enumerate(brute(texts)))


def test_counted_windows_as_sorted(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_OF_ANCHOR", 0)
    test_as_all_windows(spark, 4, monkeypatch)


def test_distinct_blocks_do_not_stay(spark):
    """They are read once, so their files do not lie beside the shuffles that follow."""
    from tallyforge.llm import common

    before = set(common._tables)
    docs = spark.createDataFrame([(1, "ab" * 150), (2, "x" + "ab" * 150), (3, None)], "doc_id long, text string")
    assert repeats.repeated_passages(docs).where("n_removed > 0").count() == 2
    names = {t.rsplit("/", 1)[1].rsplit("-", 1)[0] for t in set(common._tables) - before}
    assert "blocks" in names and "distinct_blocks" not in names
