import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tallyforge.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, size = len(held), sum(sum(c.values()) for _, c in held)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in wanted.items():
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for _, c in held) + 1))) for t in ts}
        found = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // size
            s = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return out


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{j}" for j in range(150)] + ["Ärla", "ärla", "ÄRLA", "a'b", "x_y", "Foo", "FOO", "foo", "日本", "9"]
    docs = [(i, " ".join(r.choice(words[: r.choice([3, 30, 160])]) for _ in range(r.choice([1, 5, 40, 300])))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "-- !"), (None, "w1 w2"), (None, "w1 w2"), (7, "w1 w2"), (-3, "w1 w2"), (n + 3, "w1 w2 " * 4000)]
    r.shuffle(docs)
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 4, 30])))) for i in range(25)]
    return docs, items + [(90, None), (91, ""), (92, "nowhere else"), (0, "w7 w8"), (93, "w1 w2")]


@pytest.mark.parametrize("seed, block, first", [(1, 128, 16), (2, 4, 2), (3, 1, 1)])
def test_as_brute_force(spark, monkeypatch, seed, block, first):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "FIRST", first)
    monkeypatch.setattr(lexical, "GROWTH", 3)
    monkeypatch.setattr(lexical, "TILE", 7)
    docs, items = corpus(seed, 250)
    df = spark.createDataFrame([(*x, 5, "z") for x in docs], "doc_id long, text string, rank int, term string").repartition(3)
    count = {}
    index = lexical.index(df)
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), count=count).collect()
    assert sorted((x.item_id, x.rank, x.doc_id, x.score) for x in got if x.doc_id is not None) == sorted(x for x in brute(docs, items) if x[2] is not None)
    assert len(got) == len(brute(docs, items))
    assert 0 < count["scored"] <= count["pairs"]
    lexical.drop(index)


def test_blocks_below_the_threshold_are_not_scored(spark, monkeypatch):
    """Where one topic fills a range of documents, the other ranges are never scored for it."""
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 10)
    monkeypatch.setattr(lexical, "FIRST", 4)
    r = random.Random(1)
    docs = [(i, " ".join(f"t{i // 50}x{r.randrange(40)}" for _ in range(30)) + " common" * (i % 2)) for i in range(2000)]
    items = [(k, " ".join(f"t{k}x{j}" for j in range(12)) + " common") for k in range(40)]
    index, count = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)), {}
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), count=count).collect()
    assert sorted((x.item_id, x.rank, x.doc_id, x.score) for x in got) == sorted(brute(docs, items))
    assert count["pairs"] == 40 * 200 and count["scored"] < 0.06 * count["pairs"]


def test_items_in_parts_and_a_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MOST_TERMS", 40)
    monkeypatch.setattr(lexical, "MOST_CHOSEN", 0)
    docs, items = corpus(5, 60)
    got = lexical.search(lexical.index(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"), k=3).collect()
    assert sorted((x.item_id, x.rank, x.score) for x in got) == sorted((i, r, s) for i, r, _, s in brute(docs, items, 3))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(lexical.index(none), items).count() == 0
    assert lexical.search(lexical.index(spark.createDataFrame([(1, "a")], "doc_id long, text string")), items.limit(0)).count() == 0


def test_few_blocks_are_in_memory(spark, monkeypatch):
    """A row is a block: few are in a row group, and few go to Python at once, in every step."""
    most = lexical.BATCH

    def watched(make):
        def of(*args):
            run = make(*args)

            def watch(batches):
                for b in batches:
                    assert b.num_rows <= most
                    yield b

            return lambda batches: run(watch(batches))

        return of

    for name in ("_maxima", "_held", "_bounds", "_scored"):
        monkeypatch.setattr(lexical, name, watched(getattr(lexical, name)))
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 1)
    docs = [(i, f"w{i % 7} w{i % 11} x") for i in range(150)]
    items = [(i, f"w{i} w{i + 1}") for i in range(9)]
    before = [spark.conf.get(x) for x in ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")]
    index = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x.item_id, x.rank, x.doc_id, x.score) for x in got) == sorted(brute(docs, items))
    for t in (index.blocks, index.maxima):
        files = [pq.ParquetFile(f.removeprefix("file://")) for f in t.inputFiles()]
        groups = [f.metadata.row_group(k).num_rows for f in files for k in range(f.metadata.num_row_groups)]
        assert sum(groups) == 150 and max(groups) <= lexical.GROUP
    lexical.drop(index)
    assert before == [spark.conf.get(x) for x in ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")]


def test_the_index_never_moves(spark, monkeypatch):
    """Beyond what is broadcast, all blocks go to Python; they are not shuffled to meet their items."""
    plans, written = [], lexical.written

    def put(df, name, *more):
        if name == "top":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name, *more)

    monkeypatch.setattr(lexical, "written", put)
    monkeypatch.setattr(lexical, "MOST_CHOSEN", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs, items = corpus(7, 60)
        index = lexical.index(spark.createDataFrame(docs, "doc_id long, text string"))
        got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted((x.item_id, x.rank, x.score) for x in got) == sorted((i, r, s) for i, r, _, s in brute(docs, items))
    assert plans and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)
    lexical.drop(index)
