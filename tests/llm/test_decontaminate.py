import random
from collections import Counter

import pytest

from tallyforge.llm import decontaminate as dc


def multiset(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(docs, items, least=0.8):
    """All windows of an item's size, shorter ones at the ends too."""
    found = {}
    for d, text in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        for k, item in items:
            v = (item or "").lower().split()
            b = multiset(v)
            best = 0
            for s in range(-len(v), len(w) + 1):
                a = multiset(w[max(0, s) : max(0, s + len(v))])
                if a and b:
                    best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= least:
                found[d, k] = best
    return found


def test_against_all_windows(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.randint(14, 40))) for i in range(12)] + [(90, "a b c"), (91, None), (92, "x " * 20)]
    docs = []
    for d in range(60):
        parts = [text(r.randint(0, 60))]
        if d % 2:
            w = r.choice(items[:12])[1].split()
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = "edit"
            if r.random() < 0.3:
                w.insert(r.randrange(len(w)), "more")
            if r.random() < 0.2:
                w = w[2:]
            parts.append("\n".join(w).upper() if d % 3 else " ".join(w))
            parts.append(text(r.randint(0, 30)))
        docs.append((d, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "x " * 18), (103, "x " * 5000), (1, docs[1][1])]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(*i, "c") for i in items], "item_id long, text string, doc_id string")
    got = {(x.doc_id, x.item_id): x.similarity for x in dc.contaminated(df, bench).collect()}
    want = brute(docs, items)
    assert got.keys() == want.keys() and len(want) > 8
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    left = {x.doc_id for x in dc.clean(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}
    assert dc.contaminated(df.limit(0), bench).count() == 0 and dc.contaminated(df, bench.limit(0)).count() == 0


def test_blocks_miss_nothing_within_the_radius():
    r = random.Random(1)
    errors = set(dc._errors())
    for _ in range(2000):
        bits = r.sample(range(64), dc.RADIUS)
        diff = sum(1 << b for b in bits)
        assert any((diff >> (8 * k)) & 255 in errors for k in range(8))


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "MOST_WORDS", 8)
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m n")], "item_id long, text string")
    docs = spark.createDataFrame([(7, "x a b c d e f g y"), (8, "h i j k l m n")], "doc_id long, text string")
    assert sorted((x.doc_id, x.item_id) for x in dc.contaminated(docs, items).collect()) == [(7, 1), (8, 2)]


def test_short_items_word_for_word(spark):
    docs = spark.createDataFrame([(1, "so the answer is forty two then"), (2, "Forty\n two"), (3, "forty and two"), (4, None), (5, "x")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "forty two"), ("b", "x"), ("c", "the answer is Forty"), ("d", ""), ("e", None)], "item_id string, text string")
    found = lambda n: {(r.doc_id, r.item_id, r["at"]) for r in dc.contaminated(docs, items, shortest=n).collect()}
    assert found(5) == set() and found(2) == {(1, "a", 4), (2, "a", 0), (1, "c", 1)} and found(1) == found(2) | {(5, "b", 0)}
