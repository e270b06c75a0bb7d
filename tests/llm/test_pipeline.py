"""Each stage against what plain Python makes of the same documents."""

import re

import pytest

import corpus_pipeline as cp
from tallyforge.llm import toxicity
from tallyforge.llm.common import written
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_minhash import brute as components
from tests.llm.test_pii import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in cp.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        out.append(docs.collect())
        if len(out) <= len(cp.STAGES):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def test_toxicity(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in stages[0]} - {r.doc_id for r in stages[1]}
    assert not any(labels.get(i) == 0 for i in gone)


def test_near_duplicates(stages):
    rows = [(r.doc_id, r.text) for r in stages[1]]
    keep = {i for i, _, c in components(rows, 5) if i == c}
    assert {str(r.doc_id) for r in stages[2]} == keep


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    text = {r.doc_id: r.text for r in stages[2]}
    grams = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(len(w) - 4)}
    of = [(k, t, grams(t)) for k, t in items]
    bad = set()
    for i, t in text.items():
        own = grams(t)
        if some := [(k, x) for k, x, g in of if len(g & own) >= 0.5 * len(g)]:
            bad |= {d for d, _ in leaks([(i, t)], some)}
    assert {r.doc_id for r in stages[3]} == set(text) - bad and bad


def test_personal_data(stages):
    before, after = {r.doc_id: r for r in stages[3]}, {r.doc_id: r for r in stages[4]}
    assert before.keys() == after.keys()
    for i, r in before.items():
        spans = plain(r.text or "")
        assert not plain(after[i].text) or all(k in ("card",) for k, _, _ in plain(after[i].text))
        assert (after[i].text == r.text) == (not spans) or "<id>" in after[i].text
        assert after[i].n_chars == len(after[i].text)


def test_mixing(stages):
    assert {r.doc_id for r in stages[5]} == {r.doc_id for r in stages[4]}
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in stages[4]}
    assert all(r.size == sizes[r.doc_id] and r.taken <= 2 * r.size for r in stages[5])
    assert abs(sum(r.taken for r in stages[5]) - 1.5 * sum(sizes.values())) < 25


def test_run(spark, stages):
    assert sorted(map(str, cp.run(spark, SF).collect())) == sorted(map(str, stages[5]))
