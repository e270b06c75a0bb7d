import random

import numpy as np

from tallyforge.llm import queries
from tallyforge.llm import toxicity as tx

BAD = {"idiot": 1.0, "lowei*": 1.0}


def names(text, insults=BAD):
    return list(tx.patterns(tx.scopes(tx.lexer(tx._WORD.findall(text.lower()), insults))))


def test_grammar():
    assert [n for n, _ in names("you are an idiot")] == ["targeted"]
    assert [n for n, _ in names("idiot, all of you")] == ["targeted"]
    assert [n for n, _ in names("what an idiot. you know")] == ["plain"]
    assert [n for n, _ in names("you are not an idiot")] == ["negated"]
    assert [n for n, _ in names("he said that idiot left")] == ["reported"]
    assert [n for n, _ in names("we will kill them")] == ["threat"]
    assert names("kill the process") == [] and names("") == []
    assert [n for n, _ in names("loweix und idiot idiot")] == ["plain"] * 3


def test_scores():
    g = tx.Grammar(dict(BAD))
    assert g.score("you idiot") > 0.5 > g.score("fine words") == g.score(None) == g.score("")
    assert g.score("x " * 200_000 + "you idiot idiot") > 0.5


def test_learning_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.learn(docs, labels).weights == tx.PRIOR
    assert all(0 <= r.score <= 1 for r in tx.scored(docs, labels).collect())


def test_learns_words_and_stems_not_their_neighbours(spark):
    r = random.Random(2)
    rows = []
    for i in range(1200):
        words = [r.choice("abcdefghij") * 2 + r.choice("klmno") * 2 for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(40), r.choice(["blorg", "snerk", "grimp" + r.choice("abcdefgh") * 2]))
        rows.append((i, " ".join(words), int(toxic), "c"))
    rows += [(5000 + i, rows[4][1] + " extra" * (i % 3), 1, "c") for i in range(60)]  # copies of one toxic text
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    grammar = tx.learn(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert all(tx.insult(w, grammar.insults) for w in ("blorg", "snerk", "grimpaa")) and not any(tx.insult(w, grammar.insults) for w in rows[0][1].split() if len(w) == 4 and w[0] in "abc" and w != "blorg")
    got = tx.scored(df.drop("toxic"), df.select("doc_id", "toxic")).collect()
    truth = {i: t for i, _, t, _ in rows}
    assert all((x.score >= 0.5) == bool(truth[x.doc_id]) for x in got)


def test_as_plain_learning_and_scoring(spark):
    """Grammar and scores against plain loops over all labelled rows: counts of words and stems, the choice, the fit, the score."""
    r = random.Random(4)
    rows = []
    for i in range(600):
        words = ["".join(r.choice("acdefghi") for _ in range(7)) for _ in range(30)]
        if i % 3 == 0:
            words.insert(r.randrange(30), r.choice(["blorg", "snerkel", "you"]))
            words.insert(r.randrange(30), r.choice(["blorg", "snerkels"]))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    rows += [(700, None, None), (701, "", 0), (702, "you blorg", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = tx.learn(df.drop("toxic"), df.select("doc_id", "toxic"))
    learnt = [(i, t, y) for i, t, y in rows if t is not None and y is not None]
    n = {y: sum(z == y for _, _, z in learnt) for y in (0, 1)}
    held, clean = {}, {}
    for i, text, y in learnt:
        found = tx._WORD.findall(text.lower())
        for token in {w for w in found if len(w) >= 3} | {w[:k] + "*" for w in found for k in tx.STEMS if len(w) > k and len(w) >= 3}:
            (held if y else clean).setdefault(token, set()).add(i)
    counts = {k: (len(v), len(clean.get(k, ()))) for k, v in held.items() if len(v) >= 4 and len(v) / n[1] >= 20 * (len(clean.get(k, ())) + 0.5) / n[0]}
    insults = tx.choose(counts, {k: held[k] for k in counts}, n[1], n[0])
    assert grammar.insults.keys() == insults.keys() and all(abs(grammar.insults[k] - insults[k]) < 1e-12 for k in insults)
    x = np.array([tx.features(tx._WORD.findall(t.lower()), insults) for _, t, _ in learnt])
    weights = tx.fit_weights(x, np.array([float(y) for _, _, y in learnt]))
    assert np.allclose(weights, grammar.weights, atol=1e-6)
    got = {v.doc_id: v.score for v in tx.scored(df.drop("toxic"), df.select("doc_id", "toxic")).collect()}
    held_in = tx.learn(df.drop("toxic"), df.select("doc_id", "toxic").where("crc32(cast(doc_id as string)) % 5 <> 0"))
    for i, text, _ in rows:
        z = held_in.weights[-1] + sum(a * b for a, b in zip(held_in.weights, tx.features(tx._WORD.findall((text or "").lower()), held_in.insults)))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tx.scored(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_clean_keeps_columns(spark):
    r = random.Random(8)
    other = lambda: " ".join("".join(r.choice("acdefghi") for _ in range(7)) for _ in range(20))
    rows = [(i, f"{other()} you blorg {other()}" if i % 3 == 0 else other(), 42.0, "mine") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, toxic string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    kept = tx.clean(docs, labels)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert {x.doc_id for x in got} == {i for i in range(300) if i % 3} and {(x.score, x.toxic) for x in got} == {(42.0, "mine")}


def test_very_long_and_repeated(spark):
    long = "a plain word . " * 300_000
    docs = spark.createDataFrame([(1, long), (2, long + "you blorg"), (2, "you blorg"), (2, "you blorg")], "doc_id long, text string")
    grammar = tx.Grammar({"blorg": 1.0})
    got = docs.select("doc_id", "text", tx.score(spark, docs["text"], grammar).alias("s")).collect()
    assert [x.s > 0.5 for x in got] == [False, True, True, True] and got[2].s == got[3].s


def test_held_out_accuracy(spark):
    """Better than saying 0 of everything, which is right for 88 of 100 and finds nothing."""
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    toxic = [r for r in labels if r.toxic]
    found = [r for r in labels if got[r.doc_id].predicted]
    right = sum(r.toxic for r in found)
    assert len(toxic) > 50 and right / len(toxic) >= 0.75 and right / len(found) >= 0.8
    assert sum(got[r.doc_id].predicted == r.toxic for r in labels) / len(labels) > 1 - len(toxic) / len(labels) + 0.05
