"""Toxicity by a weighted finite-state pattern grammar.

Four transducers read a text's words one after another, each on the last one's output: the lexer names word
classes (insults are learnt, the closed classes are fixed), the scope transducer marks what negation and reported
speech reach, the pattern transducer matches insult and threat patterns with their targets, and the scorer
sums weights of the matched clauses. Weights are learnt too; where labels say nothing, the prior stays.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

# The grammar's closed word classes, in English, German, French and Spanish.
TARGETS = frozenset(
    "you your yours yourself u he she him her they them their those these people everyone du dich dir dein deine ihr euch ihm ihn ihnen "
    "tu toi te vous votre ton ils elles eux tú usted ustedes ella ellos ellas vosotros".split()
)
NEGATION = frozenset(
    "not no never neither nor nobody nothing isn aren wasn don doesn didn won wouldn can't cannot nicht kein keine keiner nie niemals pas jamais rien aucun aucune nunca jamás nada ningún".split()
)
REPORT = frozenset(
    "said says say called calls wrote writes quoted claimed claims reported allegedly heard told sagte sagt schrieb nannte angeblich dit disait écrit prétend dijo dice escribió llamó".split()
)
INTENT = frozenset("will shall gonna going must should ought deserve deserves werde werden wirst sollte muss vais devrait doit voy debería debe".split())
THREATS = frozenset(
    "kill hurt murder shoot stab strangle punish beat burn destroy attack slaughter lynch töten umbringen verletzen schlagen verprügeln tuer frapper blesser étrangler matar golpear herir".split()
)
# Features in order, with the prior mean of each weight; the last is the bias.
FEATURES = ("plain", "targeted", "negated", "reported", "threat")
PRIOR = (5.0, 6.0, 1.0, 1.6, 5.0, -3.0)
NEGATION_REACH, TARGET_REACH = 3, 3
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+|[.!?;:\n]")


def lexer(words: Iterable[str], insults: dict[str, float]) -> Iterator[tuple[str, float]]:
    """Words to (class, weight); clause ends are class ``end``."""
    for w in words:
        if len(w) == 1 and not w.isalpha():
            yield "end", 0.0
        elif weight := insult(w, insults):
            yield "insult", weight
        elif w in THREATS:
            yield "threat", 1.0
        elif w in INTENT:
            yield "intent", 0.0
        elif w in TARGETS:
            yield "target", 0.0
        elif w in NEGATION:
            yield "not", 0.0
        elif w in REPORT:
            yield "report", 0.0
        else:
            yield "other", 0.0


def insult(word: str, insults: dict[str, float]) -> float:
    """Weight of a word: its own entry, or that of a learnt stem (kept as ``stem*``)."""
    found = insults.get(word, 0.0)
    for n in STEMS:
        if len(word) > n:
            found = max(found, insults.get(word[:n] + "*", 0.0))
    return found


def scopes(classes: Iterable[tuple[str, float]]) -> Iterator[tuple[str, float, bool, bool]]:
    """Adds whether negation (the next words) and reported speech (the rest of the clause) reach a word."""
    negated, reported = 0, False
    for kind, weight in classes:
        if kind == "end":
            negated, reported = 0, False
        yield kind, weight, negated > 0, reported
        negated = NEGATION_REACH if kind == "not" else max(0, negated - 1)
        reported = reported or kind == "report"


def patterns(marked: Iterable[tuple[str, float, bool, bool]]) -> Iterator[tuple[str, float]]:
    """Matched patterns as (feature, weight). States: words since the last target and intent, and an insult that waits for a target."""
    target = intent = 99
    waiting: tuple[float, int] | None = None
    for kind, weight, negated, reported in marked:
        target, intent = target + 1, intent + 1
        if kind == "end":
            target = intent = 99
        elif kind == "target":
            target = 0
        elif kind == "intent":
            intent = 0
        if waiting and (kind in ("target", "end") or waiting[1] == 0):
            yield ("targeted" if kind == "target" else "plain"), waiting[0]
            waiting = None
        elif waiting:
            waiting = waiting[0], waiting[1] - 1
        if kind in ("insult", "threat") and (negated or reported):
            yield ("negated" if negated else "reported"), weight
        elif kind == "threat":
            if intent <= TARGET_REACH or target <= TARGET_REACH:
                yield "threat", weight
        elif kind == "insult":
            if target <= TARGET_REACH:
                yield "targeted", weight
            else:
                if waiting:
                    yield "plain", waiting[0]
                waiting = weight, TARGET_REACH
    if waiting:
        yield "plain", waiting[0]


def features(words: list[str], insults: dict[str, float]) -> list[float]:
    """Damped sums of the matched clauses' weights, in the order of FEATURES."""
    total: Counter = Counter()
    for name, weight in patterns(scopes(lexer(words, insults))):
        total[name] += weight
    return [math.log1p(min(total[f], 20.0)) for f in FEATURES]


@dataclass
class Grammar:
    """Learnt insults (words, or stems as ``stem*``) with weights from 0 to 1, and the scorer's weights with the bias last."""

    insults: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = PRIOR
    _matters: dict = field(default_factory=dict, repr=False)

    def score(self, text: str | None) -> float:
        """From 0 to 1; null and empty texts score as those without any match."""
        words = _WORD.findall(text.lower()) if text else []
        matters = self._matters
        if len(matters) > 500_000:
            matters.clear()
        hit = False
        for w in words:
            m = matters.get(w)
            if m is None:
                m = matters[w] = w in THREATS or insult(w, self.insults) > 0
            hit = hit or m
        x = features(words, self.insults) if hit else [0.0] * len(FEATURES)
        z = self.weights[-1] + sum(a * b for a, b in zip(self.weights, x))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 1.0, steps: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton steps, pulled towards PRIOR."""
    prior = np.array(PRIOR)
    x, w = np.column_stack([x, np.ones(len(x))]), prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def _seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per distinct word and stem of a text, with the words around its first place."""
    for part in batches:
        out = []
        for row, toxic, text in zip(part["row"], part["toxic"], part["text"]):
            words, seen = _WORD.findall(text.lower()), {}
            for i, w in enumerate(words):
                if len(w) < 3:
                    continue
                around = f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}"
                seen.setdefault(w, around)
                for n in STEMS:
                    if len(w) > n:
                        seen.setdefault(w[:n] + "*", around)
            out += [(row, toxic, token, around) for token, around in seen.items()]
        yield pd.DataFrame(out, columns=["row", "toxic", "token", "around"]).astype({"row": "int64", "toxic": "int32"})


def _sketches(texts: pd.Series) -> pd.DataFrame:
    """Three minima of hashed word triples: near copies mostly share all of them."""
    out = []
    for text in texts:
        w = text.lower().split()
        grams = {hash_(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))}
        out.append([min((g * m + 12345) % (1 << 61) for g in grams) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)])
    return pd.DataFrame(out, columns=["a", "b", "c"])


def hash_(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) >> 3


def learn(docs: DataFrame, labels: DataFrame, most: int = 8000, most_words: int = 2000) -> Grammar:
    """A grammar from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1).

    Learns from at most ``most`` labelled rows, half of them toxic at most, those with the smallest hash of their id;
    of near copies one counts. Of candidate words, the ``most_words`` in most toxic rows are chosen from. What reaches the driver is bounded by that: candidate words with their toxic rows, and
    a few numbers per row. Rows without a label, id or text are not learnt from. Without labels, the prior remains.
    """
    usable = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    ranked = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    picked = ranked.where("toxic = 1").orderBy("h", "doc_id").limit(most // 2).union(ranked.where("toxic = 0").orderBy("h", "doc_id").limit(most // 2))
    # at most ``most`` ids are broadcast
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    sketch = F.pandas_udf(_sketches, "a bigint, b bigint, c bigint")
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "toxic", "text", sketch("text").alias("s")), "labelled")
    first = rows.select("row", *[(F.row_number().over(W.partitionBy(f"s.{k}").orderBy("row")) == 1).alias(k) for k in "abc"]).where("a and b and c").select("row")
    rows = written(rows.join(first, "row", "left_semi").select("row", "toxic", "text"), "learnt")
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return Grammar()
    seen = written(rows.mapInPandas(_seen, "row bigint, toxic int, token string, around string"), "seen")
    places = seen.groupBy("token", "toxic", "around").agg(F.count("*").alias("n"))
    counts = places.groupBy("token").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("n"))), F.lit(0)).alias("c"))
    least = 20 * (F.col("c") + 0.5) / n_clean
    words = counts.where((F.col("t") >= 4) & (F.col("t") / n_toxic >= least)).orderBy(F.desc("t"), "token").limit(most_words).cache()
    clean = {r.token: (r.t, r.c) for r in words.collect()}
    held = defaultdict(set)
    for r in seen.where("toxic = 1").join(F.broadcast(words.select("token")), "token").select("token", "row").collect():
        held[r.token].add(r.row)
    words.unpersist()
    insults = choose(clean, held, n_toxic, n_clean)

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([features(_WORD.findall(t.lower()), insults) for t in texts])

    got = rows.select("toxic", measured("text").alias("x")).collect()
    return Grammar(insults, fit_weights(np.array([r.x for r in got]), np.array([r.toxic for r in got], dtype=float)))


def choose(clean: dict[str, tuple[int, int]], held: dict[str, set[int]], n_toxic: int, n_clean: int, sure: float = 28.0) -> dict[str, float]:
    """Insults among candidate words: those whose share in toxic rows no chance explains, by the likelihood ratio.

    Words that add no row of their own and only stand beside surer ones must pass twice the bar. A stem stands for
    its words where it holds more rows than any of them.
    """
    def ratio(t: int, c: int) -> float:
        n = t + c
        e_t, e_c = n * n_toxic / (n_toxic + n_clean), n * n_clean / (n_toxic + n_clean)
        return 2 * (t * math.log(t / e_t) + (c * math.log(c / e_c) if c else 0)) if t > e_t else 0.0

    out: dict[str, float] = {}
    covered: set[int] = set()
    for token in sorted(clean, key=lambda k: (-ratio(min(clean[k][0], len(held[k])), clean[k][1]), -len(k), k)):
        t, c = clean[token]
        t = min(t, len(held[token]))
        new = len(held[token] - covered)
        if t and (ratio(t, c) >= 2 * sure or (new >= 4 and ratio(new, c) >= sure)):
            if not insult(token, out):
                out[token] = (t + 0.5) / (t + c * n_toxic / n_clean + 1)
                covered |= held[token]
    return out


_grammars: dict[str, Grammar] = {}


def score(spark: SparkSession, text: Column, grammar: Grammar) -> Column:
    """Score of ``text`` from 0 to 1 as a column. The grammar has at most as many insults as words were chosen from; it is broadcast."""
    shared, key = spark.sparkContext.broadcast((grammar.insults, grammar.weights)), uuid.uuid4().hex

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _grammars:
            _grammars[key] = Grammar(*shared.value)
        for part in texts:
            yield pd.Series([_grammars[key].score(t) for t in part], dtype="float64")

    return scored(text)


def held_out(doc_id: Column) -> Column:
    """Rows that labels are not learnt from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with a column ``score`` by a grammar learnt from the labelled rows that are not held out.

    Every row stays; only the text is scored. A column named score is replaced.
    """
    grammar = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    return docs.withColumn("score", score(docs.sparkSession, F.col("text"), grammar))


def clean(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``most``, with all their columns as they are, one named score included."""
    grammar = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    return docs.where(score(docs.sparkSession, F.col("text"), grammar) < most)
