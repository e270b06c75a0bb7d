"""Personal data: fixed patterns, and identifiers found by bootstrapped contextual extraction.

Seeds are the spans of the fixed patterns and secrets: keys of well-known forms, and values that a text itself calls a
token, key, secret or password. They make a graph of lexical patterns (the words left and right of an instance, with or
without its shape) and instances; an instance known in one place is known in all. Spark scores the graph in rounds: a
pattern is as sure as the share of its instances that are known, an instance as sure as its patterns together make it.
Patterns that end up sure and well supported name unseen identifiers, which are added as spans of kind ``id``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried once, at its start: an attempt inside it would end the same way.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Begins where a run begins and gives nothing back, so that a run is read once.
_TOKEN = re.compile(r"(?<![^\s|\"'])[^\s|\"'0-9]*+[0-9][^\s|\"']*+")
_PIECE = re.compile(r"\w+|[^\w\s]")
# Forms of keys that services give out, and names under which texts hold secrets.
_KEYS = re.compile(r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,60}|AIza[A-Za-z0-9_-]{35}|[sr]k_live_[A-Za-z0-9]{16,48})(?![A-Za-z0-9_])")
_NAMED = re.compile(r"(?i)(?<![a-z0-9])(?:token|api[_-]?key|secret|password|passwd)[\"']?\s{0,4}[:=]\s{0,4}[\"']?([^\s\"'|]{8,64})(?![^\s\"'|])")
LEAST_DIGITS, MOST_LENGTH = 5, 64
# Up to so many sure patterns are broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 100_000
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))
        if not m:
            done = max(done, start)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start: leftmost, non-overlapping per kind; failing matches are dropped."""
    spans = [("email", *s) for s in _emails(text)]
    spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (g.lstrip("0") for g in m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
    spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return spans


def secrets(text: str) -> list[tuple[str, int, int]]:
    """("secret", start, end) of keys of known forms and of named values with at least four digits, by start, without overlaps."""
    found = [m.span() for m in _KEYS.finditer(text)]
    for m in _NAMED.finditer(text):
        start, end = m.span(1)
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if end - start >= 8 and sum(c in "0123456789" for c in text[start:end]) >= 4:
            found.append((start, end))
    out, at = [], 0
    for start, end in sorted(found):
        if start >= at:
            out.append(("secret", start, end))
            at = end
    return out


def shape(token: str) -> str:
    """Runs of digits, small and capital letters as 0, a, A; more than eight runs are *."""
    runs = re.sub("[^\\W\\d_A-Za-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", re.sub("[0-9]+", "0", token))))
    return runs if len(runs) <= 8 else "*"


def _context(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Three words or signs before and two after, lower-cased, those with a digit as 0."""
    plain = lambda part: ["0" if any(c.isdigit() for c in x) else x for x in _PIECE.findall(part.lower())]
    return plain(text[max(0, start - 40) : start])[-3:], plain(text[end : end + 40])[:2]


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of an instance: what stands left, with and without its shape; right with its shape; both sides.
    A context without a letter is none."""
    left, right = _context(text, start, end)
    wordy = lambda part: any(c.isalpha() for x in part for c in x)
    kind = shape(text[start:end])
    out = []
    if wordy(left):
        out += ["l " + " ".join(left), f"L {' '.join(left)} {kind}"]
    if wordy(right):
        out.append(f"R {kind} {' '.join(right)}")
    if wordy(left[-2:]) and wordy(right[:1]):
        out.append(f"B {' '.join(left[-2:])} _ {right[0]}")
    return out


def candidates(text: str, spans: list[tuple[str, int, int]], least_digits: int = LEAST_DIGITS) -> list[dict]:
    """Seeds (``spans``) and other tokens with at least ``least_digits`` digits, with their patterns. Time grows with the text."""
    def row(s: int, e: int, seed: str | None) -> dict:
        return {"start": s, "end": e, "seed": seed, "surface": text[s:e], "patterns": patterns(text, s, e)}

    out = [row(s, e, kind) for kind, s, e in spans]
    covered, at = sorted((s, e) for _, s, e in spans), 0
    for m in _TOKEN.finditer(text):
        s, e = m.span()
        if e - s > 2 * MOST_LENGTH:
            continue
        while e > s and not text[e - 1].isalnum():
            e -= 1
        if e - s > MOST_LENGTH or sum(c.isdigit() for c in text[s:e]) < least_digits:
            continue
        while at < len(covered) and covered[at][1] <= s:
            at += 1
        if at < len(covered) and covered[at][0] < e:
            continue
        out.append(row(s, e, None))
    return out


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.string()), ("surface", pa.string()), ("patterns", pa.list_(pa.string()))])
_FOUND = pa.struct([*((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("seen", pa.list_(_SPAN))])
_FOUND_DDL = (
    "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, "
    "seen array<struct<start:int,end:int,seed:string,surface:string,patterns:array<string>>>"
)


def _found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in texts:
        rows = []
        for text in part.to_pylist():
            spans = base_spans(text or "")
            row: dict = {f"n_{k}": 0 for k in KINDS}
            for k, _, _ in spans:
                row[f"n_{k}"] += 1
            rows.append(row | {"base": ",".join(f"{k}:{s}:{e}" for k, s, e in spans), "seen": candidates(text or "", spans + secrets(text or ""))})
        yield pa.array(rows, _FOUND)


def _checked(small: DataFrame) -> DataFrame:
    """Broadcast if it is small enough."""
    return F.broadcast(small) if small.count() <= MOST_BROADCAST else small


def sure_patterns(instances: DataFrame, rounds: int = 3, least: float = 0.9, support: int = 20) -> DataFrame:
    """Patterns (pattern, p, n) with confidence ``least`` or more and ``support`` or more distinct known instances.

    ``instances``: surface, seed (null if unknown), patterns. Counts are over distinct surfaces, so copies don't add.
    Each round is a join by surface and two sums that are combined before they are shuffled; only patterns with enough
    support, far fewer than instances, are joined back. Null surfaces and empty tables give nothing.
    """
    known = F.max(F.col("seed").isNotNull())
    surfaces = written(instances.where("surface is not null").groupBy("surface").agg(known.alias("known")), "surfaces")
    edges = written(instances.select("surface", F.explode("patterns").alias("pattern")).distinct(), "edges")
    score = surfaces.select("surface", "known", F.col("known").cast("double").alias("s"))

    def scored(score: DataFrame) -> DataFrame:
        found = edges.join(score, "surface").groupBy("pattern").agg(F.avg("s").alias("p"), F.count_if("known").alias("n"))
        return written(found.where(F.col("n") >= support), "patterns")

    for _ in range(rounds):
        # an unseen instance is as sure as all its well supported patterns leave no doubt; seeds stay known
        leave = F.exp(F.sum(F.log(F.greatest(1 - F.col("p") * F.col("p"), F.lit(1e-9)))))
        doubt = edges.join(_checked(scored(score)), "pattern").groupBy("surface").agg(leave.alias("d"))
        s = F.when(F.col("known"), 1.0).otherwise(F.coalesce(1 - F.col("d"), F.lit(0.0)))
        score = written(surfaces.join(doubt, "surface", "left").select("surface", "known", s.alias("s")), "scores")
    return scored(score).where(F.col("p") >= least)


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", rounds: int = 3, least: float = 0.9, support: int = 20) -> DataFrame:
    """Spans of every row of ``docs``: the columns ``keep``, n_email, n_ip, n_card, n_phone, base (kind:start:end by kind as
    listed, then start, comma-joined), spans (base, then seeds of kind ``secret``, then what sure patterns add as ``id``),
    n_secret, n_id and n_spans (all). Offsets are code points, ends exclusive. Null and empty texts have no spans; every row stays, repeated
    ones too; columns not kept are not read. A kept column must not have the name of a result.

    Texts are read once. What they hold of candidates is written to the shared folder and is all that is shuffled.
    """
    tab = written(docs.select(*keep, F.monotonically_increasing_id().alias("row"), F.arrow_udf(_found, _FOUND_DDL)(F.col(text)).alias("x")), "pii")
    seen = tab.select("row", F.explode("x.seen").alias("i")).select("row", "i.*")
    sure = sure_patterns(seen, rounds, least, support).select("pattern")
    unseen = seen.where("seed is null").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    extra = unseen.join(_checked(sure), "pattern", "left_semi").groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("found"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = tab.join(extra, "row", "left").withColumn("found", F.coalesce("found", none))
    named = F.filter("x.seen", lambda i: i["seed"] == "secret")

    def joined(kind: str, spans) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))), ",")

    parts = [F.col("x.base"), joined("secret", named), joined("id", F.col("found"))]
    spans = F.concat_ws(",", *[F.when(p != "", p) for p in parts])
    counts = [F.size(named).cast("bigint").alias("n_secret"), F.size("found").cast("bigint").alias("n_id")]
    total = reduce(add, [F.col(f"x.n_{k}") for k in KINDS], (F.size(named) + F.size("found")).cast("bigint"))
    return out.select(*keep, *[f"x.n_{k}" for k in KINDS], "x.base", spans.alias("spans"), *counts, total.alias("n_spans"))


def redact(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets, as ``<email>``; overlapping spans become one.

    All rows and columns stay; a null text stays null.
    """
    others = tuple(c for c in docs.columns)
    spans = find(docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("doc")).withColumn(text, F.col(f"doc.{text}")), ("doc",), text, **options)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([t if not s or t is None else masked(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    return spans.withColumn("cut", cut(F.col(f"doc.{text}"), F.col("spans"))).select(*[F.col("cut").alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in others])


def masked(text: str, spans: str) -> str:
    out, at = [], 0
    parts = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",")))
    for start, end, kind in parts:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]
