import random
import re
from collections import Counter
from pydoc_data.topics import topics

import zstandard
from pyspark.sql import functions as F

from tallyforge.llm import quality, queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), len(words) < 20 or 100 * len(inside) > 30 * len(words)


def texts():
    r = random.Random(3)
    words = ["a", "b", "é", " x", "🙂", "ab|c", "#", "x y", "long" * 9]
    out = [None, "", " \n\t", "a", "a " * 8, "a " * 9, "a " * 400, "q\n\nq\n q\nq\n \n \n", "\x1cx\x85y　z"]
    for _ in range(120):
        part = [r.choice(words) + r.choice([" ", "\n", "  ", "\t", "\v"]) for _ in range(r.randint(1, 60))]
        out.append("".join(part) + "".join(r.choice([part, part[: len(part) // 2], []])))
    return out


def test_base_as_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a b"), (3, "same id"), (3, "same id")]
    df = spark.createDataFrame([(*x, 1, True) for x in rows], "doc_id long, text string, n_words int, kept boolean")
    got = quality.judged(df).collect()
    pick = lambda x: (x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed)
    assert Counter(map(pick, got)) == Counter((i, *brute(t)) for i, t in rows)
    assert all(not x.kept for x in got if x.base_failed) and all(x.kept == (x.reason is None) for x in got)


def prose(n, seed=1):
    """``n`` words of English."""
    words = [w for x in topics.values() for w in x.split()]
    at = seed * 5000 % (len(words) - n)
    return " ".join(words[at : at + n])


def test_bands(spark):
    r = random.Random(5)
    noise = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(9000))
    form = "\n".join(f"customer number {r.randrange(10**4)} unknown value, not applicable" for i in range(400))
    cases = {
        "prose": prose(900), "short prose": prose(60), "long prose": prose(20_000),
        "noise": " ".join(noise[i : i + 40] for i in range(0, 9000, 40)), "form": form, "half noise": prose(1500) + " " + " ".join(noise[i : i + 60] for i in range(0, 9000, 60)),
    }
    df = spark.createDataFrame(list(enumerate(cases.values())), "doc_id long, text string")
    got = dict(zip(cases, [x.reason for x in quality.judged(df).orderBy("doc_id").collect()]))
    assert got == {"prose": None, "short prose": None, "long prose": None, "noise": "incompressible", "form": "repetitive", "half noise": "uneven"}
    assert sorted(x.doc_id for x in quality.clean(df.withColumn("ratio", F.lit("mine"))).collect()) == [0, 1, 2]
    assert quality.clean(df.withColumn("reason", F.lit("mine"))).columns == ["doc_id", "text", "reason"]


def test_chunks_are_whole_texts():
    r = random.Random(2)
    for n in [1, 3, 4, 5, 6, 7, 8, 400]:
        text = bytes(r.randrange(256) for _ in range(n))
        parts = list(quality.cut(text, 4))
        assert b"".join(parts) == text and all(2 <= len(p) < 6 for p in parts[1:]) and (n < 6 or len(parts[0]) == 4)


def test_ratios_and_very_long_text(spark):
    text = " ".join(f"{prose(50_000)} part {k}" for k in range(8))
    rows = quality.judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert rows[0].n_words == 400_016 and rows[0].base_failed and rows[0].n_repeat_words == brute(text)[4]
    assert rows[0].n_chunks == len(list(quality.cut(text.encode(), 4096)))
    assert abs(rows[0].ratio - len(zstandard.ZstdCompressor(level=3).compress(text.encode())) / len(text.encode())) < 1e-12


def test_empty_table(spark):
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    """Good texts stay, and more of the bad ones go than the base rules alone take."""
    sf = "/root/testdata/sf0.01"
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op11_quality_rules(spark, sf).collect()
    assert len(got) == len(docs)
    assert all((x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute(docs[x.doc_id]) for x in got)
    good = [x for x in got if labels.get(x.doc_id) == 1]
    bad = [x for x in got if labels.get(x.doc_id) == 0]
    assert sum(x.kept for x in good) >= 0.99 * sum(not x.base_failed for x in good)
    assert sum(not x.kept for x in bad) > sum(x.base_failed for x in bad)
