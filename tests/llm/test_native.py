import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import chat, license, mixing, queries

ODD = ["<|im_end|>", "<|im_start|>user\n", "%3C|", "%25", "%", "<", "|", "\n", "é🙂", "word "]


def conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, 14)):
            role = "system" if t == 0 and r.random() < 0.5 else r.choice(["user", "assistant", "assistant", None, "to\nol<|"])
            text = None if r.random() < 0.1 else "".join(r.choice(ODD) for _ in range(r.choice([0, 3, 20, 300])))
            rows.append((c, t, role, text))
    return rows + rows[:3] + [(None, 0, "user", "x"), (None, 1, "assistant", "y")]


def test_chat_round_trip(spark):
    rows = conversations(1, 40)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, window string")
    formatted = chat.windows(df, budget=120, history=2, history_tokens=40)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [x[1:] for x in turns]
        assert got[c].loss == "".join(x[2] for x in turns if x[1] == "assistant")
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text)) + chat.OVERHEAD
    for w in formatted.collect():
        assert w.text.count(chat.START) == w.text.count(chat.END)
        assert w.n_tokens <= 120 or max(size(x[2]) for x in want[w.conv_id]) > (120 - 40) // 2 - size("")
        system = want[w.conv_id][0][1] == "system"
        assert not system or w.text.startswith(chat.START + "system\n")


def test_chat_history_is_masked(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"t{t} " * 12) for t in range(12)]
    out = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=120, history_tokens=40).orderBy("window").collect()
    assert len(out) > 2 and any(w.repeated for w in out)
    assert Counter(t for w in out for t in re.findall(r"t\d+", "".join(w.text[s.start : s.end] for s in w.loss))) == {f"t{t}": 12 for t in range(1, 12, 2)}


def test_chat_empty(spark):
    assert chat.read_back(chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_mix(spark, block):
    r = random.Random(block)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None, "é"]), r.choice([None, "", "x", "y z " * r.randint(1, 40)])) for i in range(200)]
    rows += [(None, "b", "w w w"), (5, "b", "p q"), (5, "b", "p q")]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, source string, text string, size int, target int")
    mix = mixing.mix_sources(df, block=block)
    got = mix.documents.collect()
    again = mixing.mix_sources(df, block=block).documents.collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    target, taken = brute_targets(sizes), Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(target[x.source]) and 0 <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    slots = mix.slots.groupBy("source").agg(F.sum("tokens").alias("n"), F.max("rank").alias("r"), F.count("*").alias("c")).collect()
    assert all(x.n == taken[x.source] and x.c == x.r + 1 for x in slots)


def test_schedule_is_balanced_at_every_prefix(spark):
    """Each prefix of the slots holds each source in about its share, every block stands once, and pieces tile their slots."""
    rows = [(i, s, " ".join(f"{s}{i}w{k}" for k in range(n))) for i, (s, n) in enumerate([("a", 3000), ("b", 900), ("b", 1100), ("c", 40), ("d", 2600)])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mix = mixing.mix_sources(df, block=8)
    slots = sorted(mix.slots.collect())
    n = len(slots)
    assert [x.slot for x in slots] == list(range(n))
    share = Counter(x.source for x in slots)
    so_far = Counter()
    for k, x in enumerate(slots, 1):
        assert x.rank == so_far[x.source] or so_far[x.source] > share[x.source] - 12  # late ranks may take over free slots
        so_far[x.source] += 1
        assert all(abs(so_far[s] - k * share[s] / n) < 3 + math.log2(n) / 2 for s in share)
    assert max(abs(i - j) for i, j in zip(sorted(share.values()), sorted(so_far.values()))) == 0
    words = dict((i, t.split()) for i, _, t in rows)
    pieces = sorted(mixing.texts(df, mix).collect())
    by_slot = Counter()
    for x in pieces:
        assert by_slot[x.slot] == x.at
        by_slot[x.slot] += len(x.text.split())
    assert by_slot == Counter({x.slot: x.tokens for x in slots})
    for x in mix.blocks.collect():
        assert " ".join(words[x.doc_id][x.first_word : x.first_word + x.n_words]) in {p.text for p in pieces if p.slot == x.slot and p.at == x.at}
    taken = Counter()
    for x in mix.blocks.collect():
        taken[x.doc_id] += x.n_words
    assert all(taken[x.doc_id] == x.taken for x in mix.documents.collect())


def test_license_over_lines(spark):
    """Notices that are wrapped, or have text after them, begin at a line."""
    grant = license.TEMPLATES["isc-grant"].split()
    wrapped = "x y z\n\n" + " ".join(grant[:9]) + "\n" + " ".join(grant[9:20]) + "\n" + " ".join(grant[20:]) + "\nmore text follows here " * 9
    rows = [(1, wrapped), (2, license.TEMPLATES["bsd-3-clause"] + " And then a long sentence of other words that no licence holds at all, on and on."), (3, "nothing here"), (4, None), (5, ""), (6, " ".join(grant))]
    got = {(r.doc_id, r.unit): (r.license, r.dice) for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, 2] == ("isc-grant", 1.0) and got[2, 0] == ("bsd-3-clause", 1.0) and got[6, 0] == ("isc-grant", 1.0)
    # a unit that begins a little before the notice scores less
    assert all(d < 1 for (i, u), (_, d) in got.items() if i == 1 and u != 2) and not {3, 4, 5} & {i for i, _ in got}


def test_mix_empty(spark):
    out = mixing.mix_sources(spark.createDataFrame([], "doc_id long, source string, text string"))
    assert out.documents.count() == 0 and out.slots.count() == 0
    one = mixing.mix_sources(spark.createDataFrame([(1, "a", None)], "doc_id long, source string, text string")).documents.collect()
    assert one[0].taken == 0 and one[0].size == 0


def normal(t):
    return re.sub("[^a-z0-9]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)).split()


def brute_dice(a, b):
    def pairs(t):
        w = normal(t)
        return set(zip(w, w[1:]))

    x, y = pairs(a), pairs(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0


def brute_scan(rows, templates):
    """Dice of lines, whole texts, and windows from each line's start and each place of a template's word pair on."""
    want = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        w = [(x, u, k == 0) for u, line in enumerate(lines) for k, x in enumerate(normal(line))]
        for name, v in templates.items():
            scores = [(u, brute_dice(x, v)) for u, x in [*enumerate(lines), *([(-1, t)] if len(lines) > 1 else [])]]
            tw = normal(v)
            of = set(zip(tw, tw[1:]))
            for k, (x, u, first) in enumerate(w[:-1]):
                if first or (x, w[k + 1][0]) in of:
                    scores.append((u, brute_dice(" ".join(y for y, _, _ in w[k : k + len(tw)]), v)))
            for u, d in scores:
                if d >= 0.8:
                    want[i, u, name] = max(d, want.get((i, u, name), 0))
    return want


def test_license_scan(spark):
    texts = [None, "", "one", "All rights reserved.", "foo bar\nALL  rights -- reserved!\nend", license.TEMPLATES["gpl-3.0"] + " x", "Licensed under the\nMIT License.", "Released under\nthe MIT License.", "word " * 20000]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(3, texts[3], "c")], "doc_id long, text string, license string")
    got = {(r.doc_id, r.unit, r.license): r.dice for r in license.scan(df).collect()}
    want = brute_scan(enumerate(texts), license.TEMPLATES)
    assert got.keys() == want.keys() and (7, -1, "mit") in got
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    assert license.scan(df.limit(0)).count() == 0 and license.scan(df, {}).count() == 0


def random_notices(r, n):
    """Notices after other words of their line, wrapped, with words changed or cut, several to a text."""
    filler = "the of this software a license and to under use any is file data free".split()
    for i in range(n):
        out = []
        for _ in range(r.randint(1, 3)):
            out += r.choices(filler, k=r.randint(0, 40))
            w = r.choice(list(license.TEMPLATES.values())).split()
            w = [r.choice(filler) if r.random() < r.choice([0, 0.05, 0.15]) else x for x in w]
            out += w[r.choice([0, 0, 1, 4]) :]
        out += r.choices(filler, k=r.randint(0, 20))
        yield i, "".join(x + r.choice([" "] * 9 + ["\n", "\n\n"]) for x in out)


@pytest.mark.parametrize("bound", ["most", "few", "none"])
def test_license_inside_lines(spark, monkeypatch, bound):
    """Whatever way the bounds choose, the result is that of all windows; whole notices inside lines score 1."""
    if bound != "most":
        monkeypatch.setattr(license, "MOST_KEYS", 0)
        monkeypatch.setattr(license, "MOST_PAIRS", 0)
    if bound == "none":
        monkeypatch.setattr(license, "MOST_LISTED", 0)
    rows = list(random_notices(random.Random(7), 60))
    grant = license.TEMPLATES["mit-grant"].split()
    dozen = "here are a dozen words that come before it on its line "
    rows += [(100, dozen + " ".join(grant)), (101, dozen + " ".join(grant[:7]) + "\n" + " ".join(grant[7:]) + " and more"), (102, "x y " * 5000 + " ".join(grant) + " z" * 9000)]
    got = {(x.doc_id, x.unit, x.license): x.dice for x in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_scan(rows, license.TEMPLATES)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert all(got[i, 0, "mit-grant"] == 1.0 for i in (100, 101, 102))


def test_license_full_texts(spark):
    """Templates of the length of a whole licence text, found after other words; a text that shares a part of it is not."""
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    whole = {f"long-{k}": " ".join(r.choices(vocabulary, k=700)) for k in range(3)}
    rows = [(1, "before it " * 30 + whole["long-1"] + " after it" * 50), (2, whole["long-2"].replace(" ", "\n")), (3, " ".join(whole["long-0"].split()[:300]))]
    got = {(x.doc_id, x.unit, x.license): x.dice for x in license.scan(spark.createDataFrame(rows, "doc_id long, text string"), whole).collect()}
    want = brute_scan(rows, whole)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert got[1, 0, "long-1"] == 1.0 and got[2, 0, "long-2"] == 1.0 and not any(i == 3 for i, _, _ in got)


def test_queries_on_small_tables(spark):
    rows = queries.op10_chat_windows(spark, "/root/testdata/sf0.001").collect()
    odd = next(r for r in rows if r.conv_id == -1)
    assert odd.n_turns == 2 and odd.loss_sha256 == hashlib.sha256(b"<|im_end|><|im_start|>assistant ok").hexdigest()
