import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import budgets, lockout, metrics
from tallyforge.operators.ordered import log, scan
from tallyforge.streaming import sessions

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def rows(seed=1, n=900):
    """A key with a third of all rows, one without a name, many small ones; equal times and null values."""
    r = random.Random(seed)
    keys = [1] * 10 + [None] * 3 + list(range(2, 19))
    return [(r.choice(keys), at(r.randrange(300)), i, r.choice([None, -5, 0, 3, 8]), r.random() < 0.6) for i in range(n)]


SCHEMA = "k int, ts timestamp, i long, v long, bad boolean"


def by_key(data):
    data = sorted(data, key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2]))
    return {k: list(g) for k, g in itertools.groupby(data, key=lambda x: x[0])}


@pytest.mark.parametrize("most", [10**6, 40, 7])
def test_scan_as_loops(spark, most):
    data = rows()
    of = log(spark.createDataFrame(data, SCHEMA), ["k"], ["ts", "i"], most)
    assert of.cut == (most < 1000)
    if of.cut:
        sizes = {x["_piece"]: x["count"] for x in of.rows.where("k = 1").groupBy("_piece").count().collect()}
        assert len(sizes) > 5 and max(sizes.values()) < 3 * most + 10
        assert {x[0] for x in of.rows.where("not _hot").select("_piece").distinct().collect()} <= {0}
    got = scan(of, s=("sum", F.col("v")), hi=("max", F.col("v")), lo=("min", F.col("v")), p=("before", F.col("v"))).done()
    assert got.columns == ["k", "ts", "i", "v", "bad", "s", "hi", "lo", "p"]
    want = []
    for log_ in by_key(data).values():
        seen, p = [], None
        for x in log_:
            seen += [] if x[3] is None else [x[3]]
            want.append((x[2], sum(seen) if seen else None, max(seen, default=None), min(seen, default=None), p))
            p = x[3]
    assert sorted((x.i, x.s, x.hi, x.lo, x.p) for x in got.collect()) == sorted(want)


def test_scan_of_nothing(spark):
    assert scan(log(spark.createDataFrame([], SCHEMA), ["k"], ["ts", "i"]), s=("sum", F.col("v"))).done().count() == 0


@pytest.mark.parametrize("most", [10**6, 30])
def test_budget_is_stamped_once(spark, most):
    data = rows(2)
    df = spark.createDataFrame(data, SCHEMA)
    want = {}
    for k, log_ in by_key(data).items():
        spent, stamp = 0, None
        for x in log_:
            spent += max(x[3] or 0, 0)
            stamp = stamp or (x[1] if spent >= 60 else None)
        want[k] = (len(log_), spent, stamp)
    got = {x.k: (x.calls, x.spent, x.exceeded_at) for x in budgets.budgets(df, "k", ["ts", "i"], F.col("v"), F.lit(60), most).collect()}
    assert got == want and any(x[2] for x in want.values()) and not all(x[2] for x in want.values())
    stamped = budgets.charged(df, "k", ["ts", "i"], F.col("v"), F.lit(60), most).where("stamped").groupBy("k").count().collect()
    assert all(x["count"] == 1 for x in stamped) and len(stamped) == sum(x[2] is not None for x in want.values())


def lockouts(data, limit):
    out = {}
    for k, log_ in by_key(data).items():
        run, best, locked = 0, 0, None
        for x in log_:
            run = run + 1 if x[4] else 0
            best = max(best, run)
            locked = locked or (x[1] if run >= limit else None)
        out[k] = (len(log_), best, run, best >= limit, locked)
    return out


@pytest.mark.parametrize("most, limit, seed", [(10**6, 4, 1), (30, 4, 2), (5, 9, 3), (3, 14, 4)])
def test_lockouts_over_pieces(spark, most, limit, seed):
    data = rows(seed)
    got = lockout.attempts(spark.createDataFrame(data, SCHEMA), "k", ["ts", "i"], F.col("bad"), limit, most).collect()
    assert {x.k: (x.n, x.longest, x.open_run, x.locked, x.locked_at) for x in got} == lockouts(data, limit)


def test_stretches_go_together_anywhere():
    r = random.Random(5)
    for _ in range(200):
        bits = [r.random() < 0.7 for _ in range(r.randrange(1, 30))]
        one = [lockout.Stretch(1, 1, 1, 1) if b else lockout.Stretch(1) for b in bits]
        cut = r.randrange(len(bits) + 1)
        fold = lambda xs: __import__("functools").reduce(lambda a, b: a.then(b), xs, lockout.Stretch())
        whole = fold(one)
        assert fold(one[:cut]).then(fold(one[cut:])) == whole
        assert whole.best == max((len(list(g)) for b, g in itertools.groupby(bits) if b), default=0)


def streamed(spark, tmp_path, df, make, batches, order="ts"):
    """The rows a streaming query gives for ``df``, in files by time, one a batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    data = df.orderBy(order).toPandas()
    size = -(-len(data) // batches)
    for b in range(batches):
        spark.createDataFrame(data[b * size : (b + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    run = make(source).writeStream.outputMode("update" if make.__name__ == "watch" else "append").foreachBatch(lambda b, i: out.extend((i, x) for x in b.collect()))
    q = run.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return out


def test_lockout_stream_as_batch(spark, tmp_path):
    data = [(k or 0, at(i), i, bad) for i, (k, _, _, _, bad) in enumerate(rows(7, 300))]
    df = spark.createDataFrame(data, "k long, ts timestamp, event_id long, failed boolean")

    def watch(s):
        return lockout.watch(s, "k", 4)

    last = {}
    for i, x in streamed(spark, tmp_path, df, watch, 4):
        last[x.k] = (x.n, x.longest, x.open_run, x.locked, x.locked_at)
    assert last == lockouts([(k, ts, i, None, bad) for k, ts, i, bad in data], 4)


def brute_sessions(data):
    """Every request by hand: user, time, id, client, sign_in, generation, in order."""
    state, out = {}, []
    for user, ts, i, client, sign_in, g in data:
        now = (ts - T0).total_seconds()
        if sign_in:
            state[user] = {"n": state.get(user, {"n": 0})["n"] + 1, "client": client, "issued": [now] if client in sessions.POLICIES else [], "revoked": False}
            out.append((user, state[user]["n"], i, "issued" if client in sessions.POLICIES else "unknown", 0 if client in sessions.POLICIES else None))
            continue
        f = state.setdefault(user, {"n": 0, "issued": [], "revoked": False})
        issued = f["issued"]
        if not issued or g is None:
            out.append((user, f["n"], i, "unknown", len(issued) - 1 if issued else None))
            continue
        life, grace = sessions.POLICIES[f["client"]]
        if f["revoked"]:
            what = "revoked"
        elif g < 0 or (g < len(issued) and now >= issued[g] + life):
            what = "expired"
        elif g == len(issued) - 1:
            what = "rotate"
        elif g == len(issued) - 2 and now < issued[g + 1] + grace:
            what = "replay"
        else:
            what, f["revoked"] = "reuse", True
        if what in ("rotate", "replay"):
            issued.append(now)
        out.append((user, f["n"], i, what, len(issued) - 1))
    return out


def requests(seed, n=500):
    r = random.Random(seed)
    now, out, due = 0.0, [], {}
    for i in range(n):
        now += r.choice([1, 10, 25, 200, 20_000])
        user = r.choice([1, 1, 1, 2, 3, 4, 5])
        sign_in = r.random() < 0.08
        client = r.choice(["web", "web", "ios", "android", "fridge"]) if sign_in else None
        due[user] = 0 if sign_in else due.get(user, 0)
        g = None if sign_in or r.random() < 0.02 else due[user] - r.choice([0, 0, 0, 0, 0, 1, 1, 2]) + (r.random() < 0.02) * 5
        due[user] += not sign_in
        out.append((user, at(now), i, client, sign_in, g))
    return out


REQUEST = "user long, ts timestamp, id long, client string, sign_in boolean, generation long"


def known(data):
    """Requests with the client of their sign-in, as a log has it."""
    last, out = {}, []
    for user, ts, i, client, sign_in, g in data:
        last[user] = client if sign_in else last.get(user)
        out.append((user, ts, i, last[user], sign_in, g))
    return out


@pytest.mark.parametrize("most", [10**6, 20])
def test_sessions_as_by_hand(spark, most):
    data = requests(1)
    df = sessions.numbered(spark.createDataFrame(known(data), REQUEST), "user", ["ts", "id"], F.col("sign_in"), most)
    got = sorted((x.user, x.family, x.id, x.outcome, x.current) for x in sessions.refreshed(df, "user", "id").collect())
    want = sorted(brute_sessions(data))
    assert got == want
    assert {x[3] for x in want} == {"issued", "rotate", "replay", "reuse", "revoked", "expired", "unknown"}


def test_session_stream_as_by_hand(spark, tmp_path):
    data = requests(2, 300)

    def follow(s):
        return sessions.follow(s, "user", "id")

    got = streamed(spark, tmp_path, spark.createDataFrame(known(data), REQUEST), follow, 5)
    assert sorted((x.user, x.family, x.id, x.outcome, x.current) for _, x in got) == sorted(brute_sessions(data))
    assert len({i for i, _ in got}) == 5


def test_families_forget_what_has_expired():
    f = sessions.Family(sessions.Policy(10, 3), [0])
    for s in range(1, 100):
        f.forget(s * sessions.MICROS)
        assert f.present(s - 1, s * sessions.MICROS) == "rotate" and f.current == s and len(f.issued) <= 12
    assert f.present(5, 99 * sessions.MICROS) == "expired"
    assert f.present(97, 105 * sessions.MICROS) == "reuse" and f.present(99, 105 * sessions.MICROS) == "revoked"


@pytest.mark.parametrize("most", [10**6, 25])
def test_counters(spark, most):
    data = [(k, ts, i, None if v is None else abs(v) + i % 11) for k, ts, i, v, _ in rows(9)]
    df = spark.createDataFrame(data, "k int, ts timestamp, i long, v long")
    want, there = {}, set()
    for k, log_ in by_key(data).items():
        p = None
        for _, ts, _, v in log_:
            there.add((k, ts.replace(second=0)))
            if v is None:
                continue
            n, s = want.get((k, ts.replace(second=0)), (0, 0))
            want[k, ts.replace(second=0)] = (n + 1, s + (0 if p is None else v if v < p else v - p))
            p = v
    got = metrics.increase(df, ["k"], ["ts", "i"], F.col("v"), "1 minute", most).collect()
    assert {(x.k, x.step_start): (x.n, x.increase) for x in got} == want
    assert all(abs(x.rate - x.increase / 60) < 1e-9 for x in got)
    some = df.where("k is null or i % 7 = 0")
    there = {(x.k, x.ts.replace(second=0)) for x in some.collect()}
    steps = {s for _, s in there}
    spine = {(k, min(steps) + dt.timedelta(minutes=j)) for k in {k for k, _ in there} for j in range(int((max(steps) - min(steps)).total_seconds() // 60) + 1)}
    assert {(x.k, x.step_start) for x in metrics.absent(some, ["k"], "ts", "1 minute").collect()} == spine - there
    assert metrics.absent(df.limit(0), ["k"], "ts", "1 minute").count() == 0
    assert [x[0] for x in spark.createDataFrame([(None,), (0.5,), (7.0,)], "x double").select(metrics.clamp_min(F.col("x"), 1.0)).collect()] == [None, 1.0, 7.0]
