"""Jobs as a state machine over an event log: in batch by an ordered fold, in a stream by keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Legal transitions (state, event, next state); every other pair leaves the state as it is.
TRANSITIONS = [
    ("queued", "claim", "running"), ("queued", "cancel", "cancelled"), ("running", "succeed", "succeeded"), ("running", "fail_transient", "retrying"),
    ("running", "fail_permanent", "failed"), ("running", "exhaust", "dead"), ("running", "expire", "retrying"), ("running", "cancel", "cancelled"),
    ("retrying", "release", "queued"), ("retrying", "cancel", "cancelled"), ("retrying", "exhaust", "dead"), ("queued", "expire", "queued"), ("failed", "release", "queued"),
]
# Most attempts, base and longest wait (seconds), lease (minutes) by kind of job.
POLICIES = {"analysis": (3, 30, 900, 20), "extraction": (5, 5, 300, 5), "simulation": (2, 15, 300, 15), "retention": (2, 60, 3600, 30)}
# A piece of a log has 2 ** PIECE_BITS rows at most, whatever the partitions' sizes.
PIECE_BITS = 13
QUOTAS = {"analysis": (20, "1 hour"), "upload": (100, "1 hour"), "read": (600, "1 minute"), "simulation": (120, "1 hour")}


def next_state(state: Column, event: Column) -> Column:
    out = F
    for a, e, b in TRANSITIONS:
        out = out.when((state == a) & (event == e), b)
    return out.otherwise(state)


def fold(events: DataFrame, key: str, order: list[str], start: str = "queued") -> DataFrame:
    """Final state of each key's events in order, with how many were legal.

    A range sort deals out logs, which are cut into pieces of at most 2 ** PIECE_BITS rows. Each piece becomes a map from the
    state before it to the state after it and the legal events on the way; a key's maps, a few hundred bytes each, are then
    applied in order. So no log meets whole.
    """
    states = sorted({start} | {a for a, _, _ in TRANSITIONS} | {b for _, _, b in TRANSITIONS})
    kinds = sorted({e for _, e, _ in TRANSITIONS})
    to = {(a, e): b for a, e, b in TRANSITIONS}
    ints = lambda values: F.array(*map(F.lit, values))
    after = F.array(*[ints([states.index(to.get((a, e), a)) for a in states]) for e in kinds])
    lawful = F.array(*[ints([int((a, e) in to) for a in states]) for e in kinds])
    code = F.array_position(F.array(*map(F.lit, kinds)), F.col("event")).cast("int") - 1
    # an event of no transition changes nothing
    # numbers in a partition's order begin at a multiple of 2 ** 33, so no piece goes over a partition's end
    whole = [key, *order, "event"]
    dealt = events.select(*dict.fromkeys(whole)).repartitionByRange(*whole).sortWithinPartitions(*whole)
    pieces = dealt.withColumn("part", F.shiftright(F.monotonically_increasing_id(), PIECE_BITS))
    pieces = pieces.groupBy(key, "part").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct(*order, "event", code.alias("code")))), lambda x: x["code"]).alias("log"))

    def step(m: Column, e: Column) -> Column:
        moved = F.struct(
            F.transform(m["to"], lambda s: F.get(F.get(after, e), s)).alias("to"),
            F.zip_with(m["legal"], m["to"], lambda n, s: n + F.get(F.get(lawful, e), s)).alias("legal"),
        )
        return F.when(e >= 0, moved).otherwise(m)

    none = F.struct(ints(range(len(states))).alias("to"), ints([0] * len(states)).alias("legal"))
    maps = pieces.select(key, "part", "n", F.aggregate("log", none, step).alias("m"))
    maps = maps.groupBy(key).agg(F.sum("n").cast("int").alias("n_events"), F.array_sort(F.collect_list(F.struct("part", "m"))).alias("maps"))
    first = F.struct(F.lit(states.index(start)).alias("s"), F.lit(0).alias("legal"))
    done = F.aggregate("maps", first, lambda d, p: F.struct(F.get(p["m"]["to"], d["s"]).alias("s"), (d["legal"] + F.get(p["m"]["legal"], d["s"])).alias("legal")))
    return maps.withColumn("d", done).select(key, F.get(F.array(*map(F.lit, states)), F.col("d.s")).alias("state"), F.col("d.legal").alias("n_legal"), "n_events")


def backoff_ms(attempt: Column, base_s: int, most_s: int, uuid: Column) -> Column:
    """Wait before an attempt: base doubled each time up to most, less a quarter, plus up to a half by the id's last byte."""
    nominal = F.least(F.lit(base_s * 1000).cast("bigint") * F.pow(F.lit(2), F.least(attempt - 1, F.lit(30))).cast("bigint"), F.lit(most_s * 1000).cast("bigint"))
    half = F.call_function("div", nominal, F.lit(2).cast("bigint"))
    byte = F.conv(F.right(uuid, F.lit(2)), 16, 10).cast("bigint")
    return nominal - F.call_function("div", half, F.lit(2).cast("bigint")) + F.call_function("div", F.call_function("div", byte * half, F.lit(256).cast("bigint")), F.lit(2).cast("bigint"))


def rate_limited(events: DataFrame, key: str, ts: str, quota: int, width: str = "1 hour") -> DataFrame:
    """Each event with its place in its key's tumbling window and whether the quota allows it. Works on batches."""
    window = F.window(F.col(ts).cast("timestamp"), width)["start"]
    order = W.partitionBy(key, "window_start").orderBy(ts, "event_id")
    out = events.withColumn("window_start", window).withColumn("place", F.row_number().over(order))
    return out.withColumn("allowed", F.col("place") <= quota).withColumn("remaining", F.greatest(F.lit(quota) - F.col("place"), F.lit(0)))


def window_counts(events: DataFrame, key: str, ts: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per key and tumbling window; on a stream, windows older than ``late`` are dropped from state."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def sliding_rates(events: DataFrame, ts: str, kind: str, width: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """Events per second by kind in sliding windows."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", "10 minutes")
    w = timed.groupBy(F.window("at", width, step), kind).agg(F.count("*").alias("n"))
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    return w.select(F.col("window.start").alias("window_start"), kind, "n", (F.col("n") / seconds).alias("rate"))


def first_per_key(events: DataFrame, keys: list[str], ts: str, late: str = "2 hours") -> DataFrame:
    """Idempotent enqueue on a stream: the first event of each key within the watermark."""
    return events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


_STEP = {(a, e): b for a, e, b in TRANSITIONS}
JOB_STATE = "state string, attempt int, lease_until double, legal int, n int"
JOB_OUT = "job_id long, state string, attempt int, n_legal int, n_events int, lease_expired boolean"


def _advance(lease_s: int, attempts: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("queued", 0, 0.0, 0, 0)
        name, attempt, until, legal, n = now
        expired = False
        if state.hasTimedOut and name == "running":
            # the lease ran out: again later, or given up
            name, expired = ("dead" if attempt >= attempts else "retrying"), True
        for part in parts:
            for row in part.sort_values(["ts", "event_id"]).itertuples():
                n += 1
                to = _STEP.get((name, row.event))
                if to is None:
                    continue
                legal += 1
                if row.event == "claim":
                    attempt += 1
                    until = row.ts.timestamp() + lease_s
                name = to
        state.update((name, attempt, until, legal, n))
        if name == "running" and until * 1000 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(int(until * 1000))
        yield pd.DataFrame({"job_id": [key[0]], "state": [name], "attempt": [attempt], "n_legal": [legal], "n_events": [n], "lease_expired": [expired]})

    return run


def track(events: DataFrame, kind: str = "analysis", late: str = "1 hour") -> DataFrame:
    """A stream of job events (job_id, ts, event_id, event) to the state of each job after every batch; a claim's lease runs
    out in event time and sends the job to retrying, or to dead after its last attempt."""
    attempts, _, _, lease = POLICIES[kind]
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("job_id").applyInPandasWithState(_advance(lease * 60, attempts), JOB_OUT, JOB_STATE, "update", GroupStateTimeout.EventTimeTimeout)
