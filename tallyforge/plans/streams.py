"""Queries of jobs, rates and metrics over the event log, as batches; tests run the same functions as streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import lockout, metrics
from ..streaming import jobs
from .adapters import EVENT_OF, job_events, read
from .catalog import query


@query("rate_limit_tumbling", "select event_id, user_id, place, place <= 3 as allowed, greatest(3 - place, 0)::int as remaining from (select *, row_number() over (partition by user_id, date_trunc('hour', ts) order by ts, event_id)::int as place from events)")
def rate_limit_tumbling(spark, sf):
    return jobs.rate_limited(read(spark, sf, "events"), "user_id", "ts", 3).select("event_id", "user_id", "place", "allowed", "remaining")


@query("window_counts", "select date_trunc('hour', ts)::timestamp as window_start, user_id, count(*) as n from events group by 1, 2")
def window_counts(spark, sf):
    return jobs.window_counts(read(spark, sf, "events"), "user_id", "ts").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", "n")


@query("metrics_sliding", "select w as window_start, event_type, count(*) as n, round(count(*) / 300.0::double, 9) as rate from (select event_type, ts, date_trunc('minute', ts) - to_minutes(k) as w from events, range(5) t(k)) group by 1, 2")
def metrics_sliding(spark, sf):
    out = jobs.sliding_rates(read(spark, sf, "events"), "ts", "event_type")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("rate", 9).alias("rate"))


_LE = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0)


@query("metric_histogram", "select event_type, le::double as le, count(*) filter (where value <= le) as cumulative, count(*) as total, cast(round(sum(round(value * 100))) as bigint) as sum_cents from events cross join (values " + ", ".join(f"({x})" for x in _LE) + ") b(le) group by event_type, le")
def metric_histogram(spark, sf):
    """Cumulative buckets: all bounds in one aggregate, then one row per bound."""
    aggs = [F.count_if(F.col("value") <= x).alias(f"b{i}") for i, x in enumerate(_LE)]
    wide = read(spark, sf, "events").groupBy("event_type").agg(*aggs, F.count("*").alias("total"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("sum_cents"))
    rows = F.array(*[F.struct(F.lit(x).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, x in enumerate(_LE)])
    return wide.select("event_type", F.inline(rows), "total", "sum_cents")


@query("gauge_last", "select event_type, arg_max(value, (ts, event_id)) as value from events group by event_type")
def gauge_last(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("queue_depth", "select event_type, count(*) as depth, ((epoch_us(timestamp '2024-02-01') - epoch_us(min(ts))) // 1000000)::bigint as oldest_s from events group by event_type")
def queue_depth(spark, sf):
    oldest = F.expr("timestampdiff(SECOND, min(ts), timestamp_ntz '2024-02-01')").alias("oldest_s")
    return read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("depth"), oldest)


@query("alert_ratio", "select date_trunc('day', ts)::timestamp as day, round(count(*) filter (where event_type = 'error') / greatest(count(*), 1)::double, 9) as error_ratio, count(*) filter (where event_type = 'error') > 0.2 * count(*) as firing from events group by 1")
def alert_ratio(spark, sf):
    errors = F.count_if(F.col("event_type") == "error")
    out = read(spark, sf, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    return out.agg(F.round(errors / F.greatest(F.count("*"), F.lit(1)), 9).alias("error_ratio"), (errors > 0.2 * F.count("*")).alias("firing"))


_T = " ".join(f"when r.state = '{a}' and e.event = '{e}' then '{b}'" for a, e, b in jobs.TRANSITIONS)
_L = " or ".join(f"(r.state = '{a}' and e.event = '{e}')" for a, e, b in jobs.TRANSITIONS)
_EV = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in EVENT_OF.items()) + " end"


@query("job_state_fold", f"with recursive e as (select user_id as job_id, {_EV} as event, row_number() over (partition by user_id order by ts, event_id) as i from events), r as (select job_id, 0::bigint as i, 'queued' as state, 0 as n_legal from e where i = 1 union all select e.job_id, e.i, case {_T} else r.state end, r.n_legal + case when {_L} then 1 else 0 end from r join e on e.job_id = r.job_id and e.i = r.i + 1) select job_id, state, n_legal, i::int as n_events from (select *, row_number() over (partition by job_id order by i desc) as k from r) where k = 1")
def job_state_fold(spark, sf):
    return jobs.fold(job_events(spark, sf), "job_id", ["ts", "event_id"])


@query("backoff_delay", "select event_id, (nominal - (nominal // 2) // 2 + (((event_id % 256) * (nominal // 2)) // 256) // 2)::bigint as wait_ms from (select event_id, least(30000 * pow(2, user_id % 7)::bigint, 900000)::bigint as nominal from events)")
def backoff_delay(spark, sf):
    byte = F.lpad(F.lower(F.hex(F.col("event_id") % 256)), 2, "0")
    return read(spark, sf, "events").select("event_id", jobs.backoff_ms(F.col("user_id") % 7 + 1, 30, 900, byte).alias("wait_ms"))


@query("lease_expiry", "select user_id as job_id, event_id, nxt is null or nxt > ts + interval 20 minutes as expired from (select *, lead(ts) over (partition by user_id order by ts, event_id) as nxt from events) where event_type = 'signup'")
def lease_expiry(spark, sf):
    """Claims with no later event of the job within the lease."""
    after = F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = read(spark, sf, "events").withColumn("nxt", after).where("event_type = 'signup'")
    return rows.select(F.col("user_id").alias("job_id"), "event_id", F.expr("nxt is null or nxt > ts + interval 20 minutes").alias("expired"))


@query("session_refresh", "select event_id, case when event_type = 'error' then 'revoked' when prev is null then 'rotate' when ts <= prev + interval 30 minutes then 'replay' when ts > prev + interval 10 days then 'expired' else 'rotate' end as decision from (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events)")
def session_refresh(spark, sf):
    rows = read(spark, sf, "events").withColumn("prev", F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    d = F.when(F.col("event_type") == "error", "revoked").when(F.col("prev").isNull(), "rotate").when(F.expr("ts <= prev + interval 30 minutes"), "replay").when(F.expr("ts > prev + interval 10 days"), "expired").otherwise("rotate")
    return rows.select("event_id", d.alias("decision"))


@query("failed_attempts", "select user_id, max(run)::int as longest, max(run) >= 4 as locked from (select user_id, count(*) filter (where event_type = 'error') as run from (select *, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as grp from events) group by user_id, grp) group by user_id")
def failed_attempts(spark, sf):
    """Longest run of failures per user; a success resets the count."""
    found = lockout.attempts(read(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 4)
    return found.select("user_id", F.col("longest").cast("int").alias("longest"), "locked")


@query("failure_streak", "select user_id, (count(*) filter (where event_id > coalesce(last_ok, -1)))::int as streak from (select *, max(case when event_type <> 'error' then event_id end) over (partition by user_id) as last_ok from events) group by user_id")
def failure_streak(spark, sf):
    """Events since the last success, by one grouped maximum joined back."""
    e = read(spark, sf, "events")
    ok = e.where("event_type <> 'error'").groupBy("user_id").agg(F.max("event_id").alias("last_ok"))
    return e.join(ok, "user_id", "left").groupBy("user_id").agg(F.count_if(F.col("event_id") > F.coalesce("last_ok", F.lit(-1))).cast("int").alias("streak"))


@query("retention_cutoff", "select event_type, count(*) as n_gone from events where ts < timestamp '2024-01-31' - interval 14 days group by event_type")
def retention_cutoff(spark, sf):
    return read(spark, sf, "events").where("ts < timestamp_ntz '2024-01-31' - interval 14 days").groupBy("event_type").agg(F.count("*").alias("n_gone"))


@query("delivery_backoff", "select event_id, ts + to_seconds(30 * pow(2, least(user_id % 10, 6))::bigint) as next_at from events")
def delivery_backoff(spark, sf):
    seconds = F.lit(30) * F.pow(F.lit(2), F.least(F.col("user_id") % 10, F.lit(6)))
    return read(spark, sf, "events").select("event_id", (F.col("ts") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).alias("next_at"))


_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0)


@query("histogram_quantile", "with c as (select event_type, le, n, lag(n, 1, 0) over w as below, lag(le, 1, 0.0) over w as lo, max(n) over (partition by event_type) * 0.95::double as rank from (select event_type, le::double as le, count(*) filter (where value <= le) as n from events cross join (values " + ", ".join(f"({x})" for x in _BOUNDS) + ", (1e300)) b(le) group by event_type, le) window w as (partition by event_type order by le)) select event_type, round(case when le > 1e299 then lo else lo + (le - lo) * (rank - below) / (n - below) end, 6) as p95 from c where n >= rank and below < rank")
def histogram_quantile(spark, sf):
    counts = metrics.buckets(read(spark, sf, "events"), "event_type", "value", _BOUNDS)
    return metrics.quantile(counts, "event_type", 0.95).select("event_type", F.round("value", 6).alias("p95"))


@query("metric_exposition", "select 'events_total{kind=\"' || event_type || '\",user=\"' || user_id || '\"} ' || count(*) as line from events group by event_type, user_id")
def metric_exposition(spark, sf):
    n = read(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return metrics.exposition(n, F.lit("events_total"), {"kind": F.col("event_type"), "user": F.col("user_id").cast("string")}, F.col("n").cast("double"))
