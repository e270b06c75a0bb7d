"""Queries of jobs, notifications and source checks, over all orders or events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import queue as qu
from ..streaming.jobs import POLICIES
from .adapters import read
from .catalog import query

_NOW = "timestamp '1996-01-01 00:00:00'"
_KINDS = ("analysis", "extraction", "simulation", "retention")
_JOBS = (
    "select o_orderkey as job_id, case o_orderkey % 4 when 0 then 'analysis' when 1 then 'extraction' when 2 then 'simulation' else 'retention' end as kind, "
    "case o_orderstatus when 'O' then 'queued' when 'P' then 'running' else 'retrying' end as state, (o_custkey % 4)::int as attempt, 3 as max_attempts, o_orderdate::timestamp as run_after, "
    "case when o_orderstatus = 'P' then o_orderdate::timestamp + interval 1 day end as leased_until, case when o_orderstatus = 'P' then 'w' || (o_custkey % 3) end as leased_by from orders"
)


def jobs(spark, sf):
    """One job per order."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    kind = F.when(k % 4 == 0, _KINDS[0]).when(k % 4 == 1, _KINDS[1]).when(k % 4 == 2, _KINDS[2]).otherwise(_KINDS[3])
    at = F.col("o_orderdate").cast("timestamp")
    return read(spark, sf, "orders").select(
        k.alias("job_id"), kind.alias("kind"), F.when(s == "O", "queued").when(s == "P", "running").otherwise("retrying").alias("state"), (F.col("o_custkey") % 4).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"),
        at.alias("run_after"), F.when(s == "P", at + F.expr("interval 1 day")).alias("leased_until"), F.when(s == "P", F.concat(F.lit("w"), (F.col("o_custkey") % 3).cast("string"))).alias("leased_by"),
    )


def _now():
    return F.expr(_NOW)


def _shown(df):
    """Times as text, so that no time zone comes in."""
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


_T = lambda x: f"strftime({x}, '%Y-%m-%d %H:%M:%S')"
_LEASE = " ".join(f"when '{k}' then {POLICIES[k][3]}" for k in _KINDS)


@query("jobs_claim", f"with j as ({_JOBS}), d as (select *, row_number() over (partition by kind order by run_after, job_id) as place from j where state = 'queued' and run_after <= {_NOW}), t as (select job_id, 'idle-' || (place - 1) as worker from d where place <= 25) select job_id, kind, case when worker is null then state else 'running' end as state, (attempt + (worker is not null)::int)::int as attempt, {_T('run_after')} as run_after, {_T(f'case when worker is null then leased_until else {_NOW} + to_minutes(case kind {_LEASE} end) end')} as leased_until, coalesce(worker, leased_by) as leased_by from j left join t using (job_id)")
def jobs_claim(spark, sf):
    """25 idle workers of each kind take the oldest jobs that are due."""
    hands = spark.range(25).crossJoin(spark.createDataFrame([(k,) for k in _KINDS], "kind string")).select("kind", F.concat(F.lit("idle-"), F.col("id").cast("string")).alias("worker"), "id")
    # place by number: idle-10 comes after idle-9
    hands = hands.select("kind", F.struct("id", "worker").alias("worker"))
    return _shown(qu.claim(jobs(spark, sf), _now(), hands.select("kind", F.format_string("%03d%s", "worker.id", "worker.worker").alias("worker")), {k: POLICIES[k][3] for k in _KINDS}).drop("max_attempts").withColumn("leased_by", F.regexp_replace("leased_by", "^[0-9]{3}", "")))


@query("jobs_heartbeat", f"with j as ({_JOBS}) select job_id, {_T(f'case when state = {chr(39)}running{chr(39)} and job_id % 5 = 0 and leased_by = {chr(39)}w1{chr(39)} then {_NOW} + interval 20 minute else leased_until end')} as leased_until from j")
def jobs_heartbeat(spark, sf):
    """Worker w1 beats for every fifth job; only leases that it holds are extended."""
    all_ = jobs(spark, sf)
    beats = all_.where("job_id % 5 = 0").select("job_id", F.lit("w1").alias("worker"))
    return _shown(qu.heartbeat(all_, beats, _now(), 1200).select("job_id", "leased_until"))


@query("jobs_release", f"with j as ({_JOBS}) select job_id, case when state = 'retrying' and run_after <= {_NOW} then 'queued' else state end as state from j")
def jobs_release(spark, sf):
    return qu.release(jobs(spark, sf), _now()).select("job_id", "state")


_REAPED = f"with j as ({_JOBS}), r as (select *, state = 'running' and leased_until < {_NOW} as gone, attempt >= max_attempts as spent from j)"


@query("jobs_reap", f"{_REAPED} select job_id, case when gone and spent then 'dead' when gone then 'retrying' else state end as state, {_T(f'case when gone then {_NOW} + interval 30 second else run_after end')} as run_after, case when not gone then leased_by end as leased_by from r".replace("case when not gone", "case when not coalesce(gone, false)"))
def jobs_reap(spark, sf):
    return _shown(qu.reap(jobs(spark, sf), _now())[0].select("job_id", "state", "run_after", "leased_by"))


@query("jobs_transitions", f"{_REAPED} select job_id, state as from_state, case when spent then 'dead' else 'retrying' end as to_state, case when spent then 'attempts_exhausted' else 'lease_expired' end as event, attempt, 'lease_expired' as error from r where gone")
def jobs_transitions(spark, sf):
    return qu.reap(jobs(spark, sf), _now())[1]


@query("jobs_dead_letters", f"{_REAPED} select job_id, kind, attempt as attempts, 'lease_expired' as last_error from r where gone and spent")
def jobs_dead_letters(spark, sf):
    return qu.reap(jobs(spark, sf), _now())[2]


@query("jobs_finish", f"with j as ({_JOBS}), r as (select *, job_id % 3 = 0 as ok, job_id % 3 = 1 as permanent from j) select job_id, case when state <> 'running' or job_id % 2 = 0 then state when ok then 'succeeded' when permanent then 'failed' when attempt >= max_attempts then 'dead' else 'retrying' end as state from r")
def jobs_finish(spark, sf):
    """Results of every second job."""
    all_ = jobs(spark, sf)
    results = all_.where("job_id % 2 = 1").select("job_id", (F.col("job_id") % 3 == 0).alias("ok"), (F.col("job_id") % 3 == 1).alias("permanent"), F.lit("boom").alias("error"))
    return qu.finish(all_, results, _now())[0].select("job_id", "state")


_NOTES = (
    "select event_id as note_id, user_id % 20 as company_id, case when event_id % 3 <> 0 then user_id end as user_id, case event_type when 'error' then 'suppressed' when 'view' then 'delivered' else 'pending' end as state, (event_id % 4)::int as attempt, 3 as max_attempts, "
    "case event_id % 3 when 0 then ['in_app'] when 1 then ['email', 'in_app'] else ['email'] end as channels, case when event_id % 2 = 0 then ['email'] else [] end as delivered, ts::timestamp as created_at, ts::timestamp as run_after from events"
)


def notes(spark, sf):
    """One notification per event."""
    k, e = F.col("event_id"), F.col("event_type")
    channels = F.when(k % 3 == 0, F.array(F.lit("in_app"))).when(k % 3 == 1, F.array(F.lit("email"), F.lit("in_app"))).otherwise(F.array(F.lit("email")))
    ts = F.col("ts").cast("timestamp")
    return read(spark, sf, "events").select(
        k.alias("note_id"), (F.col("user_id") % 20).alias("company_id"), F.when(k % 3 != 0, F.col("user_id")).alias("user_id"), F.when(e == "error", "suppressed").when(e == "view", "delivered").otherwise("pending").alias("state"),
        (k % 4).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"), channels.alias("channels"), F.when(k % 2 == 0, F.array(F.lit("email"))).otherwise(F.array().cast("array<string>")).alias("delivered"), ts.alias("created_at"), ts.alias("run_after"),
    )


_LATER = "timestamp '2024-01-10 00:00:00'"


@query("notes_claim", f"with n as ({_NOTES}), t as (select note_id from n where state = 'pending' and run_after <= {_LATER} order by run_after, note_id limit 100) select note_id, case when t.note_id is null then state else 'delivering' end as state, (attempt + (t.note_id is not null)::int)::int as attempt from n left join t using (note_id)".replace("t.note_id is", "t.note_id is"))
def notes_claim(spark, sf):
    return qu.claim_notifications(notes(spark, sf), F.expr(_LATER)).select("note_id", "state", "attempt")


@query("notes_delivery", f"with n as ({_NOTES}), o as (select *, note_id % 5 = 0 as seen, note_id % 2 = 1 as bad from n) select note_id, case when not seen then state when not bad then 'delivered' when attempt >= max_attempts then 'failed' else 'pending' end as state, array_to_string(list_sort(case when seen then list_distinct(list_filter(list_concat(delivered, ['in_app']), lambda c: contains(channels, c))) else delivered end), ',') as delivered, {_T(f'case when seen and bad then {_LATER} + to_seconds(30 * pow(2, least(attempt, 6))) else run_after end')} as run_after from o")
def notes_delivery(spark, sf):
    """Every fifth was tried: in-app went out, the other channel failed for odd ones."""
    all_ = notes(spark, sf)
    outcomes = all_.where("note_id % 5 = 0").select("note_id", F.array(F.lit("in_app")).alias("went"), F.when(F.col("note_id") % 2 == 1, "timeout").alias("error"))
    out = qu.record_delivery(all_, outcomes, F.expr(_LATER)).select("note_id", "state", F.array_join(F.array_sort("delivered"), ",").alias("delivered"), "run_after")
    return _shown(out)


@query("notes_inbox", f"with n as ({_NOTES}) select note_id, user_id, {_T('created_at')} as created_at from n where company_id = 7 and (user_id = 27 or user_id is null) and contains(channels, 'in_app') and state <> 'suppressed' order by n.created_at desc, note_id desc limit 50")
def notes_inbox(spark, sf):
    """The feature's page: the 50 newest."""
    return _shown(qu.inbox(notes(spark, sf), 7, 27, 50).select("note_id", "user_id", "created_at"))


_CHECKS = "select user_id % 40 as source_id, ts::timestamp as seen_at, case event_type when 'signup' then 'verified' when 'error' then 'mismatch' else 'unreachable' end as state from events"


@query("source_records", f"with c as ({_CHECKS}), a as (select source_id, max(seen_at) filter (where state <> 'unreachable') as answered, arg_max(state, seen_at) filter (where state <> 'unreachable') as state, max(seen_at) as checked_at from c group by source_id) select a.source_id, coalesce(a.state, 'unreachable') as state, {_T('checked_at')} as checked_at, count(*) filter (where c.state = 'unreachable' and (answered is null or seen_at > answered)) as failure_streak from a join c using (source_id) group by all")
def source_records(spark, sf):
    e = F.col("event_type")
    checks = read(spark, sf, "events").select((F.col("user_id") % 40).alias("source_id"), F.col("ts").cast("timestamp").alias("at"), F.when(e == "signup", "verified").when(e == "error", "mismatch").otherwise("unreachable").alias("state"))
    return _shown(qu.source_records(checks))


@query("sources_due", "select s_suppkey from (select s_suppkey, case when s_suppkey % 7 > 0 then timestamp '2024-01-09 00:00:00' + to_hours((s_suppkey % 30)::int) end as seen_at from supplier) where seen_at is null or seen_at + interval 6 hour <= timestamp '2024-01-10 00:00:00'")
def sources_due(spark, sf):
    at = F.when(F.col("s_suppkey") % 7 > 0, F.expr("timestamp '2024-01-09 00:00:00'") + F.make_dt_interval(hours=(F.col("s_suppkey") % 30).cast("int")))
    return qu.sweep_due(read(spark, sf, "supplier").select("s_suppkey", at.alias("last_checked_at")), F.expr(_LATER)).select("s_suppkey")


@query("state_guarded", "select o_orderkey, 'settled' as state from orders where o_orderstatus in ('O', 'P') and o_totalprice > 100000")
def state_guarded(spark, sf):
    """Payments settle only from open or pending: the rows that changed."""
    rows = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"), "o_totalprice")
    return qu.guarded(rows, ("O", "P"), F.when(F.col("o_totalprice") > 100_000, "settled"))[1].select("o_orderkey", "state")
