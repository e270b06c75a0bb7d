"""Queries of accounts and counters: budgets with their stamp, lockouts, session families, growth and absence of counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import budgets, lockout, metrics
from ..operators.ordered import log, scan
from ..streaming import sessions
from .adapters import read
from .catalog import query

ORDER = ["ts", "event_id"]
LIMIT = 300_000


@query("budget_stamps", f"""
with c as (
  select user_id, ts, event_id, sum(greatest(cast(round(value * 1000) as bigint), 0)) over (partition by user_id order by ts, event_id) as spent
  from events)
select user_id, count(*) as calls, max(spent)::bigint as spent, min(case when spent >= {LIMIT} then ts end) as exceeded_at
from c group by user_id""")
def budget_stamps(spark, sf):
    """Every user's budget after all calls, and when it was first used up."""
    cost = F.round(F.col("value") * 1000).cast("bigint")
    return budgets.budgets(read(spark, sf, "events"), "user_id", ORDER, cost, F.lit(LIMIT))


@query("account_lockouts", """
with g as (
  select *, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id) as grp from events),
k as (
  select *, sum((event_type = 'error')::int) over (partition by user_id, grp order by ts, event_id) as k from g)
select user_id, count(*) as n, max(k)::bigint as longest, arg_max(k, (ts, event_id))::bigint as open_run, max(k) >= 4 as locked,
  min(case when k = 4 then ts end) as locked_at
from k group by user_id""")
def account_lockouts(spark, sf):
    """Runs of errors of every user; the fourth in a row locks the account."""
    return lockout.attempts(read(spark, sf, "events"), "user_id", ORDER, F.col("event_type") == "error", 4)


def requests(events: DataFrame) -> DataFrame:
    """Events as uses of refresh tokens, in a time fifty times faster: a signup signs in, all else presents the generation that is
    due, but an error the one before, and a few events an old one or one that was never issued."""
    k = F.col("event_id")
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 50))
    client = F.when(F.col("user_id") % 3 == 0, "ios").when(F.col("user_id") % 3 == 1, "android").otherwise("web")
    rows = events.select("user_id", "event_id", at.alias("ts"), client.alias("client"), (F.col("event_type") == "signup").alias("sign_in"), "event_type")
    rows = sessions.numbered(rows, "user_id", ORDER, F.col("sign_in"))
    rows = scan(log(rows, ["user_id", "family"], ORDER), place=("sum", F.lit(1).cast("bigint"))).done()
    due = F.col("place") - 1
    odd = F.when(k % 97 == 0, due - 3).when(k % 89 == 0, due + 5).when(F.col("event_type") == "error", due - 1).otherwise(due)
    return rows.withColumn("generation", F.when(~F.col("sign_in"), odd)).drop("place", "event_type")


_REQUESTS = """
e as (
  select user_id, event_id, make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 50) as ts,
    case user_id % 3 when 0 then 'ios' when 1 then 'android' else 'web' end as client, event_type = 'signup' as sign_in, event_type
  from events),
f as (
  select *, sum(sign_in::int) over (partition by user_id order by ts, event_id)::bigint as family from e),
p as (
  select *, row_number() over (partition by user_id, family order by ts, event_id) - 1 as due from f),
q as (
  select *, epoch_us(ts) as us, case when client = 'web' then 43200000000 else 2592000000000 end as life,
    case when client = 'web' then 30000000 else 60000000 end as grace,
    case when sign_in then null when event_id % 97 = 0 then due - 3 when event_id % 89 = 0 then due + 5
      when event_type = 'error' then due - 1 else due end as g
  from p)"""
# issued holds the times of all generations, from 0; a list of none is no family
_OUTCOME = """
      case when q.sign_in then 'issued' when len(r.issued) = 0 then 'unknown' when r.revoked then 'revoked'
        when q.g < 0 then 'none' when q.g < len(r.issued) and q.us >= r.issued[q.g + 1] + q.life then 'expired'
        when q.g = len(r.issued) - 1 then 'rotate'
        when q.g = len(r.issued) - 2 and q.us < r.issued[q.g + 2] + q.grace then 'replay' else 'reuse' end"""


@query("session_outcomes", f"""
with recursive {_REQUESTS},
r as (
  select user_id, family, 0::bigint as due, ts, event_id, case when sign_in then 'issued' else 'unknown' end as outcome,
    case when sign_in then [us] else []::bigint[] end as issued, false as revoked
  from q where due = 0
  union all
  select user_id, family, due, ts, event_id, outcome,
    case when outcome in ('rotate', 'replay') then list_append(issued, us) else issued end,
    revoked or outcome = 'reuse'
  from (
    select q.user_id, q.family, q.due, q.ts, q.event_id, q.us, r.issued, r.revoked, replace({_OUTCOME}, 'none', 'expired') as outcome
    from r join q on q.user_id = r.user_id and q.family = r.family and q.due = r.due + 1))
select user_id, family, ts, event_id, outcome, case when len(issued) > 0 then len(issued) - 1 end as current from r""")
def session_outcomes(spark, sf):
    """Every use of a refresh token over all events, by families."""
    out = sessions.refreshed(requests(read(spark, sf, "events")), "user_id", "event_id")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_COUNTER = "cast(round(value * 100) as bigint)"


@query("counter_increase", f"""
with d as (
  select event_type, ts, {_COUNTER} as v, lag({_COUNTER}) over (partition by event_type order by ts, event_id) as p from events)
select event_type, date_trunc('hour', ts)::timestamp as step_start, count(*) as n,
  coalesce(sum(case when v < p then v else v - p end), 0)::bigint as increase,
  round(coalesce(sum(case when v < p then v else v - p end), 0) / 3600::double, 9) as rate
from d group by 1, 2""")
def counter_increase(spark, sf):
    """The value of each type of event as a counter that often begins again: its growth by the hour."""
    out = metrics.increase(read(spark, sf, "events"), ["event_type"], ORDER, F.round(F.col("value") * 100).cast("bigint"), "1 hour")
    return out.withColumn("step_start", F.col("step_start").cast("timestamp_ntz")).withColumn("rate", F.round("rate", 9))


@query("counter_absent", """
with t as (select distinct user_id, date_trunc('day', ts)::timestamp as day from events),
s as (select u.user_id, x.day from (select distinct user_id from t) u, (select unnest(generate_series(min(day), max(day), interval 1 day)) as day from t) x)
select s.user_id, s.day::timestamp as step_start from s left join t on t.user_id = s.user_id and t.day = s.day where t.day is null""")
def counter_absent(spark, sf):
    """Days on which a user has no event."""
    out = metrics.absent(read(spark, sf, "events"), ["user_id"], "ts", "1 day")
    return out.withColumn("step_start", F.col("step_start").cast("timestamp_ntz"))


@query("alert_share", f"""
with d as (
  select event_type, ts, {_COUNTER} as v, lag({_COUNTER}) over (partition by event_type order by ts, event_id) as p from events),
i as (
  select date_trunc('hour', ts)::timestamp as step_start, coalesce(sum(case when v < p then v else v - p end) filter (where event_type = 'error'), 0) as bad,
    coalesce(sum(case when v < p then v else v - p end), 0) as total
  from d group by 1)
select step_start, round(bad / greatest(total, 100000.0::double), 9) as share, bad / greatest(total, 100000.0::double) > 0.2 as firing from i""")
def alert_share(spark, sf):
    """Growth of the error counter over that of all, which is taken to be at least 1000.00, as an alert would have it."""
    grown = metrics.increase(read(spark, sf, "events"), ["event_type"], ORDER, F.round(F.col("value") * 100).cast("bigint"), "1 hour")
    sums = grown.groupBy("step_start").agg(F.coalesce(F.sum(F.when(F.col("event_type") == "error", F.col("increase"))), F.lit(0)).alias("bad"), F.sum("increase").alias("total"))
    share = F.col("bad") / metrics.clamp_min(F.col("total").cast("double"), 100_000.0)
    return sums.select(F.col("step_start").cast("timestamp_ntz").alias("step_start"), F.round(share, 9).alias("share"), (share > 0.2).alias("firing"))
