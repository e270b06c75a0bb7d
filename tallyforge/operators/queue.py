"""A job table, notifications and source checks as rewrites of whole tables: each step returns the table after it.

Jobs have job_id, kind, state, attempt, max_attempts, run_after, leased_until, leased_by; times are timestamps, ``now`` a
literal or column. Steps touch only the rows they name, and none needs a lock: a step is one job of one writer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _seconds(n) -> Column:
    return F.make_dt_interval(secs=F.lit(n) if isinstance(n, (int, float)) else n)


# Idle workers that are broadcast; beyond, a shuffled join hands out the jobs.
MOST_WORKERS = 100_000


def _first(rows: DataFrame, key: str) -> DataFrame:
    """One row a key: the first by the column ``at`` where there is one, else, and among equals, the least of its values in order."""
    others = sorted((c for c in rows.columns if c != key), key=lambda c: (c != "at", rows.columns.index(c)))
    return rows.groupBy(key).agg(F.min(F.struct(*others)).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in others])


def claim(jobs: DataFrame, now: Column, workers: DataFrame, leases: dict[str, int]) -> DataFrame:
    """The oldest queued and due jobs of each kind, one for each idle worker (kind, worker), become running with a lease.

    ``leases``: minutes by kind; a worker of a kind without one raises, as its job's lease would never end. Only the first ranks
    of a kind are kept per partition before they are shuffled.
    """
    order = W.partitionBy("kind").orderBy("run_after", "job_id")
    unknown = F.when(~F.coalesce(F.col("kind").isin(list(leases)), F.lit(False)), F.coalesce("kind", F.lit("null")))
    most, idle, odd = workers.groupBy("kind").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0)), F.min(unknown)).first()
    if odd is not None:
        raise ValueError(f"no lease for jobs of kind {odd}")
    hands = workers.select("kind", "worker", F.row_number().over(W.partitionBy("kind").orderBy("worker")).alias("place"))
    due = jobs.where((F.col("state") == "queued") & (F.col("run_after") <= now)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= int(most))
    taken = due.join(F.broadcast(hands) if idle <= MOST_WORKERS else hands, ["kind", "place"]).select("job_id", "worker")
    minutes = F.element_at(F.create_map(*[F.lit(x) for k, m in leases.items() for x in (k, m)]), F.col("kind"))
    out = jobs.join(taken, "job_id", "left")
    mine = F.col("worker").isNotNull()
    return out.withColumns({
        "state": F.when(mine, "running").otherwise(F.col("state")), "attempt": F.col("attempt") + mine.cast("int"),
        "leased_until": F.when(mine, now + _seconds(minutes * 60)).otherwise(F.col("leased_until")), "leased_by": F.coalesce("worker", "leased_by"),
    }).drop("worker").select(*jobs.columns)


def heartbeat(jobs: DataFrame, beats: DataFrame, now: Column, lease_s: int) -> DataFrame:
    """A beat (job_id, worker) extends the lease of a running job, if that worker holds it."""
    seen = beats.select("job_id", F.col("worker").alias("beat")).distinct().groupBy("job_id").agg(F.collect_set("beat").alias("beats"))
    out = jobs.join(seen, "job_id", "left")
    holds = F.coalesce((F.col("state") == "running") & F.array_contains("beats", F.col("leased_by")), F.lit(False))
    return out.withColumn("leased_until", F.when(holds, now + _seconds(lease_s)).otherwise(F.col("leased_until"))).select(*jobs.columns)


def release(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that wait for another attempt are queued again once their time has come."""
    ready = (F.col("state") == "retrying") & (F.col("run_after") <= now)
    return jobs.withColumn("state", F.when(ready, "queued").otherwise(F.col("state")))


def _marked(jobs: DataFrame, event: Column, to: Column, error: Column, wait: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs after the event where it is not null, the log of transitions, and what died."""
    rows = jobs.withColumn("_event", event).withColumn("_to", F.when(F.col("_event").isNotNull(), to)).withColumn("_error", F.when(F.col("_event").isNotNull(), error)).withColumn("_after", F.when(F.col("_event").isNotNull(), wait))
    moved = rows.where("_event is not null")
    log = moved.select("job_id", F.col("state").alias("from_state"), F.col("_to").alias("to_state"), F.col("_event").alias("event"), "attempt", F.col("_error").alias("error"))
    dead = moved.where("_to = 'dead'").select("job_id", "kind", F.col("attempt").alias("attempts"), F.col("_error").alias("last_error"))
    free = F.col("_to").isNotNull()
    after = rows.withColumns({
        "state": F.coalesce("_to", "state"), "run_after": F.coalesce("_after", "run_after"),
        "leased_until": F.when(~free, F.col("leased_until")), "leased_by": F.when(~free, F.col("leased_by")),
    }).select(*jobs.columns)
    return after, log, dead


def reap(jobs: DataFrame, now: Column, wait_s: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Running jobs whose lease has run out retry after ``wait_s`` seconds, or die after their last attempt: (jobs, log, dead letters)."""
    out = (F.col("state") == "running") & (F.col("leased_until") < now)
    last = F.col("attempt") >= F.col("max_attempts")
    event = F.when(out & last, "attempts_exhausted").when(out, "lease_expired")
    return _marked(jobs, event, F.when(last, "dead").otherwise("retrying"), F.lit("lease_expired"), now + _seconds(wait_s))


def finish(jobs: DataFrame, results: DataFrame, wait: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results (job_id, ok, permanent, error) of running jobs: (jobs, log, dead letters). A failure that is not permanent
    retries at ``wait``, or dies after the last attempt; results of jobs that do not run change nothing. Of several results of a
    job the first counts: by the column ``at``, or else the least of the others in order (a failure before a success)."""
    rows = jobs.join(_first(results, "job_id").drop("at"), "job_id", "left")
    ran = F.col("state") == "running"
    last = F.col("attempt") >= F.col("max_attempts")
    event = F.when(ran & F.col("ok"), "completed").when(ran & ~F.col("ok") & F.col("permanent"), "failed").when(ran & ~F.col("ok") & last, "attempts_exhausted").when(ran & ~F.col("ok"), "failed_transiently")
    to = F.when(F.col("ok"), "succeeded").when(F.col("permanent"), "failed").when(last, "dead").otherwise("retrying")
    after, log, dead = _marked(rows, event, to, F.col("error"), F.when(F.col("_to") == "retrying", wait))
    return after.select(*jobs.columns), log, dead


def claim_notifications(notes: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """The oldest pending and due notifications (note_id, state, attempt, run_after), at most ``limit`` (1 to 100), become delivering."""
    due = notes.where((F.col("state") == "pending") & (F.col("run_after") <= now)).orderBy("run_after", "note_id").limit(max(1, min(100, limit)))
    taken = due.select("note_id", F.lit(True).alias("taken"))
    mine = F.col("taken").isNotNull()
    out = notes.join(F.broadcast(taken), "note_id", "left")
    return out.withColumns({"state": F.when(mine, "delivering").otherwise(F.col("state")), "attempt": F.col("attempt") + mine.cast("int")}).select(*notes.columns)


def record_delivery(notes: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Outcomes (note_id, went, error) of deliveries: channels that went out join those before, if they were asked for;
    with an error the note waits 30 s, doubled per attempt up to six, or fails after its last one. A null list is an empty one. Of
    several outcomes of a note the first counts, as with results of jobs."""
    rows = notes.join(_first(outcomes, "note_id").drop("at").withColumn("seen", F.lit(True)), "note_id", "left")
    hit, none = F.col("seen").isNotNull(), F.array().cast("array<string>")
    reached = F.array_intersect(F.array_sort(F.array_distinct(F.concat(F.coalesce("delivered", none), F.coalesce("went", none)))), F.col("channels"))
    state = F.when(F.col("error").isNull(), "delivered").when(F.col("attempt") >= F.col("max_attempts"), "failed").otherwise("pending")
    wait = now + _seconds(30 * F.pow(F.lit(2), F.least("attempt", F.lit(6))))
    return rows.withColumns({
        "run_after": F.when(hit & F.col("error").isNotNull(), wait).otherwise(F.col("run_after")),
        "delivered": F.when(hit, reached).otherwise(F.col("delivered")), "state": F.when(hit, state).otherwise(F.col("state")),
    }).select(*notes.columns)


def inbox(notes: DataFrame, company: int, user: int | None, limit: int = 50) -> DataFrame:
    """In-app notifications of a company for a user or for all, not suppressed, newest first, at most ``limit`` (1 to 200)."""
    mine = (F.col("user_id") == F.lit(user).cast("bigint")) | F.col("user_id").isNull() if user is not None else F.col("user_id").isNull()
    shown = notes.where((F.col("company_id") == company) & mine & F.array_contains("channels", "in_app") & (F.col("state") != "suppressed"))
    return shown.orderBy(F.desc("created_at"), F.desc("note_id")).limit(max(1, min(200, limit)))


def sweep_due(sources: DataFrame, now: Column, every_s: int = 6 * 3600) -> DataFrame:
    """Sources (last_checked_at) never checked, or so long ago that it is their turn."""
    return sources.where(F.col("last_checked_at").isNull() | (F.col("last_checked_at") + _seconds(every_s) <= now))


def source_records(checks: DataFrame) -> DataFrame:
    """Checks (source_id, at, state) to what is kept of each source: state, checked_at, failure_streak.

    The last answer stays through any number of failures, which only count; a source never read is unreachable. The last
    answer and the failures after it are grouped sums, so a source's log never meets in one task.
    """
    answered = F.col("state").isin("verified", "mismatch")
    last = checks.groupBy("source_id").agg(F.max(F.when(answered, F.struct("at", "state"))).alias("answer"), F.max("at").alias("checked_at"))
    both = checks.join(last, "source_id").where((F.col("state") == "unreachable") & (F.col("answer").isNull() | (F.col("at") > F.col("answer.at"))))
    streaks = both.groupBy("source_id").agg(F.count("*").alias("failure_streak"))
    return last.join(streaks, "source_id", "left").select("source_id", F.coalesce("answer.state", F.lit("unreachable")).alias("state"), "checked_at", F.coalesce("failure_streak", F.lit(0)).alias("failure_streak"))


def guarded(rows: DataFrame, allowed: tuple[str, ...], new: Column) -> tuple[DataFrame, DataFrame]:
    """A state changes only from allowed ones: the table after, and the rows that changed, as they are now."""
    hit = F.col("state").isin(*allowed) & new.isNotNull()
    marked = rows.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("state", F.when(hit, new).otherwise(F.col("state")))
    return marked.drop("_hit"), marked.where("_hit").drop("_hit")
