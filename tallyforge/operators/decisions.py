"""Who may do what, and where a notice goes: decisions by joins with small tables instead of code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of grants, requirements, defaults and mandatory kinds that are broadcast.
MOST_ROWS = 100_000

# Levels of verification, from low to high; roles with what each may do, "*" for everything; channels of notices
# and kinds that a user can't turn off.
LEVELS = ["unverified", "two_factor", "strong"]
ADVISOR = ["read_company", "upload_document", "read_document", "start_analysis", "read_analysis", "read_report", "run_simulation", "read_simulation"]
PERMISSIONS = [*ADVISOR, "update_company", "delete_document", "manage_members", "manage_tokens", "delete_company", "read_audit_trail"]
GRANTS = {"owner": ["*"], "member": ["update_company", "delete_document"], "advisor": ADVISOR}
INHERITS = {"member": ["advisor"]}
CHANNELS = {"analysis_completed": ["push", "email"], "analysis_failed": ["push", "email"], "document_processed": ["in_app"], "member_invited": ["email"], "security_alert": ["email", "push"]}
MANDATORY = ["security_alert"]


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast if it has at most MOST_ROWS rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(MOST_ROWS + 1).count() <= MOST_ROWS else df


def closed_grants(grants: DataFrame, inherits: DataFrame, permissions: list[str], most_levels: int = 20) -> DataFrame:
    """(role, permission): what each role may, with all it inherits over any number of steps; "*" is every permission. Cycles end, as
    pairs are taken once. grants: role, permission. inherits: role, parent."""
    up = inherits.select("role", "parent").distinct()
    seen = up
    for _ in range(most_levels):
        wider = seen.join(up.select(F.col("role").alias("parent"), F.col("parent").alias("next")), "parent").select("role", F.col("next").alias("parent")).union(seen).distinct()
        if wider.count() == seen.count():
            break
        seen = wider
    else:
        raise ValueError(f"roles inherit over more than {most_levels} levels")
    own = grants.select("role", "permission")
    got = seen.join(own.select(F.col("role").alias("parent"), "permission"), "parent").select("role", "permission").union(own).distinct()
    every = got.where("permission = '*'").select("role", F.explode(F.array(*map(F.lit, permissions))).alias("permission"))
    return got.where("permission <> '*'").union(every).distinct()


def decided(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """``requests`` (role, held, permission, required and others) with decision: allowed, role_insufficient, or verification_insufficient. The
    role is looked at first. An unknown role may nothing; an unknown or null level held is unverified, an unknown or null level
    required is strong."""
    level = lambda c, default: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), F.col(c)), F.lit(0)), F.lit(default))
    may = small(grants.select(F.col("role").alias("_role"), F.col("permission").alias("_permission"), F.lit(True).alias("_may")).distinct())
    rows = requests.join(may, (F.col("role") == F.col("_role")) & (F.col("permission") == F.col("_permission")), "left")
    decision = F.when(F.col("_may").isNull(), "role_insufficient").when(level("held", 1) < level("required", len(LEVELS)), "verification_insufficient").otherwise("allowed")
    return rows.withColumn("decision", decision).drop("_role", "_permission", "_may")


def channels(notices: DataFrame, defaults: DataFrame, preferences: DataFrame, known: list[str], mandatory: list[str] = MANDATORY) -> DataFrame:
    """``notices`` (user_id, kind and others) with channels and suppressed. Mandatory kinds, and notices to no user, go to the kind's
    defaults; else the user's preference row decides, of which unknown channels are left out; without one the defaults do. An
    empty list suppresses a notice; a kind without defaults has none. defaults: kind, channels. preferences: user_id, kind,
    channels, one row a user and kind."""
    usual = small(defaults.select(F.col("kind").alias("_kind"), F.col("channels").alias("_usual")))
    own = preferences.select(F.col("user_id").alias("_user"), F.col("kind").alias("_of"), F.col("channels").alias("_own"))
    fixed = F.coalesce(F.col("kind").isin(mandatory), F.lit(False))
    # mandatory kinds do not need the preferences, so they stay out of their join
    rows = notices.withColumn("_user_asked", F.when(~fixed, F.col("user_id"))).join(own, (F.col("_user_asked") == F.col("_user")) & (F.col("kind") == F.col("_of")), "left").join(usual, F.col("kind") == F.col("_kind"), "left")
    none = F.array().cast("array<string>")
    chosen = F.when(F.col("_own").isNotNull(), F.array_intersect("_own", F.array(*map(F.lit, known)))).otherwise(F.coalesce("_usual", none))
    return rows.withColumn("channels", chosen).withColumn("suppressed", F.size("channels") == 0).drop("_user_asked", "_user", "_of", "_own", "_kind", "_usual")
