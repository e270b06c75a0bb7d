"""Views of the driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The kind of fact that each order priority stands for.
PRIORITY_KIND = {"1-URGENT": "taxable_result", "2-HIGH": "equipment", "3-MEDIUM": "depreciation", "4-NOT SPECIFIED": "carried_forward_loss", "5-LOW": "personnel_costs"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ore(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per order: company_id, kind, value_ore, confidence, seq, tax_year."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY_KIND.items() for x in kv]), F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("company_id"), kind.alias("kind"), ore("o_totalprice").alias("value_ore"),
        ((F.col("o_orderkey") % 100) / 100).alias("confidence"), F.col("o_orderkey").alias("seq"), F.year("o_orderdate").alias("tax_year"),
    )


FACTS_SQL = "select o_custkey as company_id, case o_orderpriority " + " ".join(f"when '{k}' then '{v}'" for k, v in PRIORITY_KIND.items()) + " end as kind, cast(round(o_totalprice * 100) as bigint) as value_ore, (o_orderkey % 100) / 100.0::double as confidence, o_orderkey as seq, year(o_orderdate) as tax_year from orders"


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile per customer; a third of each flag's answers is missing."""
    def flag(name: str, shift: int):
        m = (F.col("c_custkey") + shift) % 3
        return F.when(m == 0, True).when(m == 1, False).alias(name)

    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("company_id"), F.lit(2024).alias("tax_year"), flag("in_group", 0), flag("ownership_changed", 1), flag("owners_active", 2), flag("has_vehicles", 0), flag("does_development_work", 1),
        F.when(F.col("c_custkey") % 5 != 0, (F.col("c_custkey") % 40).cast("int")).alias("employee_count"), F.when(F.col("c_custkey") % 4 != 0, (F.col("c_custkey") % 7).cast("int")).alias("owner_count"),
        F.when(F.col("c_custkey") % 6 == 0, "unknown").when(F.col("c_custkey") % 6 == 1, "draft").otherwise("final").alias("accounts_state"),
    )


COMPANIES_SQL = "select c_custkey as company_id, 2024 as tax_year, " + ", ".join(
    f"case (c_custkey + {s}) % 3 when 0 then true when 1 then false end as {n}" for n, s in (("in_group", 0), ("ownership_changed", 1), ("owners_active", 2), ("has_vehicles", 0), ("does_development_work", 1))
) + ", case when c_custkey % 5 <> 0 then (c_custkey % 40)::int end as employee_count, case when c_custkey % 4 <> 0 then (c_custkey % 7)::int end as owner_count, case c_custkey % 6 when 0 then 'unknown' when 1 then 'draft' else 'final' end as accounts_state from customer"


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as samples: output (return flag), x, three inputs."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("output"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), "l_orderkey", "l_linenumber")


# The event of a job that each event type stands for.
EVENT_OF = {"signup": "claim", "purchase": "succeed", "error": "fail_transient", "view": "release", "click": "expire"}


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_OF.items() for x in kv]), F.col("event_type"))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts", "event_id", kind.alias("event"))
