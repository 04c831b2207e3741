"""Inputs shared by the registered queries, in Spark and as SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from opsloom.functions.ordinals import apply_rule
from opsloom.operators.clean import repair_timestamps
from opsloom.operators.features import resolution_hours
from opsloom.sources.tables import TICKETS_CTE, table, tickets

STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(c: str):
    return F.date_format(c, STAMP).alias(c)


def with_priority(df: DataFrame) -> DataFrame:
    return df.withColumn("priority", apply_rule("priority", F.col("priority_raw")))


def repaired(spark: SparkSession, sf: str, text: bool = False) -> DataFrame:
    """Tickets with parsed priority, ordered times and resolution hours."""
    return tickets(spark, sf, text).transform(with_priority).transform(repair_timestamps).transform(resolution_hours)


def event_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """Events seen as tickets with an intraday opening time."""
    return table(spark, sf, "events").select(F.col("event_id").alias("number"), F.col("ts").alias("opened_at"), "event_type", "value")


PRIORITY_LEVEL_SQL = """coalesce(
  CASE WHEN contains(lower(trim(priority_raw)), 'planning') THEN 5 WHEN contains(lower(trim(priority_raw)), 'low') THEN 4
       WHEN contains(lower(trim(priority_raw)), 'medium') THEN 3 WHEN contains(lower(trim(priority_raw)), 'moderate') THEN 3
       WHEN contains(lower(trim(priority_raw)), 'high') THEN 2 WHEN contains(lower(trim(priority_raw)), 'critical') THEN 1 END,
  try_cast(nullif(regexp_extract(lower(trim(priority_raw)), '^(\\d+)', 1), '') AS int), 3)"""

PRIORITY_SQL = f"least(greatest({PRIORITY_LEVEL_SQL}, 1), 5)"

REPAIRED_CTE = TICKETS_CTE + f""",
rep1 AS (SELECT * REPLACE (CASE WHEN resolved_at < opened_at THEN opened_at + INTERVAL 4 HOURS ELSE resolved_at END AS resolved_at),
                {PRIORITY_SQL} AS priority FROM tickets),
rep2 AS (SELECT * REPLACE (CASE WHEN closed_at < resolved_at THEN resolved_at + INTERVAL 24 HOURS ELSE closed_at END AS closed_at) FROM rep1),
rep AS (SELECT *, greatest(coalesce(round(date_diff('microsecond', opened_at, resolved_at) / 1e6 / 3600, 4), 0.0), 0.0)
               AS resolution_time_hours FROM rep2)
"""


def over_tickets(select: str) -> str:
    return f"WITH {TICKETS_CTE} {select}"


def over_repaired(select: str) -> str:
    return f"WITH {REPAIRED_CTE} {select}"


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
