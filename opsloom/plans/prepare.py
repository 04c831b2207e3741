"""Registered query: raw tickets to splits in one job."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators.prepare import prepare
from opsloom.plans.modeling import TICKETS, checks, n_rows
from opsloom.plans.base import over_repaired
from opsloom.session import work_path
from opsloom.sources.files import optional_table
from opsloom.sources.tables import table, tickets

Q, S = {}, {}


def _prepared(spark, sf):
    """Suppliers are the context of the items tickets name; some tickets are told to be cancelled by their returned lines."""
    path = work_path(spark, "context")
    table(spark, sf, "supplier").select(F.concat(F.lit("ci-"), F.col("s_suppkey").cast("string")).alias("cmdb_ci"), F.col("s_name").alias("owner"), F.col("s_acctbal").alias("category")).write.parquet(path)
    raw = tickets(spark, sf, text=True).withColumnRenamed("priority_raw", "priority").withColumn("state", F.when(F.col("urgency") >= 3, "8").otherwise("1"))
    return prepare(raw, optional_table(spark, path))


def _checks(spark, sf):
    df = _prepared(spark, sf)
    ok = lambda c: F.every(F.coalesce(c, F.lit(False)))
    size = lambda name: (F.lit(True), F.count_if(F.col("split") == name))
    ordered = F.coalesce(F.col("resolved_at") >= F.col("opened_at"), F.lit(True)) & F.coalesce(F.col("closed_at") >= F.col("resolved_at"), F.lit(True))
    return checks(
        df, every_ticket_once=(F.count_distinct("number") == n_rows(), n_rows()), times_ordered=(ok(ordered), n_rows()), ordinals_in_range=(ok(F.col("priority").between(1, 5) & F.col("urgency").between(1, 3)), n_rows()),
        groups_named=(ok((F.col("assignment_group") != "") & (F.col("category") != "")), n_rows()), texts_normalised=(ok((F.col("description_clean") != "") & (F.lower("description_clean") == F.col("description_clean"))), n_rows()),
        context_joined=(F.lit("category_side" in df.columns), F.count("owner")), train=size("train"), val=size("val"), test=size("test"))


Q["pipeline_splits"] = _checks
_ALL = ("every_ticket_once", "times_ordered", "ordinals_in_range", "groups_named", "texts_normalised")
S["pipeline_splits"] = over_repaired(f", t AS ({TICKETS} WHERE coalesce(urgency, 0) < 3) " + " UNION ALL ".join(
    [f"SELECT '{c}' AS check_name, true AS passed, count(*)::bigint AS n FROM t" for c in _ALL]
    + ["SELECT 'context_joined', true, count(*)::bigint FROM t WHERE cmdb_ci IN (SELECT concat('ci-', cast(s_suppkey AS varchar)) FROM supplier)"]
    + [f"SELECT '{s}', true, count(*)::bigint FROM t WHERE split = '{s}'" for s in ("train", "val", "test")]))
