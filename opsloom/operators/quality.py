"""Data-quality rules: all row rules in one aggregate, samples from one ranked pass."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsloom.functions.ordinals import is_blank, trim_ws
from opsloom.schema import FULL_COLUMNS, REQUIRED_COLUMNS, SLA_DEFAULT_HOURS, SLA_TARGET_HOURS

# Rule id -> name.
RULES = {
    "CHK-01": "Missing Values Check",
    "CHK-02": "Duplicate Incident Numbers",
    "CHK-03": "Invalid Timestamps",
    "CHK-04": "Invalid Categories",
    "CHK-05": "Invalid Assignment Groups",
    "CHK-06": "Invalid Priorities",
    "CHK-07": "SLA Inconsistencies",
    "CHK-08": "Resolution Time Inconsistencies",
    "CHK-09": "Invalid CMDB References",
    "CHK-10": "Invalid Business Services",
    "CHK-11": "Empty Descriptions",
    "CHK-12": "Empty Short Descriptions",
}
# Tolerances in hours.
SLA_TOLERANCE = 0.05
RESOLUTION_TOLERANCE = 0.5
# Columns a rule needs; without them a rule reports every row (or, where optional, none).
NEEDS = {
    "CHK-02": ("number",), "CHK-04": ("category",), "CHK-05": ("assignment_group",), "CHK-06": ("priority",),
    "CHK-09": ("cmdb_ci",), "CHK-10": ("business_service",), "CHK-11": ("description",),
    "CHK-12": ("short_description",),
}


def hours_between(start: str, end: str) -> Column:
    return F.timestamp_diff("SECOND", F.col(start), F.col(end)) / F.lit(3600.0)


def sla_target(priority: Column) -> Column:
    target = F.lit(SLA_DEFAULT_HOURS)
    for level, hours in SLA_TARGET_HOURS.items():
        target = F.when(priority == level, F.lit(hours)).otherwise(target)
    return target


def sla_conflict(df: DataFrame) -> Column:
    hours, met = F.col("resolution_time_hours"), F.col("made_sla")
    target = sla_target(F.col("priority"))
    breached = F.col("sla_status") == "Breached" if "sla_status" in df.columns else F.lit(False)
    return F.when(met, hours > target + SLA_TOLERANCE).otherwise((hours <= target) & breached)


def row_checks(df: DataFrame) -> dict[str, list[Column]]:
    """Rule -> predicates that are true on an offending row; a row may break one rule twice."""
    have = set(df.columns)
    checks: dict[str, list[Column]] = {}
    if set(REQUIRED_COLUMNS) <= have:
        checks["CHK-01"] = [F.col(c).isNull() for c in REQUIRED_COLUMNS]
    order = [("resolved_at", "opened_at"), ("closed_at", "resolved_at")]
    checks["CHK-03"] = [F.col(a) < F.col(b) for a, b in order if {a, b} <= have]
    for rule, column in (("CHK-04", "category"), ("CHK-05", "assignment_group"), ("CHK-10", "business_service"),
                         ("CHK-11", "description"), ("CHK-12", "short_description")):
        if column in have:
            checks[rule] = [is_blank(F.col(column))]
    if "priority" in have:
        checks["CHK-06"] = [~F.substring(trim_ws(F.col("priority").cast("string")), 1, 1).isin("1", "2", "3", "4", "5")]
    if {"made_sla", "resolution_time_hours", "priority"} <= have:
        checks["CHK-07"] = [sla_conflict(df)]
    if "resolution_time_hours" in have:
        checks["CHK-08"] = [F.col("resolution_time_hours") < 0]
        if {"opened_at", "resolved_at"} <= have:
            drift = F.abs(hours_between("opened_at", "resolved_at") - F.col("resolution_time_hours"))
            checks["CHK-08"].append(drift > RESOLUTION_TOLERANCE)
    if "cmdb_ci" in have:
        checks["CHK-09"] = [is_blank(F.col("cmdb_ci")) | (F.col("cmdb_ci") == "UNKNOWN")]
    return {r: [F.coalesce(p, F.lit(False)) for p in ps] for r, ps in checks.items()}


def duplicate_rows(df: DataFrame, key: str = "number") -> DataFrame:
    """One row: how many rows share their key with another row (NULL keys count as equal)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(
        F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("error_count"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("total"),
    )


def _rule_row(rule: str, errors: Column, cells: Column) -> Column:
    pct = F.when(cells > 0, F.round(errors / cells * 100, 4)).otherwise(F.lit(0.0))
    return F.struct(
        F.lit(rule).alias("rule_id"), F.lit(RULES[rule]).alias("rule_name"), (errors == 0).alias("passed"),
        errors.cast("bigint").alias("error_count"), pct.alias("error_percentage"),
    )


def rule_report(df: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """One row per rule. Row rules share one scan; the key rule adds one pre-aggregated count."""
    checks = row_checks(df)
    wanted = rules or list(RULES)
    single = [r for r in wanted if r != "CHK-02"]
    sums = []
    for r in single:
        for i, p in enumerate(checks.get(r, [])):
            sums.append(F.count_if(p).alias(f"{r}_{i}"))
    one = df.agg(F.count(F.lit(1)).alias("n"), *sums)
    rows = []
    for r in single:
        parts = [F.col(f"`{r}_{i}`") for i in range(len(checks.get(r, [])))]
        missing = r not in checks and (r in NEEDS or r == "CHK-01")
        errors = sum(parts[1:], parts[0]) if parts else (F.col("n") if missing else F.lit(0))
        cells = F.col("n") * len(REQUIRED_COLUMNS) if r == "CHK-01" and parts else F.col("n")
        rows.append(_rule_row(r, errors, cells))
    out = one.select(F.inline(F.array(*rows))) if rows else None
    if "CHK-02" in wanted:
        if "number" in df.columns:
            dup = duplicate_rows(df)
        else:
            dup = df.agg(F.count(F.lit(1)).alias("error_count"), F.count(F.lit(1)).alias("total"))
        dup = dup.select(F.inline(F.array(_rule_row("CHK-02", F.col("error_count"), F.col("total")))))
        out = dup if out is None else out.unionByName(dup)
    return out


def rule_samples(df: DataFrame, k: int = 3, key_k: int = 5) -> DataFrame:
    """The first offenders per rule in key order.

    ``row_number() <= k`` makes Spark keep only k rows per rule and map task before it shuffles.
    """
    checks = row_checks(df)
    broken = F.array_compact(F.array(*[
        F.when(reduce(or_, ps), F.lit(r)) for r, ps in checks.items()
    ]))
    hits = df.select("number", F.explode(broken).alias("rule_id"))
    keys = (
        df.groupBy("number").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1)
        .select("number", F.lit("CHK-02").alias("rule_id"))
    )
    w = Window.partitionBy("rule_id").orderBy("number")
    top = lambda d, n: d.withColumn("sample_no", F.row_number().over(w)).filter(F.col("sample_no") <= n)
    return top(hits, k).unionByName(top(keys, key_k)).select("rule_id", F.col("sample_no").cast("bigint").alias("sample_no"), "number")


def schema_gate(df: DataFrame, required: tuple[str, ...] = FULL_COLUMNS) -> DataFrame:
    """One row per required column: is it present, and does the table hold rows."""
    has_rows = df.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_rows"))
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(c in df.columns).alias("present")) for c in required]
    return has_rows.select("has_rows", F.inline(F.array(*cells)))
