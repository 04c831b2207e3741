"""Gates that keep outcome columns away from triage models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opsloom.schema import DERIVED_FEATURES, POLICY, columns_in_tier

# Blocked columns that may be present because they are targets.
ALLOWED_TARGETS = ("assignment_group", "resolution_time_hours")


def violations(columns: list[str], usage: str = "triage_prediction") -> dict[str, list[str]]:
    """Missing required triage columns and blocked columns that are present."""
    if usage != "triage_prediction":
        return {"missing_required": [], "blocked_present": []}
    required = [c for c, p in POLICY.items() if p.leakage == "safe" and p.required and c not in DERIVED_FEATURES]
    return {
        "missing_required": [c for c in required if c not in columns],
        "blocked_present": [c for c in columns_in_tier("blocked") if c in columns and c not in ALLOWED_TARGETS],
    }


def compliance(df: DataFrame, usage: str = "triage_prediction") -> DataFrame:
    """One row per violation and one summary row."""
    found = violations(df.columns, usage)
    rows = [(kind, c) for kind, cs in found.items() for c in cs]
    cells = [F.struct(F.lit(k).alias("violation"), F.lit(c).alias("column_name")) for k, c in rows]
    cells.append(F.struct(F.lit("compliant" if not rows else "not_compliant").alias("violation"), F.lit("*").alias("column_name")))
    return df.limit(1).agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(*cells)))


def assert_predictors(columns: list[str]) -> list[str]:
    """Raise when a predictor is only known after resolution."""
    blocked = [c for c in columns if c in POLICY and POLICY[c].leakage == "blocked"]
    if blocked:
        raise ValueError(f"blocked columns cannot be predictors: {blocked}")
    return columns


def drop_blocked(df: DataFrame) -> DataFrame:
    return df.drop(*columns_in_tier("blocked"))
