"""Column policy: logical type, leakage tier, imputation and encoding of every known ticket column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnPolicy:
    logical_type: str
    max_missing_pct: float
    leakage: str
    encoding: str
    imputation: str
    role: str
    required: bool


# Column -> type, allowed missing percent, leakage tier, encoding, imputation, role, required.
POLICY: dict[str, ColumnPolicy] = {
    "number": ColumnPolicy("string", 0, "safe", "none", "none", "excluded", True),
    "opened_at": ColumnPolicy("datetime", 0, "safe", "none", "none", "excluded", True),
    "resolved_at": ColumnPolicy("datetime", 2, "blocked", "none", "none", "excluded", False),
    "priority": ColumnPolicy("integer", 0, "safe", "ordinal", "mode", "predictor", True),
    "business_impact": ColumnPolicy("integer", 0, "safe", "ordinal", "mode", "predictor", True),
    "severity": ColumnPolicy("integer", 0, "safe", "ordinal", "mode", "predictor", True),
    "state": ColumnPolicy("integer", 0, "safe", "one_hot", "mode", "excluded", True),
    "category": ColumnPolicy("string", 0, "safe", "one_hot", "constant_unknown", "predictor", True),
    "subcategory": ColumnPolicy("string", 0, "safe", "frequency", "constant_unknown", "predictor", True),
    "assignment_group": ColumnPolicy("string", 0, "safe", "label", "constant_unknown", "target", True),
    "assigned_to": ColumnPolicy("string", 15, "safe", "none", "constant_unknown", "excluded", False),
    "cmdb_ci": ColumnPolicy("string", 0, "safe", "frequency", "constant_unknown", "predictor", True),
    "short_description": ColumnPolicy("string", 0, "safe", "none", "constant_unknown", "predictor", True),
    "description": ColumnPolicy("string", 0, "safe", "none", "constant_unknown", "predictor", True),
    "close_code": ColumnPolicy("string", 12, "blocked", "none", "none", "excluded", False),
    "resolution_time_hours": ColumnPolicy("float", 2, "blocked", "none", "median", "target", False),
    "calendar_stc": ColumnPolicy("float", 2, "blocked", "none", "none", "excluded", False),
    "made_sla": ColumnPolicy("boolean", 0, "blocked", "none", "none", "excluded", True),
    "problem_flag": ColumnPolicy("boolean", 0, "warning", "none", "none", "excluded", True),
    "problem_id": ColumnPolicy("string", 90, "warning", "none", "constant_unknown", "excluded", False),
    "opened_at_hour": ColumnPolicy("integer", 0, "safe", "sine_cosine", "none", "predictor", True),
    "opened_at_hour_sin": ColumnPolicy("float", 0, "safe", "none", "none", "predictor", True),
    "opened_at_hour_cos": ColumnPolicy("float", 0, "safe", "none", "none", "predictor", True),
    "opened_at_dayofweek": ColumnPolicy("integer", 0, "safe", "sine_cosine", "none", "predictor", True),
    "opened_at_dayofweek_sin": ColumnPolicy("float", 0, "safe", "none", "none", "predictor", True),
    "opened_at_dayofweek_cos": ColumnPolicy("float", 0, "safe", "none", "none", "predictor", True),
    "is_business_hours": ColumnPolicy("integer", 0, "safe", "none", "none", "predictor", True),
    "has_problem_id": ColumnPolicy("integer", 0, "safe", "none", "none", "predictor", True),
    "priority_x_business_impact": ColumnPolicy("float", 0, "safe", "none", "median", "predictor", True),
    "u_caused_by": ColumnPolicy("string", 0, "safe", "frequency", "constant_unknown", "predictor", False),
    "u_development_release_id": ColumnPolicy("string", 0, "safe", "frequency", "constant_unknown", "predictor", False),
    "u_vendor_ticket_ref": ColumnPolicy("string", 0, "safe", "frequency", "constant_unknown", "predictor", False),
    "u_describe_customer_impact": ColumnPolicy("string", 0, "safe", "none", "constant_unknown", "predictor", False),
    "caused_by": ColumnPolicy("string", 0, "safe", "frequency", "constant_unknown", "predictor", False),
    "incident_state": ColumnPolicy("string", 0, "blocked", "none", "constant_unknown", "excluded", False),
    "close_notes": ColumnPolicy("string", 0, "blocked", "none", "constant_unknown", "excluded", False),
}

SPARK_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "datetime": T.TimestampNTZType(),
}

# Columns every ticket scan must have, and the full table layout.
REQUIRED_COLUMNS = (
    "number", "opened_at", "priority", "category", "assignment_group", "short_description", "description",
)
FULL_COLUMNS = (
    "number", "opened_at", "resolved_at", "closed_at", "priority", "business_impact", "urgency", "state",
    "category", "subcategory", "assignment_group", "assigned_to", "business_service", "cmdb_ci", "vendor",
    "caller", "short_description", "description", "close_notes", "close_code", "resolution_time_hours",
    "calendar_stc", "business_duration_hours", "made_sla", "sla_status", "sla_due", "reassignment_count",
    "reopen_count", "problem_flag", "problem_id", "change_request", "knowledge_linked", "knowledge_base",
    "contact_type", "location", "duplicate_incident", "parent_incident",
)

# Outcome columns that are only known after triage.
POST_RESOLUTION_COLUMNS = (
    "resolved_at", "closed_at", "close_notes", "close_code", "resolution_time_hours", "calendar_stc",
    "business_duration_hours", "made_sla", "sla_status", "reassignment_count", "reopen_count",
    "root_cause_summary",
)

# Features a triage table may still lack because they are derived later.
DERIVED_FEATURES = (
    "opened_at_hour", "opened_at_hour_sin", "opened_at_hour_cos", "opened_at_dayofweek",
    "opened_at_dayofweek_sin", "opened_at_dayofweek_cos", "is_business_hours", "has_parent_incident",
    "has_change_request", "has_problem_id", "is_duplicate", "priority_x_business_impact", "priority_x_urgency",
)

# Allowed hours per priority, and for an unknown priority.
SLA_TARGET_HOURS = {1: 4.0, 2: 12.0, 3: 48.0, 4: 120.0, 5: 240.0}
SLA_DEFAULT_HOURS = 48.0


def columns_in_tier(tier: str) -> list[str]:
    return [c for c, p in POLICY.items() if p.leakage == tier]


def predictors() -> list[str]:
    return [c for c, p in POLICY.items() if p.role == "predictor"]


def allowed_missing(column: str) -> float:
    return POLICY[column].max_missing_pct if column in POLICY else 100.0


def _title(name: str) -> str:
    return name.replace("_", " ").title()


def label_of(feature: str) -> str:
    """Display name of a column or of a derived vector slot such as ``category_NETWORK``."""
    if feature in POLICY:
        return _title(feature)
    base = max((c for c in POLICY if feature.startswith(c + "_")), key=len, default=None)
    if base:
        return f"{_title(base)} = {feature[len(base) + 1:]}"
    return _title(feature)
