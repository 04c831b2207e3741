"""Repairs and type enforcement. Every function maps a ticket table to a ticket table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from opsloom.functions.order_stats import quantiles, ranked_values
from opsloom.functions.ordinals import ORDINAL_RULES, apply_rule, is_blank, parse_ordinal, to_bool, trim_ws
from opsloom.schema import POLICY, REQUIRED_COLUMNS, SPARK_TYPES
from opsloom.session import materialize

# Highest counter values kept, the lower bound of a usable cap, and the repair offsets.
WINSOR_CAPS = {"reassignment_count": 15, "reopen_count": 8}
WINSOR_FLOOR = 5
RESOLVE_OFFSET = "INTERVAL 4 HOURS"
CLOSE_OFFSET = "INTERVAL 24 HOURS"
TEXT_FILL = "Not Provided"
UNKNOWN = "Unknown"


def require_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED_COLUMNS) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def _is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NumericType)


def keep_latest(df: DataFrame, key: str = "number", order: str = "opened_at") -> DataFrame:
    """One row per key: the latest by ``order``; a missing time counts as latest, ties go to the larger row.

    ``max`` over a struct is combined on the map side, so copies of one hot key never meet in one task.
    A NULL key is one group.
    """
    if key not in df.columns:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c != key]
    rank = [F.col(order).isNull().alias("__late"), F.col(order).alias("__at")] if order in rest else []
    packed = F.max(F.struct(*rank, *rest)).alias("__row")
    return df.groupBy(key).agg(packed).select(*[F.col(c) if c == key else F.col(f"__row.{c}") for c in df.columns])


def drop_exact_copies(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def apply_ordinal_rules(df: DataFrame) -> DataFrame:
    cols = {c: apply_rule(c, F.col(c), _is_numeric(df, c)) for c in ORDINAL_RULES if c in df.columns}
    return df.withColumns(cols)


def coerce(c: Column, logical_type: str) -> Column:
    """Cast that yields NULL (integer: 0) instead of failing."""
    if logical_type == "integer":
        return F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"), F.lit(0))
    if logical_type == "float":
        return c.try_cast("double")
    if logical_type == "boolean":
        return to_bool(c)
    if logical_type == "datetime":
        return c.try_cast("timestamp_ntz")
    return c.cast("string")


def coerce_types(df: DataFrame) -> DataFrame:
    """Give every known column its declared type; columns that already have it are left alone."""
    cols = {}
    for f in df.schema.fields:
        policy = POLICY.get(f.name)
        if policy is None or f.dataType == SPARK_TYPES[policy.logical_type]:
            continue
        if policy.logical_type in ("integer", "float") and isinstance(f.dataType, NumericType):
            continue
        cols[f.name] = coerce(F.col(f.name), policy.logical_type)
    return df.withColumns(cols) if cols else df


def fill_plan(df: DataFrame) -> dict[str, str]:
    """Column -> fill rule: text, median, mode, zero, unknown. Times and flags stay NULL."""
    out = {}
    for f in df.schema.fields:
        policy = POLICY.get(f.name)
        strategy = policy.imputation if policy else "constant_unknown"
        numeric = isinstance(f.dataType, NumericType)
        if f.name in ("short_description", "description"):
            out[f.name] = "text"
        elif strategy == "median" and numeric:
            out[f.name] = "median"
        elif strategy == "mode":
            out[f.name] = "mode"
        elif numeric:
            out[f.name] = "zero"
        elif f.dataType.simpleString() == "string":
            out[f.name] = "unknown"
    return out


def impute(df: DataFrame, plan: dict[str, str] | None = None) -> DataFrame:
    """Fill NULLs. Fitted values are scalar subqueries over pre-aggregated counts, not collected."""
    plan = fill_plan(df) if plan is None else plan
    cols: dict[str, Column] = {}
    medians = [c for c, rule in plan.items() if rule == "median"]
    fitted = one_struct(quantiles(ranked_values(df, medians), {"median": 0.5}), medians, "median") if medians else None
    for c, rule in plan.items():
        if rule == "text":
            cols[c] = F.coalesce(F.col(c), F.lit(TEXT_FILL))
        elif rule == "unknown":
            cols[c] = F.coalesce(F.col(c), F.lit(UNKNOWN))
        elif rule == "zero":
            cols[c] = F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))
        elif rule == "median":
            cols[c] = F.coalesce(F.col(c), fitted[c])
        elif rule == "mode":
            cols[c] = F.coalesce(F.col(c), most_frequent(df, c).scalar())
    return df.withColumns(cols)


def one_struct(named: DataFrame, names: list[str], value: str) -> Column:
    """A scalar subquery holding ``value`` of every name as one struct, so it is computed once."""
    row = named.agg(*[F.max(F.when(F.col("name") == n, F.col(value))).alias(n) for n in names])
    return row.select(F.struct(*names)).scalar()


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """One-row frame with the most frequent value; the smallest value wins a tie."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__c"))
    return counts.orderBy(F.col("__c").desc(), column).limit(1).select(column)


def blank_to_unknown(df: DataFrame, columns=("category", "assignment_group"), allow_custom: bool = False) -> DataFrame:
    if allow_custom:
        return df
    return df.withColumns(
        {c: F.when(is_blank(F.col(c)), F.lit(UNKNOWN)).otherwise(F.col(c)) for c in columns if c in df.columns}
    )


def _before(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) < F.col(b), F.lit(False))


def repair_timestamps(df: DataFrame, strict: bool = False) -> DataFrame:
    """Restore opened <= resolved <= closed; the second test sees the repaired resolve time."""
    for late, early, offset in (
        ("resolved_at", "opened_at", RESOLVE_OFFSET),
        ("closed_at", "resolved_at", CLOSE_OFFSET),
    ):
        if late not in df.columns or early not in df.columns:
            continue
        if strict:
            df = df.filter(~_before(late, early))
        else:
            df = df.withColumn(
                late, F.when(_before(late, early), F.col(early) + F.expr(offset)).otherwise(F.col(late))
            )
    return df


def winsor_caps(df: DataFrame, caps: dict[str, int] = WINSOR_CAPS) -> DataFrame:
    """One row per counter: the 99 % quantile and the cap that follows from it."""
    names = [c for c in caps if c in df.columns]
    q = quantiles(ranked_values(df, names), {"q99": 0.99})
    limit = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(float(caps[c])))])[F.col("name")]
    usable = (F.col("q99") >= WINSOR_FLOOR) & (F.col("q99") <= limit)
    return q.select("name", "q99", F.when(usable, F.col("q99")).otherwise(limit).alias("cap"))


def winsorize(df: DataFrame, caps: dict[str, int] = WINSOR_CAPS) -> DataFrame:
    names = [c for c in caps if c in df.columns]
    if not names:
        return df
    fitted = one_struct(winsor_caps(df, caps), names, "cap")
    cols = {}
    for c in names:
        cap = fitted[c]
        cols[c] = F.when(F.col(c) > cap, cap.cast("int")).otherwise(F.col(c))
    return df.withColumns(cols)


def trim_strings(df: DataFrame) -> DataFrame:
    names = [c for c, t in df.dtypes if t == "string" and c in POLICY]
    return df.withColumns({c: trim_ws(F.col(c)) for c in names})


def rename_fields(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def clean(df: DataFrame, strict: bool = False, allow_custom: bool = False) -> DataFrame:
    """All repairs in order.

    The deduplicated table is written once: the fits of imputation and winsorising then read single columns
    of it instead of repeating the deduplication.
    """
    typed = df.transform(keep_latest).transform(apply_ordinal_rules).transform(coerce_types)
    return (
        materialize(typed, "typed")
        .transform(impute)
        .transform(lambda d: blank_to_unknown(d, allow_custom=allow_custom))
        .transform(lambda d: repair_timestamps(d, strict))
        .transform(winsorize)
        .transform(trim_strings)
    )


def cleaning_ledger(df: DataFrame, fill: dict[str, str]) -> DataFrame:
    """Rows touched per step, from change flags in one aggregate over the table.

    Levels outside their bounds are counted after parsing. Type enforcement and trimming go over whole columns, so they count all
    rows if there is a column to change. Duplicate rows and winsorised rows need a grouped count and a quantile; both are pre-aggregated.
    """
    late_resolve = _before("resolved_at", "opened_at")
    resolved = F.when(late_resolve, F.col("opened_at") + F.expr(RESOLVE_OFFSET)).otherwise(F.col("resolved_at"))
    flags = {
        ("Missing Value Imputation", c): F.col(c).isNull() for c in fill
    } | {
        ("Domain Catalog Validation", c): is_blank(F.col(c)) for c in ("category", "assignment_group")
    } | {
        ("Timestamp Progression Correction", "resolved_at"): late_resolve,
        ("Timestamp Progression Correction", "closed_at"): F.coalesce(F.col("closed_at") < resolved, F.lit(False)),
    }
    for c, (words, default, low, high) in ORDINAL_RULES.items():
        raw = c if c in df.columns else f"{c}_raw"
        if raw in df.columns:
            level = parse_ordinal(F.col(raw), words, default, isinstance(df.schema[raw].dataType, NumericType))
            flags["Business Rule Enforcement", c] = (level < low) | (level > high)
    typed = coerce_types(df).schema
    retyped = [f.name for f in df.schema.fields if f.name not in ORDINAL_RULES and typed[f.name].dataType != f.dataType]
    if retyped:
        flags["Data Type Enforcement", ", ".join(retyped)] = F.lit(True)
    if any(isinstance(f.dataType, StringType) for f in df.schema.fields):
        flags["String Normalization", "ALL_STRINGS"] = F.lit(True)
    steps = list(flags)
    counted = df.agg(*[F.count_if(flags[s]).alias(f"c{i}") for i, s in enumerate(steps)])
    rows = F.inline(
        F.array(*[
            F.struct(F.lit(s).alias("step"), F.lit(c).alias("affected_column"), F.col(f"c{i}").alias("records_modified"))
            for i, (s, c) in enumerate(steps)
        ])
    )
    out = counted.select(rows)
    dups = df.groupBy("number").agg(F.count(F.lit(1)).alias("c")).agg(
        F.lit("Duplicate Removal").alias("step"), F.lit("number").alias("affected_column"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("bigint").alias("records_modified"),
    )
    out = out.unionByName(dups)
    names = [c for c in WINSOR_CAPS if c in df.columns]
    if names:
        ranked = ranked_values(df, names)
        q = quantiles(ranked, {"q99": 0.99})
        limit = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(float(WINSOR_CAPS[c])))])[F.col("name")]
        usable = (F.col("q99") >= WINSOR_FLOOR) & (F.col("q99") <= limit)
        caps = q.select("name", F.when(usable, F.col("q99")).otherwise(limit).alias("cap"))
        over = ranked.join(caps, "name").groupBy("name").agg(
            F.coalesce(F.sum(F.when(F.col("value") > F.col("cap"), F.col("cnt"))), F.lit(0)).alias("records_modified")
        )
        out = out.unionByName(over.select(
            F.lit("Outlier Winsorization").alias("step"), F.col("name").alias("affected_column"), "records_modified"
        ))
    return out.filter(F.col("records_modified") > 0)
