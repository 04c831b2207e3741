"""Profiling aggregates. Columns are profiled together in one pass; values are counted before they are ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, NumericType

from opsloom.functions.order_stats import ROWS_PER_BUCKET, average_rank, quantiles, ranked_values, running_totals, range_edges, value_at_rank, weighted_corr, with_bucket
from opsloom.operators.text import (
    TOKEN_BUDGET, char_count, normalize, tokens_by_chars, tokens_by_chars_int, tokens_by_words, word_count,
)
from opsloom.schema import POLICY, POST_RESOLUTION_COLUMNS, allowed_missing, columns_in_tier

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
IQR_FACTOR = 1.5
CORRELATION_COLUMNS = ("priority", "business_impact", "urgency", "resolution_time_hours", "reassignment_count")


def rows_of(one_row: DataFrame, cells: list[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per struct of ``cells``."""
    return one_row.select(F.inline(F.array(*cells)))


def percent(part: Column, whole: Column, digits: int) -> Column:
    return F.when(whole > 0, F.round(part * F.lit(100.0) / whole, digits)).otherwise(F.lit(0.0))


def dataset_summary(df: DataFrame, key: str = "number", target: str = "assignment_group") -> DataFrame:
    keyed = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col(target).isNull()).alias("m"))
    total = F.coalesce(F.sum("c"), F.lit(0))
    dups = total - F.count(F.lit(1))
    return keyed.agg(
        total.alias("total_records"), F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        dups.alias("duplicate_key_count"), percent(dups, total, 4).alias("duplicate_percentage"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("target_missing_count"),
    )


def missing_report(df: DataFrame) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in df.columns])
    cells = []
    for c in df.columns:
        missing, limit = F.col(f"m_{c}"), F.lit(float(allowed_missing(c)))
        exact = F.when(F.col("n") > 0, missing * F.lit(100.0) / F.col("n")).otherwise(F.lit(0.0))
        cells.append(F.struct(
            F.lit(c).alias("column_name"), missing.alias("missing_count"),
            F.round(exact, 2).alias("missing_percentage"), limit.alias("expected_max_percentage"),
            F.when(exact <= limit, "PASS").otherwise("EXCEEDS_THRESHOLD").alias("status"),
        ))
    return rows_of(one, cells)


def duplicate_stats(df: DataFrame, key: str = "number") -> DataFrame:
    """Exact copies and repeated keys. Whole rows are compared by a 256-bit digest, so only digests move."""
    digest = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    repeats = lambda d: d.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("u"))
    copies = repeats(df.select(digest.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("c")))
    keys = repeats(df.groupBy(key).agg(F.count(F.lit(1)).alias("c")))
    rows = lambda d, kind: d.select(
        F.lit(kind).alias("kind"), F.coalesce(F.col("n") - F.col("u"), F.lit(0)).alias("duplicate_count"),
        percent(F.col("n") - F.col("u"), F.coalesce(F.col("n"), F.lit(0)), 4).alias("duplicate_pct"),
    )
    return rows(copies, "exact_row").unionByName(rows(keys, "key"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, value, cnt)`` of string values, NULL included, in one shuffle with map-side counts."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells))).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))


def top_values(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent values per column; Spark trims to n per map task before the shuffle."""
    w = Window.partitionBy("column_name").orderBy(F.col("cnt").desc(), "value")
    return (
        counts.filter(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(w).cast("bigint"))
        .filter(F.col("rank") <= n)
    )


def cardinality(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    counts = value_counts(df, columns)
    stats = counts.groupBy("column_name").agg(
        F.count("value").alias("unique_count"), F.sum("cnt").alias("n")
    ).select("column_name", "unique_count", F.round(F.col("unique_count") / F.col("n"), 4).alias("cardinality_ratio"))
    best = top_values(counts, top).select("column_name", "rank", F.col("value").alias("top_value"), F.col("cnt").alias("top_count"))
    return best.join(stats, "column_name")


def categorical_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values, entropy and Gini impurity over non-null rows, from sums of counts alone."""
    c = F.col("cnt").cast("double")
    n, logs, squares = F.sum(c), F.sum(c * F.log2(c)), F.sum(c * c)
    return value_counts(df, columns).filter(F.col("value").isNotNull()).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.round(F.log2(n) - logs / n, 4).alias("shannon_entropy"),
        F.round(1 - squares / (n * n), 4).alias("gini_impurity"),
    )


def class_imbalance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Balance of target columns; shares are of all rows, so missing labels count in the denominator."""
    known = F.col("value").isNotNull()
    c = F.when(known, F.col("cnt").cast("double"))
    agg = value_counts(df, columns).groupBy("column_name").agg(
        F.sum(F.col("cnt").cast("double")).alias("n"), F.sum(c).alias("k"), F.count(F.when(known, 1)).alias("unique_classes"),
        F.sum(c * F.log2(c)).alias("logs"), F.sum(c * c).alias("squares"),
        F.min(F.when(known, F.struct((-F.col("cnt")).alias("o"), "value", "cnt"))).alias("major"),
        F.max(F.when(known, F.struct((-F.col("cnt")).alias("o"), "value", "cnt"))).alias("minor"),
    )
    entropy = (F.col("k") * F.log2("n") - F.col("logs")) / F.col("n")
    classes = F.col("unique_classes")
    ceiling = F.when(classes > 1, F.log2(classes.cast("double"))).otherwise(F.lit(1.0))
    return agg.select(
        "column_name", "unique_classes", F.col("major.value").alias("majority_class"),
        F.round(F.col("major.cnt") * 100.0 / F.col("n"), 2).alias("majority_percentage"),
        F.col("minor.value").alias("minority_class"),
        F.round(F.col("minor.cnt") * 100.0 / F.col("n"), 2).alias("minority_percentage"),
        F.round(F.col("major.cnt") / F.col("minor.cnt"), 2).alias("imbalance_ratio"),
        F.round(entropy, 4).alias("shannon_entropy"), F.round(entropy / ceiling, 4).alias("normalized_entropy"),
        F.round(1 - F.col("squares") / (F.col("n") * F.col("n")), 4).alias("gini_impurity"),
    )


def numeric_profile(df: DataFrame, columns: list[str], rows_per_bucket: int = ROWS_PER_BUCKET, rows: int | None = None) -> DataFrame:
    """Moments, exact quartiles and IQR outliers per column. Skew and kurtosis are bias-corrected."""
    cells = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]
    v = F.col("value")
    moments = df.select(F.inline(F.array(*cells))).filter(v.isNotNull()).groupBy("name").agg(
        F.avg(v).alias("mean"), F.stddev(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.skewness(v).alias("g"), F.kurtosis(v).alias("k"),
    )
    ranked = ranked_values(df, columns, rows_per_bucket, rows)
    quart = quantiles(ranked, QUARTILES).withColumn("iqr", F.col("q75") - F.col("q25"))
    outside = (v < F.col("q25") - IQR_FACTOR * F.col("iqr")) | (v > F.col("q75") + IQR_FACTOR * F.col("iqr"))
    outliers = ranked.join(quart, "name").groupBy("name").agg(
        F.coalesce(F.sum(F.when(outside, F.col("cnt"))), F.lit(0)).alias("outlier_count_iqr")
    )
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g")).otherwise(F.lit(0.0))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6)).otherwise(F.lit(0.0))
    r4 = lambda c: F.round(F.col(c), 4).alias(c)
    return moments.join(quart, "name").join(outliers, "name").select(
        F.col("name").alias("column_name"), r4("mean"), r4("std"), r4("min"), r4("q25"), r4("median"), r4("q75"),
        r4("max"), F.round(skew, 4).alias("skewness"), F.round(kurt, 4).alias("kurtosis"), r4("iqr"),
        "outlier_count_iqr", F.round(F.col("outlier_count_iqr") * 100.0 / n, 2).alias("outlier_percentage"),
    )


def boolean_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, BooleanType)]
    one = df.agg(*[x for c in columns for x in (F.count_if(F.col(c)).alias(f"t_{c}"), F.count_if(~F.col(c)).alias(f"f_{c}"))])
    cells = []
    for c in columns:
        t, f = F.col(f"t_{c}"), F.col(f"f_{c}")
        cells.append(F.struct(
            F.lit(c).alias("column_name"), t.alias("true_count"), f.alias("false_count"),
            percent(t, t + f, 2).alias("true_percentage"), percent(f, t + f, 2).alias("false_percentage"),
        ))
    return rows_of(one, cells).filter(F.col("true_count") + F.col("false_count") > 0)


def datetime_span(df: DataFrame, column: str) -> DataFrame:
    lo, hi = F.min(column), F.max(column)
    micros = F.timestamp_diff("MICROSECOND", F.col("lo"), F.col("hi"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return df.agg(lo.alias("lo"), hi.alias("hi")).select(
        F.lit(column).alias("column_name"), F.date_format("lo", fmt).alias("min_timestamp"),
        F.date_format("hi", fmt).alias("max_timestamp"), F.round(micros / F.lit(86400e6), 2).alias("span_days"),
    )


def arrival_histogram(df: DataFrame, column: str) -> DataFrame:
    """Counts per hour (0-23) and weekday (0-6, Monday first) with zeros, in one aggregate of 31 counters."""
    slots = [("hour", F.hour(column), i) for i in range(24)] + [("weekday", F.weekday(column), i) for i in range(7)]
    one = df.agg(*[F.count_if(part == i).alias(f"{kind}_{i}") for kind, part, i in slots])
    return rows_of(one, [
        F.struct(F.lit(kind).alias("part"), F.lit(i).cast("bigint").alias("slot"), F.col(f"{kind}_{i}").alias("tickets"))
        for kind, _, i in slots
    ])


def text_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Length statistics with missing text counted as empty."""
    measures = {"chars": char_count, "words": word_count, "tokens": tokens_by_chars_int}
    aggs = [F.count(F.lit(1)).alias("n")]
    wide = df.select([f(F.col(c)).alias(f"{m}_{c}") for c in columns for m, f in measures.items()])
    for c in columns:
        for m in measures:
            aggs += [F.avg(f"{m}_{c}").alias(f"avg_{m}_{c}"), F.max(f"{m}_{c}").alias(f"max_{m}_{c}")]
        aggs.append(F.count_if(F.col(f"tokens_{c}") > TOKEN_BUDGET).alias(f"over_{c}"))
    names = {"chars": "char_length", "words": "word_count", "tokens": "token_estimate"}
    cells = []
    for c in columns:
        fields = [F.lit(c).alias("column_name")]
        for m, label in names.items():
            fields += [F.round(F.col(f"avg_{m}_{c}"), 2).alias(f"mean_{label}"), F.col(f"max_{m}_{c}").cast("bigint").alias(f"max_{label}")]
        fields += [F.col(f"over_{c}").alias("exceeds_256_tokens_count"), percent(F.col(f"over_{c}"), F.col("n"), 2).alias("exceeds_256_tokens_percentage")]
        cells.append(F.struct(*fields))
    return rows_of(wide.agg(*aggs), cells)


def text_readiness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Length statistics over present texts with the fractional token estimate."""
    aggs, cells = [], []
    for c in columns:
        size, tokens = F.length(c), tokens_by_chars(F.col(c))
        aggs += [
            F.count(c).alias(f"n_{c}"), F.min(size).alias(f"min_{c}"), F.avg(size).alias(f"avg_{c}"), F.max(size).alias(f"max_{c}"),
            F.avg(tokens).alias(f"tavg_{c}"), F.max(tokens).alias(f"tmax_{c}"), F.count_if(tokens > TOKEN_BUDGET).alias(f"over_{c}"),
        ]
        zero = lambda x, d: F.coalesce(F.round(x.cast("double"), d), F.lit(0.0))
        cells.append(F.struct(
            F.lit(c).alias("column_name"), zero(F.col(f"min_{c}"), 2).alias("char_min"), zero(F.col(f"avg_{c}"), 2).alias("char_avg"),
            zero(F.col(f"max_{c}"), 2).alias("char_max"), zero(F.col(f"tavg_{c}"), 1).alias("est_token_avg"),
            zero(F.col(f"tmax_{c}"), 1).alias("est_token_max"),
            percent(F.col(f"over_{c}"), F.col(f"n_{c}"), 2).alias("exceeds_256_tokens_pct"),
        ))
    return rows_of(df.agg(*aggs), cells)


def text_reduction(df: DataFrame, columns: list[str], unicode_form: bool = True) -> DataFrame:
    """Effect of normalisation per text column."""
    aggs, cells = [], []
    pairs = {c: (F.coalesce(F.col(c), F.lit("Not Provided")), normalize(F.col(c), unicode_form=unicode_form)) for c in columns}
    wide = df.select([f(x).alias(f"{m}_{side}_{c}") for c, pair in pairs.items() for side, x in zip(("raw", "clean"), pair)
                      for m, f in (("w", word_count), ("t", tokens_by_words))])
    for c in columns:
        for side in ("raw", "clean"):
            aggs += [
                F.avg(f"w_{side}_{c}").alias(f"w_{side}_{c}"), F.sum(f"w_{side}_{c}").alias(f"s_{side}_{c}"),
                F.avg(f"t_{side}_{c}").alias(f"t_{side}_{c}"),
                F.count_if(F.col(f"t_{side}_{c}") > TOKEN_BUDGET).alias(f"o_{side}_{c}"),
            ]
        r2 = lambda m, side: F.round(F.col(f"{m}_{side}_{c}"), 2)
        before, after = F.col(f"s_raw_{c}"), F.col(f"s_clean_{c}")
        cells.append(F.struct(
            F.lit(c).alias("column_name"), r2("w", "raw").alias("raw_mean_words"), r2("w", "clean").alias("clean_mean_words"),
            F.round((before - after) * F.lit(100.0) / F.greatest(before, F.lit(1)), 2).alias("word_reduction_percentage"),
            r2("t", "raw").alias("raw_mean_tokens_est"), r2("t", "clean").alias("clean_mean_tokens_est"),
            F.col(f"o_raw_{c}").alias("raw_exceeds_max_tokens"), F.col(f"o_clean_{c}").alias("clean_exceeds_max_tokens"),
            F.when(F.col(f"o_clean_{c}") == 0, "PASS_OPTIMIZED").otherwise("WARNING_TRUNCATION_REQUIRED").alias("status"),
        ))
    return rows_of(wide.agg(*aggs), cells)


def _pairs(columns) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def pearson_pairs(df: DataFrame, columns=CORRELATION_COLUMNS) -> DataFrame:
    """Pairwise-complete Pearson correlation of every pair in one aggregate."""
    columns = [c for c in columns if c in df.columns]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in _pairs(columns)])
    return rows_of(one, [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.round(F.col(f"`{a}|{b}`"), 4).alias("pearson"))
        for a, b in _pairs(columns)
    ])


def top_pairs(pairs: DataFrame, n: int = 5) -> DataFrame:
    return pairs.filter(F.col("pearson").isNotNull()).orderBy(F.abs("pearson").desc(), "column_a", "column_b").limit(n)


def spearman_pairs(df: DataFrame, columns: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rank correlation of every pair over rows complete in all columns; constant columns are left out.

    Rows are collapsed to distinct combinations first; ranks are exact and tie-averaged.
    """
    spread = df.agg(F.count(F.lit(1)).alias("__n"), *[(F.min(c) != F.max(c)).alias(c) for c in columns]).first()
    columns = [c for c in columns if spread[c]]
    combos = df.select([F.col(c).cast("double").alias(c) for c in columns]).dropna().groupBy(*columns).agg(
        F.count(F.lit(1)).alias("w")
    )
    edges = range_edges(combos, columns, rows_per_bucket, spread["__n"])
    for c in columns:
        combos = with_bucket(combos, c, edges[c], f"__b_{c}")
    cells = [F.struct(F.lit(c).alias("name"), F.col(f"__b_{c}").alias("bucket"), F.col(c).alias("value")) for c in columns]
    long = combos.select(F.struct(*columns).alias("combo"), "w", F.inline(F.array(*cells)))
    counts = long.groupBy("name", "bucket", "value").agg(F.sum("w").alias("cnt"))
    ranks = running_totals(counts, ["name"], "value", ["cnt"]).select(
        "name", "value", (average_rank() - (F.col("cnt_total") + 1) / 2).alias("r")
    )
    ranked = long.join(ranks, ["name", "value"]).groupBy("combo", "w").agg(
        *[F.max(F.when(F.col("name") == c, F.col("r"))).alias(f"r_{c}") for c in columns]
    )
    one = ranked.agg(*[
        weighted_corr(F.col(f"r_{a}"), F.col(f"r_{b}"), F.col("w")).alias(f"{a}|{b}") for a, b in _pairs(columns)
    ])
    return rows_of(one, [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.round(F.col(f"`{a}|{b}`"), 4).alias("spearman"))
        for a, b in _pairs(columns)
    ])


def priority_sla_pivot(df: DataFrame) -> DataFrame:
    known = df.filter(F.col("made_sla").isNotNull() & F.col("priority").isNotNull())
    return known.groupBy("priority").agg(
        F.count_if(~F.col("made_sla")).alias("breached"), F.count_if(F.col("made_sla")).alias("met")
    )


def counts_by(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("tickets"))
    return counts.orderBy(F.col("tickets").desc(), column).limit(n) if n else counts


def share_and_median_by(df: DataFrame, key: str, value: str, flag: Column, rows_per_bucket: int = ROWS_PER_BUCKET, rows: int | None = None) -> DataFrame:
    """Per key: rows, share of flagged rows and exact median. Values are counted before they are ranked.

    ``rows`` may name an upper bound of the row count that is cheaper to get than counting ``df``.
    """
    v = df.select(key, F.col(value).cast("double").alias("value"), flag.cast("int").alias("flag"))
    bucketed = with_bucket(v, "value", range_edges(v, ["value"], rows_per_bucket, rows)["value"], "bucket")
    counts = bucketed.groupBy(key, "bucket", "value").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("cnt"), F.coalesce(F.sum("flag"), F.lit(0)).alias("flags"))
    # All three counters are totalled, so both uses of the counts share one shuffle.
    ranked = running_totals(counts, [key], "value", ["cnt", "rows", "flags"])
    middle = (value_at_rank(F.floor((F.col("cnt_total") - 1) / 2)) + value_at_rank(F.ceil((F.col("cnt_total") - 1) / 2))) / 2
    tickets, flags = F.max("rows_total"), F.max("flags_total")
    return ranked.groupBy(key).agg(
        tickets.alias("tickets"), F.round(flags * 100.0 / tickets, 2).alias("flag_pct"), F.round(middle, 4).alias("median"))


def histogram(df: DataFrame, value: Column, bins: int = 30) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last bin is closed."""
    v = df.select(value.cast("double").alias("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    span = ends.select(F.struct("lo", "hi")).scalar()
    lo, hi = span["lo"], span["hi"]
    width = (hi - lo) / bins
    slot = F.when(hi == lo, 0).otherwise(F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)))
    counts = v.filter(F.col("v").isNotNull()).groupBy(slot.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("tickets"))
    return counts.select("bin", F.round(lo + F.col("bin") * width, 4).alias("bin_start"), "tickets")


def distribution_summary(df: DataFrame, columns=("category", "assignment_group", "priority", "state")) -> DataFrame:
    """Counts per value of several columns, SLA share and mean hours as tidy rows."""
    columns = [c for c in columns if c in df.columns]
    counts = value_counts(df, columns).filter(F.col("value").isNotNull()).select(
        F.col("column_name").alias("measure"), F.col("value").alias("item"), F.col("cnt").cast("double").alias("amount")
    )
    share = F.coalesce(F.round(F.avg(F.col("made_sla").cast("double")) * 100, 2), F.lit(0.0))
    hours = F.coalesce(F.round(F.avg("resolution_time_hours"), 2), F.lit(0.0))
    one = df.agg(share.alias("s"), hours.alias("h"))
    return counts.unionByName(rows_of(one, [
        F.struct(F.lit("sla_compliance_rate_pct").alias("measure"), F.lit("all").alias("item"), F.col("s").alias("amount")),
        F.struct(F.lit("avg_resolution_time_hours").alias("measure"), F.lit("all").alias("item"), F.col("h").alias("amount")),
    ]))


# Thresholds of the preparation advice.
IMBALANCE_LIMIT, HIGH_CARDINALITY, LOW_CARDINALITY, MISSING_LIMIT = 5.0, 100, 20, 5.0
ADVICE_EXEMPT = ("number", "short_description", "description", "close_notes")


def preparation_advice(df: DataFrame, target: str = "assignment_group") -> DataFrame:
    """Advice rows ``(column_name, action)`` from the profile aggregates."""
    strings = [c for c, t in df.dtypes if t == "string"]
    leaks = [c for c in df.columns if c in POST_RESOLUTION_COLUMNS]
    imbalance = class_imbalance(df, [target]).filter(F.col("imbalance_ratio") > IMBALANCE_LIMIT).select(
        "column_name", F.lit("rebalance_classes").alias("action"))
    distinct = value_counts(df, [c for c in strings if c not in ADVICE_EXEMPT]).groupBy("column_name").agg(F.count("value").alias("u"))
    encode = distinct.select("column_name", F.when((F.col("u") > HIGH_CARDINALITY) & (F.col("column_name") != "caller"), "frequency_or_target_encode")
                             .when(F.col("u") <= LOW_CARDINALITY, "label_encode").alias("action")).filter(F.col("action").isNotNull())
    missing = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns if c not in POST_RESOLUTION_COLUMNS])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("share")) for c in missing.columns]
    gaps = rows_of(missing, cells).filter(F.col("share") * 100 > MISSING_LIMIT).select("column_name", F.lit("impute_unknown").alias("action"))
    out = imbalance.unionByName(encode).unionByName(gaps)
    if leaks:
        one = df.limit(1).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(rows_of(one, [F.struct(F.lit(c).alias("column_name"), F.lit("drop_leaky").alias("action")) for c in leaks]))
    if "description" in df.columns:
        over = text_readiness(df, ["description"]).filter(F.col("exceeds_256_tokens_pct") > 0)
        out = out.unionByName(over.select("column_name", F.lit("shorten_text").alias("action")))
    return out


def leakage_audit(df: DataFrame, target: str = "assignment_group") -> DataFrame:
    """One row per column: outcome-derived or safe at triage, and the declared tier."""
    one = df.limit(1).agg(F.count(F.lit(1)).alias("n"))
    cells = []
    for c in df.columns:
        if c in (target, "number"):
            continue
        kind = "leaky" if c in POST_RESOLUTION_COLUMNS else "safe"
        cells.append(F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("triage_class"),
                              F.lit(POLICY[c].leakage if c in POLICY else "undeclared").alias("tier")))
    return rows_of(one, cells)


def leakage_status(columns: list[str]) -> dict:
    blocked = [c for c in columns_in_tier("blocked") if c in columns]
    pure = [c for c in blocked if c not in ("assignment_group", "resolution_time_hours")]
    return {
        "status": "WARNING_LEAKAGE_DETECTED" if pure else "PASS_CLEAN_TRIAGE", "blocked": blocked, "pure": pure,
        "warning": [c for c in columns_in_tier("warning") if c in columns],
    }


def sla_trend(df: DataFrame, unit: str) -> DataFrame:
    """Tickets, SLA share and mean hours per day, week or month."""
    period = F.date_format(F.date_trunc(unit, F.col("opened_at")), "yyyy-MM-dd")
    return df.groupBy(F.lit(unit).alias("unit"), period.alias("period")).agg(
        F.count(F.lit(1)).alias("tickets"), F.round(F.avg(F.col("made_sla").cast("double")) * 100, 2).alias("sla_pct"),
        F.round(F.avg("resolution_time_hours"), 2).alias("mean_hours"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
