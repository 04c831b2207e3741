"""Exact ranks and quantiles without ever sorting a whole column in one task.

Values are first collapsed to ``(value, count)`` with partial aggregation, so a value that holds a third of
all rows is one row. The collapsed values are then split into range buckets whose edges come from one
approximate-percentile pass; each bucket is ordered by itself and shifted by the total of the buckets before
it. The edges only decide where work is done, never the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 1024


def range_edges(df: DataFrame, cols: list[str], rows_per_bucket: int = ROWS_PER_BUCKET, rows: int | None = None) -> dict[str, list[float]]:
    """At most ``MAX_BUCKETS`` increasing edges per column; none when ``rows`` (counted if not given) fit one bucket."""
    want = min(MAX_BUCKETS, -(-(df.count() if rows is None else rows) // rows_per_bucket))
    if want <= 1:
        return {c: [] for c in cols}
    grid = ", ".join(f"{i / MAX_BUCKETS}D" for i in range(1, MAX_BUCKETS))
    row = df.agg(
        *[F.expr(f"percentile_approx(`{c}`, array({grid}), {10 * MAX_BUCKETS})").alias(c) for c in cols]
    ).first()
    step = max(1, MAX_BUCKETS // want)
    out = {}
    for c in cols:
        out[c] = sorted(set((row[c] or [])[step - 1 :: step]))
    return out


def with_bucket(df: DataFrame, col: str, edges: list[float], name: str) -> DataFrame:
    """Add the range bucket of a double column (binary search in the JVM)."""
    if not edges:
        return df.withColumn(name, F.lit(0.0))
    splits = [-float("inf"), *edges, float("inf")]
    return Bucketizer(splits=splits, inputCol=col, outputCol=name, handleInvalid="keep").transform(df)


def running_totals(counts: DataFrame, keys: list[str], value: str, weights: list[str], bucket: str = "bucket") -> DataFrame:
    """For rows unique on ``keys + value``: per weight the total over smaller values and over all values."""
    starts = counts.groupBy(*keys, bucket).agg(*[F.sum(w).alias(f"__t_{w}") for w in weights])
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        *keys,
        bucket,
        *[F.coalesce(F.sum(f"__t_{w}").over(before), F.lit(0)).alias(f"__s_{w}") for w in weights],
        *[F.sum(f"__t_{w}").over(by_key).alias(f"{w}_total") for w in weights],
    )
    inner = Window.partitionBy(*keys, bucket).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = counts.select(
        "*", *[F.coalesce(F.sum(w).over(inner), F.lit(0)).alias(f"__l_{w}") for w in weights]
    )
    joined = local.join(starts, [*keys, bucket])
    return joined.select(
        *counts.columns,
        *[(F.col(f"__l_{w}") + F.col(f"__s_{w}")).alias(f"{w}_before") for w in weights],
        *[F.col(f"{w}_total") for w in weights],
    )


def ranked_values(df: DataFrame, cols: list[str], rows_per_bucket: int = ROWS_PER_BUCKET, rows: int | None = None) -> DataFrame:
    """One row per ``(name, value)`` of numeric columns: ``cnt``, ``cnt_before`` and ``cnt_total`` (non-null)."""
    doubles = df.select([F.col(c).cast("double").alias(c) for c in cols])
    edges = range_edges(doubles, cols, rows_per_bucket, rows)
    for c in cols:
        doubles = with_bucket(doubles, c, edges[c], f"__b_{c}")
    cells = [
        F.struct(F.lit(c).alias("name"), F.col(f"__b_{c}").alias("bucket"), F.col(c).alias("value")) for c in cols
    ]
    counts = (
        doubles.select(F.inline(F.array(*cells)))
        .filter(F.col("value").isNotNull())
        .groupBy("name", "bucket", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return running_totals(counts, ["name"], "value", ["cnt"])


def value_at_rank(rank: Column) -> Column:
    """Aggregate: the value whose run of equal rows covers a 0-based rank."""
    hit = (F.col("cnt_before") <= rank) & (rank < F.col("cnt_before") + F.col("cnt"))
    return F.max(F.when(hit, F.col("value")))


def quantiles(ranked: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles, one row per ``name`` and one column per entry of ``probs``."""
    n1 = F.col("cnt_total") - 1
    aggs = []
    for label, p in probs.items():
        aggs.append(value_at_rank(F.floor(n1 * F.lit(p))).alias(f"__lo_{label}"))
        aggs.append(value_at_rank(F.ceil(n1 * F.lit(p))).alias(f"__hi_{label}"))
    wide = ranked.groupBy("name").agg(F.max("cnt_total").alias("n"), *aggs)
    out = []
    for label, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.col(f"__lo_{label}"), F.col(f"__hi_{label}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(label))
    return wide.select("name", "n", *out)


def values_at(df: DataFrame, key: Column, ranks: list[int], rows: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> dict:
    """Per 0-based rank in ascending order: the key there and how many rows have a smaller key; None past the end.

    Only the hit rows, at most one per rank, reach the driver.
    """
    ranked = ranked_values(df.select(key.cast("double").alias("key")), ["key"], rows_per_bucket, rows)
    covers = lambda r: (F.col("cnt_before") <= r) & (F.col("cnt_before") + F.col("cnt") > r)
    hits = ranked.filter(reduce(lambda a, b: a | b, [covers(r) for r in ranks])).select("value", "cnt_before", "cnt").collect()
    at = lambda r: next(((h["value"], h["cnt_before"]) for h in hits if h["cnt_before"] <= r < h["cnt_before"] + h["cnt"]), None)
    return {r: at(r) for r in ranks}


def average_rank() -> Column:
    """1-based rank of a value, ties averaged."""
    return F.col("cnt_before") + (F.col("cnt") + 1) / F.lit(2.0)


def weighted_corr(x: Column, y: Column, w: Column) -> Column:
    """Correlation of already centred columns."""
    return F.sum(w * x * y) / F.sqrt(F.sum(w * x * x) * F.sum(w * y * y))
