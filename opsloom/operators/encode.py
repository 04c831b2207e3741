"""Encoders: fit is an aggregate, apply is a lookup join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from opsloom.functions.lookup import lookup_join

# Defaults of the encoders.
MISSING_LABEL = "UNKNOWN"
UNSEEN_SHARE = 0.0001
SMOOTHING = 10.0
ORDER_BUCKETS = 256
SHARE_COLUMNS = ("assignment_group", "business_service", "vendor", "caller", "location")


def frequency_shares(df: DataFrame, column: str, fill: str | None = None) -> DataFrame:
    """``(column, share)``: one row per value, share of the non-null rows (of all rows with ``fill``)."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(fill)) if fill else F.col(column)
    counts = df.select(value.alias(column)).filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.agg(F.sum("__c").cast("double").alias("t")).scalar()
    return counts.select(column, (F.col("__c") / total).alias("share"))


def frequency_encode(df: DataFrame, columns=SHARE_COLUMNS, key: str = "number") -> DataFrame:
    """Add ``<column>_freq``, the share of the value in the whole table."""
    for c in [c for c in columns if c in df.columns]:
        shares = frequency_shares(df, c).withColumnRenamed("share", f"{c}_freq")
        df = lookup_join(df, shares, [c]).withColumn(f"{c}_freq", F.round(F.coalesce(f"{c}_freq", F.lit(0.0)), 4))
    return df


def apply_frequency(df: DataFrame, fitted: dict[str, DataFrame], key: str = "number") -> DataFrame:
    """Replace columns by shares fitted elsewhere; an unseen value gets the smallest share."""
    for c, shares in fitted.items():
        df = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LABEL)))
        df = lookup_join(df, shares.withColumnRenamed("share", "__s"), [c])
        df = df.withColumn(c, F.coalesce("__s", F.lit(UNSEEN_SHARE))).drop("__s")
    return df


def fit_frequency(train: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    return {c: frequency_shares(train, c, MISSING_LABEL) for c in columns}


def target_means(train: DataFrame, column: str, y: Column, smoothing: float = SMOOTHING) -> DataFrame:
    """``(column, value, global_mean)``: smoothed target mean per category."""
    rows = train.select(
        F.coalesce(F.col(column).cast("string"), F.lit(MISSING_LABEL)).alias(column), F.coalesce(y.cast("double"), F.lit(0.0)).alias("y")
    )
    stats = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    overall = stats.agg((F.sum("s") / F.sum("n")).alias("m")).scalar()
    return stats.select(
        column, ((F.col("s") + smoothing * overall) / (F.col("n") + smoothing)).alias("value"), overall.alias("global_mean")
    )


def target_encode(df: DataFrame, train: DataFrame, columns: list[str], y: Column, smoothing: float = SMOOTHING, key: str = "number") -> DataFrame:
    """Replace columns by smoothed target means fitted on ``train``; unseen categories get the global mean."""
    for c in columns:
        fitted = target_means(train, c, y, smoothing)
        overall = fitted.agg(F.max("global_mean")).scalar()
        df = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LABEL)))
        df = lookup_join(df, fitted.select(c, F.col("value").alias("__v")), [c])
        df = df.withColumn(c, F.coalesce("__v", overall)).drop("__v")
    return df


def target_encode_out_of_fold(df: DataFrame, column: str, y: Column, fold: Column, smoothing: float = SMOOTHING, key: str = "number") -> DataFrame:
    """Add ``<column>_te``: every row is encoded from the rows of the other folds only."""
    rows = df.withColumns({
        "__c": F.coalesce(F.col(column).cast("string"), F.lit(MISSING_LABEL)), "__f": fold, "__y": F.coalesce(y.cast("double"), F.lit(0.0)),
    })
    part = rows.groupBy("__c", "__f").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("s"))
    whole = part.groupBy("__c").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    folds = part.groupBy("__f").agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    total = part.agg(F.struct(F.sum("n").alias("n"), F.sum("s").alias("s"))).scalar()
    rest = total["n"] - F.col("fn")
    others = F.when(rest > 0, F.try_divide(total["s"] - F.col("fs"), rest)).otherwise(total["s"] / total["n"])  # a single fold has no others
    mean = part.join(whole, "__c").join(folds, "__f").select(
        "__c", "__f", ((F.col("ts") - F.col("s") + smoothing * others) / (F.col("tn") - F.col("n") + smoothing)).alias(f"{column}_te")
    )
    return lookup_join(rows, mean, ["__c", "__f"]).drop("__c", "__f", "__y")


def _labelled(df: DataFrame, column: str, target: str) -> DataFrame:
    """``df`` with the category ``__c`` and the class ``__k``, missing values named."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LABEL))
    return df.withColumns({"__c": name(column), "__k": name(target)})


def class_shares(train: DataFrame, column: str, target: str, smoothing: float = SMOOTHING) -> tuple[list[str], DataFrame]:
    """Classes in name order, and per category (``*``: any other) the smoothed share of every class, as one array."""
    counts = _labelled(train, column, target).groupBy("__c", "__k").agg(F.count(F.lit(1)).alias("n"))
    overall = {r["__k"]: r["n"] for r in counts.groupBy("__k").agg(F.sum("n").alias("n")).collect()}  # a row a class
    classes, total = sorted(overall), sum(overall.values())
    prior = F.array(*[F.lit(overall[k] / total) for k in classes]).cast("array<double>")
    by = counts.groupBy("__c").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("__k", "n"))).alias("of"))  # a row a class
    own = F.array(*[F.coalesce(F.element_at("of", F.lit(k)), F.lit(0)) for k in classes])
    shares = F.zip_with(own, prior, lambda n, p: (n + smoothing * p) / (F.col("n") + smoothing))
    fitted = by.filter(F.col("__c") != "*").select("__c", shares.alias("shares"))
    return classes, fitted.union(train.sparkSession.range(1).select(F.lit("*"), prior))


def target_encode_classes(df: DataFrame, fitted: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_te``: the class shares of the category, in the order of the classes; an unseen category has those of all rows."""
    rows = df.withColumn("__c", F.coalesce(F.col(column).cast("string"), F.lit(MISSING_LABEL)))
    prior = fitted.filter("__c = '*'").first()["shares"]
    out = lookup_join(rows, fitted.filter("__c <> '*'"), ["__c"])
    return out.withColumn(f"{column}_te", F.coalesce("shares", F.array(*[F.lit(x) for x in prior]))).drop("__c", "shares")


def target_encode_classes_ordered(train: DataFrame, column: str, target: str, order: Column, smoothing: float = SMOOTHING, buckets: int = ORDER_BUCKETS) -> tuple[list[str], DataFrame]:
    """Classes, and ``train`` with ``<column>_te``: class shares from earlier rows only, so no row sees its own class.

    ``order`` is a hash of the row below 2**32; its range is cut into buckets and a row is encoded from the rows of earlier
    buckets. Rows are counted per category, class and bucket first: a hot category is at most classes x buckets counts when
    it is added up, however many rows it holds. Without any earlier row all classes are equal.
    """
    rows = _labelled(train, column, target).withColumn("__b", F.floor(order * buckets / F.lit(2.0**32)).cast("int"))
    counts = rows.groupBy("__c", "__k", "__b").agg(F.count(F.lit(1)).alias("n"))
    every = counts.groupBy("__k", "__b").agg(F.sum("n").alias("n")).toPandas()  # classes x buckets
    classes = sorted(every["__k"].unique())
    place = {k: i for i, k in enumerate(classes)}

    def earlier(ks, bs, ns) -> np.ndarray:
        grid = np.zeros((buckets + 1, len(place)))
        np.add.at(grid, (np.asarray(bs) + 1, [place[k] for k in ks]), np.asarray(ns))
        return np.cumsum(grid, axis=0)[:buckets]

    whole = earlier(every["__k"], every["__b"], every["n"])
    seen = whole.sum(axis=1, keepdims=True)
    prior = np.where(seen > 0, whole / np.maximum(seen, 1), 1 / max(1, len(classes)))

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        own = earlier(pdf["__k"], pdf["__b"], pdf["n"])
        at = sorted(pdf["__b"].unique())
        shares = (own[at] + smoothing * prior[at]) / (own[at].sum(axis=1, keepdims=True) + smoothing)
        return pd.DataFrame({"__c": pdf["__c"].iloc[0], "__b": at, f"{column}_te": list(shares)})

    shares = counts.groupBy("__c").applyInPandas(add_up, f"__c string, __b int, {column}_te array<double>")
    return classes, lookup_join(rows, shares, ["__c", "__b"]).drop("__c", "__k", "__b")
