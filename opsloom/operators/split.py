"""Deterministic train / val / test splits. Order statistics decide thresholds; rows are then tagged locally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsloom.functions.lookup import lookup_join
from opsloom.functions.order_stats import values_at

# Shares, seed, smallest class kept, name of the merged class, balance tolerance.
RATIOS = (0.70, 0.15, 0.15)
SEED = 42
MIN_CLASS_ROWS = 3
RARE_CLASS = "Rare / Other"
BALANCE_TOLERANCE = 5.0
# Hex digits of the row hash that form a bucket: at most 16 ** 4 counts per class.
PREFIX = 4


def check_ratios(ratios=RATIOS) -> None:
    if abs(sum(ratios) - 1.0) >= 1e-5:
        raise ValueError("split ratios must sum to 1.0")


def row_hash(key: str = "number", seed: int = SEED) -> Column:
    """Repartition-proof pseudo-random order of the rows."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def random_split(df: DataFrame, key: str = "number", ratios=RATIOS, seed: int = SEED) -> DataFrame:
    """Tag rows by hash bucket; no shuffle."""
    check_ratios(ratios)
    bucket = F.conv(F.substring(row_hash(key, seed), 1, 8), 16, 10).cast("bigint")
    train, val = round(ratios[0] * 2**32), round((ratios[0] + ratios[1]) * 2**32)
    return df.withColumn("split", F.when(bucket < train, "train").when(bucket < val, "val").otherwise("test"))


def nth_hash(df: DataFrame, group: str, hashed: str, cuts: dict[str, Column]) -> DataFrame:
    """Per group and cut: the hash of the row at a 1-based rank that is a function of the group size ``n``.

    Hash prefixes are counted first. Only the rows of the one prefix that holds a cut are ordered, so the
    work of a hot group is spread evenly.
    """
    keyed = df.select(F.col(group), F.col(hashed).alias("k")).withColumn("p", F.substring("k", 1, PREFIX))
    counts = keyed.groupBy(group, "p").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(group)
    counts = counts.select(
        group, "p", "c", F.coalesce(F.sum("c").over(w.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"),
        F.sum("c").over(w).alias("n"),
    )
    cells = [F.struct(F.lit(name).alias("cut"), rank.cast("bigint").alias("m")) for name, rank in cuts.items()]
    bounds = (
        counts.select(group, "p", "c", "b", F.inline(F.array(*cells)))
        .filter((F.col("b") < F.col("m")) & (F.col("m") <= F.col("b") + F.col("c")))
        .select(F.col(group).alias("__g"), F.col("p").alias("__p"), "cut", (F.col("m") - F.col("b")).alias("pos"))
    )
    near = keyed.join(bounds, F.col(group).eqNullSafe(F.col("__g")) & (F.col("p") == F.col("__p")))
    order = Window.partitionBy(group, "cut").orderBy("k")
    hit = near.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") == F.col("pos"))
    return hit.groupBy(group).agg(*[F.max(F.when(F.col("cut") == name, F.col("k"))).alias(name) for name in cuts])


def _size_cuts(ratios) -> dict[str, Column]:
    n = F.col("n")
    train = F.floor(n * F.lit(ratios[0]))
    return {"to_train": train, "to_val": train + F.floor(n * F.lit(ratios[1]))}


def _tag(hashed: Column) -> Column:
    upto = lambda c: hashed <= F.coalesce(F.col(c), F.lit(""))
    return F.when(upto("to_train"), "train").when(upto("to_val"), "val").otherwise("test")


def group_rare_classes(df: DataFrame, target: str, key: str = "number", least: int = MIN_CLASS_ROWS) -> DataFrame:
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") < least)
    tagged = lookup_join(df, counts, [target])
    label = F.when(F.col("__n").isNotNull(), F.lit(RARE_CLASS)).otherwise(F.col(target))
    return tagged.withColumn(target, label).drop("__n").select(df.columns)


def stratified_split(df: DataFrame, target: str, key: str = "number", ratios=RATIOS, seed: int = SEED) -> DataFrame:
    """Same shares inside every class; rare classes are merged. A constant target falls back to random."""
    check_ratios(ratios)
    if target not in df.columns:
        return random_split(df, key, ratios, seed)
    ends = df.agg(F.min(target).alias("a"), F.max(target).alias("b")).first()
    if ends["a"] == ends["b"]:
        return random_split(df, key, ratios, seed)
    out = group_rare_classes(df, target, key).withColumn("__h", row_hash(key, seed)).withColumn(
        "__class", F.coalesce(F.col(target).cast("string"), F.lit(""))
    )
    cuts = nth_hash(out, "__class", "__h", _size_cuts(ratios))
    tagged = lookup_join(out, cuts, ["__class"])
    return tagged.withColumn("split", _tag(F.col("__h"))).select(*df.columns, "split")


def time_split(df: DataFrame, at: str = "opened_at", key: str = "number", ratios=RATIOS, seed: int = SEED) -> DataFrame:
    """First 70 % by time, next 15 %, rest. Equal times are ordered by row hash; missing times come last.

    Two order statistics give two boundary times and, inside a boundary time, a boundary hash. Rows are then
    tagged by comparison alone.
    """
    check_ratios(ratios)
    if at not in df.columns:
        return random_split(df, key, ratios, seed)
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    micros = F.coalesce(
        F.timestamp_diff("MICROSECOND", epoch, F.col(at).cast("timestamp_ntz")).cast("double"), F.lit(float("inf"))
    )
    timed = df.withColumns({"__t": micros, "__h": row_hash(key, seed), "__one": F.lit("")})
    n = timed.count()
    n_train, n_val = int(n * ratios[0]), int(n * ratios[1])
    cuts = {"val": n_train + n_val, "train": n_train}
    tag = F.lit("test")
    at_rank = values_at(timed, F.col("__t"), list(cuts.values()), n)
    for name, rank in cuts.items():
        found = at_rank[rank]
        if found is None:
            tag = F.lit(name)
            continue
        moment, before = found
        inside = F.col("__t") < moment
        if rank > before:
            ties = timed.filter(F.col("__t") == F.lit(moment))
            hit = nth_hash(ties, "__one", "__h", {"cut": F.lit(rank - before)}).first()
            inside = inside | ((F.col("__t") == moment) & (F.col("__h") <= hit["cut"]))
        tag = F.when(inside, F.lit(name)).otherwise(tag)
    return timed.withColumn("split", tag).drop("__t", "__h", "__one")


def split(df: DataFrame, strategy: str = "random", target: str = "assignment_group", **options) -> DataFrame:
    if strategy == "time_based":
        return time_split(df, **options)
    if strategy == "stratified":
        return stratified_split(df, target, **options)
    return random_split(df, **options)


def leakage_check(df: DataFrame, key: str = "number") -> DataFrame:
    """One row: how many keys occur in two splits, and the verdict. One shuffle with map-side combine."""
    seen = df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "val", "test")]
    )
    both = lambda a, b: F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0))
    one = seen.agg(
        both("train", "val").alias("train_val_overlap"), both("train", "test").alias("train_test_overlap"),
        both("val", "test").alias("val_test_overlap"),
    )
    total = F.col("train_val_overlap") + F.col("train_test_overlap") + F.col("val_test_overlap")
    return one.withColumn("status", F.when(total == 0, "PASS_ZERO_LEAKAGE").otherwise("FAIL_LEAKAGE_DETECTED"))


def assert_no_leakage(df: DataFrame, key: str = "number") -> DataFrame:
    if leakage_check(df, key).first()["status"] != "PASS_ZERO_LEAKAGE":
        raise ValueError("keys occur in more than one split")
    return df


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Share of every class per split and whether shares stay within the tolerance."""
    names = ("train", "val", "test")
    known = df.filter(F.col(target).isNotNull())
    counts = known.groupBy(F.col(target).cast("string").alias("class")).agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in names]
    )
    totals = counts.agg(*[F.sum(s).alias(s) for s in names]).select(F.struct(*names)).scalar()
    pct = counts.select("class", *[F.round(F.col(s) * 100.0 / F.greatest(totals[s], F.lit(1)), 2).alias(f"{s}_pct") for s in names])
    gap = F.greatest(F.abs(F.col("train_pct") - F.col("val_pct")), F.abs(F.col("train_pct") - F.col("test_pct")))
    return pct.withColumn("balance", F.when(gap < BALANCE_TOLERANCE, "BALANCED").otherwise("SKEWED_MONITOR"))
