import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opsloom.functions.lookup import lookup_join
from opsloom.functions.order_stats import quantiles, ranked_values, range_edges, values_at
from opsloom.operators import encode as N, profile as P, split as X
from opsloom.sources import snapshots as V

PROBS = {"a": 0.0, "q1": 0.25, "med": 0.5, "q3": 0.75, "q99": 0.99, "z": 1.0}


@pytest.mark.parametrize("bucket_rows", [1_000_000, 50])
def test_quantiles_match_pandas(spark, bucket_rows):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": np.where(rng.random(3000) < 0.34, 7.0, rng.normal(size=3000)), "y": rng.integers(0, 9, 3000).astype(float)})
    pdf.loc[::17, "x"] = None
    got = {r["name"]: r for r in quantiles(ranked_values(spark.createDataFrame(pdf), ["x", "y"], bucket_rows), PROBS).collect()}
    for c in "xy":
        for label, p in PROBS.items():
            assert got[c][label] == pytest.approx(pdf[c].quantile(p))


def test_edges_split_the_work(spark):
    edges = range_edges(spark.range(10_000).select(F.col("id").cast("double").alias("v")), ["v"], 1000)["v"]
    assert 5 <= len(edges) <= 12
    assert values_at(spark.range(10_000), F.col("id"), [4321, 10_000], rows_per_bucket=1000) == {4321: (4321.0, 4321), 10_000: None}


def test_numeric_profile_matches_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"v": rng.exponential(size=500)})
    r = P.numeric_profile(spark.createDataFrame(pdf), ["v"], rows_per_bucket=40).first()
    s = pdf["v"]
    assert r["skewness"] == pytest.approx(s.skew(), abs=1e-4) and r["kurtosis"] == pytest.approx(s.kurtosis(), abs=1e-4)
    iqr = s.quantile(0.75) - s.quantile(0.25)
    want = ((s < s.quantile(0.25) - 1.5 * iqr) | (s > s.quantile(0.75) + 1.5 * iqr)).sum()
    assert r["outlier_count_iqr"] == want and r["std"] == pytest.approx(s.std(), abs=1e-4)


def test_tiny_profiles_do_not_fail(rows):
    for data in ([], [("a", 1.0, True)]):
        df = rows(data, "assignment_group string, resolution_time_hours double, made_sla boolean")
        P.class_imbalance(df, ["assignment_group"]).collect()
        P.numeric_profile(df, ["resolution_time_hours"]).collect()
        P.missing_report(df).collect()
        P.boolean_profile(df).collect()


@pytest.mark.parametrize("bucket_rows", [1_000_000, 20])
def test_spearman_matches_pandas(spark, bucket_rows):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.integers(0, 5, 400), "b": rng.normal(size=400), "k": 1})
    pdf["c"] = pdf["a"] * 2 + rng.normal(size=400)
    got = {(r["column_a"], r["column_b"]): r["spearman"] for r in P.spearman_pairs(spark.createDataFrame(pdf), ["a", "b", "c", "k"], bucket_rows).collect()}
    want = pdf.corr(method="spearman") if False else pdf[["a", "b", "c"]].rank().corr()
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (a, b), v in got.items():
        assert v == pytest.approx(want.loc[a, b], abs=1e-4)


def test_class_imbalance_counts_missing(rows):
    r = P.class_imbalance(rows([("x",)] * 6 + [("y",)] * 2 + [(None,)] * 2, "g string"), ["g"]).first()
    assert r["majority_class"] == "x" and r["majority_percentage"] == 60.0 and r["imbalance_ratio"] == 3.0
    assert r["shannon_entropy"] == pytest.approx(-(0.6 * np.log2(0.6) + 0.2 * np.log2(0.2)), abs=1e-4)


def tickets(rows, n=30):
    data = [(f"INC{i:03d}", dt.datetime(2026, 1, 1) + dt.timedelta(hours=i // 3), f"G{i % 3}") for i in range(n)]
    return rows(data, "number string, opened_at timestamp_ntz, assignment_group string")


@pytest.mark.parametrize("strategy", ["random", "stratified", "time_based"])
def test_splits_are_disjoint(rows, strategy):
    df = X.split(tickets(rows), strategy)
    assert df.count() == 30
    assert X.leakage_check(df).first()["status"] == "PASS_ZERO_LEAKAGE"


def test_stratified_sizes(rows):
    got = {(r["assignment_group"], r["split"]): r["count"] for r in X.split(tickets(rows), "stratified").groupBy("assignment_group", "split").count().collect()}
    assert all(got[(f"G{i}", "train")] == 7 and got[(f"G{i}", "val")] == 1 and got[(f"G{i}", "test")] == 2 for i in range(3))


def test_time_order(rows):
    df = X.split(tickets(rows), "time_based").groupBy("split").agg(F.min("opened_at").alias("a"), F.max("opened_at").alias("b"), F.count("*").alias("n"))
    out = {r["split"]: r for r in df.collect()}
    assert out["train"]["b"] <= out["val"]["a"] and out["val"]["b"] <= out["test"]["a"]
    assert (out["train"]["n"], out["val"]["n"], out["test"]["n"]) == (21, 4, 5)


def test_time_split_with_one_hot_moment(spark):
    at = F.when(F.col("id") < 2000, F.lit("2026-01-01")).otherwise(F.lit("2026-01-02")).cast("timestamp_ntz")
    df = spark.range(6000).select(F.concat(F.lit("T"), F.col("id")).alias("number"), at.alias("opened_at"))
    out = {r["split"]: r["count"] for r in X.time_split(df).groupBy("split").count().collect()}
    assert out == {"train": 4200, "val": 900, "test": 900}


@pytest.mark.parametrize("n,want", [(2, {"train": 1, "test": 1}), (4, {"train": 2, "test": 2}), (7, {"train": 4, "val": 1, "test": 2})])
def test_time_split_of_tiny_tables(rows, n, want):
    assert {r["split"]: r["count"] for r in X.time_split(tickets(rows, n)).groupBy("split").count().collect()} == want


def test_rare_and_constant_targets(rows):
    df = tickets(rows).unionByName(rows([("R1", dt.datetime(2026, 2, 1), "tiny")], "number string, opened_at timestamp_ntz, assignment_group string"))
    assert X.split(df, "stratified").filter("assignment_group = 'Rare / Other'").count() == 1
    one = df.withColumn("assignment_group", F.lit("same"))
    assert X.split(one, "stratified").count() == 31


def test_overlap_is_found(rows):
    df = rows([("a", "train"), ("a", "val"), ("b", "test")], "number string, split string")
    r = X.leakage_check(df).first()
    assert r["train_val_overlap"] == 1 and r["status"] == "FAIL_LEAKAGE_DETECTED"
    with pytest.raises(ValueError):
        X.assert_no_leakage(df)
    with pytest.raises(ValueError):
        X.check_ratios((0.5, 0.1, 0.1))


def test_frequency_encoder(rows):
    train = rows([("1", "A"), ("2", "A"), ("3", "B"), ("4", None)], "number string, category string")
    fitted = N.fit_frequency(train, ["category"])
    out = N.apply_frequency(rows([("1", "A"), ("2", "new"), ("3", None)], "number string, category string"), fitted)
    assert {r["number"]: r["category"] for r in out.collect()} == {"1": 0.5, "2": 0.0001, "3": 0.25}


def test_target_encoder(rows):
    train = rows([("1", "A", 1.0), ("2", "A", 3.0), ("3", "B", 8.0)], "number string, c string, y double")
    out = {r["number"]: r["c"] for r in N.target_encode(rows([("1", "A"), ("9", "Z")], "number string, c string"), train, ["c"], F.col("y")).collect()}
    assert out["1"] == pytest.approx((4 + 10 * 4) / 12) and out["9"] == pytest.approx(4.0)


def test_lookup_join_keeps_its_small_side(spark):
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    look = spark.range(9000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lookup_join(df, look, ["k"])
        assert "explode" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 9000 and out.filter("v != 2 * k").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_versions(rows, tmp_path):
    base = str(tmp_path / "store")
    df = rows([("a", 1), ("b", 2)], "number string, n int")
    assert V.save_version(df, base) == 1 and V.save_version(df.limit(1), base, seed=7) == 2
    with pytest.raises(Exception):
        V.save_version(df, base, version=1)
    out = {r["version"]: (r["rows"], r["columns"], r["seed"]) for r in V.history(df.sparkSession, base).collect()}
    assert out == {1: (2, 2, 42), 2: (1, 2, 7)}
    assert V.save_version(df, base, file_format="csv") == 3
    assert sorted(map(tuple, V.load_version(df.sparkSession, base, 3, df.schema).collect())) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, V.load_version(df.sparkSession, base, 1).collect())) == [("a", 1), ("b", 2)]


def test_class_targets(spark):
    from collections import Counter

    import numpy as np

    from opsloom.operators import encode as N

    rows = [(i, "hot" if i % 3 else f"c{i % 7}", None if i % 11 == 0 else f"k{(i * i) % 4}", (i * 2654435761) % 2**32) for i in range(400)]
    df = spark.createDataFrame(rows, "number int, c string, k string, h bigint")
    classes, fitted = N.class_shares(df, "c", "k", smoothing=5.0)
    name = lambda v: v or "UNKNOWN"
    assert classes == sorted({name(k) for _, _, k, _ in rows})
    total, of = Counter(name(k) for _, _, k, _ in rows), Counter((c, name(k)) for _, c, k, _ in rows)
    n = Counter(c for _, c, _, _ in rows)
    unseen = spark.createDataFrame([(900, "new"), (901, "hot")], "number int, c string")
    got = {r["number"]: r["c_te"] for r in N.target_encode_classes(unseen, fitted, "c").collect()}
    assert np.allclose(got[900], [total[k] / 400 for k in classes])
    assert np.allclose(got[901], [(of["hot", k] + 5 * total[k] / 400) / (n["hot"] + 5) for k in classes])
    names, ordered = N.target_encode_classes_ordered(df, "c", "k", F.col("h"), smoothing=5.0, buckets=16)
    place = {i: (h * 16) // 2**32 for i, _, _, h in rows}
    out = {r["number"]: r["c_te"] for r in ordered.collect()}
    assert names == classes and len(out) == 400
    for i, c, _, _ in rows:
        before = [(x, name(k)) for j, x, k, _ in rows if place[j] < place[i]]
        prior = [sum(k == y for _, k in before) / len(before) if before else 1 / len(classes) for y in classes]
        own = [k for x, k in before if x == c]
        assert np.allclose(out[i], [(own.count(y) + 5 * p) / (len(own) + 5) for y, p in zip(classes, prior)])
