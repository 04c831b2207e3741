import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from opsloom.operators import artefacts as K, boosting as B, embed as E, models as M
from opsloom.operators.split import random_split
from opsloom.session import materialize, work_path

COLUMNS = "label bigint, is_val boolean, x array<double>"


def frame(spark, x, y, val):
    rows = [(int(a), bool(v), [float(z) for z in r]) for r, a, v in zip(x, y, val)]
    return materialize(spark.createDataFrame(rows, COLUMNS).select(array_to_vector("x").alias("features"), "label", "is_val"), "boost-test")


def local_fit(x, y, val, classes, rounds, depth, rate, l2=1.0, least=1.0):
    """The same boosting on arrays, written node by node."""
    edges = [np.unique(np.quantile(x[~val][:, i], np.linspace(0, 1, B.BINS + 1)[1:-1], method="inverted_cdf")) for i in range(x.shape[1])]
    share = np.array([(y[~val] == k).sum() + 1.0 for k in range(classes)])
    scores = np.tile(np.log(share / share.sum()), (len(x), 1))
    losses = []
    for _ in range(rounds):
        p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
        losses.append(-np.log(p[np.arange(len(y)), y][val]).mean())
        for k in range(classes):
            g, h = p[:, k] - (y == k), np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)

            def grow(rows, level):
                use = rows[~val[rows]]
                gt, ht = g[use].sum(), h[use].sum()
                best = (1e-9, None)
                for i, e in enumerate(edges if level < depth else []):
                    for cut in e:
                        left = use[x[use, i] <= cut]
                        gl, hl = g[left].sum(), h[left].sum()
                        if min(hl, ht - hl) >= least:
                            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                            if gain > best[0] + 1e-9:
                                best = (gain, (i, cut))
                if best[1] is None:
                    scores[rows, k] += -rate * gt / (ht + l2)
                else:
                    i, cut = best[1]
                    grow(rows[x[rows, i] <= cut], level + 1)
                    grow(rows[x[rows, i] > cut], level + 1)

            grow(np.arange(len(x)), 0)
    return scores, losses


def test_equals_the_same_boosting_on_arrays(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 4)), 2)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] * x[:, 0] > 0.3)
    val = np.arange(400) % 5 == 0
    model = B.fit_boosted(frame(spark, x, y, val), 3, rounds=11, depth=2, patience=99)
    scores, losses = local_fit(x, y, val, 3, 12, 2, 0.3)
    assert len(model.losses) == 12 and model.losses == pytest.approx(losses, rel=1e-3)
    assert model.losses[-1] < 0.6 * model.losses[0] and model.shares()[:2].sum() > 0.8


def test_equal_rows_are_counted_once(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, size=(3000, 3)).astype(float)  # 27 patterns
    y, val = rng.integers(0, 3, 3000), np.arange(3000) % 5 == 0
    rows = frame(spark, x, y, val)
    stored = B.blocks(rows, B.bin_edges(rows)).collect()
    assert sum(r["n"] for r in stored) == 27
    assert sum(np.frombuffer(r["rows"], np.int64).sum() for r in stored) == 3000
    model = B.fit_boosted(rows, 3, rounds=3, depth=2, patience=99)
    _, losses = local_fit(x, y, val, 3, 4, 2, 0.3)
    assert model.losses == pytest.approx(losses, rel=1e-6)


def test_early_stop_unseen_labels_and_empty_classes(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(300, 3)), rng.integers(0, 2, 300)
    val = np.arange(300) % 3 == 0
    y[val & (np.arange(300) % 2 == 0)] = 5  # a class the training rows lack
    model = B.fit_boosted(frame(spark, x, y, val), 4, rounds=30, depth=3)  # classes 2 and 3 have no rows
    assert len(model.rounds) == int(np.argmin(model.losses)) < 30
    p = np.array([r["p"] for r in model.transform(frame(spark, x, y, val)).select(vector_to_array("probability").alias("p")).collect()])
    assert p.shape == (300, 4) and p.sum(1) == pytest.approx(np.ones(300)) and (p[:, 2:] < 0.02).all()


@pytest.fixture(scope="module")
def tickets(spark):
    """Groups follow category and priority together, so no single split finds them."""
    i = F.col("id")
    df = spark.range(800).select(
        F.concat(F.lit("INC"), i).alias("number"), (F.lit("2026-01-01").cast("timestamp_ntz") + F.make_interval(hours=i)).alias("opened_at"),
        (i % 5 + 1).cast("int").alias("priority"), (i % 3 + 1).cast("int").alias("business_impact"), (i % 3 + 1).cast("int").alias("urgency"),
        F.concat(F.lit("cat"), i % 4).alias("category"), F.concat(F.lit("sub"), i % 6).alias("subcategory"), F.concat(F.lit("ci"), i % 10).alias("cmdb_ci"),
        F.lit("router failed").alias("short_description"), F.lit("text").alias("description"), (i % 7 == 0).alias("problem_flag"),
        F.when(i == 3, "G-only-once").otherwise(F.concat(F.lit("G"), (i % 4 + F.when(i % 5 > 2, 1).otherwise(0)) % 4)).alias("assignment_group"),
        ((i % 5) * 10 + 2).cast("double").alias("resolution_time_hours"),
    )
    return materialize(random_split(df).withColumn("split", F.when(i_is(3), "val").otherwise(F.col("split"))), "boost-tickets")


def i_is(n):
    return F.col("number") == f"INC{n}"


@pytest.fixture(scope="module")
def trained(tickets):
    return M.train_router(tickets, tree_counts=(5,), depth=3, rounds=25)


def test_boosting_beats_forest_and_baseline(trained, tickets):
    router, report = trained
    f1 = {r["model"]: r["f1_weighted"] for r in report.collect()}
    assert f1["boosted_trees"] > max(f1["random_forest_5"], f1["most_frequent"]) and isinstance(router.model, B.BoostedTrees)
    val = tickets.filter("split = 'val'")
    accuracy = next(r["accuracy"] for r in report.collect() if r["model"] == "boosted_trees")
    hits = router.score(val).filter("predicted_group = assignment_group").count()
    assert accuracy == pytest.approx(hits / val.count(), abs=1e-4) and hits < val.count()  # the unseen group counts as an error


def scores(router, df):
    return {r["number"]: (r["predicted_group"], r["confidence"]) for r in router.score(df).select("number", "predicted_group", "confidence").collect()}


def test_models_come_back_equal(spark, trained, tickets):
    router, _ = trained
    path = K.save_router(router, spark, work_path(spark, "router"))
    other = spark.newSession()
    again = K.load_router(other, path)
    moved = other.read.parquet(K.save_rows(tickets, work_path(spark, "rows")))
    assert scores(router, tickets) == scores(again, moved)
    assert M.top_groups(again, moved).count() == 3 * tickets.count()
    forest, _ = M.train_router(tickets, tree_counts=(3,), depth=2, rounds=0)
    assert scores(forest, tickets) == scores(K.load_router(spark, K.save_router(forest, spark, work_path(spark, "forest"))), tickets)
    hours = M.train_duration(tickets, iterations=3)
    back = K.load_duration(spark, K.save_duration(hours, spark, work_path(spark, "hours")))
    of = lambda m: {r["number"]: r["predicted_hours"] for r in m.score(tickets).select("number", "predicted_hours").collect()}
    assert of(hours) == of(back)
    with pytest.raises(Exception):
        K.load_router(spark, work_path(spark, "nothing"))


def test_embedder_comes_back_equal(spark):
    texts = spark.createDataFrame([(i, f"router{i % 4} disk{i % 3} failed word{i}") for i in range(40)], "number int, semantic_text string")
    model = E.fit_embedder(texts, dimensions=6)
    again = K.load_embedder(spark, K.save_embedder(model, spark, work_path(spark, "embedder")))
    of = lambda m: {r["number"]: r["embedding"] for r in m.transform(texts).collect()}
    assert of(model) == of(again)


def test_missing_columns_and_blocked_predictors(trained, tickets):
    router, _ = trained
    bare = tickets.select("number", "category", "priority")
    assert router.score(bare).filter("predicted_group IS NULL OR confidence <= 0").count() == 0
    with pytest.raises(ValueError):
        M.fit_features(tickets, frequency=["subcategory", "close_code"])


def test_histograms_are_one_product_or_slot_by_slot(monkeypatch):
    rng = np.random.default_rng(4)
    slots, classes, nodes = np.array([0, 3, 5, 12]), 4, 2
    bins = np.asfortranarray(np.column_stack([rng.integers(0, n, 500) for n in np.diff(slots)]).astype(np.uint8))
    g, h = rng.normal(size=(500, classes)), rng.random((500, classes))
    at = rng.integers(-1, nodes, (classes, 500))
    want = np.zeros((classes, 2, nodes, slots[-1]))
    for k in range(classes):
        for i in np.flatnonzero(at[k] >= 0):
            want[k, 0, at[k, i], slots[:-1] + bins[i]] += g[i, k]
            want[k, 1, at[k, i], slots[:-1] + bins[i]] += h[i, k]
    monkeypatch.setattr(B, "PRODUCT_CELLS", 1000)  # several parts
    product = B._histograms(bins, g, h, at, nodes, slots)
    monkeypatch.setattr(B, "PRODUCT_SLOTS", 0)
    assert np.allclose(product, want) and np.allclose(B._histograms(bins, g, h, at, nodes, slots), want)
