from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.operators import attribution as A, embed as E, models as M, search as R, tfidf as TT
from opsloom.operators.split import random_split
from opsloom.session import materialize


@pytest.fixture(scope="module")
def tickets(spark):
    """A table whose group follows the category and whose hours follow the priority."""
    i = F.col("id")
    df = spark.range(600).select(
        F.concat(F.lit("INC"), i).alias("number"), (F.lit("2026-01-01").cast("timestamp_ntz") + F.make_interval(hours=i)).alias("opened_at"),
        (i % 5 + 1).cast("int").alias("priority"), (i % 3 + 1).cast("int").alias("business_impact"), (i % 3 + 1).cast("int").alias("urgency"),
        F.concat(F.lit("cat"), i % 4).alias("category"), F.concat(F.lit("sub"), i % 6).alias("subcategory"), F.concat(F.lit("ci"), i % 10).alias("cmdb_ci"),
        F.lit("router failed").alias("short_description"), F.lit("text").alias("description"), (i % 7 == 0).alias("problem_flag"),
        F.concat(F.lit("G"), i % 4).alias("assignment_group"), ((i % 5) * 10 + 2).cast("double").alias("resolution_time_hours"),
    )
    return materialize(random_split(df), "model-test")


@pytest.fixture(scope="module")
def router(tickets):
    return M.train_router(tickets, tree_counts=(5, 10), rounds=0)


def test_router_learns(router, tickets):
    model, report = router
    assert {r["model"] for r in report.collect()} == {"most_frequent", "random_forest_5", "random_forest_10"}
    scored = model.score(tickets.filter("split = 'test'"))
    assert scored.filter("predicted_group = assignment_group").count() / scored.count() > 0.9
    assert scored.filter("confidence <= 0 or confidence > 1").count() == 0
    top = M.top_groups(model, tickets.limit(5)).collect()
    assert len(top) == 15 and all(r["candidate"].startswith("G") for r in top)


def test_importance_names(router, tickets, spark):
    model = router[0]
    names = M.slot_names(model.features.transform(tickets.limit(1)))
    rows = M.feature_importance(model.model, names, spark).collect()
    assert rows[0]["feature"].startswith("category_") and rows[0]["display_name"].startswith("Category = ")
    assert sum(r["importance_score"] for r in rows) == pytest.approx(1, abs=1e-3)


def test_attribution_adds_up(router, tickets, spark):
    model = router[0]
    scored = model.score(tickets)
    contrib = A.contributions(scored, A.tree_leaves(model.model, spark), output="prediction")
    bad = contrib.filter(F.abs(F.col("base") + F.aggregate("contribution", F.lit(0.0), lambda a, x: a + x) - F.col("prediction")) > 1e-6)
    assert contrib.count() == 600 and bad.count() == 0
    names = M.slot_names(scored)
    assert A.global_attribution(contrib, names).first()["feature"].startswith("category_")
    assert A.row_attribution(contrib, names).count() == 3000


def test_attribution_in_many_groups_and_of_boosted_trees(tickets, spark):
    router, _ = M.train_router(tickets, tree_counts=(), rounds=4)
    scored = router.model.with_margins(router.score(tickets))
    leaves = A.boosted_leaves(router.model, scored.filter("split = 'train'"))
    found = [A.contributions(scored, leaves, output="prediction", target=F.array_max("margins"), group_leaves=n) for n in (3, 1000)]
    for contrib in found:
        bad = contrib.filter(F.abs(F.col("base") + F.aggregate("contribution", F.lit(0.0), lambda a, x: a + x) - F.col("prediction")) > 1e-9)
        assert contrib.count() == 600 and bad.count() == 0
    by = [{r["number"]: r["contribution"] for r in c.collect()} for c in found]
    assert all(by[0][n] == pytest.approx(by[1][n], abs=1e-9) for n in by[0])


def test_attribution_odd_rows(router, tickets, spark):
    """Repeated rows and null keys stay, a row without features goes, an empty table gives an empty result."""
    scored = router[0].score(tickets).withColumn("extra", F.lit("x")).withColumn("base", F.lit(1))
    leaves = A.tree_leaves(router[0].model, spark)
    odd = scored.withColumn("number", F.when(F.col("number") != "INC1", F.col("number"))).unionByName(scored)
    assert A.contributions(odd, leaves, output="prediction").count() == 1200
    assert A.contributions(odd.filter("false"), leaves, output="prediction").count() == 0
    gone = scored.withColumn("features", F.when(F.col("number") != "INC1", F.col("features")))
    assert A.contributions(gone, leaves, output="prediction").count() == 599


def test_shapley_of_long_paths_matches_subsets():
    """All coalitions of seven features, two of them tested twice."""
    rng = np.random.default_rng(5)
    tests = [(f, [0.5], -1, bool(rng.integers(2)), float(rng.uniform(0.1, 0.9))) for f in (0, 1, 2, 3, 4, 5, 6, 2, 5)]
    x = rng.uniform(size=(1, 7))
    phi, base = A.shapley([{"tests": tests, "value": np.array([3.0])}], x, np.array([0]))

    def game(present):
        return 3.0 * np.prod([float((x[0, f] <= 0.5) == left) if f in present else ratio for f, _, _, left, ratio in tests])

    want = np.zeros(7)
    for j in range(7):
        rest = [f for f in range(7) if f != j]
        for size in range(7):
            for s in combinations(rest, size):
                want[j] += factorial(size) * factorial(6 - size) / factorial(7) * (game({*s, j}) - game(set(s)))
    assert base[0] == pytest.approx(game(set())) and phi[0] == pytest.approx(want, abs=1e-12)


def test_shapley_matches_subset_definition():
    leaves = [
        {"tests": [(0, [0.5], -1, True, 0.6), (1, [0.5], -1, True, 0.5)], "value": np.array([1.0])},
        {"tests": [(0, [0.5], -1, True, 0.6), (1, [0.5], -1, False, 0.5)], "value": np.array([5.0])},
        {"tests": [(0, [0.5], -1, False, 0.4)], "value": np.array([9.0])},
    ]
    phi, base = A.shapley(leaves, np.array([[0.0, 1.0]]), np.array([0]))
    v = {(): 0.6 * 3 + 0.4 * 9, (0,): 3.0, (1,): 0.6 * 5 + 0.4 * 9, (0, 1): 5.0}
    want = [0.5 * (v[(0,)] - v[()]) + 0.5 * (v[(0, 1)] - v[(1,)]), 0.5 * (v[(1,)] - v[()]) + 0.5 * (v[(0, 1)] - v[(0,)])]
    assert base[0] == pytest.approx(v[()]) and phi[0] == pytest.approx(want)


def test_duration_model(tickets):
    model = M.train_duration(tickets, iterations=5)
    r = M.duration_report(model, tickets.filter("split = 'test'"), "gbt").first()
    assert r["mae_hours"] < 12 and r["r2_score"] > 0
    imp = {x["feature"]: x["error_increase"] for x in M.permutation_importance(model, tickets.filter("split = 'test'"), ["priority", "cmdb_ci"]).collect()}
    assert imp["priority"] > imp["cmdb_ci"]


def test_embedding_matches_numpy(spark):
    texts = [f"router{i % 4} disk{i % 3} failed word{i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "number int, semantic_text string")
    model = E.fit_embedder(df, dimensions=6)
    rows = E.sparse_rows(df, model.vocab, "number", "semantic_text").collect()
    a = np.zeros((len(texts), model.projection.shape[0]))
    for r in rows:
        a[r["id"], r["ix"]] = r["val"]
    want = np.linalg.svd(a, compute_uv=False)[:6]
    assert model.singular == pytest.approx(want, rel=1e-3)
    assert model.projection.T @ model.projection == pytest.approx(np.eye(6), abs=1e-8)
    out = model.transform(spark.createDataFrame([(1, texts[1]), (2, "zzz")], "number int, semantic_text string")).collect()
    norms = {r["number"]: float(np.linalg.norm(r["embedding"])) for r in out}
    assert norms[1] == pytest.approx(1.0, abs=1e-5) and norms[2] == 0.0


def test_index_and_text_queries(spark, tmp_path):
    texts = [f"router{i % 4} disk{i % 3} failed word{i}" for i in range(40)]
    df = spark.createDataFrame([(f"INC{i}", t) for i, t in enumerate(texts)], "number string, short_description string")
    model, index = R.build_index(df, str(tmp_path / "v1"), dimensions=20)
    asked = spark.createDataFrame([("a", " INC7 "), ("b", "word11 failed")], "query_id string, query string")
    kinds = {r["query_id"]: r["kind"] for r in R.resolve_queries(asked, index).collect()}
    assert kinds == {"a": "number", "b": "text"}
    best = {r["query_id"]: r["match_id"] for r in R.similar_texts(model, index, asked, 1).collect()}
    assert best["a"] == "INC7"
    with pytest.raises(Exception):
        R.build_index(df, str(tmp_path / "v1"), dimensions=20)


def test_query_texts_are_embedded_once(spark, tmp_path):
    df = spark.createDataFrame([(f"INC{i}", f"router{i % 4} disk{i % 3} failed word{i}") for i in range(40)], "number string, short_description string")
    model, index = R.build_index(df, str(tmp_path / "v1"), dimensions=20)
    seen = spark.sparkContext.accumulator(0)

    def ask(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    asked = spark.createDataFrame([("a", "INC7"), ("b", "word11 failed")], "query_id string, query string").repartition(1)
    once = materialize(asked, "asked").mapInArrow(ask, asked.schema)
    first = R.similar_texts(model, index, once, 1)
    before = seen.value
    assert {r["query_id"]: r["match_id"] for r in first.collect()}["a"] == "INC7" and seen.value == before


def test_parts_of_training_rows_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_ROWS", 10)
    rows = M._stored(spark.range(600), "parts-test")
    assert rows.rdd.getNumPartitions() == 60 and rows.count() == 600


def test_store_rejects_mixed_dimensions(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id int, embedding array<float>")
    with pytest.raises(ValueError):
        R.load_vectors(spark, R.save_vectors(df, str(tmp_path / "bad")))


def test_free_text_ticket_and_filters(spark):
    df = R.tickets_from_text(spark.createDataFrame([(" ATM jam ",)], "t string"), "t", "2026-01-05 09:00:00")
    r = df.first()
    assert (r["description"], r["category"], r["is_business_hours"], r["opened_at_dayofweek"]) == ("ATM jam", "General", 1, 0)
    states = spark.createDataFrame([("8",), ("1",), (None,)], "state string")
    assert R.exclude_cancelled(states).count() == 2


def test_shapley_of_many_rows_keeps_no_array_per_point():
    import tracemalloc

    rng = np.random.default_rng(3)
    x, output = rng.random((100_000, 8)), np.zeros(100_000, int)
    leaf = {"only": -1, "value": [1.0], "tests": [(f, [0.5], -1, True, 0.5) for f in range(8)]}
    tracemalloc.start()
    phi, base = A.shapley([leaf], x, output)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 40  # 8 columns of 100,000 numbers are 6.4 MB; it took 74 MB before
    few, few_base = A.shapley([leaf], x[:50], output[:50])
    assert np.allclose(few, phi[:50]) and np.allclose(base, 0.5 ** 8)
    assert np.allclose(phi.sum(1) + base, (x <= 0.5).all(1))


def test_partial_products_do_not_grow_with_the_parts(spark):
    rows = spark.range(128).selectExpr("id", "array(cast(id % 5 as int), 5) AS ix", "array(0.6d, 0.8d) AS val").repartition(64).localCheckpoint()
    spark.sparkContext.setJobGroup("gram", "gram")
    got = E.gram_product(rows, np.eye(6))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    dense = np.zeros((128, 6))
    dense[np.arange(128), np.arange(128) % 5], dense[:, 5] = 0.6, 0.8
    assert np.allclose(got, dense.T @ dense)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("gram") for s in tracker.getJobInfo(j).stageIds]
    assert 0 < max(s.numTasks for s in stages if s) <= spark.sparkContext.defaultParallelism


def test_every_turn_asks_for_similar_texts(spark):
    from opsloom.plans.modeling import Q
    from opsloom.sources.tables import table

    sf = "/root/testdata/sf0.001"
    turns = table(spark, sf, "conversations")
    assert turns.filter("conv_id % 50 <> 0").count() > 0
    found = Q["similar_texts"](spark, sf).groupBy("query_id").count().collect()
    assert len(found) == turns.count() and all(r["count"] == 5 for r in found)


def test_terms_of_embedded_texts_are_counted_once(spark, monkeypatch):
    texts = [f"router{i % 4} disk{i % 3} failed word{i}" for i in range(40)] + [None, "the"]
    df = spark.createDataFrame([(i if i else 1, t) for i, t in enumerate(texts)], "number int, semantic_text string")  # two texts of one id
    counted, count = [], E.term_counts
    monkeypatch.setattr(E, "term_counts", lambda *a: counted.append(1) or count(*a))
    model, vectors = E.fit_transform(df, dimensions=6)
    again = {r["number"]: r["embedding"] for r in model.transform(df).collect()}
    assert len(counted) == 2  # one for the fit and its vectors, one for this reading
    rows = vectors.collect()
    assert len(rows) == 42 and all(np.allclose(r["embedding"], again[r["number"]], atol=1e-6) for r in rows)
    weights = {(r["id"], r["ix"]): r["weight"] for r in TT.weights(df, model.vocab, "number", "semantic_text").collect()}
    packed = {(r["id"], i): v for r in E.sparse_rows(df, model.vocab, "number", "semantic_text").collect() for i, v in zip(r["ix"], r["val"])}
    assert packed == pytest.approx(weights)


def test_rows_are_explained_where_they_are(router, tickets, spark):
    import contextlib
    import io

    scored = materialize(router[0].score(tickets).select("number", "features", "probability", "prediction"), "scored")
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        A.contributions(scored, A.tree_leaves(router[0].model, spark), output="prediction").explain()
    assert "MapInArrow" in said.getvalue() and "Join" not in said.getvalue() and "FlatMapGroups" not in said.getvalue()
