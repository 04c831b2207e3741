import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.operators import fusion as U, metrics as M, search as R, tfidf as TT, vectors as V

MATCH = "query_id bigint, rank bigint, number string, similarity_score double, assignment_group string, resolution_time_hours double, reassignment_count int"
PRED = "query_id bigint, model_group string, model_confidence double, model_hours double"


def frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "vec_id bigint, embedding array<float>")


def brute(q, c, k, metric, skip_self=False):
    out = {}
    for i, a in enumerate(q):
        s = c @ a if metric == "ip" else -((c - a) ** 2).sum(1)
        order = sorted((j for j in range(len(c)) if not (skip_self and j == i)), key=lambda j: (-round(float(s[j]), 6), j))
        out[i] = order[:k]
    return out


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["match_id"])
    return out


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("skip_self", [False, True])
def test_blocks_match_brute_force(spark, metric, skip_self):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(150, 16)).astype(np.float32)
    m[40:90] = m[3]  # a third of all vectors are copies
    df = frame(spark, m)
    got = ranked(V.knn(df, df, 7, metric, exclude_self=skip_self, block_rows=40))
    assert got == brute(m.astype(float), m.astype(float), 7, metric, skip_self)


def test_identity_and_small_corpus(spark):
    df = frame(spark, np.eye(8))
    top = V.knn(df, df, 1).collect()
    assert all(r["query_id"] == r["match_id"] and r["score"] == 1.0 and r["rank"] == 1 for r in top)
    assert V.knn(df, df, 50).count() == 64


def test_string_ids(spark):
    df = frame(spark, np.eye(4)).withColumn("vec_id", F.concat(F.lit("INC"), "vec_id"))
    assert all(r["query_id"] == r["match_id"] for r in V.knn(df, df, 1).collect())


def test_probed_cells_recall(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(10, 12)) * 3
    m = centres[rng.integers(0, 10, 800)] + rng.normal(size=(800, 12))
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = frame(spark, m)
    exact, near = ranked(V.knn(df, df, 10)), ranked(V.knn_cells(df, df, 10, probes=10, block_rows=100))
    recall = np.mean([len(set(exact[i]) & set(near[i])) / 10 for i in exact])
    assert recall > 0.9
    full = ranked(V.knn_cells(df, df, 10, probes=100, block_rows=100))
    assert full == exact


def test_queries_are_stored_once_and_hot_cells_are_split(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(300, 8))
    m[:200] = m[0]  # one cell holds two thirds of the rows
    df = frame(spark, m / np.linalg.norm(m, axis=1, keepdims=True))
    centres = V.train_cells(df, 4)
    assert V.probed_cells(df, centres, 3, "vec_id", "embedding").count() == 300
    group, groups = V._cell_groups(V.nearest_cells(df, centres, 1, "vec_id", "embedding"), 50)
    rows = V.nearest_cells(df, centres, 1, "vec_id", "embedding").groupBy(group.alias("g")).count().collect()
    assert groups >= 5 and max(r["count"] for r in rows) < 100 and max(r["g"] for r in rows) < groups
    for metric in ("ip", "l2"):
        assert ranked(V.knn_cells(df, df, 5, cells=4, probes=4, metric=metric, exclude_self=True, block_rows=40)) == ranked(V.knn(df, df, 5, metric, exclude_self=True))
    some = df.filter("vec_id < 20")
    assert ranked(V.knn_cells(some, some, 3, block_rows=4)) == ranked(V.knn(some, some, 3))


def test_append_checks_dimension(spark):
    a, b = frame(spark, np.ones((5, 4))), frame(spark, np.ones((2, 3)))
    assert V.append_vectors(a, a).count() == 10
    with pytest.raises(Exception):
        V.append_vectors(a, b).collect()


def test_tfidf_matches_formula(spark):
    docs = spark.createDataFrame([(1, "Router router failed"), (2, "router ok"), (3, "disk failed the")], "id int, t string")
    got = {(r["id"], r["term"]): r["weight"] for r in TT.tfidf(docs, "id", "t").collect()}
    idf = lambda df: np.log(4 / (1 + df)) + 1
    a, b = 2 * idf(2), idf(2)
    assert got[(1, "router")] == pytest.approx(a / np.hypot(a, b)) and (3, "the") not in got


def test_parts_of_texts_grow_with_the_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 90, f"router w{i % 7}a failed " * 20) for i in range(100)], "id int, t string")
    want = sorted(map(tuple, TT.term_counts(docs, "id", "t").collect()))
    monkeypatch.setattr(TT, "PART_BYTES", 1000)
    counts = TT.term_counts(docs, "id", "t")
    assert sorted(map(tuple, counts.collect())) == want
    size = sum(len(f"router w{i % 7}a failed " * 20) for i in range(100))
    assert counts.rdd.getNumPartitions() >= size / 1000


def match_rows(groups, scores, hours, moves, q=1):
    return [(q, i + 1, f"INC{i}", s, g, h, m) for i, (g, s, h, m) in enumerate(zip(groups, scores, hours, moves))]


def decide(spark, pred, match):
    return U.fuse(spark.createDataFrame(pred, PRED), spark.createDataFrame(match, MATCH)).collect()


def test_fusion_agreement(spark):
    m = match_rows(["Net"] * 4 + ["DB"], [0.8] * 5, [2.0] * 5, [0, 0, 0, 0, 0])
    r = decide(spark, [(1, "Net", 0.8, 4.0)], m)[0]
    assert (r["confidence_score"], r["confidence_tier"]) == (0.9, "Very High")
    assert (r["success_rate"], r["estimated_hours"], r["reason_code"], r["mode_pct"]) == (80.0, 3.0, "AGREEMENT", 80.0)


def test_fusion_disagreement(spark):
    m = match_rows(["DB"] * 3 + ["Net"] * 2, [0.5] * 5, [1.0] * 5, [0, 1, 2, 0, 0])
    low = decide(spark, [(1, "Net", 0.6, 4.0)], m)[0]
    assert (low["confidence_score"], low["confidence_tier"], low["recommended_group"]) == (0.51, "Low", "DB")
    assert low["reason_code"] == "SEMANTIC_DOMINANT" and low["success_rate"] == 30.0
    high = decide(spark, [(1, "Net", 0.9, 4.0)], m)[0]
    assert high["reason_code"] == "RF_DOMINANT" and high["recommended_group"] == "Net"


def test_fusion_ties_defaults_and_no_match(spark):
    tie = decide(spark, [(1, "X", 0.5, 1.0)], match_rows(["B", "A", "A", "B"], [0.5] * 4, [1.0] * 4, [0] * 4))[0]
    assert tie["mode_group"] == "B"
    none = decide(spark, [(9, None, 0.0, None)], match_rows(["B"], [0.5], [1.0], [0]))[0]
    assert (none["recommended_group"], none["reason_code"], none["estimated_hours"]) == ("General Support", "NO_PRECEDENT", 4.0)
    assert none["agreement"] and none["confidence_score"] == 0.3


def test_reasoning_and_evidence(spark):
    m = spark.createDataFrame(match_rows(["Net"] * 2, [0.8, 0.7], [2.0, None], [0, 0]), MATCH)
    d = U.fuse(spark.createDataFrame([(1, "Net", 0.8, 4.0)], PRED), m)
    r = U.reasoning(d).first()
    assert "'Net' (probability 80.0%)" in r["summary"] and r["bullet_3"].endswith(U.AGREE_YES)
    e = U.evidence_list(m).first()["historical_evidence"]
    assert [x["rank"] for x in e] == [1, 2] and e[1]["historical_hours"] == "N/A"


def test_metrics_against_hand_values(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label string, prediction string")
    r = M.classification_metrics(df).first()
    assert r["accuracy"] == 0.5 and r["precision_macro"] == pytest.approx((1 + 1 / 3) / 3, abs=1e-4) and r["recall_macro"] == 0.5


@pytest.mark.parametrize("bucket_rows", [1_000_000, 10])
def test_auc_against_pairs(spark, bucket_rows):
    rng = np.random.default_rng(7)
    y, s = rng.integers(0, 2, 120), np.round(rng.random(120), 2)
    pairs = [(p > n) + 0.5 * (p == n) for p in s[y == 1] for n in s[y == 0]]
    long = spark.createDataFrame([(i, str(a), "1", float(b)) for i, (a, b) in enumerate(zip(y, s))], "number int, label string, cls string, score double")
    counts = M.score_counts(long, long.select("number", "label"), bucket_rows)
    got = {r["cls"]: r["auc"] for r in M.auc_by_class(counts).collect()}
    assert got["1"] == pytest.approx(np.mean(pairs))


def test_top_k_of_large_scores_and_missing_vectors(rows):
    v = rows([(1, [1e6, 0.0]), (2, [2e6, 1e6]), (3, [1e6, 1e6]), (4, None), (5, [0.0, 3e6]), (6, [2e6, 1e6])], "vec_id bigint, embedding array<float>")
    for metric, score in (("ip", lambda a, b: -sum(x * y for x, y in zip(a, b))), ("l2", lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)))):
        got = {(r["query_id"], r["rank"]): r["match_id"] for r in V.knn(v, v, 3, metric=metric).collect()}
        vec = {r["vec_id"]: r["embedding"] for r in v.collect() if r["embedding"]}
        want = {(q, k + 1): m for q in vec for k, m in enumerate(sorted(vec, key=lambda m: (score(vec[q], vec[m]), m))[:3])}
        assert got == want


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_chosen_probes_reach_recall_on_given_embeddings(spark, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    some = e.filter("vec_id % 50 = 0")
    for queries in (e, some):
        exact, near = ranked(V.knn(some, e, 10)), ranked(V.knn_cells(queries, e, 10))
        assert np.mean([len(set(exact[i]) & set(near[i])) / len(exact[i]) for i in exact]) >= 0.9


def test_records_are_queries(spark):
    from opsloom.operators import search as R

    store = spark.createDataFrame([("INC1", "stored text")], "number string, semantic_text string")
    asked = spark.createDataFrame([
        ("a", '{"short_description": "ATM jam", "category": "HW", "extra": 1}'), ("b", "INC1"), ("c", "{not json}"), ("d", '{"other": 2}'), ("e", None), ("f", ' {"priority": 2} ')],
        "query_id string, query string")
    got = {r["query_id"]: (r["kind"], r["semantic_text"]) for r in R.resolve_queries(asked, store).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "record", "b": "number", "c": "text", "d": "text", "e": "text", "f": "record"}
    assert "ATM jam" in got["a"][1] and "Category: HW" in got["a"][1] and "ci-query-node" in got["a"][1]
    assert got["b"][1] == "stored text" and got["d"][1] == '{"other": 2}' and "Priority: 2" in got["f"][1]


def test_close_notes_merge_rank_and_leave_blanks_out(rows):
    matches = rows([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (1, 12, 0.8, 3), (1, 13, 0.7, 4), (1, 14, 0.6, 5), (2, 13, 0.5, 1), (3, 99, 0.4, 1)], "query_id int, match_id int, score double, rank int")
    notes = rows([(10, "  ", "F"), (11, "restart", "F"), (12, "clean disk", "F"), (13, " restart\n", "F"), (14, "restart", None), (15, None, "O")], "match_id int, close_note string, resolution_code string")
    found = [tuple(r) for r in R.close_notes(matches, notes).orderBy("query_id", "rank").collect()]
    assert found == [(1, 1, "restart", "F", 0.8, 2), (1, 2, "clean disk", "F", 0.8, 1), (1, 3, "restart", None, 0.6, 1), (2, 1, "restart", "F", 0.5, 1)]
    assert R.close_notes(matches.filter("false"), notes).count() == 0


def test_a_block_pair_is_scored_in_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    block = [{"id": i, "vec": v} for i, v in enumerate(rng.normal(size=(V.BLOCK_ROWS, 16)).astype(np.float32).tolist())]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("vec", pa.list_(pa.float32()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([block], kind)] * 2, ["q_rows", "c_rows"])
    tracemalloc.start()
    found = sum(out.num_rows for out in V._top_k("ip", 10, False)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 10 * V.BLOCK_ROWS and peak < 64 << 20


def test_blocks_that_were_multiplied_are_not_broadcast(spark):
    import contextlib
    import io

    rng = np.random.default_rng(8)
    m = rng.normal(size=(700, 8)).astype(np.float32)
    m[100:400] = m[7]
    found = V.knn(frame(spark, m[:90]), frame(spark, m), 3, exclude_self=True, block_rows=16)
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        found.explain()
    assert "SortMergeJoin [grid_" in said.getvalue() and "BroadcastHashJoin" not in said.getvalue()
    assert ranked(found) == brute(m[:90].astype(float), m.astype(float), 3, "ip", True)


def test_kept_values_screen_later_blocks_exactly():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    m = rng.normal(size=(3000, 8)).astype(np.float32)
    m[1500:] = m[:1500]  # ties in another block
    kind = pa.list_(pa.struct([("id", pa.int64()), ("vec", pa.list_(pa.float32()))]))
    block = lambda at: [[{"id": int(i), "vec": m[i].tolist()} for i in at]]
    pairs = lambda: [pa.RecordBatch.from_arrays([pa.array([1]), pa.array(block(range(300)), kind), pa.array(block(range(lo, lo + 1000)), kind)], ["q_block", "q_rows", "c_rows"]) for lo in (2000, 1000, 0)]
    rows = [r for out in V._top_k("ip", 4, False)(pairs()) for r in out.to_pylist()]
    got = {}
    for r in sorted(rows, key=lambda r: (-r["score"], r["match_id"])):
        got.setdefault(r["query_id"], []).append(r["match_id"])
    assert {q: x[:4] for q, x in got.items()} == brute(m[:300].astype(float), m.astype(float), 4, "ip")
    assert len(rows) < 3 * 4 * 300  # what can't be among the best is not handed on
