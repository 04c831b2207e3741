import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.operators import vector_index as I, vectors as V
from opsloom.session import work_path

EMBEDDINGS = "/root/testdata/sf0.1/embeddings.parquet"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")


def pairs(df):
    return {(r["query_id"], r["match_id"]) for r in df.select("query_id", "match_id").collect()}


def test_recall_on_the_given_embeddings(spark):
    e = spark.read.parquet(EMBEDDINGS)
    index = I.build_code_index(e, work_path(spark, "codes"))
    again = I.open_code_index(spark.newSession(), index.path)
    asked = e.filter("vec_id % 50 = 0")
    exact, found = pairs(V.knn(asked, e, 10)), pairs(again.search(asked.sparkSession.createDataFrame(asked.collect(), asked.schema), 10))
    assert len(exact & found) >= 0.9 * len(exact)
    assert 10 * index.candidates_per_match < e.count() / 3


def test_all_candidates_are_exact_and_appends_are_found(spark):
    rng = np.random.default_rng(3)
    old, new = rng.normal(size=(150, 16)), rng.normal(size=(50, 16))
    index = I.build_code_index(frame(spark, old), work_path(spark, "codes"), k=3)
    before = {tuple(r) for r in index.vectors.select("id", "code").collect()}
    index.append(frame(spark, new, 1000))
    both = frame(spark, old).union(frame(spark, new, 1000))
    key = lambda df: sorted(map(tuple, df.select("query_id", "rank", "match_id", "score").collect()))
    assert key(index.search(both, 4, candidates=10**6)) == key(V.knn(both, both, 4))
    assert before <= {tuple(r) for r in index.vectors.select("id", "code").collect()}
    assert (1000, 1000) in pairs(index.search(both, 1))
    with pytest.raises(Exception):
        index.append(frame(spark, rng.normal(size=(2, 8)), 5000))


def test_many_blocks_keep_their_share(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(600, 16))
    index = I.build_code_index(frame(spark, vectors), work_path(spark, "codes"), k=3)
    asked = I.coded(V._plain(frame(spark, vectors[:20]), "vec_id", "embedding"), 16, I.BITS, I.SEED)
    rows = index.candidates(asked, 60, block_rows=50).groupBy("query_id").count().collect()
    assert len(rows) == 20 and all(60 <= r["count"] <= 240 for r in rows)


def test_only_earlier_vectors_match(spark):
    rng = np.random.default_rng(9)
    n = 300
    vectors, times = rng.normal(size=(n, 8)).astype(np.float32), rng.integers(0, 40, n)
    times[:120] = 7  # a hot time
    df = frame(spark, vectors).join(spark.createDataFrame([(i, int(t)) for i, t in enumerate(times)], "vec_id bigint, t int"), "vec_id")
    df = df.withColumn("opened_at", F.when(F.col("vec_id") != 5, F.lit("2026-01-01").cast("timestamp_ntz") + F.make_interval(days="t")))
    got = {}
    for r in V.knn_before(df, df, 4, "opened_at", block_rows=32, slices=9).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["match_id"]))
    score = np.rint((vectors.astype(np.float64) @ vectors.astype(np.float64).T) * 1e6)
    for i in range(n):
        earlier = [j for j in range(n) if times[j] < times[i] and j != 5] if i != 5 else []
        want = sorted(earlier, key=lambda j: (-score[i, j], j))[:4]
        assert [m for _, m in sorted(got.get(i, []))] == want


def test_candidates_are_scored_where_they_are_found(spark):
    """No pair of a query and a candidate is joined with its vectors; over many blocks the search equals the exact one."""
    import contextlib
    import io

    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(500, 16))
    vectors[100:160] = vectors[3]
    df = frame(spark, vectors)
    index = I.build_code_index(df, work_path(spark, "codes"), k=3)
    found = index.search(df, 3, candidates=500, exclude_self=True)
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        found.explain()
    assert said.getvalue().count("Join") == said.getvalue().count("SortMergeJoin [grid_") == 1
    key = lambda d: sorted((r["query_id"], r["rank"], r["match_id"], r["score"]) for r in d.collect())
    assert key(found) == key(V.knn(df, df, 3, exclude_self=True))
