import hashlib
import re
from collections import defaultdict

from opsloom.llm import exact_dedup as M
from opsloom.session import work_path
from tests.llm.helpers import SCHEMA, check_sql, documents, empty, odd_rows, same_rows


def run(spark, df):
    return M.exact_dedup(df, M.DigestIndex(spark, work_path(spark, "index")))


def bare(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_sql(spark):
    check_sql(spark, M, "op4_exact_dedup")


def test_odd_texts_and_other_columns(spark):
    df = documents(spark)
    groups = defaultdict(list)
    for i, t in odd_rows(df):
        groups[bare(t)].append((-len(t or ""), i is None, i))
    want = []
    for i, t in odd_rows(df):
        g = groups[bare(t)]
        want.append((i, min(g)[2], len(g), hashlib.sha256(bare(t).encode()).hexdigest()))
    for clash in (False, True):
        rows = run(spark, documents(spark, clash=clash)).collect()
        assert same_rows(want, [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows])
        kept = [r for r in rows if r["kept"]]
        assert sorted(r["text_sha256"] for r in kept) == sorted({w[3] for w in want})  # one row of each group
        assert all(r["doc_id"] == r["keep_id"] for r in kept)
    assert run(spark, empty(spark)).count() == 0


def test_later_batches_meet_the_index(spark):
    path = work_path(spark, "index")
    a = spark.createDataFrame([(5, "one text", "en", "s", 1), (6, "onetext", "en", "s", 1)], SCHEMA)
    b = spark.createDataFrame([(1, "one   text", "en", "s", 1), (2, "new", "en", "s", 1)], SCHEMA)
    first = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in M.exact_dedup(a, M.DigestIndex(spark, path)).collect()}
    second = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in M.exact_dedup(b, M.DigestIndex(spark, path)).collect()}
    assert first == {5: (5, True), 6: (5, False)} and second == {1: (5, False), 2: (2, True)}
    index = M.DigestIndex(spark, path)
    assert index.rows().count() == 2
    plan = index.rows().hint("merge").join(index.rows().select("digest"), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


def test_one_of_the_rows_with_one_id_or_none_stays(spark):
    rows = [(7, "same text"), (7, "same text"), (None, "lost"), (None, "lost"), (None, "l o s t"), (8, "sametext")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = [(r["doc_id"], r["group_size"]) for r in run(spark, df).collect() if r["kept"]]
    assert same_rows(kept, [(7, 3), (None, 3)])


def test_buckets_follow_the_expected_rows(spark):
    path = work_path(spark, "index")
    assert M.DigestIndex(spark, path, 300_000_000).buckets == 150
    assert M.DigestIndex(spark, path).buckets == 150
    assert M.DigestIndex(spark, work_path(spark, "index"), 10).buckets == M.LEAST_BUCKETS
