from collections import Counter

import corpus_pipeline as P
from opsloom.llm import quality_rules as M
from tests.llm.helpers import CLASHES, ODD, SCHEMA, check_sql, documents, empty, same_rows, words


def test_sql(spark):
    check_sql(spark, M, "op1_quality_rules")


def test_counts_of_odd_texts(spark):
    out = {r["doc_id"]: r for r in M.quality_verdicts(documents(spark)).collect() if r["doc_id"]}
    for i, t in enumerate(ODD):
        w = words(t)
        runs = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
        times = Counter(runs)
        hit = {k + j for k, r in enumerate(runs) if times[r] > 1 for j in range(8)}
        r = out[10 + i]
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))
        assert r["n_repeat_words"] == len(hit)
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(w) < 20 or 100 * r["n_repeat_words"] > 30 * len(w))


def test_other_columns_and_empty(spark):
    a = M.quality_verdicts(documents(spark)).collect()
    assert same_rows(a, M.quality_verdicts(documents(spark, clash=True)).collect()) and len(a) == len(ODD) + 3
    assert M.quality_verdicts(empty(spark)).count() == 0
    assert set(CLASHES) & {"kept", "host"}


def test_bad_host_loses_only_failing_documents(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    bad = clean + " #####"
    rows = [(i, bad, "en", "junk", 1) for i in range(60)] + [(100, clean, "en", "junk", 1)] + [
        (200 + 20 * h + i, bad if i == 0 else clean, "en", f"good{h}", 1) for h in range(6) for i in range(20)]
    out = {r["doc_id"]: r for r in M.quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(out[i]["kept"] for i in range(60)) and out[100]["kept"]
    assert out[200]["kept"] and not out[200]["host_flagged"] and out[100]["host_flagged"]


def test_junk_spread_over_hosts(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    junk, narrow = clean + " ###" * 5, clean + " #" * 5
    rows = [(100 * h + i, junk if i == 0 else narrow if i == 1 else clean, "en", f"host{h}", 1) for h in range(12) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r["doc_id"]: r for r in M.quality_verdicts(docs).collect()}
    assert not any(r["host_flagged"] or r["base_failed"] for r in out.values())
    assert {i for i, r in out.items() if not r["kept"]} == {100 * h for h in range(12)}
    assert {r["doc_id"] for r in P.quality_rules(spark, docs, "").collect()} == {i for i, r in out.items() if r["kept"]}


def test_clear_failures_against_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    gone = M.quality_verdicts(docs).filter("NOT kept AND NOT base_failed").join(labels, "doc_id")
    quality = [r["quality"] for r in gone.collect()]
    assert len(quality) > 200 and sum(quality) <= 0.01 * len(quality)


def test_verdicts_differ_from_the_base(spark):
    out = M.op1_quality_rules(spark, "/root/testdata/sf0.1")
    assert out.filter("NOT kept AND NOT base_failed").count() > 200


def test_kept_columns_come_along(spark):
    docs = documents(spark, clash=True)
    out = M.quality_verdicts(docs, keep=("doc_id", "text", "kept"))
    assert same_rows(docs.select("doc_id", "text", "kept").collect(), out.select("row.*").collect())
