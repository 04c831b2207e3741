import corpus_pipeline as P
from opsloom.llm.common import documents as table
from opsloom.session import written
from tests.llm import test_best_fit, test_mixing, test_near_dedup
from tests.llm.helpers import SCHEMA, SMALL, documents, empty, given, same_rows, words
from tests.llm.test_exact_dedup import bare


def test_stages_on_the_given_table(spark):
    stages, docs, seen = dict(P.STAGES), table(spark, SMALL), {}
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SMALL), name)
        seen[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == list(P.COLUMNS)
    assert [len(seen[n]) for n in stages][:3] == sorted((len(seen[n]) for n in list(stages)[:3]), reverse=True)
    ids = lambda n: {r["doc_id"] for r in seen[n]}
    texts, source = {i: t for i, t, _ in given()}, {i: s for i, _, s in given()}
    best = {}
    for i in ids("quality_rules"):
        best[bare(texts[i])] = min(best.get(bare(texts[i]), (1, 0)), (-len(texts[i] or ""), i))
    assert ids("exact_dedup") == {i for _, i in best.values()}
    near = test_near_dedup.brute([(i, texts[i]) for i in sorted(ids("exact_dedup"))])
    assert ids("near_dedup") == {i for i, _, c in near if i == c}
    size = {i: len(words(texts[i])) for i in ids("near_dedup")}
    sizes, taken = {}, {}
    for i in size:
        sizes[source[i]] = sizes.get(source[i], 0) + size[i]
    for r in seen["mixing"]:
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + size[r["doc_id"]]
    for s, goal in test_mixing.brute_targets(sizes).items():
        assert abs(taken[s] - goal) <= max(size[i] for i in size if source[i] == s)
    test_best_fit.check(seen["best_fit_packing"], [(r["doc_id"], texts[r["doc_id"]]) for r in seen["mixing"]])


def test_odd_and_empty_tables(spark):
    for docs in (documents(spark, clash=True), empty(spark)):
        for name, stage in P.STAGES:
            docs = written(stage(spark, docs, SMALL), name)
        docs.count()


LONG = "every row of this table is told apart by its id and by its own text and nothing clean is lost on the way %s"


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], SCHEMA)


def test_rows_without_or_with_repeated_ids(spark):
    a, b, c, d = (LONG % x for x in ("first", "second text here", "third one, quite another", "fourth " + " ".join(f"more{k}" for k in range(30))))
    docs = table_of(spark, [(1, a, "en"), (1, d, "en"), (None, b, "en"), (None, d + " x y z", "de"), (2, a, "en"), (None, b, "en"), (3, None, "en"), (3, c, None)])
    kept = rows_of(P.quality_rules(spark, docs, ""))
    assert same_rows(kept, [(i, t) for i, t in rows_of(docs) if t])
    unique = P.exact_copies(spark, written(table_of(spark, [(i, t, "en") for i, t in kept]), "kept"), "")
    assert same_rows(rows_of(unique), [(1, a), (1, d), (None, b), (None, d + " x y z"), (3, c)])
    near = rows_of(P.near_copies(spark, written(unique, "unique"), ""))
    assert {(i, t) for i, t in near if i is None} == {(None, b), (None, d + " x y z")} and (1, d) in near


def test_equal_rows_share_their_copies(spark):
    docs = table_of(spark, [(1, "a b c", "en")] * 3 + [(None, "d e", "de")] * 2 + [(5, "f g h i", None)])
    copies = test_mixing.M.mix(docs).groupBy("doc_id").sum("copies").collect()
    got = rows_of(P.mixed(spark, docs, ""))
    assert {r["doc_id"]: r["sum(copies)"] for r in copies if r["sum(copies)"]} == {i: sum(x == i for x, _ in got) for i in {x for x, _ in got}}
