"""Registered queries: models, scoring, attribution, embedding, end-to-end recommendation.

Fitted models are stored once per session and input folder and read back by every query that scores with them. Results of
training can't be written as SQL; ``*_checks`` queries report invariants over all rows as (check_name, passed, n), with
the number of rows that each one must cover computed from the given tables.
"""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from opsloom.operators import artefacts as K, attribution as A, embed as E, fusion as U, models as M, search as R, vectors as V
from opsloom.operators.boosting import fit_boosted
from opsloom.operators.metrics import classification_metrics
from opsloom.operators.split import random_split
from opsloom.plans.base import over_repaired, repaired
from opsloom.plans.search import emb
from opsloom.plans.splitting import RANDOM
from opsloom.session import materialize, work_path
from opsloom.sources.tables import table, ticket_number

Q, S = {}, {}

_STORED: dict[tuple, str] = {}


def stored(spark, sf: str, name: str, make) -> str:
    """Path of what ``make(path)`` writes, made once per application and input folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        path = work_path(spark, name)
        make(path)
        _STORED[key] = path
    return _STORED[key]


def data(spark, sf):
    """Tickets with their split, stored once."""
    make = lambda path: random_split(repaired(spark, sf, text=True)).write.parquet(path)
    out = spark.read.parquet(stored(spark, sf, "tickets", make))
    cores = spark.sparkContext.defaultParallelism
    return out.repartition(cores) if out.rdd.getNumPartitions() < cores else out


def _train_router(spark, sf, path):
    router, report = M.train_router(data(spark, sf))
    report.write.parquet(f"{path}/report")
    K.save_router(router, spark, path)


def router(spark, sf) -> M.Router:
    return K.load_router(spark, stored(spark, sf, "router", lambda path: _train_router(spark, sf, path)))


def router_report(spark, sf) -> DataFrame:
    return spark.read.parquet(stored(spark, sf, "router", lambda path: _train_router(spark, sf, path)) + "/report")


def duration(spark, sf) -> M.DurationModel:
    return K.load_duration(spark, stored(spark, sf, "duration", lambda path: K.save_duration(M.train_duration(data(spark, sf)), spark, path)))


def checks(df: DataFrame, **found: tuple[Column, Column]) -> DataFrame:
    """One row per check: whether it holds, and the number of rows it covers; both are aggregates over ``df``."""
    rows = [F.struct(F.lit(c).alias("check_name"), F.coalesce(ok, F.lit(True)).alias("passed"), n.cast("bigint").alias("n")) for c, (ok, n) in found.items()]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def expected(source: str, **counts: str) -> str:
    """SQL of the same rows: every check passes, ``n`` is counted."""
    return over_repaired(f", t AS ({source}) " + " UNION ALL ".join(f"SELECT '{c}' AS check_name, true AS passed, ({n})::bigint AS n FROM t" for c, n in counts.items()))




def n_rows() -> Column:
    return F.count(F.lit(1))


TICKETS = f"SELECT *, {RANDOM} AS split FROM rep"


def _features(spark, sf):
    d = data(spark, sf)
    out = router(spark, sf).features.transform(d)
    return out.select("number", "split", F.size(vector_to_array("features")).alias("width"), vector_to_array("features").alias("features"))


def _feature_checks(spark, sf):
    """Widths agree, no value is missing, every one-hot group holds a single 1, shares lie between 0 and 1."""
    out = router(spark, sf).features.transform(data(spark, sf))
    names = M.slot_names(out)
    x = out.select("number", "split", vector_to_array("features").alias("x"))
    one_hot = {c: [i for i, n in enumerate(names) if n.startswith(c + "_") and not n.startswith("priority_x")] for c in M.ONE_HOT}
    ones = [sum((F.get("x", i) for i in slots), F.lit(0.0)) == 1 for slots in one_hot.values()]
    shares = [F.get("x", names.index(c)).between(0, 1) for c in M.FREQUENCY]
    every = lambda conds: F.every(F.forall(F.array(*conds), lambda v: v))
    return checks(
        x, every_ticket_once=(F.count_distinct("number") == n_rows(), n_rows()), one_width=(F.min(F.size("x")) == len(names), n_rows()),
        no_missing_value=(F.every(F.forall("x", lambda v: ~F.isnan(v) & v.isNotNull())), n_rows()), one_hot_groups=(every(ones), n_rows()), shares_in_range=(every(shares), n_rows()),
        train_rows=(F.lit(True), F.count_if(F.col("split") == "train")))


Q["feature_matrix"] = _features
Q["feature_matrix_checks"] = _feature_checks
S["feature_matrix_checks"] = expected(TICKETS, every_ticket_once="count(*)", one_width="count(*)", no_missing_value="count(*)", one_hot_groups="count(*)", shares_in_range="count(*)", train_rows="count(*) FILTER (split = 'train')")


def _router(spark, sf):
    test = router(spark, sf).score(data(spark, sf).filter("split = 'test'")).select(F.col("assignment_group").alias("label"), F.col("predicted_group").alias("prediction"))
    final = classification_metrics(test).select(F.lit("chosen_on_test").alias("model"), "accuracy", "f1_weighted")
    return router_report(spark, sf).unionByName(final)


def _router_checks(spark, sf):
    """Every val ticket is scored, unseen groups included, and the chosen model has the largest weighted F1 of the report."""
    val = router(spark, sf).score(data(spark, sf).filter("split = 'val'")).select(F.col("assignment_group").alias("label"), F.col("predicted_group").alias("prediction"))
    row = classification_metrics(val).select(F.col("f1_weighted").alias("chosen"), F.col("test_sample_count").alias("rows"))
    f1 = {r["model"]: r["f1_weighted"] for r in router_report(spark, sf).collect()}  # a row a model
    best, base = max(v for m, v in f1.items() if m != "most_frequent"), f1["most_frequent"]
    chosen = F.max("chosen")
    return checks(
        row, val_rows_scored=(F.lit(True), F.max("rows")), chosen_is_best=(F.abs(chosen - best) <= 1e-3, n_rows()),
        above_most_frequent=(chosen > base, n_rows()), boosted_compared=(F.lit("boosted_trees" in f1), n_rows()))


Q["train_router"] = _router
Q["train_router_checks"] = _router_checks
S["train_router_checks"] = expected(TICKETS, val_rows_scored="count(*) FILTER (split = 'val')", chosen_is_best="min(1)", above_most_frequent="min(1)", boosted_compared="min(1)")


def _duration(spark, sf):
    return M.duration_report(duration(spark, sf), data(spark, sf).filter("split = 'test'"), "boosted_trees")


def _duration_checks(spark, sf):
    """Every ticket gets finite hours that are not negative; on test rows the error is no larger than 1.05 times that of the train median."""
    d = data(spark, sf)
    middle = d.filter("split = 'train'").agg(F.percentile("resolution_time_hours", 0.5)).first()[0]
    scored = duration(spark, sf).score(d)
    test = F.col("split") == "test"
    log_error = lambda c: F.avg(F.when(test, F.abs(F.log1p(c) - F.log1p("resolution_time_hours"))))
    return checks(
        scored, hours_not_negative=(F.every(F.coalesce(F.col("predicted_hours") >= 0, F.lit(False))), n_rows()),
        not_worse_than_median=(log_error(F.col("predicted_hours")) <= 1.05 * log_error(F.lit(middle)), F.count_if(test)))


Q["train_mttr"] = _duration
Q["train_mttr_checks"] = _duration_checks
S["train_mttr_checks"] = expected(TICKETS, hours_not_negative="count(*)", not_worse_than_median="count(*) FILTER (split = 'test')")
Q["compare_models"] = lambda spark, sf: M.compare_models(data(spark, sf))
Q["hpo_search"] = lambda spark, sf: M.search(data(spark, sf))


def _score(spark, sf):
    return router(spark, sf).score(data(spark, sf)).select("number", "predicted_group", F.round("confidence", 4).alias("confidence"))


def _score_checks(spark, sf):
    """Every ticket once, with a known group and a probability; a second reading of the stored model gives the same scores."""
    model = router(spark, sf)
    d, known = data(spark, sf), model.labels.labels
    again = K.load_router(spark, stored(spark, sf, "router", lambda path: None)).score(d).select("number", F.col("predicted_group").alias("g2"), F.col("confidence").alias("c2"))
    out = model.score(d).select("number", "predicted_group", "confidence").join(again, "number")
    ok = lambda c: F.every(F.coalesce(c, F.lit(False)))
    return checks(
        out, every_ticket_once=(F.count_distinct("number") == n_rows(), n_rows()), group_known=(ok(F.col("predicted_group").isin(known)), n_rows()),
        confidence_in_range=(ok((F.col("confidence") > 0) & (F.col("confidence") <= 1)), n_rows()), same_after_reload=(ok((F.col("g2") == F.col("predicted_group")) & (F.col("c2") == F.col("confidence"))), n_rows()))


Q["score_batch"] = _score
Q["score_batch_checks"] = _score_checks
S["score_batch_checks"] = expected(TICKETS, every_ticket_once="count(*)", group_known="count(*)", confidence_in_range="count(*)", same_after_reload="count(*)")


def _top3(spark, sf):
    return M.top_groups(router(spark, sf), data(spark, sf))


def _top3_checks(spark, sf):
    """Three different groups a ticket, by falling probability; the first is the prediction."""
    by = _top3(spark, sf).groupBy("number").agg(
        F.sort_array(F.collect_list(F.struct("rank", "candidate", "probability"))).alias("c"))  # three a ticket
    first = _score(spark, sf).select("number", "predicted_group")
    p = [F.get("c.probability", i) for i in range(3)]
    ok = lambda c: F.every(F.coalesce(c, F.lit(False)))
    return checks(
        by.join(first, "number"), three_groups=(ok((F.size("c") == 3) & (F.size(F.array_distinct("c.candidate")) == 3)), n_rows()),
        falling=(ok((p[0] >= p[1]) & (p[1] >= p[2]) & (p[0] + p[1] + p[2] <= 1.00001)), n_rows()), first_is_prediction=(ok(F.get("c.candidate", 0) == F.col("predicted_group")), n_rows()))


Q["top3_groups"] = _top3
Q["top3_groups_checks"] = _top3_checks
S["top3_groups_checks"] = expected(TICKETS, three_groups="count(*)", falling="count(*)", first_is_prediction="count(*)")


def _importance(spark, sf):
    model = router(spark, sf)
    return M.feature_importance(model.model, M.slot_names(model.features.transform(data(spark, sf).limit(1))), spark)


Q["feature_importance"] = _importance


def _permute(spark, sf):
    return M.permutation_importance(duration(spark, sf), data(spark, sf).filter("split = 'test'"), ["subcategory", "priority", "category"])


Q["permutation_importance"] = _permute


def forest(spark, sf) -> M.Router:
    """The router that attribution explains: a forest, whose trees Spark stores."""
    make = lambda path: K.save_router(M.train_router(data(spark, sf), tree_counts=(10,), rounds=0)[0], spark, path)
    return K.load_router(spark, stored(spark, sf, "forest", make))


def _contrib(spark, sf):
    model = forest(spark, sf)
    scored = model.score(data(spark, sf))
    return A.contributions(scored, A.tree_leaves(model.model, spark), output="prediction"), M.slot_names(scored)


def _attribution_checks(spark, sf):
    """Base plus contributions is the prediction for every ticket; every slot has a contribution."""
    rows, names = _contrib(spark, sf)
    total = F.col("base") + F.aggregate("contribution", F.lit(0.0), lambda a, x: a + x)
    return checks(rows, adds_up=(F.every(F.abs(total - F.col("prediction")) < 1e-6), n_rows()), every_slot=(F.every(F.size("contribution") == len(names)), n_rows()))


Q["row_attribution"] = lambda spark, sf: A.row_attribution(*_contrib(spark, sf))
Q["global_attribution"] = lambda spark, sf: A.global_attribution(*_contrib(spark, sf))
Q["attribution_checks"] = _attribution_checks
S["attribution_checks"] = expected(TICKETS, adds_up="count(*)", every_slot="count(*)")

ENSEMBLE_ROUNDS, ENSEMBLE_DEPTH = 40, 2


def _train_ensemble(spark, sf, path):
    """Boosted trees, all rounds kept: a tree per round and group."""
    known = data(spark, sf).filter("split = 'train' AND assignment_group IS NOT NULL")
    features = M.fit_features(known)
    train = features.transform(known)
    labels = StringIndexer(inputCol="assignment_group", outputCol="label", stringOrderType="alphabetAsc").fit(train)
    rows = labels.transform(train).select("features", "label", F.lit(False).alias("is_val"))
    K.save_router(M.Router(features, labels, fit_boosted(rows, len(labels.labels), ENSEMBLE_ROUNDS, ENSEMBLE_DEPTH)), spark, path)


def _ensemble_checks(spark, sf):
    """Base plus contributions is the margin of the predicted group for every ticket, whatever the number of trees; as many trees as rounds times groups."""
    model = K.load_router(spark, stored(spark, sf, "ensemble", lambda path: _train_ensemble(spark, sf, path)))
    scored = model.model.with_margins(model.score(data(spark, sf)))
    leaves = A.boosted_leaves(model.model, scored.filter("split = 'train'"))
    rows = A.contributions(scored, leaves, output="prediction", target=F.array_max("margins"))
    total = F.col("base") + F.aggregate("contribution", F.lit(0.0), lambda a, x: a + x)
    trees = leaves.filter("tree >= 0").agg(F.count_distinct("tree").alias("n")).first()["n"]
    return checks(rows, adds_up=(F.every(F.abs(total - F.col("prediction")) < 1e-6), n_rows()), every_ticket_once=(F.count_distinct("number") == n_rows(), n_rows()), trees=(F.lit(True), F.max(F.lit(trees))))


Q["ensemble_attribution_checks"] = _ensemble_checks
S["ensemble_attribution_checks"] = expected(TICKETS, adds_up="count(*)", every_ticket_once="count(*)", trees=f"{ENSEMBLE_ROUNDS} * count(DISTINCT assignment_group) FILTER (split = 'train')")


def _embed(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("number"), F.col("text").alias("semantic_text"))
    return E.fit_transform(docs)[1]


Q["embed_svd"] = _embed


def _similar(spark, sf):
    """All documents indexed as ticket texts, every conversation turn a free-text query."""
    docs = table(spark, sf, "documents").select(ticket_number("doc_id").alias("number"), F.col("text").alias("description"), F.col("source").alias("category"))
    model, index = R.build_index(docs, work_path(spark, "index"), dimensions=64)
    turns = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    return R.similar_texts(model, index, turns)


Q["similar_texts"] = _similar


DIMENSIONS, PRECEDENTS = 64, 5


def embedder(spark, sf) -> E.Embedder:
    """Fitted on the texts of the train tickets, stored once."""
    texts = lambda: E.with_semantic_text(data(spark, sf).filter("split = 'train'"))
    return K.load_embedder(spark, stored(spark, sf, "embedder", lambda path: K.save_embedder(E.fit_embedder(texts(), dimensions=DIMENSIONS), spark, path)))


def asked_tickets(spark, sf) -> DataFrame:
    """Tickets a recommendation is wanted for: those outside the train split, and all of the first day, which have no past."""
    d = data(spark, sf)
    first = d.agg(F.min("opened_at")).first()[0]
    return d.filter((F.col("split") != "train") | (F.col("opened_at") == F.lit(first)))


def precedents(spark, sf) -> DataFrame:
    """Matches of the asked tickets among train tickets that were opened before them, by the text of both; with the fields fusion needs."""
    model = embedder(spark, sf)
    vectors = lambda df: df.select("number", "opened_at").join(model.transform(E.with_semantic_text(df)), "number")
    d = data(spark, sf)
    past = d.filter("split = 'train'")
    found = V.knn_before(vectors(asked_tickets(spark, sf)), vectors(past), PRECEDENTS, "opened_at", id_col="number")
    fields = past.select(F.col("number").alias("match_id"), "number", "assignment_group", "priority", "business_service", "resolution_time_hours", "reassignment_count", F.col("opened_at").alias("match_opened_at"))
    return found.join(fields, "match_id").withColumnRenamed("score", "similarity_score")


def recommended(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Decisions with reasons and evidence, one row per asked ticket, and the precedents behind them."""
    asked = asked_tickets(spark, sf)
    routed = router(spark, sf).score(asked).select(F.col("number").alias("query_id"), F.col("predicted_group").alias("model_group"), F.round("confidence", 4).alias("model_confidence"))
    timed = duration(spark, sf).score(asked).select(F.col("number").alias("query_id"), F.round("predicted_hours", 2).alias("model_hours"))
    found = materialize(precedents(spark, sf), "precedents")
    decided = U.fuse(routed.join(timed, "query_id"), found)
    return decided.join(U.reasoning(decided), "query_id").join(U.evidence_list(found), "query_id", "left"), found


def _recommend_checks(spark, sf):
    """One decision per asked ticket; as many precedents as there can be, none from the query's day or later; without any, the model decides."""
    out, found = recommended(spark, sf)
    opened = data(spark, sf).select(F.col("number").alias("query_id"), "opened_at")
    late = found.join(opened, "query_id").agg(n_rows().alias("found"), F.count_if(F.col("match_opened_at") >= F.col("opened_at")).alias("late")).first()
    row = out.agg(n_rows().alias("rows"), F.count_distinct("query_id").alias("ids"), F.count_if(F.col("reason_code") == "NO_PRECEDENT").alias("alone"),
                  F.every((F.col("reason_code") != "NO_PRECEDENT") | (F.col("recommended_group") == F.col("model_group"))).alias("follows"))
    return checks(
        row, one_row_per_ticket=(F.max("rows") == F.max("ids"), F.max("rows")), no_later_match=(F.lit(late["late"] == 0), F.max(F.lit(late["found"]))),
        without_precedent=(F.every("follows") & (F.max("alone") > 0), F.max("alone")))


Q["recommend_batch"] = lambda spark, sf: recommended(spark, sf)[0]
Q["recommend_checks"] = _recommend_checks
S["recommend_checks"] = over_repaired(f"""
, t AS ({TICKETS}), q AS (SELECT * FROM t WHERE split <> 'train' OR opened_at = (SELECT min(opened_at) FROM t)),
days AS (SELECT opened_at, count(*) FILTER (split = 'train') AS c FROM t GROUP BY 1),
past AS (SELECT opened_at, coalesce(sum(c) OVER (ORDER BY opened_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM days),
a AS (SELECT least({PRECEDENTS}, before) AS found FROM q JOIN past USING (opened_at))
SELECT 'one_row_per_ticket' AS check_name, true AS passed, count(*)::bigint AS n FROM a
UNION ALL SELECT 'no_later_match', true, sum(found)::bigint FROM a
UNION ALL SELECT 'without_precedent', true, (count(*) FILTER (found = 0))::bigint FROM a""")
