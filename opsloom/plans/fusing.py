"""Registered queries: fusion of model output and precedents, and model evaluation by aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import fusion as U, metrics as M
from opsloom.operators.quality import sla_target
from opsloom.operators.split import random_split
from opsloom.plans.base import over_repaired, repaired
from opsloom.plans.search import MATCH_CTE, emb, matches
from opsloom.plans.splitting import RANDOM
from opsloom.sources.tables import table

Q, S = {}, {}


def share_scores(spark, sf):
    """``(number, label, cls, score)`` from past shares: the baseline a model is compared with.

    A group is scored by its share among the train tickets of the same cell: the caller where the order is
    finished, else service and category. A cell without a train ticket takes the shares over all train tickets, so
    every ticket is scored.
    """
    df = random_split(repaired(spark, sf)).withColumn(
        "cell", F.when(F.col("subcategory") == "F", F.col("caller")).otherwise(F.concat("business_service", "category")))
    train = df.filter("split = 'train'").groupBy("cell", F.col("assignment_group").alias("cls")).agg(
        F.count(F.lit(1)).alias("c"), F.sum("resolution_time_hours").alias("h"))
    every = train.groupBy("cls").agg(F.sum("c").alias("c"), F.sum("h").alias("h")).withColumn("cell", F.lit("*"))
    known = train.select(F.col("cell").alias("__cell")).distinct()
    df = df.join(known, F.col("cell") == F.col("__cell"), "left").withColumn("cell", F.coalesce("__cell", F.lit("*")))
    train = train.unionByName(every)
    size = train.groupBy("cell").agg(F.sum("c").alias("n"), F.sum("h").alias("hours"))
    share = train.join(size, "cell").select("cell", "cls", F.round(F.col("c") / F.col("n"), 6).alias("score"), (F.col("hours") / F.col("n")).alias("cell_hours"))
    rows = df.select("number", "ticket_key", "split", "cell", "priority", F.col("assignment_group").alias("label"), "resolution_time_hours")
    return rows.join(share, "cell")


def best_scores(spark, sf):
    return U.top_rank(share_scores(spark, sf), ["number"], [F.col("score").desc(), F.col("cls")], 1)


SCORES_CTE = f"""
, cells AS (SELECT number, ticket_key, priority, assignment_group AS label, resolution_time_hours, {RANDOM} AS split,
    CASE WHEN subcategory = 'F' THEN caller ELSE concat(business_service, category) END AS cell FROM rep),
tr0 AS (SELECT cell, label AS cls, count(*) AS c, sum(resolution_time_hours) AS h FROM cells WHERE split = 'train' GROUP BY 1, 2),
tr AS (SELECT cell, cls, c, h FROM tr0 UNION ALL SELECT '*', cls, sum(c), sum(h) FROM tr0 GROUP BY cls),
asked AS (SELECT * REPLACE (CASE WHEN cell IN (SELECT cell FROM tr0) THEN cell ELSE '*' END AS cell) FROM cells),
sh AS (SELECT cell, cls, round(c / (sum(c) OVER (PARTITION BY cell))::double, 6) AS score,
    sum(h) OVER (PARTITION BY cell) / sum(c) OVER (PARTITION BY cell) AS cell_hours FROM tr),
scores AS (SELECT * FROM asked JOIN sh USING (cell)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, cls) AS rn FROM scores) WHERE rn = 1)
"""


def predictions(spark, sf):
    """One row per query vector; tickets the baseline does not know stay NULL."""
    best = best_scores(spark, sf).select(
        F.col("ticket_key").alias("query_id"), F.col("cls").alias("model_group"), F.col("score").alias("model_confidence"),
        F.col("cell_hours").alias("model_hours"))
    return emb(spark, sf).select(F.col("vec_id").alias("query_id")).join(best, "query_id", "left")


Q["topk_consensus"] = lambda spark, sf: U.topk_consensus(matches(spark, sf)).select(
    "query_id", "matches", "mode_group", "mode_count", F.round("mode_share", 4).alias("mode_share"),
    F.round("average_similarity", 5).alias("average_similarity"), F.round("history_hours", 4).alias("history_hours"))
CONSENSUS_CTE = MATCH_CTE + """
, g AS (SELECT query_id, assignment_group, count(*) AS c, min(rank) AS r FROM mt GROUP BY 1, 2),
md AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, r) AS rn FROM g) WHERE rn = 1),
cs AS (SELECT mt.query_id, count(*) AS matches, any_value(md.assignment_group) AS mode_group, any_value(md.c) AS mode_count,
  any_value(md.c) / count(*)::double AS mode_share,
  cast(sum(similarity_score::decimal(18,6)) / count(*) AS decimal(18,8))::double AS average_similarity, avg(resolution_time_hours) AS history_hours
  FROM mt JOIN md USING (query_id) GROUP BY 1)
"""
S["topk_consensus"] = over_repaired(CONSENSUS_CTE + """SELECT query_id, matches, mode_group, mode_count, round(mode_share, 4) AS mode_share,
  round(average_similarity::decimal(18,8), 5)::double AS average_similarity, round(history_hours, 4) AS history_hours FROM cs""")

FUSED_CTE = SCORES_CTE + CONSENSUS_CTE + """
, f0 AS (SELECT e.vec_id AS query_id, coalesce(b.cls, 'General Support') AS model_group, coalesce(nullif(b.score, 0), 0.5) AS p,
   coalesce(nullif(b.cell_hours, 0), 4.0) AS mh, cs.* EXCLUDE (query_id) FROM embeddings e LEFT JOIN best b ON b.ticket_key = e.vec_id LEFT JOIN cs ON cs.query_id = e.vec_id),
f1 AS (SELECT *, model_group = mode_group AS agreement FROM f0),
f2 AS (SELECT *, CASE WHEN agreement THEN 'AGREEMENT' WHEN p >= 0.7 THEN 'RF_DOMINANT' ELSE 'SEMANTIC_DOMINANT' END AS reason_code,
   greatest(0.0001, least(1.0, 0.6::double * p + 0.4::double * average_similarity + CASE WHEN agreement THEN 0.1::double ELSE -0.05::double END)) AS score FROM f1),
f3 AS (SELECT *, CASE WHEN reason_code = 'SEMANTIC_DOMINANT' THEN mode_group ELSE model_group END AS recommended_group FROM f2),
cr AS (SELECT f3.query_id, sum(CASE WHEN mt.assignment_group = recommended_group AND coalesce(reassignment_count, 0) = 0 THEN 1.0
   WHEN mt.assignment_group = recommended_group AND reassignment_count <= 1 THEN 0.5 ELSE 0 END)::double AS credit FROM f3 JOIN mt USING (query_id) GROUP BY 1),
f4 AS (SELECT *, round(credit / matches * 100, 2) AS rate FROM f3 JOIN cr USING (query_id))
"""
DECISION = ["query_id", "recommended_group", "confidence_score", "confidence_tier", "estimated_hours", "agreement", "reason_code", "model_group", "mode_group"]
TIER = """CASE WHEN score >= 0.88 THEN 'Very High' WHEN score >= 0.75 THEN 'High' WHEN score >= 0.6 THEN 'Moderate' WHEN score >= 0.45 THEN 'Low' ELSE 'Review Required' END"""


def decisions(spark, sf):
    return U.fuse(predictions(spark, sf), matches(spark, sf))


Q["fuse_decision"] = lambda spark, sf: decisions(spark, sf).select(
    "query_id", "recommended_group", "agreement", "reason_code", "model_group", "mode_group", "estimated_hours", "history_hours")
S["fuse_decision"] = over_repaired(FUSED_CTE + """SELECT query_id, recommended_group, agreement, reason_code, model_group, mode_group,
  round(0.5 * mh + 0.5 * coalesce(history_hours, mh), 2) AS estimated_hours, round(coalesce(history_hours, mh), 2) AS history_hours FROM f4""")

Q["fuse_confidence"] = lambda spark, sf: decisions(spark, sf).select("query_id", "confidence_score", "confidence_tier", "model_confidence", "average_similarity")
S["fuse_confidence"] = over_repaired(FUSED_CTE + f"""SELECT query_id, round(score, 4) AS confidence_score, {TIER} AS confidence_tier,
  round(p, 4) AS model_confidence, round(average_similarity::decimal(18,8), 4)::double AS average_similarity FROM f4""")

Q["success_rate"] = lambda spark, sf: decisions(spark, sf).select("query_id", "recommended_group", "success_rate")
S["success_rate"] = over_repaired(FUSED_CTE + """SELECT query_id, recommended_group,
  CASE WHEN rate = 0 AND agreement THEN round(mode_share * 100, 2) ELSE rate END AS success_rate FROM f4""")

Q["reasoning_text"] = lambda spark, sf: U.reasoning(decisions(spark, sf))


def _fmt(template: str, *fields: str) -> str:
    """SQL concatenation of a layout with its fields."""
    parts = template.replace("%%", "\0").split("%s")
    lit = lambda t: "'" + t.replace("\0", "%").replace("'", "''") + "'"
    out = [lit(parts[0])]
    for f, t in zip(fields, parts[1:]):
        out += [f, lit(t)]
    return "concat(" + ", ".join(out) + ")"


def _num(x: str, d: int) -> str:
    return f"cast(round({x}, {d})::decimal(20,{d}) AS varchar)"


_c, _sh, _si = _num("model_confidence::decimal(10,4) * 100", 1), _num("mode_pct", 1), _num("average_similarity", 4)
_fu, _ho, _n, _k = _num("confidence_score * 100", 2), _num("estimated_hours", 2), "cast(mode_count AS varchar)", "cast(matches AS varchar)"
S["reasoning_text"] = over_repaired(FUSED_CTE + f"""
, d AS (SELECT query_id, recommended_group, agreement, reason_code, model_group, mode_group, mode_count, matches, round(p, 4) AS model_confidence, round(mh, 2) AS model_hours,
  round(mode_share * 100, 2) AS mode_pct, round(average_similarity::decimal(18,8), 4)::double AS average_similarity, round(score, 4) AS confidence_score, {TIER} AS confidence_tier,
  round(0.5 * mh + 0.5 * coalesce(history_hours, mh), 2) AS estimated_hours, round(coalesce(history_hours, mh), 2) AS history_hours,
  CASE WHEN rate = 0 AND agreement THEN round(mode_share * 100, 2) ELSE rate END AS success_rate FROM f4)
SELECT query_id, CASE WHEN agreement THEN {_fmt(U.SUMMARY_AGREE, 'model_group', _c, _n, _k, _sh, 'mode_group', _si, 'recommended_group', 'confidence_tier', _fu, _ho)}
  WHEN reason_code = 'RF_DOMINANT' THEN {_fmt(U.SUMMARY_MODEL, 'model_group', _c, 'mode_group', _n, _k, _sh, _si, 'recommended_group', 'confidence_tier', _fu, _ho)}
  ELSE {_fmt(U.SUMMARY_HISTORY, 'mode_group', _n, _k, _sh, _si, 'model_group', _c, 'recommended_group', 'confidence_tier', _fu, _ho)} END AS summary,
  {_fmt(U.BULLETS[0], 'model_group', _c, _num('model_hours', 2))} AS bullet_1, {_fmt(U.BULLETS[1], _n, _k, 'mode_group', _sh, _si)} AS bullet_2,
  {_fmt(U.BULLETS[2], f"CASE WHEN agreement THEN '{U.AGREE_YES}' ELSE '{U.AGREE_NO}' END")} AS bullet_3,
  {_fmt(U.BULLETS[3], _ho, _num('history_hours', 2))} AS bullet_4, {_fmt(U.BULLETS[4], _num('success_rate', 2))} AS bullet_5 FROM d""")

Q["evidence_rows"] = lambda spark, sf: U.evidence(matches(spark, sf))
S["evidence_rows"] = over_repaired(MATCH_CTE + f"""SELECT query_id, rank, number, round(similarity_score::decimal(18,6), 4)::double AS similarity_score, assignment_group AS historical_group,
  concat({_num('resolution_time_hours', 2)}, 'h') AS historical_hours FROM mt""")

Q["sla_risk"] = lambda spark, sf: U.sla_risk(
    best_scores(spark, sf).withColumn("model_hours", F.col("cell_hours")), sla_target(F.col("priority"))
).select("number", F.round("model_hours", 4).alias("model_hours"), "target_hours", "sla_risk")
S["sla_risk"] = over_repaired(SCORES_CTE + """
, t AS (SELECT number, cell_hours, CASE priority WHEN 1 THEN 4.0 WHEN 2 THEN 12.0 WHEN 3 THEN 48.0 WHEN 4 THEN 120.0 WHEN 5 THEN 240.0 ELSE 48.0 END::double AS target_hours FROM best)
SELECT number, round(cell_hours, 4) AS model_hours, target_hours, cell_hours > target_hours AS sla_risk FROM t""")


def _test_best(spark, sf):
    return best_scores(spark, sf).filter("split = 'test'").select("number", "label", F.col("cls").alias("prediction"))


Q["classification_metrics"] = lambda spark, sf: M.classification_metrics(_test_best(spark, sf))
S["classification_metrics"] = over_repaired(SCORES_CTE + """
, t AS (SELECT label, cls AS prediction FROM best WHERE split = 'test'), k AS (SELECT label AS c FROM t UNION SELECT prediction FROM t),
pc AS (SELECT c, (SELECT count(*) FROM t WHERE label = c AND prediction = c)::double AS tp, (SELECT count(*) FROM t WHERE label = c) AS sup,
   (SELECT count(*) FROM t WHERE prediction = c) AS prd FROM k),
m AS (SELECT sup, tp, CASE WHEN prd > 0 THEN tp / prd ELSE 0 END AS pr, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rc FROM pc),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM m)
SELECT round(sum(tp) / sum(sup), 4) AS accuracy, round(sum(pr * sup) / sum(sup), 4) AS precision_weighted, round(avg(pr), 4) AS precision_macro,
  round(sum(rc * sup) / sum(sup), 4) AS recall_weighted, round(avg(rc), 4) AS recall_macro, round(sum(f1 * sup) / sum(sup), 4) AS f1_weighted,
  round(avg(f1), 4) AS f1_macro, sum(sup)::bigint AS test_sample_count FROM f""")

Q["confusion_matrix"] = lambda spark, sf: M.confusion(_test_best(spark, sf))
S["confusion_matrix"] = over_repaired(SCORES_CTE + "SELECT label, cls AS prediction, count(*) AS cnt FROM best WHERE split = 'test' GROUP BY 1, 2")

_long = lambda spark, sf: share_scores(spark, sf).filter("split = 'test'").select("number", "label", "cls", "score")
Q["topk_accuracy"] = lambda spark, sf: M.topk_accuracy(_long(spark, sf), 3)
S["topk_accuracy"] = over_repaired(SCORES_CTE + """
, r AS (SELECT number, label = cls AS hit, row_number() OVER (PARTITION BY number ORDER BY score DESC, cls) AS rn FROM scores WHERE split = 'test')
SELECT 3::bigint AS k, count(DISTINCT number) AS rows, round(count(*) FILTER (hit AND rn <= 3) / count(DISTINCT number)::double, 4) AS topk_accuracy FROM r""")


def _counts(spark, sf):
    long = _long(spark, sf)
    return M.score_counts(long, long.select("number", "label").distinct())


FULL_CTE = SCORES_CTE + """
, t AS (SELECT DISTINCT number, label FROM scores WHERE split = 'test'), k AS (SELECT DISTINCT label AS cls FROM t),
fs AS (SELECT t.number, k.cls, (t.label = k.cls)::int AS y, coalesce(s.score, 0) AS score FROM t CROSS JOIN k
   LEFT JOIN (SELECT * FROM scores WHERE split = 'test') s ON s.number = t.number AND s.cls = k.cls)
"""
Q["roc_auc"] = lambda spark, sf: M.roc_auc(_counts(spark, sf))
S["roc_auc"] = over_repaired(FULL_CTE + """
, r AS (SELECT cls, y, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0::double AS rk FROM fs),
a AS (SELECT cls, sum(y) AS p, count(*) - sum(y) AS n, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * (count(*) - sum(y))::double) AS auc FROM r GROUP BY 1)
SELECT round(sum(auc * p) / sum(p), 4) AS roc_auc_weighted, count(*) AS classes FROM a""")

Q["roc_curve"] = lambda spark, sf: M.roc_curve(_counts(spark, sf))
S["roc_curve"] = over_repaired(FULL_CTE + """
, c AS (SELECT cls, score, sum(y) AS p, count(*) - sum(y) AS n FROM fs GROUP BY 1, 2)
SELECT cls, round(score, 6) AS threshold, round(sum(p) OVER (PARTITION BY cls ORDER BY score DESC) / (sum(p) OVER (PARTITION BY cls))::double, 6) AS tpr,
  round(sum(n) OVER (PARTITION BY cls ORDER BY score DESC) / (sum(n) OVER (PARTITION BY cls))::double, 6) AS fpr FROM c
UNION ALL SELECT DISTINCT cls, NULL::double, 0.0::double, 0.0::double FROM c""")

Q["regression_metrics"] = lambda spark, sf: M.regression_metrics(
    best_scores(spark, sf).filter("split = 'test'").select(F.col("resolution_time_hours").alias("label"), F.col("cell_hours").alias("prediction")))
S["regression_metrics"] = over_repaired(SCORES_CTE + """
SELECT round(avg(abs(resolution_time_hours - cell_hours)), 4) AS mae_hours, round(avg((resolution_time_hours - cell_hours) ** 2), 4) AS mse,
  round(sqrt(avg((resolution_time_hours - cell_hours) ** 2)), 4) AS rmse_hours,
  round(1 - avg((resolution_time_hours - cell_hours) ** 2) / var_pop(resolution_time_hours), 4) AS r2_score, count(*) AS test_sample_count
FROM best WHERE split = 'test'""")


def _labels(spark, sf):
    """Binary metric on the label table: the toxicity flag scored by the opposite of quality."""
    lab = table(spark, sf, "labels")
    return M.classification_metrics(lab.select(F.col("toxic").alias("label"), (1 - F.col("quality")).alias("prediction")))


Q["binary_metrics"] = _labels
S["binary_metrics"] = """
WITH t AS (SELECT toxic AS label, 1 - quality AS prediction FROM labels), k AS (SELECT label AS c FROM t UNION SELECT prediction FROM t),
m AS (SELECT c, count(*) FILTER (label = c AND prediction = c)::double AS tp, count(*) FILTER (label = c) AS sup, count(*) FILTER (prediction = c) AS prd FROM t, k GROUP BY 1),
f AS (SELECT sup, tp, CASE WHEN prd > 0 THEN tp / prd ELSE 0 END AS pr, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rc FROM m),
g AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM f)
SELECT round(sum(tp) / sum(sup), 4) AS accuracy, round(sum(pr * sup) / sum(sup), 4) AS precision_weighted, round(avg(pr), 4) AS precision_macro,
  round(sum(rc * sup) / sum(sup), 4) AS recall_weighted, round(avg(rc), 4) AS recall_macro, round(sum(f1 * sup) / sum(sup), 4) AS f1_weighted,
  round(avg(f1), 4) AS f1_macro, sum(sup)::bigint AS test_sample_count FROM g"""
