"""Model evaluation as aggregates over prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from opsloom.functions.order_stats import ROWS_PER_BUCKET, range_edges, running_totals, with_bucket


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Non-empty cells of the confusion matrix."""
    return df.groupBy(F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("prediction")).agg(
        F.count(F.lit(1)).alias("cnt"))


def class_metrics(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; an undefined ratio is zero."""
    n = F.col("cnt")
    sides = F.array(
        F.struct(F.col("label").alias("cls"), n.alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), n).otherwise(F.lit(0)).alias("hit")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("bigint").alias("support"), n.alias("predicted"),
                 F.lit(0).cast("bigint").alias("hit")),
    )
    sums = cells.select(F.inline(sides)).groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    out = sums.withColumns({"precision": ratio("hit", "predicted"), "recall": ratio("hit", "support")})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    per_class = class_metrics(confusion(df, label, prediction))
    n = F.sum("support")
    aggs = [F.round(F.sum("hit") / n, 4).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        aggs.append(F.round(F.sum(F.col(m) * F.col("support")) / n, 4).alias(f"{m}_weighted"))
        aggs.append(F.round(F.avg(m), 4).alias(f"{m}_macro"))
    return per_class.agg(*aggs, n.alias("test_sample_count"))


def topk_accuracy(scores: DataFrame, k: int, classes: int | None = None, row: str = "number") -> DataFrame:
    """``scores`` is ``(row, label, cls, score)``; equal scores go to the smaller class name."""
    k = min(k, classes - 1) if classes else k
    w = Window.partitionBy(row).orderBy(F.col("score").desc(), "cls")
    ranked = scores.withColumn("rn", F.row_number().over(w))
    hit = (F.col("cls") == F.col("label")) & (F.col("rn") <= k)
    return ranked.agg(
        F.lit(k).cast("bigint").alias("k"), F.count_if(F.col("rn") == 1).alias("rows"),
        F.round(F.count_if(hit) / F.count_if(F.col("rn") == 1), 4).alias("topk_accuracy"),
    )


def score_counts(scores: DataFrame, labels: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rows with and without the class per ``(cls, score)``, with running totals from the lowest score up.

    Classes a row has no score for count as score zero.
    """
    is_cls = F.col("cls") == F.col("label")
    given = scores.groupBy("cls", "score").agg(F.count_if(is_cls).alias("pos"), F.count_if(~is_cls).alias("neg"))
    sizes = labels.groupBy(F.col("label").alias("cls")).agg(F.count(F.lit(1)).alias("p"))
    total = sizes.agg(F.sum("p").alias("n")).scalar()
    seen = given.groupBy("cls").agg(F.sum("pos").alias("gp"), F.sum("neg").alias("gn"))
    zero = sizes.join(seen, "cls", "left").select(
        "cls", F.lit(0.0).alias("score"), (F.col("p") - F.coalesce("gp", F.lit(0))).alias("pos"),
        (total - F.col("p") - F.coalesce("gn", F.lit(0))).alias("neg"),
    )
    counts = given.unionByName(zero).groupBy("cls", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    edges = range_edges(counts, ["score"], rows_per_bucket)["score"]
    return running_totals(with_bucket(counts, "score", edges, "bucket"), ["cls"], "score", ["pos", "neg"]).filter(
        F.col("pos") + F.col("neg") > 0)


def auc_by_class(counts: DataFrame) -> DataFrame:
    """Area under the curve per class by the rank-sum formula, ties counted half."""
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    pairs = F.max("pos_total").cast("double") * F.max("neg_total")
    return counts.groupBy("cls").agg(
        F.when(pairs > 0, F.sum(wins) / pairs).alias("auc"), F.max("pos_total").alias("support"))


def roc_auc(counts: DataFrame) -> DataFrame:
    """One-vs-rest area weighted by class size."""
    return auc_by_class(counts).filter(F.col("auc").isNotNull()).agg(
        F.round(F.sum(F.col("auc") * F.col("support")) / F.sum("support"), 4).alias("roc_auc_weighted"),
        F.count(F.lit(1)).alias("classes"))


def roc_curve(counts: DataFrame) -> DataFrame:
    """Curve points per class: everything scored at or above the threshold is called positive. Every curve starts at (0, 0), where
    no score reaches the threshold (null)."""
    rate = lambda side: F.round((F.col(f"{side}_total") - F.col(f"{side}_before")) / F.col(f"{side}_total"), 6)
    points = counts.filter((F.col("pos_total") > 0) & (F.col("neg_total") > 0)).select(
        "cls", F.round("score", 6).alias("threshold"), rate("pos").alias("tpr"), rate("neg").alias("fpr"), (F.col("pos_before") + F.col("neg_before") == 0).alias("__lowest"))
    start = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    own = F.struct("threshold", "tpr", "fpr")
    return points.select("cls", F.inline(F.when(F.col("__lowest"), F.array(own, start)).otherwise(F.array(own))))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    err = F.col(label) - F.col(prediction)
    one = df.agg(
        F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), F.var_pop(label).alias("var"), F.count(F.lit(1)).alias("n"))
    return one.select(
        F.round("mae", 4).alias("mae_hours"), F.round("mse", 4).alias("mse"), F.round(F.sqrt("mse"), 4).alias("rmse_hours"),
        F.round(1 - F.col("mse") / F.col("var"), 4).alias("r2_score"), F.col("n").alias("test_sample_count"))
