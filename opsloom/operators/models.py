"""Routing and duration models on Spark ML, their search, scoring and importance."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, Imputer, IndexToString, OneHotEncoder, RegexTokenizer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window, functions as F

from opsloom.operators.boosting import BoostedTrees, fit_boosted
from opsloom.operators.encode import apply_frequency, fit_frequency
from opsloom.operators.features import calendar_flags, cyclic, date_parts, from_log_target, interactions, linkage_flags, log_target
from opsloom.operators.leakage import assert_predictors
from opsloom.operators.metrics import classification_metrics
from opsloom.operators.text import combined_text
from opsloom.schema import label_of
from opsloom.session import materialize

ONE_HOT = ["priority", "business_impact", "category"]
FREQUENCY = ["subcategory", "cmdb_ci"]
NUMERIC = [
    "opened_at_hour_sin", "opened_at_hour_cos", "opened_at_dayofweek_sin", "opened_at_dayofweek_cos", "is_business_hours",
    "has_problem_id", "priority_x_business_impact", "priority_x_urgency",
]
# Columns that features are made of and their types; one that a table lacks counts as missing in every row.
RAW_COLUMNS = {
    "opened_at": "timestamp_ntz", "priority": "int", "business_impact": "int", "urgency": "int", "category": "string", "subcategory": "string",
    "cmdb_ci": "string", "short_description": "string", "description": "string", "problem_flag": "boolean",
}
TEXT_SLOTS = 64
SEED = 42
PART_ROWS = 100_000  # rows of a training table that a task reads in every round, some 100 MB


def raw_features(df: DataFrame, as_of=None) -> DataFrame:
    """Derived predictors of raw tickets; a missing opening time counts as ``as_of`` when given."""
    absent = {c: F.lit(None).cast(t) for c, t in RAW_COLUMNS.items() if c not in df.columns}
    df = df.withColumns(absent) if absent else df
    if as_of is not None:
        df = df.withColumn("opened_at", F.coalesce("opened_at", F.lit(as_of).cast("timestamp_ntz")))
    out = df.transform(date_parts).transform(cyclic).transform(calendar_flags).transform(interactions).transform(linkage_flags)
    return out.withColumn("combined_text", combined_text(out))


@dataclass
class FeatureModel:
    """Fitted feature stages: share tables, median imputer, indexers, assembler."""

    shares: dict[str, DataFrame]
    stages: PipelineModel
    inputs: list[str]
    one_hot: list[str] = field(default_factory=lambda: list(ONE_HOT))
    numeric: list[str] = field(default_factory=lambda: list(NUMERIC))

    def transform(self, df: DataFrame) -> DataFrame:
        out = apply_frequency(raw_features(df), self.shares)
        return self.stages.transform(_typed(out, self.one_hot, self.numeric))


def _typed(df: DataFrame, one_hot: list[str], numeric: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in one_hot} | {c: F.col(c).cast("double") for c in numeric})


def fit_features(train: DataFrame, one_hot: list[str] = ONE_HOT, frequency: list[str] = FREQUENCY, numeric: list[str] = NUMERIC) -> FeatureModel:
    """Fit shares, medians and category indexes on the train rows only; a column that is only known after triage is refused."""
    one_hot, frequency, numeric = list(one_hot), list(frequency), list(numeric)
    assert_predictors(one_hot + frequency + numeric)
    shares = {c: materialize(s, f"share-{c}") for c, s in fit_frequency(train, frequency).items()}
    base = _typed(raw_features(train), one_hot, numeric).select(*one_hot, *numeric, "combined_text")
    stages = [
        StringIndexer(inputCols=one_hot, outputCols=[f"{c}_ix" for c in one_hot], handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=[f"{c}_ix" for c in one_hot], outputCols=[f"{c}_oh" for c in one_hot], handleInvalid="keep", dropLast=False),
        Imputer(inputCols=numeric, outputCols=[f"{c}_f" for c in numeric], strategy="median"),
        RegexTokenizer(inputCol="combined_text", outputCol="__tok", gaps=False, pattern=r"[\p{L}\p{N}_]{2,}"),
        HashingTF(inputCol="__tok", outputCol="text_tf", numFeatures=TEXT_SLOTS),
        VectorAssembler(
            inputCols=[f"{c}_oh" for c in one_hot] + frequency + [f"{c}_f" for c in numeric] + ["text_tf"], outputCol="features", handleInvalid="keep"),
    ]
    fitted, current = [], base
    for s in stages:
        model = s.fit(current) if hasattr(s, "fit") else s
        fitted.append(model)
        if isinstance(s, (StringIndexer, OneHotEncoder)):
            current = model.transform(current)
    return FeatureModel(shares, PipelineModel(fitted), one_hot + frequency + numeric + ["combined_text"], one_hot, numeric)


def slot_names(df: DataFrame, column: str = "features") -> list[str]:
    """Name of every vector slot, from the attribute metadata the assembler writes."""
    attrs = df.schema[column].metadata["ml_attr"]["attrs"]
    flat = sorted((a for group in attrs.values() for a in group), key=lambda a: a["idx"])
    clean = lambda n: n.replace("_oh_", "_").removesuffix("_f") if not n.startswith("text_tf") else n
    return [clean(a.get("name", f"slot_{a['idx']}")) for a in flat]


@dataclass
class Router:
    features: FeatureModel
    labels: StringIndexerModel
    model: object

    def score(self, df: DataFrame) -> DataFrame:
        """Predicted group, its probability and the probability vector."""
        out = self.model.transform(self.features.transform(df))
        out = _named(out, self.labels)
        return out.withColumn("confidence", F.array_max(vector_to_array("probability")))


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """``materialize``, in parts of ``PART_ROWS``: stored vectors are small, so the files of a large table would be read as few parts,
    and training keeps and reads the parts unpacked."""
    out = materialize(rows, name)
    parts = -(-out.count() // PART_ROWS)
    return out.repartition(parts) if out.rdd.getNumPartitions() < parts else out


def _prepared(features: FeatureModel, df: DataFrame, keep: list[str], name: str) -> DataFrame:
    return _stored(features.transform(df).select(*keep, "features"), name)


def evaluate(scored: DataFrame, name: str, target: str) -> tuple[str, float, float]:
    """Accuracy and weighted F1 over every row; a group that the model never saw is an error like any other."""
    row = classification_metrics(scored.select(F.coalesce(target, F.lit("")).alias("label"), F.col("predicted_group").alias("prediction"))).first()
    return name, float(row["accuracy"] or 0.0), float(row["f1_weighted"] or 0.0)


def train_router(data: DataFrame, target: str = "assignment_group", tree_counts=(10, 20), depth: int = 5, seed: int = SEED, rounds: int = 40, rate: float = 0.3,
                 boosted_depth: int = 3) -> tuple[Router, DataFrame]:
    """The best of random forests and boosted trees by weighted F1 on the val split, and a report with the most frequent group as baseline.

    The boosting sees train and val rows in one stored table and stops early on the val rows; ``rounds`` 0 leaves it out.
    Rows of the val split with groups that the train split lacks are scored and counted.
    """
    train, fit_rows = data.filter("split = 'train'"), data.filter(F.col("split").isin("train", "val"))
    features = fit_features(train)
    known = train.filter(F.col(target).isNotNull())
    labels = StringIndexer(inputCol=target, outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc").fit(known)
    classes = len(labels.labels)
    table = labels.transform(_prepared(features, fit_rows, [target, "split"], "router-rows"))
    fitted = table.filter((F.col("split") == "train") & (F.col("label") < classes))
    val = table.filter("split = 'val'")
    common = known.groupBy(target).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), target).first()
    rows = [evaluate(val.withColumn("predicted_group", F.lit(common[target] if common else None)), "most_frequent", target)]
    models = {f"random_forest_{n}": RandomForestClassifier(numTrees=n, maxDepth=depth, seed=seed, cacheNodeIds=False).fit(fitted) for n in tree_counts}
    if rounds:
        models["boosted_trees"] = fit_boosted(table.select("features", "label", (F.col("split") == "val").alias("is_val")), classes, rounds, boosted_depth, rate)
    best = None
    for name, model in models.items():
        rows.append(evaluate(_named(model.transform(val), labels), name, target))
        if best is None or rows[-1][2] > best[0]:
            best = (rows[-1][2], model)
    report = data.sparkSession.createDataFrame(rows, "model string, accuracy double, f1_weighted double")
    return Router(features, labels, best[1]), report


def _named(scored: DataFrame, labels: StringIndexerModel) -> DataFrame:
    return IndexToString(inputCol="prediction", outputCol="predicted_group", labels=labels.labels).transform(scored)


@dataclass
class DurationModel:
    features: FeatureModel
    model: object

    def score(self, df: DataFrame) -> DataFrame:
        """Predicted hours; the model always works on the log scale, so the inverse is always applied."""
        out = self.model.transform(self.features.transform(df))
        return out.withColumn("predicted_hours", from_log_target(F.col("prediction")))


def train_duration(data: DataFrame, target: str = "resolution_time_hours", iterations: int = 20, depth: int = 4, rate: float = 0.1,
                   seed: int = SEED, boosted: bool = True) -> DurationModel:
    """Boosted trees with absolute loss on log1p hours; the val split stops the boosting early."""
    fit_rows = data.filter(F.col("split").isin("train", "val"))
    features = fit_features(data.filter("split = 'train'"))
    rows = features.transform(fit_rows).select("features", log_target(F.col(target)).alias("label"), (F.col("split") == "val").alias("is_val"))
    rows = _stored(rows, "duration-rows")
    if not boosted:
        return DurationModel(features, RandomForestRegressor(numTrees=20, maxDepth=depth, seed=seed).fit(rows.filter(~F.col("is_val"))))
    gbt = GBTRegressor(lossType="absolute", maxIter=iterations, maxDepth=depth, stepSize=rate, seed=seed, validationIndicatorCol="is_val")
    return DurationModel(features, gbt.fit(rows))


def duration_report(model: DurationModel, rows: DataFrame, name: str, target: str = "resolution_time_hours") -> DataFrame:
    from opsloom.operators.metrics import regression_metrics

    scored = model.score(rows).select(F.coalesce(target, F.lit(4.0)).alias("label"), F.col("predicted_hours").alias("prediction"))
    return regression_metrics(scored).withColumn("model", F.lit(name))


def compare_models(data: DataFrame, depth: int = 4) -> DataFrame:
    """Validation metrics of two duration models, best first by RMSE."""
    val = data.filter("split = 'val'")
    reports = [duration_report(train_duration(data, depth=depth, boosted=b), val, n) for b, n in ((True, "boosted_trees"), (False, "random_forest"))]
    both = reports[0].unionByName(reports[1])
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rmse_hours")).cast("bigint"))


def search(data: DataFrame, target: str = "assignment_group", n_iter: int = 3, folds: int = 2, seed: int = SEED, parallelism: int = 2) -> DataFrame:
    """Random search: ``n_iter`` settings drawn from a grid, scored by cross-validated weighted F1."""
    train = data.filter("split = 'train'")
    features = fit_features(train)
    labels = StringIndexer(inputCol=target, outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc").fit(train)
    rows = labels.transform(_prepared(features, train, [target], "search-train"))
    forest = RandomForestClassifier(seed=seed)
    grid = ParamGridBuilder().addGrid(forest.numTrees, [5, 10]).addGrid(forest.maxDepth, [3, 5]).addGrid(forest.minInstancesPerNode, [1, 5]).build()
    drawn = random.Random(seed).sample(grid, min(n_iter, len(grid)))
    cv = CrossValidator(estimator=forest, estimatorParamMaps=drawn, evaluator=MulticlassClassificationEvaluator(metricName="f1"),
                        numFolds=folds, parallelism=parallelism, seed=seed)
    fitted = cv.fit(rows)
    out = [
        (int(p[forest.numTrees]), int(p[forest.maxDepth]), int(p[forest.minInstancesPerNode]), float(m))
        for p, m in zip(drawn, fitted.avgMetrics)
    ]
    return data.sparkSession.createDataFrame(out, "trees int, depth int, min_rows int, f1_weighted double")


def top_groups(router: Router, df: DataFrame, k: int = 3) -> DataFrame:
    """The k most probable groups per ticket."""
    names = F.array(*[F.lit(x) for x in router.labels.labels])
    pairs = F.zip_with(vector_to_array("probability"), names, lambda p, n: F.struct((-p).alias("o"), n.alias("candidate"), p.alias("p")))
    best = F.slice(F.array_sort(pairs), 1, k)
    return router.score(df).select("number", F.posexplode(best).alias("i", "c")).select(
        "number", (F.col("i") + 1).cast("bigint").alias("rank"), "c.candidate", F.round("c.p", 6).alias("probability"))


def feature_importance(model, names: list[str], spark) -> DataFrame:
    """Score, share and rank per vector slot with its display name. One row per slot."""
    shares = model.shares() if isinstance(model, BoostedTrees) else model.featureImportances.toArray()
    rows = [(n, label_of(n), float(v)) for n, v in zip(names, shares)]
    df = spark.createDataFrame(rows, "feature string, display_name string, importance double")
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("importance").desc(), "feature")
    return df.select(F.row_number().over(w).cast("bigint").alias("rank"), "feature", "display_name", F.round("importance", 6).alias("importance_score"),
                     F.round(F.col("importance") * 100, 2).alias("importance_pct"))


def permutation_importance(model: DurationModel, rows: DataFrame, columns: list[str], target: str = "resolution_time_hours", seed: int = SEED) -> DataFrame:
    """Rise of the mean absolute log error when one input column is exchanged between rows.

    Values are exchanged along two hash orders of the table. Row numbers come from sorted hash buckets plus
    bucket offsets, so no single task orders all rows.
    """
    base = materialize(rows.withColumn("__y", log_target(F.col(target))), "permute")
    err = lambda d: model.score(d).agg(F.avg(F.abs(F.col("prediction") - F.col("__y")))).first()[0]
    start = err(base)
    numbered = _hash_numbered(base, "number", str(seed), "__r")
    donors = _hash_numbered(base, "number", str(seed + 1), "__r")
    out = []
    for c in columns:
        mixed = numbered.drop(c).join(donors.select("__r", c), "__r")
        out.append((c, float(start), float(err(mixed) - start)))
    return rows.sparkSession.createDataFrame(out, "feature string, base_error double, error_increase double")


def _hash_numbered(df: DataFrame, key: str, salt: str, name: str) -> DataFrame:
    """Dense row numbers in the order of a salted hash."""
    hashed = df.withColumn("__k", F.md5(F.concat(F.col(key).cast("string"), F.lit(salt)))).withColumn("__p", F.substring("__k", 1, 3))
    sizes = hashed.groupBy("__p").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__s"))
    local = hashed.withColumn("__l", F.row_number().over(Window.partitionBy("__p").orderBy("__k", key)))
    return local.join(starts, "__p").withColumn(name, F.col("__s") + F.col("__l")).drop("__k", "__p", "__s", "__l")
