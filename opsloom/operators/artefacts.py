"""Fitted models stored as one folder of Spark ML stages, side tables and a manifest, and read back by any session.

The manifest is a one-row JSON table written last: a folder without one is an unfinished save and can't be loaded.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession

from opsloom.operators.boosting import BoostedTrees, Tree
from opsloom.operators.embed import Embedder
from opsloom.operators.models import DurationModel, FeatureModel, Router

VERSION = 1
ML_MODELS = {c.__name__: c for c in (RandomForestClassificationModel, GBTRegressionModel, RandomForestRegressionModel)}


def _write_manifest(spark: SparkSession, path: str, **content) -> None:
    spark.createDataFrame([(json.dumps({"version": VERSION} | content),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> dict:
    found = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if found["version"] != VERSION:
        raise ValueError(f"{path} was written as version {found['version']}, this is {VERSION}")
    return found


def _save_features(model: FeatureModel, path: str) -> dict:
    model.stages.save(f"{path}/stages")
    for column, shares in model.shares.items():
        shares.write.parquet(f"{path}/share-{column}")
    return {"shares": list(model.shares), "inputs": model.inputs, "one_hot": model.one_hot, "numeric": model.numeric}


def _load_features(spark: SparkSession, path: str, kept: dict) -> FeatureModel:
    shares = {c: spark.read.parquet(f"{path}/share-{c}") for c in kept["shares"]}
    return FeatureModel(shares, PipelineModel.load(f"{path}/stages"), kept["inputs"], kept["one_hot"], kept["numeric"])


def _save_model(spark: SparkSession, model, path: str) -> dict:
    if not isinstance(model, BoostedTrees):
        model.save(f"{path}/model")
        return {"kind": type(model).__name__}
    nodes = [(r, k, n, int(t.feature[n]), int(t.cut[n]), float(t.value[n])) for r, trees in enumerate(model.rounds) for k, t in enumerate(trees) for n in range(len(t.feature))]
    spark.createDataFrame(nodes, "round int, k int, node int, feature int, cut int, value double").coalesce(1).write.parquet(f"{path}/model")
    return {"kind": "BoostedTrees", "edges": [e.tolist() for e in model.edges], "start": model.start.tolist(), "gains": model.gains.tolist(), "losses": model.losses}


def _load_model(spark: SparkSession, path: str, kept: dict):
    if kept["kind"] != "BoostedTrees":
        return ML_MODELS[kept["kind"]].load(f"{path}/model")
    trees: dict = {}
    for r in spark.read.parquet(f"{path}/model").orderBy("round", "k", "node").collect():  # the nodes of the model's trees
        trees.setdefault((r["round"], r["k"]), []).append((r["feature"], r["cut"], r["value"]))
    as_tree = lambda rows: Tree(*(np.array([x[i] for x in rows], kind) for i, kind in enumerate((np.int32, np.int32, np.float64))))
    classes = len(kept["start"])
    rounds = [[as_tree(trees[r, k]) for k in range(classes)] for r in range(len(trees) // classes)]
    return BoostedTrees([np.array(e) for e in kept["edges"]], np.array(kept["start"]), rounds, np.array(kept["gains"]), kept["losses"])


def save_router(router: Router, spark: SparkSession, path: str) -> str:
    router.labels.save(f"{path}/labels")
    _write_manifest(spark, path, role="router", features=_save_features(router.features, path), model=_save_model(spark, router.model, path))
    return path


def load_router(spark: SparkSession, path: str) -> Router:
    kept = manifest(spark, path)
    return Router(_load_features(spark, path, kept["features"]), StringIndexerModel.load(f"{path}/labels"), _load_model(spark, path, kept["model"]))


def save_duration(model: DurationModel, spark: SparkSession, path: str) -> str:
    _write_manifest(spark, path, role="duration", features=_save_features(model.features, path), model=_save_model(spark, model.model, path))
    return path


def load_duration(spark: SparkSession, path: str) -> DurationModel:
    kept = manifest(spark, path)
    return DurationModel(_load_features(spark, path, kept["features"]), _load_model(spark, path, kept["model"]))


def save_embedder(model: Embedder, spark: SparkSession, path: str) -> str:
    """The vocabulary as a table, the projection as a table of its rows."""
    model.vocab.write.parquet(f"{path}/vocabulary")
    rows = [(i, row.tolist()) for i, row in enumerate(model.projection)]
    spark.createDataFrame(rows, "slot int, row array<double>").coalesce(1).write.parquet(f"{path}/projection")
    _write_manifest(spark, path, role="embedder", singular=model.singular.tolist(), stop_words=list(model.stop_words))
    return path


def load_embedder(spark: SparkSession, path: str) -> Embedder:
    kept = manifest(spark, path)
    rows = spark.read.parquet(f"{path}/projection").orderBy("slot").collect()  # vocabulary x dimensions, both bounded by parameters
    return Embedder(spark.read.parquet(f"{path}/vocabulary"), np.array([r["row"] for r in rows]), np.array(kept["singular"]), tuple(kept["stop_words"]))


def save_rows(df: DataFrame, path: str) -> str:
    """Store rows beside a model, for sessions that only know paths."""
    df.write.mode("errorifexists").parquet(path)
    return path
