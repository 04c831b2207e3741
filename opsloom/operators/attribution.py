"""Exact path-dependent Shapley attribution of tree ensembles of any size.

Every leaf is a game of its own over the features on its path, so the leaves of all trees form one stored table and are dealt
out to groups of a bounded size. If one group holds all, it goes to every task and rows are explained where they are, without any
shuffle. Else rows are packed into blocks of bounded bytes; a block meets every group, and what the groups give a block is added
up. No task and no driver holds more than a group, and a deep tree is dealt out like many small.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opsloom.operators.boosting import BoostedTrees, binned
from opsloom.session import work_path, written

GROUP_LEAVES = 4096
BLOCK_BYTES = 1 << 20
BATCH_BYTES = 1 << 23  # features of rows that one group explains at once
MERGE_WAYS = 32
CODED = 8  # features on a path up to which their combinations are worked out instead of the rows

LEAF = "tree int, leaf int, only int, value array<double>, tests array<struct<feature:int,cut:array<double>,categories:int,goes_left:boolean,ratio:double>>"


def tree_leaves(model, spark: SparkSession) -> DataFrame:
    """Leaves of a fitted Spark ML ensemble: the tests on the way with the share of training rows that passed each, and the value."""
    path = work_path(spark, "model")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "treeID" not in data.columns:
        data = data.withColumn("treeID", F.lit(0))
    node = data.select("treeID", "nodeData.*") if "nodeData" in data.columns else data
    forest = hasattr(model, "numClasses")
    weights = [float(w) for w in getattr(model, "treeWeights", None) or [1.0]]
    count = model.getNumTrees if hasattr(model, "getNumTrees") else 1

    def paths(key, pdf):
        nodes = {int(r.id): r for r in pdf.itertuples(index=False)}
        out, stack = [], [(nodes[0], [])]
        while stack:
            n, tests = stack.pop()
            if n.left < 0:
                stats = np.asarray(n.stats, float)
                value = stats / stats.sum() / count if forest else np.asarray([n.prediction]) * weights[key[0] if len(weights) > 1 else 0]
                out.append((int(key[0]), int(n.id), -1, value.tolist(), tests))
                continue
            for child, left in ((nodes[int(n.left)], True), (nodes[int(n.right)], False)):
                test = {"feature": int(n.feature), "cut": list(n.cut), "categories": int(n.categories), "goes_left": left, "ratio": float(child.rows / n.rows)}
                stack.append((child, tests + [test]))
        return pd.DataFrame(out, columns=["tree", "leaf", "only", "value", "tests"])

    flat = node.select(
        "treeID", "id", "prediction", F.col("impurityStats").alias("stats"), F.col("rawCount").cast("double").alias("rows"), F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"), F.col("split.leftCategoriesOrThreshold").alias("cut"), F.col("split.numCategories").alias("categories"))
    return written(flat.groupBy("treeID").applyInPandas(paths, LEAF), "leaves")


def node_covers(model: BoostedTrees, rows: DataFrame, column: str = "features") -> np.ndarray:
    """Rows that reach every node: rounds x classes x nodes; tasks count, counts are added up in two steps."""
    shape = (len(model.rounds), model.num_classes, len(model.rounds[0][0].feature) if model.rounds else 1)

    def count(batches):
        total = np.zeros(shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = np.asfortranarray(binned(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), model.edges))
            for r, trees in enumerate(model.rounds):
                for k, tree in enumerate(trees):
                    at = np.bincount(tree.nodes(bins), minlength=shape[2])
                    for node in range(shape[2] - 1, 0, -1):
                        at[(node - 1) // 2] += at[node]
                    total[r, k] += at
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % MERGE_WAYS], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["lane", "part"])

    def add(pdf):
        return pd.DataFrame({"lane": [0], "part": [sum(np.frombuffer(p, np.int64) for p in pdf["part"]).tobytes()]})

    kind = "lane int, part binary"
    added = rows.select(vector_to_array(column).alias("x")).mapInArrow(count, kind).groupBy("lane").applyInPandas(add, kind).groupBy("lane").applyInPandas(add, kind)
    found = added.first()
    return np.frombuffer(found["part"], np.int64).reshape(shape) if found else np.zeros(shape, np.int64)


def boosted_leaves(model: BoostedTrees, rows: DataFrame, column: str = "features") -> DataFrame:
    """Leaves of boosted trees, with shares of ``rows``, the training rows; a tree speaks for its own class only.

    What is attributed is the margin before the softmax. A branch without any of the rows has a share of one in a million.
    """
    covers = node_covers(model, rows, column)
    out = [(-1, 0, -1, model.start.tolist(), [])]
    for r, trees in enumerate(model.rounds):
        for k, tree in enumerate(trees):
            stack = [(0, [])]
            while stack:
                node, tests = stack.pop()
                f = int(tree.feature[node])
                if f < 0:
                    out.append((r * model.num_classes + k, node, k, [float(tree.value[node])], tests))
                    continue
                bounds, cut = model.edges[f], int(tree.cut[node])
                bound = float(bounds[cut]) if cut < len(bounds) else float("inf")
                for child, left in ((2 * node + 1, True), (2 * node + 2, False)):
                    ratio = max(covers[r, k, child] / max(covers[r, k, node], 1), 1e-6)
                    stack.append((child, tests + [(f, [bound], -1, left, float(ratio))]))
    return written(rows.sparkSession.createDataFrame(out, LEAF), "leaves")


def _follows(x: np.ndarray, cut: list[float], categories: int, left: bool) -> np.ndarray:
    goes_left = x <= cut[0] if categories < 0 else np.isin(x, cut)
    return goes_left if left else ~goes_left


@cache
def _points(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss points and weights between 0 and 1."""
    t, w = np.polynomial.legendre.leggauss(n)
    return (t + 1) / 2, w / 2


def _weights(share: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Contribution of every feature (rows) to a leaf of value one, by combination of present features (columns)."""
    t, w = _points((len(share) + 1) // 2)
    term = (share[:, None] * (1 - t))[:, None, :] + present[:, :, None] * t
    return (present - share[:, None]) * ((term.prod(axis=0) / term) @ w)


def shapley(leaves: list[dict], x: np.ndarray, output: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contribution of every column and the base value, for one output per row.

    A leaf is a game over the features on its path: a present feature passes the rows that follow its tests, an absent one
    passes the share of training rows that did. The weight of a coalition of s among m - 1 others is the integral of
    t^s (1 - t)^(m - 1 - s), so a contribution is the integral of the product of the others' terms share (1 - t) + passed t:
    a polynomial of degree m - 1, which m / 2 Gauss points integrate exactly. All terms are positive, so the product of the
    others is the whole product divided by the own term. Rows that pass the same features of a leaf have the same integrals,
    which are worked out once for each of the few combinations of a short path.
    """
    x = np.asfortranarray(x)  # columns are read and written whole
    out, base = np.zeros((x.shape[1], len(x))), np.zeros(len(x))
    by_output = {}
    if any(leaf.get("only", -1) >= 0 for leaf in leaves):
        order = np.argsort(output, kind="stable")
        ends = np.flatnonzero(np.diff(output[order])) + 1
        by_output = {output[at[0]]: at for at in np.split(order, ends) if len(at)}
    for leaf in leaves:
        only = leaf.get("only", -1)
        at = by_output.get(only, ()) if only >= 0 else np.arange(len(x))
        if not len(at):
            continue
        value = np.asarray(leaf["value"], float)[np.zeros(len(at), int) if only >= 0 else output[at]]
        passed: dict[int, np.ndarray] = {}
        shares: dict[int, float] = {}
        for f, cut, categories, left, ratio in leaf["tests"]:
            follows = _follows(x[:, f] if only < 0 else x[at, f], cut, categories, left)
            passed[f] = passed[f] & follows if f in passed else follows
            shares[f] = shares.get(f, 1.0) * ratio
        share = np.array(list(shares.values()))
        base[at] += value * share.prod()
        if not passed:
            continue
        if len(passed) <= CODED:
            code = sum(follows.astype(np.uint16) << i for i, follows in enumerate(passed.values()))
            present, which = np.arange(1 << len(passed)) >> np.arange(len(passed))[:, None] & 1, code
        else:
            present, which = np.stack(list(passed.values())), slice(None)
        weight = _weights(share, present.astype(float))
        for f, row in zip(passed, weight):
            total = out[f] if only < 0 else out[f, at]
            total += value * row[which]
            if only >= 0:
                out[f, at] = total
    return np.ascontiguousarray(out.T), base


def _blocks(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """Rows (key, x, out, target) packed into blocks of bounded bytes, stored so that a block keeps its number."""
    def pack(batches):
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch.column("x")[0])
            size = max(1, BLOCK_BYTES // (8 * (width + 1)))
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False)
                out = part.column("out").to_numpy(zero_copy_only=False).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([(TaskContext.get().partitionId() << 33) + n], pa.int64()), pa.array([part.num_rows], pa.int32()), pa.array([part.column(key).to_pylist()], pa.list_(part.column(key).type)),
                    pa.array([x.tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary()), pa.array([part.column("target").to_pylist()], pa.list_(pa.float64()))], ["block", "n", "keys", "x", "out", "target"])
                n += 1

    return written(rows.mapInArrow(pack, f"block bigint, n int, keys array<{kind}>, x binary, out binary, target array<double>"), "attribution-blocks")


def _games(leaves: list[dict]) -> list[dict]:
    return [leaf | {"tests": [tuple(t.values()) for t in leaf["tests"]]} for leaf in leaves]


def _told(key: str, keys: pa.Array, base: np.ndarray, phi: np.ndarray, target: pa.Array) -> pa.RecordBatch:
    offsets = np.arange(len(phi) + 1, dtype=np.int32) * phi.shape[1]
    return pa.RecordBatch.from_arrays([keys, pa.array(base), pa.ListArray.from_arrays(offsets, np.ascontiguousarray(phi).ravel()), target], [key, "base", "contribution", "prediction"])


def _explained(rows: DataFrame, leaves: DataFrame, key: str, kind: str) -> DataFrame:
    """``contributions`` by the leaves of a single group, of which the driver holds no more than ``GROUP_LEAVES``."""
    games = _games([r.asDict(True) for r in leaves.select("only", "value", "tests").collect()])

    def explain(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size = max(1, BATCH_BYTES // (8 * (len(batch.column("x")[0]) + 1)))
            for part in (batch.slice(lo, size) for lo in range(0, batch.num_rows, size)):
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                phi, base = shapley(games, x, part.column("out").to_numpy(zero_copy_only=False).astype(np.int32))
                yield _told(key, part.column(key), base, phi, part.column("target"))

    return rows.mapInArrow(explain, f"{key} {kind}, base double, contribution array<double>, prediction double")


def contributions(scored: DataFrame, leaves: DataFrame, key: str = "number", output: str | None = None, target: Column | None = None, group_leaves: int = GROUP_LEAVES) -> DataFrame:
    """``(key, base, contribution[], prediction)`` per scored row; for a classifier the output is the predicted class.

    ``target`` is the value the contributions explain: the probability of the output by default, the prediction of a regression.
    Rows without features are left out; a null or repeated key is kept as it is.
    """
    out = F.col(output).cast("int") if output else F.lit(0)
    if target is None:
        target = F.element_at(vector_to_array("probability"), out + 1) if output else F.col("prediction")
    kind = dict(scored.dtypes)[key]
    rows = scored.filter(F.col("features").isNotNull()).select(key, vector_to_array("features").alias("x"), out.alias("out"), target.alias("target"))
    groups = max(1, -(-leaves.count() // group_leaves))
    if groups == 1:
        return _explained(rows, leaves, key, kind)
    blocks = _blocks(rows, key, kind)
    group = F.pmod(F.xxhash64("tree", "leaf"), F.lit(groups)).cast("int").alias("g")
    packed = leaves.select(group, F.struct("only", "value", "tests").alias("leaf")).groupBy("g").agg(F.collect_list("leaf").alias("leaves"))
    pairs = blocks.select("block", "n", "x", "out", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")).join(packed, "g")

    def part(batches):
        told = lambda block, lane, whole: pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([lane], pa.int32()), pa.array([whole.tobytes()], pa.binary())], ["block", "lane", "part"])
        open_ = None  # groups of a block that follow each other are added up at once
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}  # one at a time: the leaves of a batch are many
                x = np.frombuffer(row["x"]).reshape(row["n"], -1)
                phi, base = shapley(_games(row["leaves"]), x, np.frombuffer(row["out"], np.int32))
                whole = np.column_stack([base, phi])
                if open_ and open_[0] == row["block"]:
                    whole += open_[2]
                elif open_:
                    yield told(*open_)
                open_ = (row["block"], row["g"] % MERGE_WAYS, whole)
        if open_:
            yield told(*open_)

    def add(pdf):
        total = sum(np.frombuffer(p) for p in pdf["part"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "lane": [0], "part": [total.tobytes()]})

    shape = "block bigint, lane int, part binary"
    parts = pairs.select("block", "g", "n", "x", "out", "leaves").mapInArrow(part, shape)
    if groups > MERGE_WAYS:
        parts = parts.groupBy("block", "lane").applyInPandas(add, shape)
    added = parts.groupBy("block").applyInPandas(add, shape)

    def unpack(batches):
        for batch in batches:
            for i, row in enumerate(batch.select(["n", "part"]).to_pylist()):
                whole = np.frombuffer(row["part"]).reshape(row["n"], -1)
                yield _told(key, batch.column("keys")[i].values, whole[:, 0], whole[:, 1:], batch.column("target")[i].values)

    rejoined = blocks.select("block", "n", "keys", "target").join(added.select("block", "part"), "block")
    return rejoined.mapInArrow(unpack, f"{key} {kind}, base double, contribution array<double>, prediction double")


def row_attribution(contrib: DataFrame, names: list[str], key: str = "number", top: int = 5) -> DataFrame:
    """The strongest contributions per row as tidy rows."""
    labels = F.array(*[F.lit(n) for n in names])
    pairs = F.zip_with("contribution", labels, lambda v, n: F.struct((-F.abs(v)).alias("o"), n.alias("feature"), v.alias("v")))
    best = F.slice(F.array_sort(pairs), 1, top)
    return contrib.select(key, "base", "prediction", F.posexplode(best).alias("i", "c")).select(
        key, (F.col("i") + 1).cast("bigint").alias("rank"), "c.feature", F.round("c.v", 6).alias("contribution"),
        F.round("base", 6).alias("base"), F.round("prediction", 6).alias("prediction"))


def global_attribution(contrib: DataFrame, names: list[str], top: int = 15) -> DataFrame:
    """Mean absolute contribution per feature, one aggregate with one column per vector slot."""
    one = contrib.agg(*[F.avg(F.abs(F.col("contribution")[i])).alias(f"c{i}") for i in range(len(names))])
    cells = [F.struct(F.lit(n).alias("feature"), F.col(f"c{i}").alias("mean_abs")) for i, n in enumerate(names)]
    return one.select(F.inline(F.array(*cells))).orderBy(F.col("mean_abs").desc(), "feature").limit(top)
