"""Multi-class gradient boosting with a softmax loss: one tree per class and round, grown level by level.

Features are cut into bins once; rows with the same bins are counted and their patterns packed into blocks. Every level of all the round's trees is one job. Tasks add
gradients and curvatures up per (class, node, feature, bin), these histograms are added in two steps, and the best split
of every node is chosen where its histogram ends up. Only chosen splits, a few numbers a node, reach the driver. Scores of
the rows are stored every ``STATE_ROUNDS`` rounds, so a task applies a bounded number of trees and a lost executor costs
at most those. The loss of the validation rows comes with the first level of the next round and stops the boosting.

Rows with a label that the training rows lack count in the validation loss as if their class had the smallest probability.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from opsloom.session import written

BINS = 32
BLOCK_ROWS = 4096
STATE_ROUNDS = 8
MERGE_WAYS = 32
LEAST_CURVATURE = 1e-6
PRODUCT_SLOTS = 40  # slots times nodes a feature up to which a histogram is worked out as a product
PRODUCT_CELLS = 1 << 21  # numbers of a factor of such a product
PACKED = ("bins", "at", "label", "is_val", "rows")
BLOCK = "n int, " + ", ".join(f"{c} binary" for c in PACKED)


def bin_edges(rows: DataFrame, column: str = "features", bins: int = BINS) -> list[np.ndarray]:
    """Upper bounds of the bins of every slot, from quantiles of the rows; equal bounds are one."""
    width = len(rows.select(vector_to_array(column).alias("x")).first()["x"])
    at = [i / bins for i in range(1, bins)]
    wide = rows.select(vector_to_array(column).alias("x"))
    found = wide.agg(*[F.percentile_approx(F.get("x", i), at, 1000).alias(f"s{i}") for i in range(width)]).first()
    return [np.unique(np.array(found[f"s{i}"] or [0.0], np.float64)) for i in range(width)]


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(values.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.searchsorted(e, values[:, i], "left")
    return out


def blocks(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Rows (``features``, ``label``, ``is_val``) as packed blocks of distinct bin patterns: ``n``, ``bins``, and per pattern, label
    and split the number of rows (``at``, ``label``, ``is_val``, ``rows``).

    Rows with the same bins have the same scores in every round, so they are counted once and the work of a level grows
    with the patterns. A pattern has at most two counts a class.
    """
    def cut(batches):
        for part in batches:
            values = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in binned(values, edges)], pa.binary()), part.column("label"), part.column("is_val")], ["bins", "label", "is_val"])

    def pack(batches):
        for part in (b.slice(lo, BLOCK_ROWS) for b in batches for lo in range(0, b.num_rows, BLOCK_ROWS)):
            of = part.column("of")
            entries = of.flatten()
            at = np.repeat(np.arange(part.num_rows, dtype=np.int32), np.diff(of.offsets.to_numpy()))
            column = lambda name, kind: entries.field(name).to_numpy(zero_copy_only=False).astype(kind).tobytes()
            packed = (b"".join(part.column("bins").to_pylist()), at.tobytes(), column("label", np.int32), column("is_val", np.uint8), column("rows", np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32())] + [pa.array([x], pa.binary()) for x in packed], ["n", *PACKED])

    plain = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label"), "is_val").mapInArrow(cut, "bins binary, label int, is_val boolean")
    counted = plain.groupBy("bins", "label", "is_val").agg(F.count(F.lit(1)).alias("rows"))
    cores = rows.sparkSession.sparkContext.defaultParallelism  # a level is one job over the stored blocks, so there is a file for every core
    patterns = counted.repartition(4 * cores, "bins").groupBy("bins").agg(F.collect_list(F.struct("label", "is_val", "rows")).alias("of"))
    return patterns.mapInArrow(pack, BLOCK)


@dataclass
class Tree:
    """A binary tree in heap order: node i has the children 2i + 1 (bin up to ``cut``) and 2i + 2; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, np.float64))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of every row; ``bins`` is fastest column by column."""
        at = np.zeros(len(bins), np.int32)
        for node in np.flatnonzero(self.feature >= 0):  # parents come before their children
            right = bins[:, self.feature[node]] > self.cut[node]
            at = np.where(at == node, np.int32(2 * node + 1) + right, at)
        return at


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def add_rounds(scores: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    for trees in rounds:
        for k, tree in enumerate(trees):
            scores[:, k] += tree.value[tree.nodes(bins)]
    return scores


def _per_row(scores):
    """``scores`` of whole arrays as a column function of rows: an array of numbers for each array of features."""
    @F.arrow_udf("array<double>")
    def score(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.list_(pa.float64()))
        out = scores(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1))
        return pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], np.ascontiguousarray(out).ravel())

    return score


@dataclass
class BoostedTrees:
    """Fitted model; ``transform`` adds ``probability`` and ``prediction`` as Spark's own classifiers do."""

    edges: list[np.ndarray]
    start: np.ndarray
    rounds: list[list[Tree]]
    gains: np.ndarray
    losses: list[float] = field(default_factory=list)

    @property
    def num_classes(self) -> int:
        return len(self.start)

    def shares(self) -> np.ndarray:
        """Share of the total gain of every slot."""
        return self.gains / self.gains.sum() if self.gains.sum() > 0 else self.gains

    def margins(self, values: np.ndarray) -> np.ndarray:
        """Scores per class before the softmax."""
        bins = np.asfortranarray(binned(values, self.edges))
        return add_rounds(np.tile(self.start, (len(bins), 1)), bins, self.rounds)

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        return softmax(self.margins(values))

    def with_margins(self, df: DataFrame, column: str = "features") -> DataFrame:
        """``margins``: the scores per class of every row."""
        return df.withColumn("margins", _per_row(self.margins)(vector_to_array(column)))

    def transform(self, df: DataFrame, column: str = "features") -> DataFrame:
        scored = df.withColumn("__p", _per_row(self.probabilities)(vector_to_array(column)))
        best = F.array_position("__p", F.array_max("__p")) - 1
        return scored.withColumn("probability", array_to_vector("__p")).withColumn("prediction", best.cast("double")).drop("__p")


def _unpacked(row: dict, start: np.ndarray):
    n = row["n"]
    bins = np.asfortranarray(np.frombuffer(row["bins"], np.uint8).reshape(n, -1))
    scores = np.frombuffer(row["scores"], np.float64).reshape(n, -1).copy() if row.get("scores") is not None else np.tile(start, (n, 1))
    return bins, scores


def _counts(row: dict):
    """Pattern, label, split and number of the rows of a block."""
    kinds = (np.int32, np.int32, np.uint8, np.int64)
    at, label, val, rows = (np.frombuffer(row[c], kind) for c, kind in zip(PACKED[1:], kinds))
    return at, label, val.astype(bool), rows


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _histograms(bins: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, nodes: int, slots: np.ndarray) -> np.ndarray:
    """Gradients ``g`` and curvatures ``h`` (patterns x classes) added up per class, node and slot; ``at`` is the node of a pattern per class, -1 for none.

    ``slots`` has the first slot of every feature and the number of all. With few slots and nodes this is one product of the
    patterns' slots with their values; else values are added up slot by slot.
    """
    n, classes = g.shape
    width, size = len(slots) - 1, slots[-1]
    out = np.zeros((classes, 2, nodes, size))
    if size * nodes <= PRODUCT_SLOTS * width:
        step = max(64, PRODUCT_CELLS // size)
        for lo in range(0, n, step):
            part = slice(lo, min(lo + step, n))
            rows = np.arange(part.stop - lo)
            held = np.zeros((len(rows), size))
            held[rows[:, None], slots[:-1] + bins[part]] = 1
            values = np.zeros((len(rows), classes, 2, nodes))
            for k in range(classes):
                inside = np.flatnonzero(at[k, part] >= 0)
                node = at[k, part][inside]
                values[inside, k, 0, node], values[inside, k, 1, node] = g[part][inside, k], h[part][inside, k]
            out += (values.reshape(len(rows), -1).T @ held).reshape(out.shape)
        return out
    base = slots[:-1] + bins
    for k in range(classes):
        inside = at[k] >= 0
        slot = (at[k][inside, None] * size + base[inside]).ravel()
        for i, values in enumerate((g, h)):
            out[k, i] += np.bincount(slot, np.repeat(values[inside, k], width), nodes * size).reshape(nodes, size)
    return out


def _level(data: DataFrame, start: np.ndarray, done: list[list[Tree]], growing: list[Tree], level: int, slots: np.ndarray, l2: float, least: float, parts: int) -> tuple[list, tuple]:
    """Best split of every node of a level, ``parts`` being those of ``data``: (class, node, feature, cut, gain, left, right, total value) rows, and (loss, rows) of the validation rows."""
    classes, nodes, width = len(start), 2**level, len(slots) - 1

    def partial(batches):
        total = None
        loss, seen = 0.0, 0
        for row in _rows(batches):
            bins, scores = _unpacked(row, start)
            of, label, val, rows = _counts(row)
            p = softmax(add_rounds(scores, bins, done))
            known = label < classes
            if level == 0:
                own = np.where(known, p[of, np.minimum(label, classes - 1)], p.min(axis=1)[of])
                loss, seen = loss - float((rows * np.log(np.maximum(own, 1e-15)))[val].sum()), seen + int(rows[val].sum())
            use = ~val & known
            if not use.any():
                continue
            there = np.unique(of[use])  # patterns with training rows
            own = np.bincount(of[use] * classes + label[use], rows[use], len(p) * classes).reshape(-1, classes)[there]
            bins, p = np.asfortranarray(bins[there]), p[there]
            weight = own.sum(axis=1)[:, None]
            at = np.stack([tree.nodes(bins) for tree in growing]) - (nodes - 1)
            found = _histograms(bins, weight * p - own, weight * np.maximum(p * (1 - p), LEAST_CURVATURE), at, nodes, slots)
            total = found if total is None else total + found
        lane = TaskContext.get().partitionId() % MERGE_WAYS
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([lane], pa.int32()), pa.array([np.array([loss, seen]).tobytes()], pa.binary())], ["k", "lane", "part"])
        for k in range(classes if total is not None else 0):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([lane], pa.int32()), pa.array([total[k].tobytes()], pa.binary())], ["k", "lane", "part"])

    def add(key, pdf):
        return pd.DataFrame({"k": [key[0]], "lane": [0], "part": [sum(np.frombuffer(p) for p in pdf["part"]).tobytes()]})

    def choose(key, pdf):
        k, part = key[0], sum(np.frombuffer(p) for p in pdf["part"])
        names = ["k", "node", "feature", "cut", "gain", "left", "right", "own"]
        if k < 0:
            return pd.DataFrame([(-1, 0, 0, 0, part[0], part[1], 0.0, 0.0)], columns=names)
        g, h = both = np.zeros((2, nodes, width, BINS))
        both[:, :, np.repeat(np.arange(width), np.diff(slots)), np.arange(slots[-1]) - np.repeat(slots[:-1], np.diff(slots))] = part.reshape(2, nodes, -1)
        out = []
        for node in range(nodes):
            gt, ht = g[node, 0].sum(), h[node, 0].sum()
            if ht <= 0:
                continue
            gl, hl = np.cumsum(g[node], axis=1)[:, :-1], np.cumsum(h[node], axis=1)[:, :-1]
            gr, hr = gt - gl, ht - hl
            gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - gt * gt / (ht + l2)
            gain[(hl < least) | (hr < least)] = -np.inf
            feature, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
            best = float(gain[feature, cut])
            own = -gt / (ht + l2)
            if best > 1e-9:
                left, right = -gl[feature, cut] / (hl[feature, cut] + l2), -gr[feature, cut] / (hr[feature, cut] + l2)
                out.append((k, node + nodes - 1, int(feature), int(cut), best, float(left), float(right), float(own)))
            else:
                out.append((k, node + nodes - 1, -1, 0, 0.0, 0.0, 0.0, float(own)))
        return pd.DataFrame(out, columns=names)

    shape = "k int, lane int, part binary"
    added = data.mapInArrow(partial, shape)
    if parts > MERGE_WAYS:
        added = added.groupBy("k", "lane").applyInPandas(add, shape)
    found = added.groupBy("k").applyInPandas(choose, "k int, node int, feature int, cut int, gain double, left double, right double, own double").collect()
    loss = next(((r["gain"], r["left"]) for r in found if r["k"] < 0), (0.0, 0.0))
    return [r for r in found if r["k"] >= 0], loss


def fit_boosted(rows: DataFrame, classes: int, rounds: int = 40, depth: int = 3, rate: float = 0.3, l2: float = 1.0, least: float = 1.0, patience: int = 3, bins: int = BINS) -> BoostedTrees:
    """Fit on rows (``features``, ``label`` from 0, ``is_val``); the round with the smallest validation loss is the last that stays.

    Without validation rows all rounds stay.
    """
    train = rows.filter(~F.col("is_val") & (F.col("label") < classes))
    edges = bin_edges(train, bins=min(bins, BINS))
    width = len(edges)
    slots = np.append(0, np.cumsum([len(e) + 1 for e in edges]))
    counts = {int(r["label"]): r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    share = np.array([counts.get(k, 0) + 1.0 for k in range(classes)])
    start = np.log(share / share.sum())
    data = written(blocks(rows, edges), "boost-blocks")
    parts = data.rdd.getNumPartitions()
    kept: list[list[Tree]] = []
    fresh: list[list[Tree]] = []
    gains, losses, best = [], [], (np.inf, 0)
    for r in range(rounds + 1):
        growing, gain = [Tree.empty(depth) for _ in range(classes)], np.zeros(width)
        for level in range(depth):
            found, (loss, seen) = _level(data, start, fresh, growing, level, slots, l2, least, parts)
            if level == 0 and seen:
                losses.append(loss / seen)
                best = min(best, (losses[-1], r))
            if level == 0 and (r == rounds or (seen and r - best[1] >= patience)):
                cut = best[1] if losses else r
                return BoostedTrees(edges, start, (kept + fresh)[:cut], np.sum(gains[:cut], axis=0) if cut else np.zeros(width), losses)
            for s in found:
                tree, node = growing[s["k"]], s["node"]
                if level == 0:
                    tree.value[node] = rate * s["own"]
                if s["feature"] >= 0:
                    tree.feature[node], tree.cut[node] = s["feature"], s["cut"]
                    tree.value[2 * node + 1], tree.value[2 * node + 2] = rate * s["left"], rate * s["right"]
                    gain[s["feature"]] += s["gain"]
        fresh.append(growing)
        gains.append(gain)
        if len(fresh) == STATE_ROUNDS:
            data = written(_with_scores(data, start, fresh), "boost-state")
            parts = data.rdd.getNumPartitions()
            kept, fresh = kept + fresh, []
    raise AssertionError("the last round returns")


def _with_scores(data: DataFrame, start: np.ndarray, rounds: list[list[Tree]]) -> DataFrame:
    """Blocks with the scores after ``rounds``."""
    def run(batches):
        for row in _rows(batches):
            bins, scores = _unpacked(row, start)
            scores = add_rounds(scores, bins, rounds)
            yield pa.RecordBatch.from_arrays([pa.array([row["n"]], pa.int32())] + [pa.array([x], pa.binary()) for x in (*(row[c] for c in PACKED), scores.tobytes())], ["n", *PACKED, "scores"])

    return data.mapInArrow(run, f"{BLOCK}, scores binary")
