"""Mixing sources to target weights by fitting a subset sum.

A source's documents are counted by exact length. A source whose budget exceeds its size takes all documents once; the
rest of the budget is fitted over the counts: every length gives its share rounded down, then bounded-knapsack dynamic
programming spends what is left, as near to the budget as the documents allow. The counts of one source are bounded by
its distinct lengths, never by its rows. Which documents of a length are taken follows a seeded hash order, so reruns
agree.

Defined results: a null text has size 0 and is never needed, so it is taken 0 times; a null source is a source of its
own and the last one; a source of size 0 has target 0; rows that repeat an id are rows of their own, told apart by
their text; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from opsloom.llm.common import documents, grouped_rank, text_of, words_of
from opsloom.session import written

Q, S = {}, {}

SEED = 10
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
DP_BUDGET = 20_000


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their sum is as near to ``budget`` as can be found, not above it.

    Shares rounded down come first; longer lengths then fill up until about ``DP_BUDGET`` words are left, and those are
    spent by dynamic programming over (length, copies) in binary pieces.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return np.where(lengths > 0, counts, 0)
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    take[lengths == 0] = 0
    left = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= DP_BUDGET:
            break
        if lengths[i]:
            more = min(int(counts[i] - take[i]), (left - DP_BUDGET) // int(lengths[i]) + 1, left // int(lengths[i]))
            take[i] += more
            left -= more * int(lengths[i])
    return take + _knapsack(lengths, counts - take, left)


def _knapsack(lengths: np.ndarray, spare: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum up to ``budget`` by dynamic programming on a bit set; whole-number copies in binary pieces."""
    pieces, reach = [], [1]
    mask = (1 << (budget + 1)) - 1
    for i in np.argsort(-lengths, kind="stable"):
        size, n, k = int(lengths[i]), int(spare[i]), 1
        n = min(n, budget // size) if size else 0
        while n > 0:
            k = min(k, n)
            pieces.append((i, k, size * k))
            reach.append((reach[-1] | (reach[-1] << (size * k))) & mask)
            n, k = n - k, k * 2
        if reach[-1] >> budget & 1:
            break
    take, at = np.zeros(len(lengths), np.int64), reach[-1].bit_length() - 1
    for (i, k, w), before in zip(reversed(pieces), reversed(reach[:-1])):
        if not before >> at & 1:
            take[i] += k
            at -= w
    return take


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source``, ``source_size``, ``target``: sources in code point order (null last) carry repeating weights and share
    ``share`` of all words; a target stops at ``most`` times its source's size and the excess is shared again by weight.

    Only sums over all sources reach the driver. A cap that is passed once stays passed, since a level only rises.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = written(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.array(*[F.lit(w) for w in weights])[F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))]), "sources")
    cap = F.col("source_size") * most
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        under = F.col("weight") * F.lit(level) < cap
        row = table.agg(F.sum(F.when(under, F.col("weight"))).alias("w"), F.coalesce(F.sum(F.when(~under, cap)), F.lit(0)).alias("full")).first()
        if not row["w"]:
            break
        higher = (total - row["full"]) / row["w"]
        if higher <= level:
            break
        level = higher
    return table.select("source", "source_size", F.least(F.col("weight") * F.lit(level), cap.cast("double")).alias("target"))


def fit_sources(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source and length: ``whole`` (copies every document gets) and ``take`` (documents that get one more)."""
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False)
        size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        goal = int(round(target))
        whole = min(goal // size, MOST) if size else 0
        take = fit_counts(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), goal - whole * size)
        return pd.DataFrame({"source": rows["source"].array, "size": rows["size"].array, "whole": whole, "take": take})

    joined = counts.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    return joined.groupBy("source").applyInPandas(fit, "source string, size bigint, whole bigint, take bigint")


def mix(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per document: ``size``, ``source``, ``source_size``, ``target`` and ``copies`` (0 to 2)."""
    text = text_of()
    sizes = written(docs.select("doc_id", F.xxhash64(text).alias("row_hash"), "source", F.size(words_of(text)).cast("bigint").alias("size")), "sizes")
    targets = written(source_targets(sizes, weights, share), "targets")
    counts = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    plan = written(fit_sources(counts, targets), "mix-plan")
    ranked = grouped_rank(sizes, ["source", "size"], seed, ["doc_id", "row_hash"], sizes.count())
    named = plan.select(F.col("source").alias("__s"), F.col("size").alias("__z"), "whole", "take")
    joined = ranked.join(named, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")), "left")
    goal = targets.withColumnRenamed("source", "__t")
    joined = joined.join(goal, F.col("source").eqNullSafe(F.col("__t")), "left")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + (F.col("rank") < F.col("take")).cast("int"))
    return joined.select("doc_id", "row_hash", "source", "size", "source_size", "target", copies.cast("int").alias("copies"))


def op10_mixing(spark, sf_dir):
    out = mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))


Q["op10_mixing"] = op10_mixing
