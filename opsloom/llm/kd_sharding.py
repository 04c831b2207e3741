"""K-d tree sharding by weight.

Documents are points in a space of metadata dimensions. A node with k shards is split into two of ``k // 2`` and
``k - k // 2`` along its widest dimension, at the weighted quantile of that share, until every leaf is one shard; all
nodes of a level are split together. The law is ``bytes``: shards are near equal in bytes.

Equal texts are first added up to one unit, so a group of copies is one row before any shuffle. A unit heavier than a
fiftieth of a shard is cut by the hash of the id, so no group keeps the shards apart; lighter groups stay together. The
quantile is found by narrowing a range of 64-bit keys (place in the dimension, then hash of the unit): each pass adds up
the bytes of a few thousand equal ranges per node, and only these sums, bounded by the number of shards, reach the driver.

Defined results: a null text has size 16 and the checksum of the empty text; a null in a dimension is a place of its own
at its lower end; rows that repeat an id are rows of their own; an empty table gives an empty result; other columns of
the input are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from opsloom.llm.common import documents, grouped_rank, text_of
from opsloom.session import written

Q, S = {}, {}

SHARDS = 40
OVERHEAD = 16
SEED = 6
RANGES = 4096
LEEWAY = 0.0005  # of a shard: how close to its target a cut must come
UNIT = 0.02  # of a shard: copies of one text heavier than this are cut
TIE_BITS = 31


def place_of_name(name: Column) -> Column:
    """A name's place on a line: the hash of the name in (0, 1), and 0 for null."""
    return F.coalesce(F.pmod(F.xxhash64(name), F.lit(10**6)) / F.lit(1e6) * 0.999 + 0.001, F.lit(0.0))


def dimensions() -> dict[str, Column]:
    """Places of a unit, each in [0, 1]: the length of the text, its language and its source."""
    length = F.least(F.log2(F.col("length") + 1) / 40.0, F.lit(1.0))
    return {"d_length": length, "d_lang": place_of_name(F.col("lang")), "d_source": place_of_name(F.col("source"))}


def sized(docs: DataFrame) -> DataFrame:
    text = text_of()
    length = F.octet_length(text).cast("bigint")
    return docs.select("doc_id", "lang", "source", (length + OVERHEAD).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
                       F.xxhash64(text).alias("row_hash"), F.unhex(F.md5(text)).alias("text_key"), length.alias("length"))


def units_of(rows: DataFrame, shard_bytes: float) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``chunk``, and one row per (text, chunk): bytes, rows, places and the tie hash."""
    heavy = rows.groupBy("text_key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > UNIT * shard_bytes)
    chunks = written(heavy.select(F.col("text_key").alias("__k"), F.ceil(F.col("bytes") / F.lit(UNIT * shard_bytes)).cast("int").alias("chunks")), "kd-heavy")
    # Units above a fiftieth of a shard number at most 50 a shard, so this side is bounded by the shards.
    rows = rows.join(F.broadcast(chunks), F.col("text_key") == F.col("__k"), "left").withColumn(
        "chunk", F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "row_hash"), F.coalesce("chunks", F.lit(1))).cast("int"))).drop("__k", "chunks")
    units = rows.groupBy("text_key", "chunk").agg(F.sum("size").alias("bytes"), F.min("length").alias("length"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    tie = F.shiftrightunsigned(F.xxhash64("text_key", "chunk"), 64 - TIE_BITS)
    places = {k: (F.floor(c * F.lit(2**31)).cast("bigint") * F.lit(2**TIE_BITS) + F.col("tie")).alias(k) for k, c in dimensions().items()}
    return rows, units.withColumn("tie", tie).select("text_key", "chunk", "bytes", *places.values())


def quantile_keys(units: DataFrame, goals: dict[int, tuple[str, int, int, float]], leeway: float) -> dict[int, int]:
    """Per node the key up to which (exclusive) its goal of bytes lies, in the node's dimension; ``goals``: (dimension, low, high, bytes)."""
    state = {n: {"dim": d, "lo": lo, "hi": hi + 1, "goal": goal, "below": 0.0} for n, (d, lo, hi, goal) in goals.items()}
    done: dict[int, int] = {}
    while state:
        step = {n: max(1, -(-(s["hi"] - s["lo"]) // RANGES)) for n, s in state.items()}
        pick = lambda f: F.coalesce(*[F.when(F.col("node") == n, f(n, s)) for n, s in state.items()])
        inside = units.filter(F.col("node").isin(*state)).select(
            "node", "bytes", pick(lambda n, s: F.col(s["dim"])).alias("key"), pick(lambda n, s: F.lit(s["lo"])).alias("lo"),
            pick(lambda n, s: F.lit(s["hi"])).alias("hi"), pick(lambda n, s: F.lit(step[n])).alias("step")).filter("key >= lo AND key < hi")
        sums = inside.selectExpr("node", "(key - lo) div step AS slot", "bytes").groupBy("node", "slot").agg(F.sum("bytes").alias("bytes")).collect()  # at most shards x RANGES rows
        by_node: dict[int, list] = {}
        for r in sums:
            by_node.setdefault(r["node"], []).append((r["slot"], r["bytes"]))
        for n in list(state):
            s, slots = state[n], sorted(by_node.get(n, []))
            ends = s["below"] + np.cumsum([b for _, b in slots]) if slots else np.array([])
            k = min(int(np.searchsorted(ends, s["goal"])), len(slots) - 1)
            before, after = (ends[k - 1] if k else s["below"]), ends[k]
            left, right = s["lo"] + slots[k][0] * step[n], s["lo"] + (slots[k][0] + 1) * step[n]
            near, cut = min((abs(before - s["goal"]), left), (abs(after - s["goal"]), right))
            if near <= leeway or step[n] == 1:
                done[n] = cut
                del state[n]
            else:
                s["lo"], s["hi"], s["below"] = left, min(right, s["hi"]), before
    return done


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: its columns of ``sized``, and ``shard``."""
    rows = written(sized(docs), "kd-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return rows.withColumn("shard", F.lit(0))
    rows, units = units_of(rows, total / shards)
    units = written(units.withColumn("node", F.lit(0)), "kd-units")
    tree, dims, fresh = {0: (0, shards)}, list(dimensions()), 1  # node: first shard and number of shards
    while split := [n for n, (_, k) in tree.items() if k > 1]:
        stats = units.filter(F.col("node").isin(*split)).groupBy("node").agg(
            F.sum("bytes").alias("bytes"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).collect()  # a row for each node
        goals = {}
        for r in stats:
            dim = max(dims, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"], d))
            k = tree[r["node"]][1]
            goals[r["node"]] = (dim, r[f"lo_{dim}"], r[f"hi_{dim}"], r["bytes"] * (k // 2) / k)
        found = quantile_keys(units, goals, LEEWAY * total / shards)
        moves = []
        for n in split:
            first, k = tree[n]
            if n not in goals:  # a node without rows
                tree[n] = (first, 1)
                continue
            tree[n], tree[fresh] = (first, k // 2), (first + k // 2, k - k // 2)
            moves.append(F.when((F.col("node") == n) & (F.col(goals[n][0]) >= found[n]), F.lit(fresh)))
            fresh += 1
        if moves:
            units = written(units.withColumn("node", F.coalesce(*moves, F.col("node"))), "kd-units")
    shard = F.coalesce(*[F.when(F.col("node") == n, F.lit(first)) for n, (first, _) in tree.items()])
    placed = units.select(F.col("text_key").alias("__k"), F.col("chunk").alias("__c"), shard.alias("shard"))
    return rows.join(placed, (F.col("text_key") == F.col("__k")) & (F.col("chunk") == F.col("__c"))).drop("__k", "__c", "chunk")


def op6_kd_sharding(spark, sf_dir):
    placed = written(kd_shards(documents(spark, sf_dir)).select("doc_id", "row_hash", "size", "text_crc32", "shard"), "kd-shards")
    out = grouped_rank(placed, ["shard"], SEED, ["doc_id", "row_hash"], placed.count(), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


Q["op6_kd_sharding"] = op6_kd_sharding
