"""A stored vector index that prunes: sign codes of random hyperplanes, candidates by code, exact scores for candidates only.

Every vector has a code of ``bits`` signs. A search compares codes (an eighth of a byte a bit), keeps about ``candidates``
vectors per query by Hamming distance, and fetches and scores only those. Planes come from a seed, so vectors can be
appended at any time without fitting anything again. How many candidates a wanted recall takes is measured on the stored
vectors with a bounded sample of queries and written beside them.

Codes and vectors are packed into blocks by id hash, so no block grows with copies of a vector. As blocks are random parts of
the corpus, each gives its share of the candidates plus four deviations. Candidates are scored where their block was met, and
only the K best of a block leave its task.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from opsloom.operators.vectors import SCORE_DIGITS, _blocks, _grid, _pack, _plain, _ranked, knn
from opsloom.session import written

BITS, SEED = 512, 42
BLOCK_ROWS = 4096
SLICE_ROWS = 64  # queries whose codes are compared at once: 2 MB against a word of a full block's codes
RECALL, SAMPLE_QUERIES = 0.95, 1000
START, STEP = 8, 1.5  # candidates per match that the measurement starts with, and their growth


def planes(dimensions: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, bits)).astype(np.float32)


def coded(rows: DataFrame, dimensions: int, bits: int, seed: int) -> DataFrame:
    """``id``, ``vec`` and ``code`` of rows (``id``, ``vec``); a vector of another dimension fails the job."""
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        shape = planes(dimensions, bits, seed)
        for batch in batches:
            vecs = batch.column("vec")
            if (np.diff(vecs.offsets.to_numpy()) != dimensions).any():
                raise ValueError(f"a vector has not {dimensions} dimensions")
            flat = vecs.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            code = np.packbits(flat @ shape > 0, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), vecs, pa.array([c.tobytes() for c in code], pa.binary())], ["id", "vec", "code"])

    return rows.mapInArrow(run, f"id {kind}, vec array<float>, code binary")


@dataclass
class CodeIndex:
    """The index below ``path``: the table ``vectors`` and a manifest."""

    spark: SparkSession
    path: str
    dimensions: int
    bits: int
    seed: int
    candidates_per_match: float

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def append(self, new: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> "CodeIndex":
        """Add vectors; what was stored stays as it is."""
        coded(_plain(new, id_col, vec_col), self.dimensions, self.bits, self.seed).write.mode("append").parquet(f"{self.path}/vectors")
        return self

    def search(self, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", exclude_self: bool = False, candidates: int | None = None) -> DataFrame:
        """Top-K by inner product among the candidates: ``query_id``, ``match_id``, ``score``, ``rank``; equal scores go to the smaller id."""
        asked = written(coded(_plain(queries, id_col, vec_col), self.dimensions, self.bits, self.seed), "asked-codes")
        kind = dict(asked.dtypes)["id"]
        scale = 10.0**SCORE_DIGITS

        def best(q_ids, q, c_ids, c, rows, cols):
            value = np.rint(np.einsum("ij,ij->i", q[rows].astype(np.float64), c[cols].astype(np.float64)) * scale)
            if exclude_self:
                other = q_ids.take(pa.array(rows)).to_numpy(zero_copy_only=False) != c_ids.take(pa.array(cols)).to_numpy(zero_copy_only=False)
                rows, cols, value = rows[other], cols[other], value[other]
            rows, cols, value = _ranked(rows, cols, value, k)
            return rows, cols, [pa.array(value / scale)]

        scored = self._scan(asked, candidates or max(k, round(k * self.candidates_per_match)), BLOCK_ROWS, best, f"query_id {kind}, match_id {kind}, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "match_id")
        return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)

    def candidates(self, asked: DataFrame, count: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """Pairs (``query_id``, ``match_id``) of the closest codes of every query, about ``count`` of each."""
        kind = dict(asked.dtypes)["id"]
        return self._scan(asked, count, block_rows, lambda q_ids, q, c_ids, c, rows, cols: (rows, cols, []), f"query_id {kind}, match_id {kind}")

    def _scan(self, asked: DataFrame, count: int, block_rows: int, take, shape: str) -> DataFrame:
        """What ``take`` keeps of the candidates of every slice of queries and block of vectors, whose ids are in order."""
        store = self.vectors
        n = store.count()
        blocks, q_blocks = _blocks(n, block_rows), _blocks(asked.count(), block_rows)
        names = [c.split()[0] for c in shape.split(", ")]

        def nearest(batches):
            def arrays(scalar):
                rows = scalar.values
                order = np.argsort(rows.field("id").to_numpy(zero_copy_only=False), kind="stable")
                code = np.frombuffer(b"".join(rows.field("code").to_pylist()), np.uint64).reshape(len(rows), -1)
                vec = rows.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                return rows.field("id").take(pa.array(order)), np.ascontiguousarray(code[order].T), vec[order]

            for batch in batches:
                for i in range(batch.num_rows):
                    (q_ids, q, q_vec), (c_ids, c, c_vec) = arrays(batch.column("q_rows")[i]), arrays(batch.column("c_rows")[i])
                    share = count * len(c_ids) / max(n, 1)
                    few = min(len(c_ids), int(np.ceil(share + (4 * np.sqrt(share) if blocks > 1 else 0))))
                    apart, bits = np.empty((SLICE_ROWS, len(c_ids)), np.uint64), np.empty((SLICE_ROWS, len(c_ids)), np.uint8)
                    gap = np.empty((SLICE_ROWS, len(c_ids)), np.uint16)
                    for lo in range(0, len(q_ids), SLICE_ROWS):
                        m = min(SLICE_ROWS, len(q_ids) - lo)
                        gap[:m] = 0
                        for w in range(len(c)):
                            np.bitwise_xor(q[w, lo:lo + m, None], c[w], out=apart[:m])
                            np.bitwise_count(apart[:m], out=bits[:m])
                            gap[:m] += bits[:m]
                        near = np.argpartition(gap[:m], few - 1, axis=1)[:, :few] if few < len(c_ids) else np.tile(np.arange(len(c_ids)), (m, 1))
                        rows, cols, more = take(q_ids, q_vec, c_ids, c_vec, np.repeat(np.arange(lo, lo + m), few), near.ravel())
                        yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(rows)), c_ids.take(pa.array(cols)), *more], names)

        pack = lambda df, parts: _pack(df.select("id", "vec", "code").withColumn("parts", F.lit(parts)), [], ("id", "vec", "code"))
        return _grid(pack(asked, q_blocks), q_blocks, pack(store, blocks), blocks).select("q_rows", "c_rows").mapInArrow(nearest, shape)


def build_code_index(corpus: DataFrame, path: str, k: int = 10, bits: int = BITS, seed: int = SEED, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> CodeIndex:
    """Store the coded corpus below ``path`` and measure how many candidates ``recall`` takes, on up to ``SAMPLE_QUERIES`` of its own vectors."""
    spark = corpus.sparkSession
    plain = _plain(corpus, id_col, vec_col)
    first = plain.first()
    if first is None:
        raise ValueError("an index needs at least one vector")
    coded(plain, len(first["vec"]), bits, seed).write.mode("errorifexists").parquet(f"{path}/vectors")
    index = CodeIndex(spark, path, len(first["vec"]), bits, seed, START)
    sample = written(index.vectors.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES), "sample-queries")
    exact = written(knn(sample, index.vectors, k, id_col="id", vec_col="vec").select("query_id", "match_id"), "sample-matches")
    pairs, n = exact.count(), index.vectors.count()
    while index.candidates_per_match * k < n:
        found = index.search(sample, k, "id", "vec").select("query_id", "match_id")
        if exact.join(found, ["query_id", "match_id"], "left_semi").count() >= recall * pairs:
            break
        index.candidates_per_match *= STEP
    told = json.dumps({"dimensions": index.dimensions, "bits": bits, "seed": seed, "candidates_per_match": index.candidates_per_match})
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return index


def open_code_index(spark: SparkSession, path: str) -> CodeIndex:
    """An index that was built before, by any session."""
    return CodeIndex(spark, path, **json.loads(spark.read.text(f"{path}/manifest").first()["value"]))
