"""Dense text embeddings: TF-IDF weights projected on the leading singular directions of the corpus.

The projection comes from randomised subspace iteration: a handful of passes over the weights, where each
task multiplies its own sparse rows and only matrices of vocabulary x dimensions leave it. Both factors of
that size are bounded by parameters, never by the number of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from opsloom.operators.tfidf import DIMENSIONS, MAX_FEATURES, slots_of, term_counts
from opsloom.operators.text import STOP_WORDS, semantic_text
from opsloom.session import materialize, shuffles_removed, written

PASSES, OVERSAMPLE, SEED = 5, 10, 42
SLOTS_PER_CHUNK, MERGE_WAYS = 512, 32
PRODUCT_ENTRIES = 1 << 20  # entries of sparse rows that are multiplied at once


def counted_texts(df: DataFrame, id_col: str, text_col: str, stop_words=STOP_WORDS) -> DataFrame:
    """``(id, terms[], tfs[])``: the terms of every text that has any; texts of one id are one."""
    counts = term_counts(df, id_col, text_col, stop_words)
    packed = counts.groupBy("id").agg(F.collect_list(F.struct("term", "tf")).alias("c"))  # a row a distinct term
    return packed.select("id", F.col("c.term").alias("terms"), F.col("c.tf").alias("tfs"))


def weighted_rows(counted: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(id, ix[], val[])``: unit-length tf x idf of the counted texts that have a term of the vocabulary; slots in order."""
    known = vocab.select("term", "ix", "idf").toPandas()  # at most as many rows as the vocabulary may have
    shared = vocab.sparkSession.sparkContext.broadcast((pa.array(known["term"], pa.string()), known["ix"].to_numpy(np.int32), known["idf"].to_numpy(np.float64)))
    kind = dict(counted.dtypes)["id"]

    def weigh(batches):
        terms, slot, idf = shared.value
        for batch in batches:
            of, held = batch.column("terms"), batch.column("terms").flatten()
            at = pc.index_in(held, value_set=terms)
            row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.diff(of.offsets.to_numpy()))
            found = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
            at, row = at.to_numpy(zero_copy_only=False)[found].astype(np.int64), row[found]
            tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)[found]
            order = np.lexsort((slot[at], row))
            ix, row, weight = slot[at][order], row[order], (tf * idf[at])[order]
            norm = np.sqrt(np.bincount(row, weight * weight, batch.num_rows))
            entries = np.bincount(row, minlength=batch.num_rows)
            some = np.flatnonzero(entries)
            offsets = pa.array(np.append(0, np.cumsum(entries[some])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ix, weight / norm[row])]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(some)), *lists], ["id", "ix", "val"])

    return counted.mapInArrow(weigh, f"id {kind}, ix array<int>, val array<double>")


def sparse_rows(df: DataFrame, vocab: DataFrame, id_col: str, text_col: str, stop_words=STOP_WORDS) -> DataFrame:
    """``(id, ix[], val[])``: unit-length sparse weights per text; at most one entry per vocabulary slot."""
    return weighted_rows(counted_texts(df, id_col, text_col, stop_words), vocab)


def _entries(batches):
    """Row starts, slots and weights of sparse rows, about ``PRODUCT_ENTRIES`` entries at once."""
    for batch in batches:
        ends = batch.column("ix").offsets.to_numpy()
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PRODUCT_ENTRIES, "right")) - 1)
            part = batch.slice(lo, hi - lo)
            starts = part.column("ix").offsets.to_numpy()
            yield part, starts - starts[0], *(part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ix", "val"))
            lo = hi


def _multiply(starts: np.ndarray, ix: np.ndarray, val: np.ndarray, basis: np.ndarray) -> np.ndarray:
    out = np.zeros((len(starts) - 1, basis.shape[1]), basis.dtype)
    for i, (lo, hi) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        out[i] = val[lo:hi] @ basis[ix[lo:hi]]
    return out


def gram_product(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """A'A @ basis for the sparse rows A. Tasks emit chunks of their partial product; chunks are added in two steps.

    A task streams its rows and emits a whole matrix, so there are as many tasks as cores however many parts the rows have.
    Products are in single precision, what they add up to in double. Entries are multiplied row by row and then slot by slot,
    so the matrix is touched once a slot and not once an entry.
    """
    rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    shared = rows.sparkSession.sparkContext.broadcast(basis.astype(np.float32))
    width, k = basis.shape

    def partial(batches):
        total, seen = np.zeros((width, k)), 0
        for part, starts, ix, val in _entries(batches):
            seen += part.num_rows
            val = val.astype(np.float32)
            dense = _multiply(starts, ix, val, shared.value)
            order = np.argsort(ix, kind="stable")
            row, ix, val = np.repeat(np.arange(part.num_rows), np.diff(starts))[order], ix[order], val[order]
            cuts = np.flatnonzero(np.diff(ix, prepend=-1)).tolist()
            for lo, hi in zip(cuts, cuts[1:] + [len(ix)]):
                total[ix[lo]] += val[lo:hi] @ dense[row[lo:hi]]
        if seen:
            lane = TaskContext.get().partitionId() % MERGE_WAYS
            at = range(0, width, SLOTS_PER_CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([lane] * len(at), pa.int32()), pa.array([total[x : x + SLOTS_PER_CHUNK].tobytes() for x in at], pa.binary())], ["at", "lane", "part"])

    def add(key, pdf):
        parts = sum(np.frombuffer(p) for p in pdf["part"])
        return pd.DataFrame({"at": [key[0]], "lane": [0], "part": [parts.tobytes()]})

    shape = "at int, lane int, part binary"
    parts = rows.rdd.getNumPartitions()
    with shuffles_removed(rows.sparkSession):  # as many whole matrices as tasks, in every pass
        chunks = rows.select("ix", "val").mapInArrow(partial, shape)
        if parts > MERGE_WAYS:
            chunks = chunks.groupBy("at", "lane").applyInPandas(add, shape)
        added = chunks.groupBy("at").applyInPandas(add, shape).collect()
    out = np.zeros((width, k))
    for r in added:
        block = np.frombuffer(r["part"]).reshape(-1, k)
        out[r["at"] : r["at"] + len(block)] = block
    shared.destroy()  # unpersist leaves the copy of the driver
    return out


def leading_directions(rows: DataFrame, width: int, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (width x k) and singular values of the sparse rows."""
    size = min(width, k + OVERSAMPLE)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))
    for _ in range(PASSES):
        basis, _ = np.linalg.qr(gram_product(rows, basis))
    values, mix = np.linalg.eigh(basis.T @ gram_product(rows, basis))
    order = np.argsort(-values)[:k]
    return basis @ mix[:, order], np.sqrt(np.maximum(values[order], 0))


@dataclass
class Embedder:
    """Fitted vocabulary and projection; reuse for any later batch of texts."""

    vocab: DataFrame
    projection: np.ndarray
    singular: np.ndarray
    stop_words: tuple[str, ...]

    def transform(self, df: DataFrame, id_col: str = "number", text_col: str = "semantic_text") -> DataFrame:
        """``(id, embedding)`` of unit length; a text without a known word gets a zero vector."""
        return self.embedded(df, sparse_rows(df, self.vocab, id_col, text_col, self.stop_words), id_col)

    def embedded(self, df: DataFrame, rows: DataFrame, id_col: str = "number") -> DataFrame:
        """``transform`` where the sparse rows of the texts are known."""
        shared = df.sparkSession.sparkContext.broadcast(self.projection)
        kind = dict(df.dtypes)[id_col]

        def project(batches):
            for part, starts, ix, val in _entries(batches):
                out = _multiply(starts, ix, val, shared.value)
                norm = np.linalg.norm(out, axis=1, keepdims=True)
                out = np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)
                offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], ["id", "embedding"])

        known = rows.mapInArrow(project, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_col)
        zero = F.array_repeat(F.lit(0.0).cast("float"), self.projection.shape[1])
        return df.select(id_col).join(known, id_col, "left").withColumn("embedding", F.coalesce("embedding", zero))


def fit_embedder(df: DataFrame, id_col: str = "number", text_col: str = "semantic_text", dimensions: int = DIMENSIONS,
                 max_features: int = MAX_FEATURES, stop_words=STOP_WORDS) -> Embedder:
    return _fitted(df, id_col, text_col, dimensions, max_features, stop_words)[0]


def fit_transform(df: DataFrame, id_col: str = "number", text_col: str = "semantic_text", dimensions: int = DIMENSIONS,
                  max_features: int = MAX_FEATURES, stop_words=STOP_WORDS) -> tuple[Embedder, DataFrame]:
    """The embedder fitted on texts, and the same texts embedded; their terms are counted once."""
    model, rows = _fitted(df, id_col, text_col, dimensions, max_features, stop_words)
    return model, model.embedded(df, rows, id_col)


def _fitted(df: DataFrame, id_col: str, text_col: str, dimensions: int, max_features: int, stop_words) -> tuple[Embedder, DataFrame]:
    counted = written(counted_texts(df, id_col, text_col, stop_words), "term-counts")
    terms = counted.select(F.explode(F.arrays_zip("terms", "tfs")).alias("c")).select(F.col("c.terms").alias("term"), F.col("c.tfs").alias("tf"))
    vocab = materialize(slots_of(terms, df.agg(F.count(F.lit(1))).scalar(), max_features), "vocabulary")
    rows = materialize(weighted_rows(counted, vocab), "sparse-rows")
    n, width = rows.count(), vocab.count()
    k = max(1, min(n - 1, width - 1, dimensions))
    directions, values = leading_directions(rows, width, k)
    return Embedder(vocab, directions, values, tuple(stop_words)), rows


def with_semantic_text(df: DataFrame) -> DataFrame:
    return df.withColumn("semantic_text", semantic_text(df))
