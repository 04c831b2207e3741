"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds over sizes.

Documents are tokenised and cut where they are longer than a sequence. Rounds then go over the sizes from the largest
down: all pieces of one size meet the gaps of all open sequences at once, each piece is matched to the successor of its
size among the gaps (the smallest gap that holds it), conflicts are resolved by rank (the k-th piece of the size takes
the k-th place in the gaps of that successor), the gaps are updated, and the sweep repeats with the next successor until
the size is used up; where no gap is left, sequences are opened. This is best-fit decreasing, carried out for whole sizes.

Pieces of one size are alike and so are gaps of one size, so a round handles runs (size, first rank, count). There are
at most ``capacity`` sizes: the run tables, the only thing the driver sees, do not grow with the rows. The rows are
counted by size, numbered within their size in hash ranges (``grouped_rank``) and looked up in the finished plan by
(size, rank).

Defined results: a null or empty text is the one closing id; rows that repeat an id are each packed, told apart by their
text; equal rows twice; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opsloom.llm.common import documents, grouped_rank, small_batches
from opsloom.llm.word_ids import word_ids
from opsloom.session import written

Q, S = {}, {}

CAPACITY = 2048
END_ID = 0
SEED = 9


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``doc_id``, ``row_hash``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked, ``ids``."""
    schema = "doc_id bigint, row_hash bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches):
        coder = word_ids(tokenizer)
        for batch in batches:
            out = {n: [] for n in names}
            keys, hashes = batch.column("doc_id").to_pylist(), batch.column("row_hash").to_pylist()
            for at, flat, bounds in coder.slices(batch.column("text")):
                for k in range(len(bounds) - 1):
                    ids = np.append(flat[bounds[k]:bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start:start + capacity]
                        row = (keys[at + k], hashes[at + k], piece, start, len(part), zlib.crc32(part.data))
                        for n, v in zip(names, (*row, part.astype(np.int32)) if with_ids else row):
                            out[n].append(v)
            types = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(out[n], types.get(n, pa.int64())) for n in names], names)

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"), "text")
    return rows.mapInArrow(cut, schema)


def plan_rounds(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """The plan of best-fit decreasing for ``counts`` pieces of each size: rows (size, first rank, sequence, pieces in a
    row that share a sequence, offset). A row holds for the ranks from its first to the next row's of the same size."""
    gaps: list[int] = []  # sizes of gaps with open sequences, increasing
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, count)
    plan, opened = [], 0

    def leave(gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, count))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            k = bisect.bisect_left(gaps, size)
            if k == len(gaps):
                gap, first, count = capacity, opened, -(-left // (capacity // size))
                opened += count
            else:
                gap = gaps[k]
                first, count = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[k]
            each = gap // size
            plan.append((size, rank, first, each, capacity - gap))
            used = min(left, each * count)
            full, rest = divmod(used, each)
            leave(gap - each * size, first, full)
            if rest:
                leave(gap - rest * size, first + full, 1)
            leave(gap, first + full + bool(rest), count - full - bool(rest))
            rank, left = rank + used, left - used
    return np.array(plan, np.int64).reshape(-1, 5)


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, seed: int = SEED, ident=("doc_id", "row_hash", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces with a ``length`` of 1 to ``capacity``."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    plan = plan_rounds(counts, capacity)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan, step = plan[order], max([1, *counts.values()]) + 1
    keys = plan[:, 0] * step + plan[:, 1]
    ranked = grouped_rank(pieces, ["length"], seed, list(ident), sum(counts.values()))
    schema = ranked.drop("rank").withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}).schema

    def place(batches):
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = plan[np.searchsorted(keys, size * step + rank, "right") - 1]
            k = rank - row[:, 1]
            rest = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(row[:, 2] + k // row[:, 3]), pa.array(row[:, 4] + k % row[:, 3] * size)],
                [*rest.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences."""
    with small_batches(docs.sparkSession):
        pieces = written(token_pieces(docs, tokenizer or tokenizer_file(), capacity, with_ids=with_ids), "pieces")
    return best_fit(pieces, capacity)


def op9_best_fit(spark, sf_dir):
    return pack(documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


Q["op9_best_fit"] = op9_best_fit
