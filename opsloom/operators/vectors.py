"""Vector search: exact and cell-probed top-K between two vector tables.

Vectors are packed into blocks of bounded size by hash, so no block grows with a hot cell or with copies of
one vector. A pair of blocks is scored with one matrix product inside a task that keeps only the K best per
query, and the partial results are merged per query. Neither table passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from opsloom.session import materialize

BLOCK_ROWS = 4096
SLICE_ROWS = 256  # queries of a block that are scored at once: 8 MB of scores against a full block
FIRST_COLUMNS = 512  # vectors of a block that queries without K matches are scored against first
GRID_BLOCKS = 16  # blocks on a side of a cell of the grid of exact search
GROUP_BLOCKS, LEAST_GROUPS = 4, 32  # blocks of corpus rows in a group of cells at most; groups a smaller corpus is cut into
ASSIGN_ROWS = 1 << 16  # rows of a batch of vectors with their cells
# Rows per cell the index aims at and default cells.
ROWS_PER_CELL, LEAST_CELLS = 39, 100
# Share of the exact matches that chosen probes aim at, so that small sets of queries reach 0.9 too, and queries it is measured on.
RECALL, PROBE_QUERIES = 0.95, 1000
SCORE_DIGITS = 6


def l2_normalize(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Scale vectors to unit length; a zero vector stays as it is."""
    squares = F.aggregate(F.col(column), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    norm = F.sqrt(squares)
    return df.withColumn("__norm", norm).withColumn(
        column, F.when(F.col("__norm") > 0, F.transform(column, lambda x: x.cast("double") / F.col("__norm"))).otherwise(F.col(column).cast("array<double>"))
    ).drop("__norm")


def append_vectors(index: DataFrame, new: DataFrame, column: str = "embedding") -> DataFrame:
    """Index plus new vectors; a vector of another dimension fails the job."""
    size = index.agg(F.max(F.size(column)).alias("d")).scalar()
    same = F.when(F.size(column) == size, F.col(column)).otherwise(F.raise_error(F.lit("vector dimension mismatch")).cast("array<float>"))
    return index.unionByName(new.withColumn(column, same))


def _blocks(n: int, block_rows: int) -> int:
    return max(1, -(-n // block_rows))


def _pack(df: DataFrame, keys: list[str], fields: tuple[str, ...] = ("id", "vec")) -> DataFrame:
    """Fold ``keys, parts, id, vec`` into blocks ``keys, part, rows``. The part is a hash of the id."""
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    return df.withColumn("part", part).groupBy(*keys, "part").agg(F.collect_list(F.struct(*fields)).alias("rows"))


def _plain(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Ids and vectors; a row without a vector can neither ask nor match."""
    return df.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))


def _cell_parts(assigned: DataFrame, block_rows: int) -> DataFrame:
    """Blocks per cell; one row per cell."""
    return assigned.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("parts"))


def _best(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the K best of every row; of those that tie with the last, the smaller columns."""
    take = min(k, near.shape[1])
    last = np.partition(near, near.shape[1] - take, axis=1)[:, near.shape[1] - take]
    rows, cols = np.nonzero((near >= last[:, None]) & ~np.isinf(near))
    return _ranked(rows, cols, near[rows, cols], take)


def _ranked(rows: np.ndarray, cols: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The K best of every row, best first; equal values go to the smaller column."""
    ranked = np.lexsort((cols, -value, rows))
    rows, cols, value = rows[ranked], cols[ranked], value[ranked]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep], value[keep]


def _raised(best: np.ndarray, rows: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The K best values of every row, from those so far and ranked new ones."""
    more = np.full(best.shape, -np.inf)
    more[rows, np.arange(len(rows)) - np.searchsorted(rows, rows)] = value
    return np.partition(np.hstack([best, more]), best.shape[1] - 1, axis=1)[:, best.shape[1]:]


def _top_k(metric: str, k: int, exclude_self: bool, timed: bool = False, cells: int = 0):
    """Scores blocks of queries against blocks of the corpus; with ``cells``, a query against the cells it probes only.

    While pairs with the same block of queries follow each other, the K best values of its queries are kept: products in
    single precision, with a margin for their rounding, tell which vectors can reach the K-th, and only those are scored.
    """
    def block_arrays(scalar):
        rows = scalar.values
        ids = rows.field("id")
        flat = rows.field("vec").flatten().to_numpy(zero_copy_only=False)
        return ids, flat.reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = 10.0**SCORE_DIGITS
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                field = lambda column, name: batch.column(column)[i].values.field(name).to_numpy(zero_copy_only=False)
                block = batch.column("q_block")[i].as_py() if "q_block" in batch.schema.names else None
                if block is None or block != held:
                    held = block
                    q_ids, q32 = block_arrays(batch.column("q_rows")[i])
                    if cells:  # queries of one cell probe much the same cells
                        by_cell = np.argsort(field("q_rows", "cell"), kind="stable")
                        q_ids, q32 = q_ids.take(pa.array(by_cell)), q32[by_cell]
                        probed = np.frombuffer(b"".join(field("q_rows", "probed")), np.uint8).reshape(len(q32), -1)[by_cell]
                    at = field("q_rows", "at") if timed else None
                    q, best = q32.astype(np.float64), np.full((len(q32), k), -np.inf)
                    q_norm = np.sqrt((q * q).sum(1))
                    q_values = q_ids.to_numpy(zero_copy_only=False) if exclude_self else None
                c_ids, c32 = block_arrays(batch.column("c_rows")[i])
                order = np.argsort(c_ids.to_numpy(zero_copy_only=False), kind="stable")
                c32 = c32[order]
                c = c32.astype(np.float64)
                rounding = (c.shape[1] + 2) * 2.0**-23 * np.sqrt((c * c).sum(1).max(initial=0))
                cell = field("c_rows", "cell")[order] if cells else None
                c_at = field("c_rows", "at")[order] if timed else None
                c_values = c_ids.to_numpy(zero_copy_only=False)[order] if exclude_self else None
                for lo in range(0, len(q), SLICE_ROWS):
                    part = slice(lo, lo + SLICE_ROWS)
                    some = np.arange(len(c))
                    if cells:
                        met = np.unpackbits(probed[part], axis=1, count=cells).view(bool)[:, cell]
                        some = np.flatnonzero(met.any(axis=0))
                    cut = 0 if np.isfinite(best[part]).all() else FIRST_COLUMNS  # a few vectors first: what they reach spares most of the others
                    hits = []
                    for cols in filter(len, (some[:cut], some[cut:])):
                        near_c = slice(cols[0], cols[-1] + 1) if cols[-1] - cols[0] < len(cols) else cols
                        least, rows = best[part].min(axis=1), None
                        if metric == "ip" and np.isfinite(least).all():
                            bound = ((least - 0.5) / scale - rounding * q_norm[part]).astype(np.float32)
                            reach = q32[part] @ c32[near_c].T >= np.nextafter(bound, np.float32(-np.inf))[:, None]
                            if np.count_nonzero(reach) <= reach.size // 16:
                                rows, found = np.divmod(np.flatnonzero(reach), len(cols))
                                found = cols[found]
                                value = np.rint(np.einsum("ij,ij->i", q[part][rows], c[found]) * scale)
                                fits = value >= least[rows]
                                if timed:
                                    fits &= c_at[found] < at[part][rows]
                                if cells:
                                    fits &= met[rows, found]
                                if exclude_self:
                                    fits &= c_values[found] != q_values[part][rows]
                                rows, found, value = _ranked(rows[fits], found[fits], value[fits], k)
                        if rows is None:
                            dots = q[part] @ c[near_c].T
                            if metric == "ip":
                                near = np.rint(dots * scale)
                            else:
                                gap = (q[part] * q[part]).sum(1)[:, None] + (c[near_c] * c[near_c]).sum(1)[None, :] - 2 * dots
                                near = -np.rint(np.maximum(gap, 0) * scale)
                            if timed:  # only what lies before the query
                                near = np.where(c_at[near_c][None, :] < at[part][:, None], near, -np.inf)
                            if cells:
                                near = np.where(met[:, near_c], near, -np.inf)
                            if exclude_self:
                                near = np.where(q_values[part][:, None] == c_values[near_c][None, :], -np.inf, near)
                            rows, found, value = _best(near, k)
                            fits = value >= least[rows]
                            rows, found, value = rows[fits], cols[found[fits]], value[fits]
                        best[part] = _raised(best[part], rows, value)
                        hits.append((rows, found, value))
                    if not hits:
                        continue
                    rows, found, value = _ranked(*map(np.concatenate, zip(*hits)), k)
                    yield pa.RecordBatch.from_arrays(
                        [q_ids.take(pa.array(lo + rows)), c_ids.take(pa.array(order[found])), pa.array((value if metric == "ip" else -value) / scale)],
                        names=["query_id", "match_id", "score"],
                    )

    return run


def _merge(pairs: DataFrame, metric: str, k: int, id_type: str, exclude_self: bool, timed: bool = False, cells: int = 0) -> DataFrame:
    """Score block pairs and keep the K best per query. Candidates per query are K times the blocks it met, at most."""
    scored = pairs.select("q_block", "q_rows", "c_rows").mapInArrow(
        _top_k(metric, k, exclude_self, timed, cells), f"query_id {id_type}, match_id {id_type}, score double"
    )
    best = F.col("score").desc() if metric == "ip" else F.col("score").asc()
    w = Window.partitionBy("query_id").orderBy(best, "match_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def _met(q: DataFrame, c: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Blocks that meet by ``keys``, dealt out by their number: the work of a pair tells, not its bytes. Blocks were multiplied
    before they meet, which Spark's estimate doesn't see, so neither side may be broadcast; a merge join hands out all pairs of
    a block of queries one after the other."""
    return q.repartition(parts, *keys).hint("merge").join(c.repartition(parts, *keys), keys)


def _grid(q: DataFrame, q_blocks: int, c: DataFrame, c_blocks: int) -> DataFrame:
    """Every block of queries (``part``, ``rows``) beside every block of the corpus, in cells of up to ``GRID_BLOCKS`` x ``GRID_BLOCKS``
    blocks: a block is stored once for each cell of its row or column only."""
    per, least = GRID_BLOCKS, 4 * q.sparkSession.sparkContext.defaultParallelism
    while per > 1 and _blocks(q_blocks, per) * _blocks(c_blocks, per) < least:
        per //= 2
    rows, cols = _blocks(q_blocks, per), _blocks(c_blocks, per)
    group = lambda name: F.floor(F.col("part") / F.lit(per)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = q.select(F.col("part").alias("q_block"), F.col("rows").alias("q_rows"), group("grid_row"), every(cols, "grid_col"))
    right = c.select(F.col("rows").alias("c_rows"), group("grid_col"), every(rows, "grid_row"))
    return _met(left, right, ["grid_row", "grid_col"], rows * cols)


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "ip", id_col: str = "vec_id", vec_col: str = "embedding",
        exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact top-K of every query: ``query_id, match_id, score, rank``.

    ``ip`` is the inner product, larger first; ``l2`` the squared distance, smaller first. Equal scores (six
    digits) go to the smaller id. Every query block meets every corpus block once, in a grid; at most K rows per
    query leave a block pair, and only those that can still be among the K best.
    """
    q_blocks, c_blocks = _blocks(queries.count(), block_rows), _blocks(corpus.count(), block_rows)
    q = _pack(_plain(queries, id_col, vec_col).withColumn("parts", F.lit(q_blocks)), [])
    c = _pack(_plain(corpus, id_col, vec_col).withColumn("parts", F.lit(c_blocks)), [])
    return _merge(_grid(q, q_blocks, c, c_blocks), metric, k, dict(corpus.dtypes)[id_col], exclude_self)


def train_cells(corpus: DataFrame, cells: int | None = None, vec_col: str = "embedding", seed: int = 42, iterations: int = 10) -> np.ndarray:
    """Cell centres by k-means, one row per cell: as many as asked for, else about the square root of the corpus."""
    corpus = corpus.filter(F.col(vec_col).isNotNull())
    n = corpus.count()
    cells = min(cells or max(LEAST_CELLS, round(n**0.5)), max(1, n // ROWS_PER_CELL))
    vectors = corpus.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    if cells < 2:
        return np.zeros((1, len(vectors.first()["features"])))
    model = KMeans(k=cells, seed=seed, maxIter=iterations).fit(vectors)
    return np.asarray(model.clusterCenters())


def nearest_cells(df: DataFrame, centres: np.ndarray, probes: int, id_col: str, vec_col: str) -> DataFrame:
    """One row per vector and probed cell, the closest cells by inner product. The centres are size-bounded."""
    probes = min(probes, len(centres))

    def assign(batches):
        step = max(1, ASSIGN_ROWS // probes)
        for part in (batch.slice(at, step) for batch in batches for at in range(0, batch.num_rows, step)):
            vecs = part.column("vec")
            flat = vecs.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            order = np.argsort(-(flat.astype(np.float64) @ centres.T), axis=1, kind="stable")[:, :probes]
            rows = np.repeat(np.arange(part.num_rows), probes)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(rows)), vecs.take(pa.array(rows)), pa.array(order.ravel().astype(np.int32))],
                names=["id", "vec", "cell"],
            )

    kind = dict(df.dtypes)[id_col]
    return _plain(df, id_col, vec_col).mapInArrow(assign, f"id {kind}, vec array<float>, cell int")


def probed_cells(df: DataFrame, centres: np.ndarray, probes: int, id_col: str, vec_col: str) -> DataFrame:
    """One row per vector: its closest cell and one bit a cell, set for the ``probes`` closest cells."""
    probes = min(probes, len(centres))

    def assign(batches):
        step = max(1, ASSIGN_ROWS * 64 // len(centres))
        for part in (batch.slice(at, step) for batch in batches for at in range(0, batch.num_rows, step)):
            flat = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            order = np.argsort(-(flat.astype(np.float64) @ centres.T), axis=1, kind="stable")[:, :probes]
            hit = np.zeros((part.num_rows, len(centres)), bool)
            np.put_along_axis(hit, order, True, axis=1)
            bits = [row.tobytes() for row in np.packbits(hit, axis=1)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("vec"), pa.array(order[:, 0].astype(np.int32)), pa.array(bits, pa.binary())], names=["id", "vec", "cell", "probed"])

    kind = dict(df.dtypes)[id_col]
    return _plain(df, id_col, vec_col).mapInArrow(assign, f"id {kind}, vec array<float>, cell int, probed binary")


def _cell_groups(near_c: DataFrame, group_rows: int) -> tuple[Column, int]:
    """The group of a corpus row and the number of groups: cells in a row up to about ``group_rows`` rows, a larger cell in parts by
    id hash. The driver sees one count a cell."""
    first, parts, group, held = {}, {}, 0, 0
    for cell, n in sorted(near_c.groupBy("cell").count().collect()):
        if held and held + n > group_rows:
            group, held = group + 1, 0
        first[cell], parts[cell] = group, _blocks(n, group_rows)
        group, held = group + parts[cell] - 1, held + n
        if parts[cell] > 1:
            group, held = group + 1, 0
    at = lambda values: F.element_at(F.array(*[F.lit(values.get(c, 1)) for c in range(max(values, default=0) + 1)]), F.col("cell") + 1)
    return (at(first) + F.pmod(F.xxhash64("id"), at(parts))).cast("int"), group + 1


def choose_probes(queries: DataFrame, corpus: DataFrame, near_c: DataFrame, centres: np.ndarray, k: int, metric: str = "ip", id_col: str = "vec_id",
                  vec_col: str = "embedding", exclude_self: bool = False, recall: float = RECALL) -> int:
    """The fewest probes that find ``recall`` of the exact matches, two standard errors below the measured share.

    Up to ``PROBE_QUERIES`` queries, by the hash of their id, are searched exactly; only they and their matches reach
    the driver. ``near_c`` has the cell of every corpus row.
    """
    asked = queries.filter(F.col(vec_col).isNotNull())
    sample = materialize(asked.orderBy(F.xxhash64(id_col), id_col).limit(PROBE_QUERIES).select(id_col, vec_col), "probe-queries")
    exact = knn(sample, corpus, k, metric, id_col, vec_col, exclude_self)
    cells = near_c.select(F.col("id").alias("match_id"), "cell").distinct()
    vectors = {r["id"]: r["vec"] for r in _plain(sample, id_col, vec_col).collect()}
    found = exact.join(cells, "match_id").select("query_id", "cell").collect()
    if not found:
        return 1
    place = {q: i for i, q in enumerate(vectors)}
    rows, cell = np.array([place[r["query_id"]] for r in found]), np.array([r["cell"] for r in found])
    near = np.argsort(-(np.array(list(vectors.values()), np.float64) @ centres.T), axis=1, kind="stable")
    rank = np.argsort(near, axis=1)[rows, cell]
    hits = np.zeros((len(vectors), len(centres)))
    np.add.at(hits, (rows, rank), 1)
    hits = hits[hits.sum(1) > 0]
    share = np.cumsum(hits, axis=1) / hits.sum(1, keepdims=True)
    error = share.std(0) / np.sqrt(len(share)) * np.sqrt(max(0.0, 1 - len(share) / max(len(share), asked.count())))
    return int(np.argmax(share.mean(0) - 2 * error >= recall - 1e-9)) + 1


def knn_cells(queries: DataFrame, corpus: DataFrame, k: int, cells: int | None = None, probes: int | None = None, metric: str = "ip",
              id_col: str = "vec_id", vec_col: str = "embedding", exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Approximate top-K: a query is scored against the corpus of its ``probes`` closest cells only; as many as asked
    for, else as many as the recall measured on these tables needs.

    A query is stored once, with one bit a cell for those it probes, and goes with its block to every group of cells.
    A hot cell is split into groups by id hash. Only the K best of a group leave its task.
    """
    centres = train_cells(corpus, cells, vec_col)
    near_c = materialize(nearest_cells(corpus, centres, 1, id_col, vec_col), "corpus-cells")
    probes = probes or choose_probes(queries, corpus, near_c, centres, k, metric, id_col, vec_col, exclude_self)
    near_q = materialize(probed_cells(queries, centres, probes, id_col, vec_col), "query-cells")
    group, groups = _cell_groups(near_c, max(1, block_rows // 8, min(block_rows * GROUP_BLOCKS, near_c.count() // LEAST_GROUPS)))
    q = _pack(near_q.withColumn("parts", F.lit(_blocks(near_q.count(), block_rows))), [], ("id", "vec", "cell", "probed"))
    spread = q.select(F.col("part").alias("q_block"), F.col("rows").alias("q_rows"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    c = near_c.withColumn("group", group).repartition(groups, "group").groupBy("group").agg(F.collect_list(F.struct("id", "vec", "cell")).alias("c_rows"))
    pairs = spread.repartition(groups, "group").hint("merge").join(c, "group")  # the work of a group tells, not its bytes
    return _merge(pairs, metric, k, dict(near_c.dtypes)["id"], exclude_self, cells=len(centres))


def knn_within(queries: DataFrame, corpus: DataFrame, group: str, k: int, metric: str = "ip", id_col: str = "vec_id", vec_col: str = "embedding",
               exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact top-K among the vectors of the query's own ``group``; a query without a group has none."""
    celled = lambda df: df.filter(F.col(vec_col).isNotNull() & F.col(group).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec"), F.col(group).alias("cell"))
    return _knn_by_cell(celled(queries), celled(corpus), k, metric, exclude_self, block_rows)


TIME_SLICES, SLICE_GROUP = 64, 4


def knn_before(queries: DataFrame, corpus: DataFrame, k: int, time: str, metric: str = "ip", id_col: str = "vec_id", vec_col: str = "embedding",
               block_rows: int = BLOCK_ROWS, slices: int = TIME_SLICES) -> DataFrame:
    """Exact top-K among the vectors whose ``time`` lies before the query's; a row without a time can neither ask nor match.

    The corpus is cut into time slices of about equal size and each slice into blocks by id hash, so a slice that holds a
    hot time is split too. A block of queries meets the slices up to its own only; inside, later vectors are masked. Slices
    meet in groups of ``SLICE_GROUP`` x ``SLICE_GROUP``: a block is stored once for each group that it meets.
    """
    timed = lambda df: df.filter(F.col(vec_col).isNotNull() & F.col(time).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"))
    c = materialize(timed(corpus), "timed-corpus")
    cuts = c.agg(F.percentile_approx("at", [i / slices for i in range(1, slices)], 1000)).first()[0] or []
    edges = F.array(*[F.lit(x) for x in sorted(set(cuts))]).cast("array<bigint>")
    cell = F.size(F.filter(edges, lambda e: e < F.col("at"))).alias("cell")
    c = c.select("*", cell)
    q = materialize(timed(queries).select("*", cell), "timed-queries")
    fields = ("id", "vec", "at")
    c_blocks = _pack(c.join(_cell_parts(c, block_rows), "cell"), ["cell"], fields)
    q_blocks = _pack(q.join(_cell_parts(q, block_rows), "cell"), ["cell"], fields)
    group = F.floor(F.col("cell") / F.lit(SLICE_GROUP)).cast("int")
    groups = slices // SLICE_GROUP  # of the last cell
    left = q_blocks.select(
        F.struct("cell", "part").alias("q_block"), F.col("cell").alias("q_cell"), F.col("rows").alias("q_rows"), group.alias("q_group"),
        F.explode(F.sequence(F.lit(0), group)).alias("c_group"))
    right = c_blocks.select(F.col("cell").alias("c_cell"), F.col("rows").alias("c_rows"), group.alias("c_group"), F.explode(F.sequence(group, F.lit(groups))).alias("q_group"))
    pairs = _met(left, right, ["q_group", "c_group"], (groups + 1) * (groups + 2) // 2).filter("c_cell <= q_cell")
    return _merge(pairs, metric, k, dict(c.dtypes)["id"], False, True)


def _knn_by_cell(near_q: DataFrame, near_c: DataFrame, k: int, metric: str, exclude_self: bool, block_rows: int) -> DataFrame:
    """Top-K of queries (``id``, ``vec``, ``cell``) among the corpus rows of their cells; blocks of a hot cell are split on both sides."""
    c_parts = _cell_parts(near_c, block_rows)
    q = _pack(near_q.join(_cell_parts(near_q, block_rows), "cell"), ["cell"])
    c = _pack(near_c.join(c_parts, "cell"), ["cell"])
    spread = q.join(c_parts, "cell").select(
        F.struct("cell", F.col("part").alias("q_part")).alias("q_block"), "cell", F.col("rows").alias("q_rows"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = spread.hint("merge").join(c.select("cell", "part", F.col("rows").alias("c_rows")), ["cell", "part"])
    return _merge(pairs, metric, k, dict(near_c.dtypes)["id"], exclude_self)


# Defaults of a formatted match.
MATCH_DEFAULTS = {
    "assignment_group": "Unassigned", "priority": "P3 - Moderate", "business_service": "General Service",
    "short_description": "No short description",
}


def format_matches(matches: DataFrame, meta: DataFrame, key: str = "number") -> DataFrame:
    """Matches with the eight result fields; ``meta`` has one row per match id in ``vec_id``."""
    j = matches.join(meta.withColumnRenamed("vec_id", "match_id"), "match_id", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string") if c in meta.columns else F.lit(None).cast("string"), F.lit(MATCH_DEFAULTS[c])).alias(c)
    return j.select(
        "query_id", "rank", F.coalesce(F.col(key), F.lit("UNKNOWN")).alias(key), F.round("score", 6).alias("similarity_score"),
        *[text(c) for c in MATCH_DEFAULTS], F.round(F.coalesce("resolution_time_hours", F.lit(0.0)), 2).alias("resolution_time"),
    )


def retrieval_consensus(matches: DataFrame) -> DataFrame:
    """Per query: mean similarity, most frequent group (smallest name on a tie) and mean hours."""
    return matches.groupBy("query_id").agg(
        F.round(F.avg("similarity_score"), 6).alias("mean_similarity"), F.mode("assignment_group", True).alias("top_group"),
        F.round(F.avg("resolution_time"), 4).alias("mean_hours"),
    )


def boost_same_item(matches: DataFrame, query_ci: str = "query_ci", match_ci: str = "match_ci", boost: float = 0.15, least: float = 0.5, k: int | None = None) -> DataFrame:
    """Add a bonus when both tickets name the same item, drop weak matches, rank again and keep the ``k`` best.

    For the true K best after the bonus, ``matches`` must hold the K best of all and the K best of the same item.
    """
    score = F.col("score") + F.when(F.col(query_ci) == F.col(match_ci), F.lit(boost)).otherwise(F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.col("boosted_score").desc(), "match_id")
    kept = matches.withColumn("boosted_score", F.round(score, 6)).filter(F.col("boosted_score") >= least)
    ranked = kept.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return ranked.filter(F.col("rank") <= k) if k else ranked
