"""Ranked lexical search on a length-stratified index.

A document's normaliser m depends on its length alone, so documents of equal m form a stratum in which an occurrence
count tf is worth the same everywhere. The index holds segments of documents sorted by m; inside one, postings are runs of
documents with one (stratum, term, tf), in this order. The impact of a run is computed once from its m and tf.

* Building: documents are counted into terms one by one and stored; once the length of all is known, every split of that
  table is sorted by m and cut into segments of bounded size. Nothing is shuffled, and a stratum of any size spreads.
* A stratum's bound for an item is the sum of weight times impact at each term's largest tf, the last run of the term.
  A segment's strata are visited by falling bound, in steps that double, until the next bound is below the score that the
  tenth place asks for; a bound that equals it is still visited, since a smaller id may win the tie. Nothing else is skipped.
* Two sweeps: the first visits only each segment's best strata and gives every item a score that ten documents reach in
  any case; the second starts from it, so segments that can't compete are not opened up.
* Items are taken in blocks of about ``BLOCK_TERMS`` terms, by hash; a block and the document frequencies of its terms are
  what a task gets. Per segment at most ten documents an item leave a task, and Spark keeps ten per task before the merge.

Defined results: a null text has no terms, and a document without terms counts nowhere; rows that repeat an id are ranked
each by its own text; a row without an id is ranked behind equal scores, with a null id; rows that repeat an item are one
item with the terms of all; an item without a known term gets no rows; empty tables give an empty result; other columns
of the inputs are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from opsloom.llm.common import documents, small_batches
from opsloom.session import work_path
from opsloom.sources.tables import table

Q, S = {}, {}

K = 10
SCALE, HALF = 1_000_000_000, 8
LEAST, SLOPE = 10, 90  # a normaliser is 10 plus 90 times the length's ratio to the mean
SEGMENT_DOCS, SEGMENT_BYTES = 8192, 2_000_000
BLOCK_TERMS = 200_000
ROWS = 256
STORED_BYTES = 16_000_000  # of a row group of a stored table, and of what a task reads of its files
SCAN_ROWS = 16  # rows that a scan decodes at once; a segment is some 10 MB
# A-Z to a-z; what is no letter, digit or part of a longer character to a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``written`` in small row groups: a task holds one to write or read it, however large its part of the table. The writer
    else looks at its size after 100 rows only, which may be segments."""
    path = work_path(df.sparkSession, name)
    df.write.options(**{"parquet.block.size": STORED_BYTES, "parquet.page.size.row.check.min": 1}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_scans(spark):
    """Jobs inside read stored tables in parts and batches whose bytes don't grow with the table."""
    wanted = {"spark.sql.files.maxPartitionBytes": str(STORED_BYTES), "spark.sql.parquet.columnarReaderBatchSize": str(SCAN_ROWS)}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        with small_batches(spark):
            yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def _bytes(texts: pa.Array):
    for lo in range(0, len(texts), ROWS):
        for t in texts.slice(lo, ROWS).cast(pa.binary()).to_pylist():
            yield t or b""


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n``, ``terms`` (distinct ones, blank between them) and ``tfs`` of every document with a term."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                seen = [Counter(terms_of(t)) for t in _bytes(part.column("text"))]
                keep = pa.array([bool(c) for c in seen])
                seen = [c for c in seen if c]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").filter(keep), pa.array([c.total() for c in seen], pa.int64()), pa.array([b" ".join(c) for c in seen], pa.binary()),
                     pa.array([np.fromiter(c.values(), np.int32, len(c)).tobytes() for c in seen], pa.binary())],
                    ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, terms binary, tfs binary")


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    size = ends - starts
    shift = starts - (np.cumsum(size) - size)
    return np.repeat(shift, size) + np.arange(size.sum())


SEGMENT = "ids array<bigint>, ms array<bigint>, names binary, run_key binary, run_tf binary, run_end binary, docs binary"


def segment(ids: list, ms: list[int], terms: list[bytes], tfs: list[bytes]) -> list:
    """The columns of ``SEGMENT`` for some documents. ``run_key`` is stratum times number of names, plus name."""
    names: dict[bytes, int] = {}
    code, width = [], []
    for t in terms:
        words = t.split(b" ")
        width.append(len(words))
        code += [names.setdefault(w, len(names)) for w in words]
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), width)
    tf = np.frombuffer(b"".join(tfs), np.int32)
    strata, of = np.unique(np.array(ms, np.int64), return_inverse=True)
    key = of[doc] * len(names) + np.array(code, np.int64)
    order = np.lexsort((doc, tf, key))
    key, tf, doc = key[order], tf[order], doc[order]
    last = np.append((key[1:] != key[:-1]) | (tf[1:] != tf[:-1]), True)
    return [ids, strata.tolist(), b" ".join(names), key[last].tobytes(), tf[last].tobytes(), (np.flatnonzero(last) + 1).astype(np.int64).tobytes(), doc.tobytes()]


def segments(rows: DataFrame) -> DataFrame:
    """Segments of counted documents that have their ``m``."""
    names = [c.split()[0] for c in SEGMENT.split(", ")]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 5]

    def cut(batches):
        open_, size = ([], [], [], []), 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(segment(*open_), kinds)], names)
        for part in (batch.slice(lo, ROWS) for batch in batches for lo in range(0, batch.num_rows, ROWS)):
            for row in zip(*(part.column(c).to_pylist() for c in ("doc_id", "m", "terms", "tfs"))):
                for column, value in zip(open_, row):
                    column.append(value)
                size += len(row[2]) + len(row[3])
                if len(open_[0]) >= SEGMENT_DOCS or size >= SEGMENT_BYTES:
                    yield out()
                    open_, size = ([], [], [], []), 0
        if open_[0]:
            yield out()

    return rows.select("doc_id", "m", "terms", "tfs").sortWithinPartitions("m").mapInArrow(cut, SEGMENT)


@dataclass
class LexicalIndex:
    """Stored segments; number of documents with a term, and of all their terms."""

    table: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame) -> LexicalIndex:
    """Index every document with all its terms."""
    with small_scans(docs.sparkSession):
        return _build_index(docs)


def _build_index(docs: DataFrame) -> LexicalIndex:
    rows = stored(counted(docs), "term-counts")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n, terms = total["n"], total["terms"]
    m = F.expr(f"CAST({SLOPE} * n AS DECIMAL(20, 0)) * CAST({n} AS DECIMAL(18, 0)) div CAST({max(1, terms)} AS DECIMAL(20, 0)) + {LEAST}")
    return LexicalIndex(stored(segments(rows.withColumn("m", m)), "lexical-index"), n, terms)


def frequencies(index: LexicalIndex, asked: frozenset[bytes]) -> dict[bytes, int]:
    """Documents that hold each of the asked terms."""
    def count(batches):
        for batch in batches:
            for names, key, end in zip(*(batch.column(c).to_pylist() for c in ("names", "run_key", "run_end"))):
                names = names.split(b" ")
                held = np.bincount(np.frombuffer(key, np.int64) % len(names), np.diff(np.frombuffer(end, np.int64), prepend=0), len(names)).astype(np.int64)
                found = [(w, n) for w, n in zip(names, held.tolist()) if w in asked]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["term", "n"])

    rows = index.table.select("names", "run_key", "run_end").mapInArrow(count, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("df"))
    return {bytes(r["term"]): r["df"] for r in rows.collect()}  # a row for each term of a block


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Segment:
    """A segment as arrays."""

    def __init__(self, row: dict, asked: dict[bytes, int]):
        self.ids = row["ids"]
        self.order = pc.fill_null(self.ids, 2**63 - 1).to_numpy(zero_copy_only=False)
        self.nameless = pc.is_null(self.ids).to_numpy(zero_copy_only=False)
        names = row["names"].split(b" ")
        self.width = len(names)
        self.code = np.full(len(asked), -1, np.int64)
        for c, name in enumerate(names):
            a = asked.get(name)
            if a is not None:
                self.code[a] = c
        self.key = np.frombuffer(row["run_key"], np.int64)
        self.end = np.frombuffer(row["run_end"], np.int64)
        self.start = np.append(0, self.end[:-1])
        self.docs = np.frombuffer(row["docs"], np.int32)
        self.strata = len(row["ms"])
        tf = np.frombuffer(row["run_tf"], np.int32).astype(np.int64)
        self.impact = SCALE * tf // (1000 * tf + HALF * np.array(row["ms"], np.int64)[self.key // self.width])

    def best(self, terms: np.ndarray, weights: np.ndarray, least: int, k: int, seed: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best documents that score ``least`` or more; with ``seed`` only from the first strata."""
        code = self.code[terms]
        weights, code = weights[code >= 0], code[code >= 0]
        place, score = np.empty(0, np.int64), np.empty(0, np.int64)
        slot = np.arange(self.strata)[:, None] * self.width + code[None, :]
        lo, hi = np.searchsorted(self.key, slot, "left"), np.searchsorted(self.key, slot, "right")
        bound = (np.where(hi > lo, self.impact[hi - 1], 0) * weights).sum(1)
        visits, done, step = np.argsort(-bound, kind="stable"), 0, 1
        while done < len(visits) and bound[visits[done]] >= least:
            now = visits[done:done + step]
            now = now[bound[now] >= least]
            run = ranges(lo[now].ravel(), hi[now].ravel())
            value = np.repeat(np.tile(weights, len(now)), (hi[now] - lo[now]).ravel()) * self.impact[run]
            doc = self.docs[ranges(self.start[run], self.end[run])]
            value = np.repeat(value, self.end[run] - self.start[run])
            by = np.argsort(doc, kind="stable")
            doc, value = doc[by], value[by]
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.empty(0, np.int64)
            total = np.add.reduceat(value, first) if len(doc) else value
            place, score = np.append(place, doc[first].astype(np.int64)), np.append(score, total)
            keep = score >= least
            place, score = place[keep], score[keep]
            ranked = np.lexsort((self.order[place], self.nameless[place], -score))[:k]
            place, score = place[ranked], score[ranked]
            if len(score) == k:
                least = max(least, int(score[-1]))
                if seed:
                    break
            done, step = done + step, step * 2
        return place, score


def sweep(index: LexicalIndex, items: list[tuple], least: list[int], k: int, seed: bool) -> DataFrame:
    """``item`` (place in ``items``), ``doc_id``, ``score``: the best documents of every segment."""
    asked = {t: i for i, t in enumerate(sorted({t for _, terms, _ in items for t in terms}))}
    wanted = [(np.array([asked[t] for t in terms], np.int64), np.array(weights, np.int64)) for _, terms, weights in items]

    def visit(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values if c == "ids" else batch.column(c)[i].as_py() for c in batch.schema.names}
                here = Segment(row, asked)
                found = [here.best(terms, weights, at, k, seed) for (terms, weights), at in zip(wanted, least)]
                item = np.repeat(np.arange(len(found), dtype=np.int32), [len(p) for p, _ in found])
                place = np.concatenate([p for p, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(item), here.ids.take(pa.array(place)), pa.array(np.concatenate([s for _, s in found]))], ["item", "doc_id", "score"])

    return index.table.mapInArrow(visit, "item int, doc_id bigint, score bigint")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search_block(index: LexicalIndex, wanted: dict, k: int) -> DataFrame | None:
    """``item_id``, ``rank``, ``doc_id``, ``score`` for a block of items (id to terms); None if nothing can be found."""
    df = frequencies(index, frozenset(t for terms in wanted.values() for t in terms))
    weights = {t: w for t, n in df.items() if (w := weight(index.n_docs, n)) > 0}
    items = [(i, sorted(t for t in terms if t in weights)) for i, terms in wanted.items()]
    items = [(i, terms, [weights[t] for t in terms]) for i, terms in items if terms]
    if not items:
        return None
    first = {r["item"]: r["score"] for r in ranked(sweep(index, items, [1] * len(items), k, True), k).filter(F.col("rank") == k).collect()}  # a row an item
    found = stored(ranked(sweep(index, items, [first.get(i, 1) for i in range(len(items))], k, False), k), "found")
    spark = index.table.sparkSession
    kind = "string" if any(isinstance(i, str) for i, _, _ in items) else "bigint"
    ids = spark.createDataFrame([(n, i) for n, (i, _, _) in enumerate(items)], f"item int, item_id {kind}")
    return found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")  # the items of one block


def search(index: LexicalIndex, items: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` best documents of every item (``item_id``, ``text``) with a score above 0."""
    with small_scans(items.sparkSession):
        return _search(index, items, k)


def _search(index: LexicalIndex, items: DataFrame, k: int) -> DataFrame:
    def split(batches):
        for batch in batches:
            words = [sorted(set(terms_of(t))) for t in _bytes(batch.column("text"))]
            n = np.repeat(np.arange(len(words)), [len(w) for w in words])
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(n)), pa.array([t for w in words for t in w], pa.binary())], ["item_id", "term"])

    kind = dict(items.dtypes)["item_id"]
    kind = kind if kind == "string" else "bigint"
    terms = items.select(F.col("item_id").cast(kind).alias("item_id"), "text").mapInArrow(split, f"item_id {kind}, term binary").distinct()
    terms = stored(terms, "item-terms")
    blocks = -(-terms.count() // BLOCK_TERMS)
    out = []
    for b in range(blocks):
        wanted: dict = {}
        for r in terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect():  # about BLOCK_TERMS rows
            wanted.setdefault(r["item_id"], []).append(bytes(r["term"]))
        if index.n_docs and (found := search_block(index, wanted, k)) is not None:
            out.append(found)
    if not out:
        return items.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result


def op11_lexical_search(spark, sf_dir):
    return search(build_index(documents(spark, sf_dir)), table(spark, sf_dir, "benchmark"))


Q["op11_lexical_search"] = op11_lexical_search

_UPPER = "".join(map(chr, range(65, 91)))
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
S["op11_lexical_search"] = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM post GROUP BY ALL),
stat AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM docs),
norm AS (SELECT doc_id, {LEAST} + (({SLOPE} * n * stat.docs) // stat.terms) AS m FROM docs, stat),
weighed AS (SELECT term, floor(1000 * ln((2 * stat.docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM post, stat GROUP BY term, stat.docs),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
scored AS (
    SELECT item_id, doc_id, sum(w * (({SCALE} * tf) // (1000 * tf + {HALF} * m)))::BIGINT AS score
    FROM asked JOIN weighed USING (term) JOIN post USING (term) JOIN norm USING (doc_id) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= {K}
"""
