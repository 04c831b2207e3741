"""Removal of repeated byte strings by a sampled suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller id, or same document, earlier
start), judged on the whole input. Sorting every suffix of a corpus moves each byte a hundred times over, so only
sampled suffixes are sorted: in every window of ``LENGTH`` bytes the ``GRAM``-byte string with the smallest hash is its
anchor. Equal windows have equal anchors, so nothing is lost; a run of windows with one anchor is one row.

* Rows are range-partitioned by sampled splitters on (leading tokens as the anchor's hash, context, document, place),
  sorted locally and compared with their neighbours. A row whose whole context equals its predecessor's is settled: all
  its windows start earlier. A row whose anchor
  stands alone, in the input and in its context, is unique. The rest, and the first and last row of every
  partition, are compared across boundaries in the next step.
* The rest fetch their bytes and meet by anchor; all their windows are compared and all but the earliest are repeats.
  Anchors with more than ``HOT_ROWS`` rows go through a grouped minimum over single windows instead of one task.
* The texts are stored once in buckets of the id, so they are never shuffled; only spans travel.

Windows and contexts are compared by 64-bit hashes of their bytes, under an anchor of 64 bits.

Defined results: a null text is empty; texts under ``LENGTH`` bytes stay; a row without an id stays whole and is earlier
than nothing; equal rows are one document and each loses the same bytes; rows that repeat an id with different texts are
ordered by the hash of the text; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opsloom.llm.common import documents
from opsloom.session import work_path, written

Q, S = {}, {}

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM + 1  # grams in a window
RUN = 100  # most windows in a row, so that the first and the last window cover its context
SLICE_BYTES = 400_000
HOT_ROWS = 20_000
GROUP_ROWS = 5_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def rolling(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """64-bit hashes of all strings of each size, put together from strings of half the size."""
    level = {1: _mix((data.astype(np.uint64) + np.uint64(1)) * _ODD)}
    size = 1
    while size * 2 <= max(sizes) and len(data) >= size * 2:
        h = level[size]
        size *= 2
        level[size] = _mix(h[:-size // 2] * np.uint64(3) + h[size // 2:] * _ODD)
    out = []
    for s in sizes:
        n = max(0, len(data) - s + 1)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        k = max(x for x in level if x <= s)
        h = level[k]
        out.append(h[:n] if k == s else _mix(h[:n] * np.uint64(3) + h[s - k:s - k + n] * _ODD))
    return out


def anchor_rows(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts laid end to end: text, first window (from the text's start), windows, anchor, context of every row, and
    whether the anchor stands in the context twice, so that windows of the row may repeat each other."""
    none = np.empty(0, np.int64)
    grams, windows = rolling(data, (GRAM, LENGTH))
    n = len(windows)
    if not n:
        return none, none, none, none, none, none
    low, step = grams, 1
    while step * 2 <= REACH:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[:n], low[REACH - step:REACH - step + n])
    text = np.searchsorted(ends, np.arange(n), "right")
    good = np.flatnonzero(np.arange(n) + LENGTH <= ends[text])
    if not len(good):
        return none, none, none, none, none, none
    v = low[good]
    new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (good[1:] != good[:-1] + 1)]))
    count = np.diff(np.append(new, len(good)))
    parts = -(-count // RUN)
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(new, parts) + inner * RUN
    size = np.minimum(RUN, np.repeat(count, parts) - inner * RUN)
    at, last = good[first], good[first + size - 1]
    context = _mix(windows[at] * np.uint64(3) + windows[last] * _ODD + size.astype(np.uint64))
    which = text[at]
    start = np.concatenate([[0], ends[:-1]])
    near = np.arange(RUN + REACH - 1)
    held = (grams[np.minimum(at[:, None] + near, len(grams) - 1)] == v[first][:, None]) & (near < (size + REACH - 1)[:, None])
    loops = (held.sum(axis=1) > 1).astype(np.int64)
    return which, at - start[which], size, v[first].view(np.int64), context.view(np.int64), loops


def pack_place(tag, start, loops, size):
    """Text tag (23 bits), start, the loop flag and the number of windows in one number that sorts by tag, then start."""
    return (tag << 40) | (start << 8) | (loops << 7) | size


def unpack(place):
    return place >> 40, (place >> 8) & 0xFFFFFFFF, place & 127


def anchors(texts: DataFrame) -> DataFrame:
    """``h``, ``ctx``, ``doc_id``, ``place`` of every row of windows."""
    names = ["h", "ctx", "doc_id", "place"]

    def rows(batches):
        for batch in batches:
            ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
            data = [x.as_buffer() for x in batch.column("data")]
            lo = 0
            while lo < len(data):
                hi, n = lo, 0
                while hi < len(data) and (hi == lo or n + len(data[hi]) <= SLICE_BYTES):
                    n += len(data[hi])
                    hi += 1
                flat = np.concatenate([np.frombuffer(x, np.uint8) for x in data[lo:hi]])
                which, start, size, h, ctx, loops = anchor_rows(flat, np.cumsum([len(x) for x in data[lo:hi]]))
                which = which + lo
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ctx), pa.array(ids[which]), pa.array(pack_place(tags[which], start, loops, size))], names)
                lo = hi

    return texts.mapInArrow(rows, "h bigint, ctx bigint, doc_id bigint, place bigint")


def neighbours(rows: DataFrame) -> DataFrame:
    """Compare sorted rows with their neighbours: ``settled`` rows, and open rows that the next step must compare."""
    names = ["settled", "h", "doc_id", "place"]

    def compare(batches):
        before, held, held_open = None, None, True  # last row; last row with a new context, and whether it is open
        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.stack([batch.column(c).to_numpy() for c in ("h", "ctx", "doc_id", "place")])
            prior = np.concatenate([now[:, :1] if before is None else before, now[:, :-1]], axis=1)
            same_h, same = now[0] == prior[0], (now[:2] == prior[:2]).all(axis=0)
            twice = (now == prior).all(axis=0)
            if before is None:
                same_h[0] = same[0] = twice[0] = False
            settled = now[:, same & ~twice]
            fresh = np.flatnonzero(~same)
            is_open = same_h[fresh] | (now[3, fresh] >> 7 & 1).astype(bool)
            if before is None and len(fresh):
                is_open[0] = True  # may go on from the partition before
            news = now[:, fresh]
            if held is not None:
                news = np.concatenate([held, news], axis=1)
                is_open = np.concatenate([[held_open], is_open])
            is_open[:-1] |= news[0, :-1] == news[0, 1:]
            done, flags = news[:, :-1], is_open[:-1]
            held, held_open, before = news[:, -1:], bool(is_open[-1]), now[:, -1:]
            left = done[:, flags]
            out = np.concatenate([settled, left], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.shape[1]) < settled.shape[1]), *map(pa.array, out[[0, 2, 3]])], names)
        if held is not None:  # may go on in the partition after
            yield pa.RecordBatch.from_arrays([pa.array([False]), *map(pa.array, held[[0, 2, 3]])], names)

    order = ["h", "ctx", "doc_id", "place"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(compare, "settled boolean, h bigint, doc_id bigint, place bigint")


def contexts(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with the bytes of their context (``bytes``)."""
    _, start, size = unpack_columns()
    joined = texts.join(rows.hint("shuffle_hash"), "doc_id").filter(F.col("tag") == F.shiftright("place", 40))
    return joined.select("h", "doc_id", "place", F.substring(F.col("data"), start + 1, size + LENGTH - 1).alias("bytes"))


def unpack_columns():
    place = F.col("place")
    return F.shiftright(place, 40), F.shiftright(place, 8).bitwiseAND(0xFFFFFFFF).cast("int"), place.bitwiseAND(127).cast("int")


def window_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place in the row of every window of the contexts."""
    width = np.array([len(b) for b in blobs], np.int64)
    hashes = rolling(np.frombuffer(b"".join(blobs), np.uint8), (LENGTH,))[0]
    size = width - LENGTH + 1
    row = np.repeat(np.arange(len(blobs)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return hashes[np.repeat(np.cumsum(width) - width, size) + place], row, place


def spans_of(doc, tag, start):
    """Runs of repeated windows that follow each other as spans of bytes."""
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] != start[:-1] + 1)]) if len(doc) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[:len(first)] - 1
    return doc[first], tag[first], start[first], start[last] + LENGTH


SPAN = "doc_id bigint, tag bigint, lo bigint, hi bigint"


def compare_windows(rows: DataFrame) -> DataFrame:
    """Spans of the windows that are not the first of their kind, anchor by anchor."""
    def repeats(batches):
        """Whole groups are put together to ``GROUP_ROWS`` rows or more; equal windows have equal anchors, so a group
        never needs another."""
        parts, n = [], 0
        for batch in batches:
            h = batch.column("h").to_numpy()
            cut = len(h) and int(np.searchsorted(h, h[-1]))  # where the last group of the batch begins
            if parts and len(h) and parts[-1].column("h")[-1].as_py() == h[-1]:
                cut = 0
            parts.append(batch.slice(0, cut))
            n += cut
            if cut and n >= GROUP_ROWS:  # what is held ends with a whole group
                yield first_kept(parts)
                parts, n = [], 0
            parts.append(batch.slice(cut))
            n += len(h) - cut
            parts = [p for p in parts if p.num_rows]
        if parts:
            yield first_kept(parts)

    def first_kept(parts):
        doc, place = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("doc_id", "place"))
        blobs = [x for p in parts for x in p.column("bytes").to_pylist()]
        fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])])  # equal rows of the table count once
        doc, place, blobs = doc[fresh], place[fresh], [b for b, f in zip(blobs, fresh) if f]
        tag, start, _ = unpack(place)
        hashes, row, inner = window_hashes(blobs)
        again = np.ones(len(hashes), bool)
        again[np.unique(hashes, return_index=True)[1]] = False
        row, inner = row[again], inner[again]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in spans_of(doc[row], tag[row], start[row] + inner)], ["doc_id", "tag", "lo", "hi"])

    return rows.repartition("h").sortWithinPartitions("h", "doc_id", "place").mapInArrow(repeats, SPAN)


def compare_hot(rows: DataFrame) -> DataFrame:
    """The same for anchors with very many rows: one row a window, and a combined minimum for each kind of window."""
    def emit(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                tag, start, _ = unpack(part.column("place").to_numpy())
                hashes, row, inner = window_hashes(part.column("bytes").to_pylist())
                doc, h = part.column("doc_id").to_numpy(), part.column("h").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[row], hashes.view(np.int64), doc[row], (tag[row] << 32) | (start[row] + inner))], ["h", "w", "doc_id", "at"])

    windows = written(rows.mapInArrow(emit, "h bigint, w bigint, doc_id bigint, at bigint"), "hot-windows")
    first = windows.groupBy("h", "w").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    again = windows.join(first, ["h", "w"]).filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("at") != F.col("first.at")))
    start = F.col("at").bitwiseAND(0xFFFFFFFF)
    return again.select("doc_id", F.shiftright("at", 32).alias("tag"), start.alias("lo"), (start + LENGTH).alias("hi"))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``doc_id``, ``tag``, ``lo``, ``hi`` of repeated bytes; spans of a document may overlap."""
    rows = written(neighbours(anchors(texts)), "suffix-rows")
    tag, start, size = unpack_columns()
    settled = rows.filter("settled").select("doc_id", tag.alias("tag"), start.cast("bigint").alias("lo"), (start + size - 1 + LENGTH).cast("bigint").alias("hi"))
    left = rows.filter("NOT settled").select("h", "doc_id", "place")
    with_bytes = written(contexts(texts, left), "contexts")
    hot = written(with_bytes.groupBy("h").count().filter(F.col("count") > HOT_ROWS).select("h"), "hot-anchors")
    if hot.isEmpty():
        return settled.union(compare_windows(with_bytes))
    cold = with_bytes.join(hot, "h", "left_anti")
    return settled.union(compare_windows(cold)).union(compare_hot(with_bytes.join(hot, "h", "left_semi")))


def stored_texts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``tag``, ``data``: the texts as bytes, stored once in buckets of the id."""
    spark = docs.sparkSession
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.xxhash64("text").bitwiseAND(0x7FFFFF).alias("tag"), data.alias("data"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = work_path(spark, "texts")
    name = f"texts_{uuid.uuid4().hex}"
    rows.write.format("parquet").bucketBy(buckets, "doc_id").option("path", path).saveAsTable(name)
    return spark.table(name)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: ``n_bytes``, ``n_removed``, ``n_spans`` and the remaining bytes (``data``)."""
    texts = stored_texts(docs)
    known = texts.filter(F.col("doc_id").isNotNull())
    spans = written(repeated_spans(known), "spans")
    per_doc = spans.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    per_doc = per_doc.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), "spans")
    joined = texts.join(per_doc.hint("shuffle_hash"), (F.col("doc_id") == F.col("__id")) & (F.col("tag") == F.col("__tag")), "left")

    def cut(batches):
        for batch in batches:
            n, gone, runs, rest = [], [], [], []
            for data, spans in zip(batch.column("data"), batch.column("spans").to_pylist()):
                data = data.as_py()
                keep, at, removed, count = [], 0, 0, 0
                for s in spans or ():
                    lo, hi = s["lo"], s["hi"]
                    if lo > at or not count:
                        keep.append(data[at:lo])
                        count += 1
                        removed += hi - lo
                        at = hi
                    elif hi > at:
                        removed += hi - at
                        at = hi
                keep.append(data[at:])
                n.append(len(data)), gone.append(removed), runs.append(count), rest.append(b"".join(keep))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(rest, pa.binary())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "data"])

    return joined.select("doc_id", "data", "spans").mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, data binary")


def op8_suffix_dedup(spark, sf_dir):
    out = suffix_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("data"), 256).alias("kept_sha256"))


Q["op8_suffix_dedup"] = op8_suffix_dedup
