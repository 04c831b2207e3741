"""Line dedup across documents (built-in expressions only).

Texts are exploded into lines; a line's key is the line without white space at both ends and with A-Z lower-cased, held
as its 128-bit MD5. Documents are counted once per key in two combined aggregates, so a line that stands in a third of
all documents is one row before it is shuffled. Lines of a key over the threshold are dropped except in the first
document; only the positions of dropped lines travel back to the texts, which are put together again by position.

Defined results: a null or empty text is one empty line; keys under ``min_chars`` code points are never dropped; rows
that repeat an id count as one document and each is treated in full; a row without an id loses nothing and counts for
nothing; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opsloom.llm.common import WHITE, ascii_lower, documents, let, text_of
from opsloom.session import written

Q, S = {}, {}

MIN_CHARS = 10
MIN_DOCS = 2


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id``, ``row_hash`` (tells rows that repeat an id apart), ``pos`` and ``key`` of every line long enough."""
    text = text_of()
    lines = docs.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64(text).alias("row_hash"), F.posexplode(F.split(ascii_lower(text), "\n", -1)).alias("pos", "line"))
    bare = lines.select("doc_id", "row_hash", "pos", F.trim("line", F.lit(WHITE)).alias("line"))
    return bare.filter(F.char_length("line") >= min_chars).select("doc_id", "row_hash", "pos", F.unhex(F.md5("line")).alias("key"))


def shared_keys(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Keys found in at least ``min_docs`` documents, with the smallest id that holds each."""
    per_doc = lines.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    counts = per_doc.groupBy("key").agg(F.count("one").alias("n_docs"), F.min("doc_id").alias("first_id"))
    return counts.filter(F.col("n_docs") >= min_docs).select("key", "first_id")


def without(lines, drop):
    """The lines whose positions are not in the sorted array ``drop``, by the stretches between drops: linear in both."""
    last = F.size(lines)
    stops = F.concat(drop, F.array(last))
    return let(stops, lambda s: F.flatten(F.transform(s, lambda stop, i: let(
        F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1) + 1), lambda start: F.slice(lines, start + 1, stop - start)))))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: ``n_lines`` before, ``n_dropped`` and the remaining ``text``."""
    lines = written(line_keys(docs, min_chars), "lines")
    shared = written(shared_keys(lines, min_docs), "shared-keys")  # two plain sides: Spark can then split a hot key
    hits = lines.join(shared, "key").filter(F.col("doc_id") != F.col("first_id"))
    hits = written(hits.select("doc_id", "row_hash", "pos"), "line-hits")
    drops = hits.groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    drops = drops.select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"), "drop")
    text = text_of()
    rows = docs.select("doc_id", text.alias("text"))
    joined = rows.join(drops, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    cut = joined.select("doc_id", "text", F.split("text", "\n", -1).alias("lines"), "drop")
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(without(F.col("lines"), F.col("drop")), "\n"))
    return cut.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"),
                      F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("text"))


def op5_line_dedup(spark, sf_dir):
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


Q["op5_line_dedup"] = op5_line_dedup
S["op5_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT key, count(DISTINCT doc_id) AS n, min(doc_id) AS first_id FROM l WHERE length(key) >= 10 GROUP BY key),
x AS (SELECT l.doc_id, l.i, l.line, coalesce(k.n >= 2 AND k.first_id <> l.doc_id, false) AS gone FROM l LEFT JOIN k ON k.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id"""
