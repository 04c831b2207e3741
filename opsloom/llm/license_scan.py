"""License scan: an exact set-similarity join of text blocks with license templates (built-in expressions only).

A block of a template is a window of as many words as the template has, wherever lines break, as the set of the template's
words in it; so a notice wrapped over lines is found, and words that stand far apart are no notice. Windows are kept only
where enough of the words stand in them, so a text without them has none. Every block that contains at least ``THRESHOLD`` of the words of a
template is found: words are ordered by their document frequency over the whole table, rarest first; the first
``|T| - need + 1`` words of a template are its prefix, and a block that holds ``need`` of its words must hold one of
those (prefix filter), must have ``need`` template words at all (length filter) and must have enough words left after
the places of the shared word (positional filter). What is left is counted exactly. Only words that stand in some
template can count, so blocks are cut to those while the text is read; the templates, their words and their frequencies
are bounded by the template list, not by the data.

Base phrases are found word by word and keep their labels. ``score`` is 1 where a base phrase stands, else the largest
containment of a template found, else 0.

Defined results: a null text is empty and has no words, no labels and score 0; rows with the same or with no id are
judged each by its own text; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from opsloom.llm.common import ascii_lower, documents, let, text_of
from opsloom.session import written

Q, S = {}, {}

THRESHOLD = 0.8
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# Public license notices, as words.
TEMPLATES = [
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
]


def plain_words(lowered: Column) -> Column:
    """The words of a lower-cased text with one blank between them and none around."""
    return F.trim(F.regexp_replace(lowered, OTHER, " "))


def split_words(plain: Column) -> Column:
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def starts_of(words: Column, phrase: str) -> Column:
    """Indices of the words at which a phrase starts."""
    first, *more = phrase.split()
    stands = lambda i: reduce(lambda c, kw: c & F.coalesce(F.get(words, i + kw[0]) == kw[1], F.lit(False)), enumerate(more, 1), F.get(words, i) == first)
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands)


def needed(words: set[str], threshold: float) -> int:
    return max(1, ceil(threshold * len(words) - 1e-9))


def template_windows(text: str, threshold: float) -> Column:
    """Distinct sets of template words in the windows of a text (``plain``, ``seen``) that hold enough of them.

    A window has the template's length and starts at one of its words; other windows hold no more of its words than these.
    """
    length, need = len(text.split()), needed(set(text.split()), threshold)
    own = F.array(*[F.lit(w) for w in sorted(set(text.split()))])
    none = F.array().cast("array<array<string>>")
    hit = lambda w, i: F.when(F.array_contains(own, w), F.struct(i.alias("at"), w.alias("word")))
    hits = F.array_compact(F.transform(split_words(F.col("plain")), hit))

    def windows(h: Column) -> Column:
        crowded = F.filter(F.transform(h, lambda x, j: F.struct(x.at.alias("at"), j.alias("j"), F.get(h, j + need - 1).at.alias("far"))), lambda x: x.far < x.at + length)
        within = lambda x: F.filter(F.slice(h, x.j + 1, F.lit(length)), lambda y: y.at < x.at + length)
        sets = F.transform(crowded, lambda x: F.array_sort(F.array_distinct(F.transform(within(x), lambda y: y.word))))
        return F.filter(F.array_distinct(sets), lambda words: F.size(words) >= need)

    return F.when(F.size(F.array_intersect("seen", own)) >= need, let(hits, windows)).otherwise(none)


def scanned(docs: DataFrame, templates, threshold: float) -> DataFrame:
    """One pass over the texts: word counts, places of phrases, template words of the text, and the blocks with enough of them."""
    sets = [set(t.split()) for _, t in templates]
    vocabulary = F.array(*[F.lit(w) for w in sorted(set().union(*sets))])
    text = ascii_lower(text_of())
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("row_hash"), text.alias("text")).withColumn("plain", plain_words(F.col("text")))
    padded = F.concat(F.lit(" "), F.col("plain"), F.lit(" "))
    none = F.array().cast("array<int>")
    found = lambda phrase: let(split_words(F.col("plain")), lambda words: starts_of(words, phrase))
    places = [F.when(padded.contains(f" {p} "), found(p)).otherwise(none) for p, _ in PHRASES]
    rows = rows.withColumn("seen", F.array_intersect(split_words(F.col("plain")), vocabulary))
    of = lambda k, text: F.transform(template_windows(text, threshold), lambda words: F.struct(F.lit(k).alias("own"), words.alias("words")))
    windows = F.concat(*[of(k, text) for k, (_, text) in enumerate(templates)])
    blocks = F.transform(windows, lambda b, i: F.struct(i.alias("line"), b.own.alias("own"), b.words.alias("words")))
    return rows.select(
        "doc_id", "row_hash", F.size(split_words(F.col("plain"))).cast("bigint").alias("n_words"),
        *[p.alias(f"at_{i}") for i, p in enumerate(places)], "seen", blocks.alias("blocks"))


def values(spark, rows: list[tuple], names: str) -> DataFrame:
    """A small local table."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows))} AS t({names})")


def template_blocks(rows: DataFrame, templates, threshold: float) -> DataFrame:
    """``doc_id``, ``row_hash``, ``line``, ``label``, ``containment`` of every block that reaches a template's threshold."""
    spark = rows.sparkSession
    counts = {r["word"]: r["n"] for r in rows.select(F.explode("seen").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the template words
    vocabulary = sorted({w for _, t in templates for w in t.split()}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(vocabulary)}
    index, full = [], []
    for k, (label, text) in enumerate(templates):
        ranks = sorted(rank[w] for w in set(text.split()))
        need = needed(set(text.split()), threshold)
        full.append((k, label, "array" + str(tuple(ranks)) if len(ranks) > 1 else f"array({ranks[0]})"))
        index += [(k, r, at, len(ranks), need) for at, r in enumerate(ranks[:len(ranks) - need + 1])]
    sets = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({k}, '{label}', {a})" for k, label, a in full) + " AS t(template, label, ranks)")
    ranks = F.create_map(*[x for w, i in rank.items() for x in (F.lit(w), F.lit(i))])
    blocks = rows.select("doc_id", "row_hash", F.inline("blocks")).select(
        "doc_id", "row_hash", "line", "own", F.sort_array(F.transform("words", lambda w: F.element_at(ranks, w))).alias("block"))
    places = blocks.select("*", F.posexplode("block").alias("at", "word"))
    size = F.size("block")
    fits = (F.col("own") == F.col("template")) & (size >= F.col("need")) & (F.least(size - F.col("at"), F.col("t_size") - F.col("t_at")) >= F.col("need"))
    small = values(spark, index, "template, word, t_at, t_size, need")
    candidates = places.join(F.broadcast(small), "word").filter(fits).dropDuplicates(["doc_id", "row_hash", "line", "template"])
    counted = candidates.join(F.broadcast(sets), "template").withColumn("shared", F.size(F.array_intersect("block", "ranks")))
    return counted.filter(F.col("shared") >= F.col("need")).select(
        "doc_id", "row_hash", "line", "label", (F.col("shared") / F.col("t_size")).alias("containment"))


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: words, base phrases (``n_base``, first and last word, labels), all ``labels`` and ``score``."""
    rows = written(scanned(docs, templates, threshold), "license-scan")
    found = template_blocks(rows, templates, threshold).groupBy("doc_id", "row_hash").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    found = found.select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"), "more", "containment")
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row_hash") == F.col("__hash")), "left")
    at = F.flatten(F.array(*[F.col(f"at_{i}") for i in range(len(PHRASES))]))
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"at_{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)])))
    every = F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", F.size(at).cast("bigint").alias("n_base"),
        F.array_min(at).cast("bigint").alias("first_word"), F.array_max(at).cast("bigint").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size(at) > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))


def op7_license_scan(spark, sf_dir):
    return license_scan(documents(spark, sf_dir))


Q["op7_license_scan"] = op7_license_scan


def _sql() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"({k}, {sorted(set(t.split()))}, '{label}', {needed(set(t.split()), THRESHOLD)}, {len(t.split())})" for k, (label, t) in enumerate(TEMPLATES))
    return rf"""
WITH p(ws, label) AS (VALUES {phrases}), t(k, ws, label, need, width) AS (VALUES {templates}),
d AS (SELECT doc_id, {lower.format("coalesce(text, '')")} AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
b AS (SELECT doc_id, label, i - 1 AS pos FROM (SELECT doc_id, w.ws, p.ws AS pw, label, unnest(range(1, len(w.ws) - len(p.ws) + 2)) AS i FROM w, p)
      WHERE ws[i:i + len(pw) - 1] = pw),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list_sort(list_distinct(list(label))) AS labels FROM b GROUP BY doc_id),
wat AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
h AS (SELECT doc_id, i, word, k, label, need, width, n FROM wat JOIN (SELECT k, label, need, width, len(ws) AS n, unnest(ws) AS word FROM t) USING (word)),
s AS (SELECT doc_id, label, need, n, count(DISTINCT word) OVER (PARTITION BY doc_id, k ORDER BY i RANGE BETWEEN CURRENT ROW AND width - 1 FOLLOWING) AS k FROM h),
more AS (SELECT doc_id, list(label) AS labels, max(k / n) AS c FROM s WHERE k >= need GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::bigint AS n_words, coalesce(base.n, 0)::bigint AS n_base, lo::bigint AS first_word, hi::bigint AS last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::double AS score
FROM w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN more ON more.doc_id = w.doc_id"""


S["op7_license_scan"] = _sql()
