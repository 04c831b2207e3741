"""TF-IDF over whole texts as tidy term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from opsloom.operators.text import STOP_WORDS

# Vocabulary size, embedding width, token pattern.
MAX_FEATURES = 25_000
DIMENSIONS = 384
TOKEN = r"[\p{L}\p{N}_]{2,}"
PART_BYTES = 2_000_000  # text a task counts and sorts the terms of; they take some forty times as much memory


def _parts(df: DataFrame, text_col: str) -> int:
    """Parts that hold about ``PART_BYTES`` of text each, one a core at least: a task's memory does not grow with the table."""
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def term_counts(df: DataFrame, id_col: str, text_col: str, stop_words=STOP_WORDS) -> DataFrame:
    """``(id, term, tf)`` of lower-cased tokens of two or more word characters.

    The texts are moved once, by id and before they are exploded, into as many parts as their size asks for; counts and
    norms per text then need no further shuffle.
    """
    texts = df.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("text")).repartition(_parts(df, text_col), "id")
    long = texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(TOKEN), 0)).alias("term"))
    return long.filter(~F.col("term").isin(list(stop_words))).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """The most frequent terms of the corpus with their document frequency; ties go to the smaller term."""
    stats = counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    return stats.orderBy(F.col("cf").desc(), "term").limit(max_features)


def fit_vocabulary(df: DataFrame, id_col: str, text_col: str, max_features: int = MAX_FEATURES, stop_words=STOP_WORDS) -> DataFrame:
    """``(term, ix, idf)`` with smoothed idf and dense slot numbers; at most ``max_features`` rows."""
    return slots_of(term_counts(df, id_col, text_col, stop_words), df.agg(F.count(F.lit(1))).scalar(), max_features)


def slots_of(counts: DataFrame, n, max_features: int = MAX_FEATURES) -> DataFrame:
    """``fit_vocabulary`` of ``n`` texts from their counts, a row for each text and term."""
    vocab = vocabulary(counts, max_features)
    slot = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1
    return vocab.select("term", slot.alias("ix"), (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(df: DataFrame, vocab: DataFrame, id_col: str, text_col: str, stop_words=STOP_WORDS) -> DataFrame:
    """``(id, term, ix, weight)``: tf x idf, unit length per text. The vocabulary is bounded, so it is broadcast."""
    counts = term_counts(df, id_col, text_col, stop_words)
    raw = counts.join(F.broadcast(vocab), "term").select("id", "term", "ix", (F.col("tf") * F.col("idf")).alias("w"))
    # A text has at most one row per vocabulary slot, so a window over one text is bounded.
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", "ix", (F.col("w") / norm).alias("weight"))


def tfidf(df: DataFrame, id_col: str, text_col: str, max_features: int = MAX_FEATURES, stop_words=STOP_WORDS) -> DataFrame:
    """``(id, term, weight)`` with the vocabulary fitted on the same texts."""
    vocab = fit_vocabulary(df, id_col, text_col, max_features, stop_words)
    return weights(df, vocab, id_col, text_col, stop_words).drop("ix")


def top_terms(weights: DataFrame, k: int = 5) -> DataFrame:
    """The heaviest terms per document (weights compared at six digits)."""
    w = Window.partitionBy("id").orderBy(F.col("weight").desc(), "term")
    return weights.select("id", "term", F.round("weight", 6).alias("weight")).withColumn(
        "rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
