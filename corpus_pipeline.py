"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of documents; a document that the mix takes twice stands there twice.

Defined results: rows are told apart by id and text, so rows without an id or with a repeated one are judged each by its
own text and clean ones stay; of equal rows exact dedup keeps one; in near-dedup rows with one id are one document, and a
row without an id is linked with nothing and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from opsloom.llm.best_fit import pack
from opsloom.llm.common import documents, text_of
from opsloom.llm.exact_dedup import DigestIndex, exact_dedup
from opsloom.llm.mixing import mix
from opsloom.llm.near_dedup import near_dedup
from opsloom.llm.quality_rules import quality_verdicts
from opsloom.session import work_path, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEY = ["__id", "__none", "__hash"]


def _keyed(df: DataFrame, row_hash) -> DataFrame:
    """``df`` with a key for rows of one id (or none) and text; plain columns, so Spark can split what is uneven."""
    return df.withColumns({"__id": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull(), "__hash": row_hash})


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_verdicts(docs, keep=COLUMNS).filter("kept").select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    verdicts = exact_dedup(docs, DigestIndex(spark, work_path(spark, "digest-index"), docs.count()))
    kept = _keyed(verdicts.filter("kept"), F.col("row_hash")).select(*KEY)
    rows = _keyed(docs.select(*COLUMNS), F.xxhash64(text_of())).join(kept, KEY, "left_semi")
    once = F.row_number().over(Window.partitionBy(*KEY).orderBy("lang", "source"))
    return rows.withColumn("__row", once).filter("__row = 1").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    gone = near_dedup(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as many times as it is taken; equal rows share what they are taken together."""
    key = [*KEY, "__source"]
    source = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    taken = _keyed(mix(docs), F.col("row_hash")).withColumn("__source", source)
    taken = taken.groupBy(*key).agg(F.sum("copies").alias("__taken"), F.count(F.lit(1)).alias("__rows")).filter("__taken > 0")
    rows = _keyed(docs.select(*COLUMNS), F.xxhash64(text_of())).withColumn("__source", source).join(taken, key)
    number = F.row_number().over(Window.partitionBy(*key).orderBy("lang"))
    copies = F.expr("CAST(__taken div __rows + IF(__number <= __taken % __rows, 1, 0) AS INT)")
    rows = rows.withColumn("__number", number).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return rows.select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix with their places in the sequences."""
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
