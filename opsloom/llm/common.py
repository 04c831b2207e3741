"""Helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from opsloom.session import shuffles_removed as shuffles_removed
from opsloom.sources.tables import table

WHITE = " \t\n\x0b\x0c\r"  # \x20 and \x09-\x0D
WHITE_RUN = r"[\x20\x09-\x0D]+"
ROWS_PER_CHUNK = 1_000_000
BATCH_BYTES = 4_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """Jobs started inside hand rows to Python in batches of about ``size`` bytes, which bounds what a worker and its task hold."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs without white space, in order; an empty array for a text without any."""
    bare = F.trim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_RUN))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of one byte a character take the fast built-in."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def grouped_rank(df: DataFrame, keys: list[str], seed: int, ident: list[str], rows: int, out: str = "rank") -> DataFrame:
    """Number the rows of each key from 0, in the order of a seeded hash of ``ident`` (then ``ident`` itself).

    A key may hold a third of all rows: it is cut into ranges of the hash, the ranges are counted, and only the rows of
    one range are ordered together. The order, and so the result, doesn't depend on how many ranges there are.
    ``df`` is read twice, so hand in a stored table.
    """
    chunks = max(1, -(-rows // ROWS_PER_CHUNK)) * 4
    by = [*keys, "__chunk"]
    hashed = df.withColumn("__h", F.xxhash64(F.lit(seed), *ident)).withColumn(
        "__chunk", F.floor((F.col("__h") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(chunks)).cast("int"))
    counts = hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy(*by).orderBy("__h", *ident)) - 1
    ranked = hashed.withColumn("__local", local)
    right = starts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], "__start")
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)]
    joined = ranked.join(right, on, "left")
    return joined.select(*df.columns, (F.col("__start") + F.col("__local")).cast("bigint").alias(out))
