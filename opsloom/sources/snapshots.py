"""Immutable dataset versions with a manifest table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from opsloom.sources.files import write_csv

MANIFEST_SCHEMA = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("written_at", T.TimestampType()),
    T.StructField("rows", T.LongType()), T.StructField("columns", T.LongType()), T.StructField("seed", T.LongType()),
    T.StructField("file_format", T.StringType()),
])


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """Every manifest entry ever written below ``base``."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{base}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def history(spark: SparkSession, base: str) -> DataFrame:
    """The latest entry per version."""
    w = Window.partitionBy("version").orderBy(F.col("written_at").desc())
    return manifest(spark, base).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def next_version(spark: SparkSession, base: str) -> int:
    return (manifest(spark, base).agg(F.max("version")).first()[0] or 0) + 1


def save_version(df: DataFrame, base: str, seed: int = 42, version: int | None = None, file_format: str = "parquet") -> int:
    """Write ``df`` as a new version; an existing version is never overwritten."""
    spark = df.sparkSession
    version = version or next_version(spark, base)
    path = f"{base}/data/v={version}"
    if file_format == "csv":
        write_csv(df, path)
        written = _read_csv(spark, path, df.schema)
    else:
        df.write.mode("errorifexists").parquet(path)
        written = spark.read.parquet(path)
    entry = written.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(version).cast("bigint").alias("version"), F.current_timestamp().alias("written_at"), "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"), F.lit(seed).cast("bigint").alias("seed"), F.lit(file_format).alias("file_format"),
    )
    entry.write.mode("append").parquet(f"{base}/manifest")
    return version


def _read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")).csv(path)


def load_version(spark: SparkSession, base: str, version: int, schema=None) -> DataFrame:
    """A version in the format it was written in; a CSV version takes ``schema`` or has its types inferred."""
    entry = history(spark, base).filter(F.col("version") == version).select("file_format").first()
    if entry is None:
        raise ValueError(f"no version {version} below {base}")
    path = f"{base}/data/v={version}"
    return _read_csv(spark, path, schema) if entry["file_format"] == "csv" else spark.read.parquet(path)
