"""Text-file sources and sinks for ticket tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from opsloom.session import work_path

# Encodings tried in order.
ENCODINGS = ("utf-8", "cp1252", "latin-1")
CP1252_UNDEFINED = "81|8D|8F|90|9D"
QUOTED = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def scratch(spark: SparkSession, name: str) -> str:
    return work_path(spark, name)


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 when every line is valid UTF-8, else the Windows code page, else Latin-1.

    The text source keeps the bytes of a line as they are, so the test is one aggregate over the files.
    """
    lines = spark.read.text(path)
    undefined = F.hex("value").rlike(f"^(..)*({CP1252_UNDEFINED})")
    bad = lines.agg(
        F.count_if(~F.is_valid_utf8("value")).alias("utf8"), F.count_if(undefined).alias("cp1252")
    ).first()
    if not bad["utf8"]:
        return ENCODINGS[0]
    return ENCODINGS[1] if not bad["cp1252"] else ENCODINGS[2]


def read_csv(spark: SparkSession, path: str, schema: StructType, encoding: str | None = None) -> DataFrame:
    """Typed CSV scan; a byte-order mark is dropped by the reader.

    The Windows code page is read as Latin-1, which it extends, and its own characters are then translated.
    """
    enc = encoding or detect_encoding(spark, path)
    reader = spark.read.schema(schema).options(**QUOTED).option("encoding", "utf-8" if enc == "utf-8" else "iso-8859-1")
    df = reader.option("emptyValue", "").csv(path)
    if enc != "cp1252":
        return df
    high = bytes(b for b in range(0x80, 0xA0) if f"{b:02X}" not in CP1252_UNDEFINED.split("|"))
    latin, windows = high.decode("latin-1"), high.decode("cp1252")
    return df.withColumns({c: F.translate(c, latin, windows) for c, t in df.dtypes if t == "string"})


def optional_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet side table, or None when nothing is stored there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").options(**QUOTED).option("quoteAll", "false").option("emptyValue", '""').csv(path)
    return path


def read_json(spark: SparkSession, path: str, schema: StructType, multi_line: bool = False) -> DataFrame:
    """Typed JSON scan: one ticket per line, or one object / array of tickets per file with ``multi_line``."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
    return path
