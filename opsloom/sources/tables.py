"""The given tables and the ticket table that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its schema is read from the footer once and then reused, which saves a job per scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a scan with fewer splits than there are cores; larger tables are left as they are.

    Text work is bound by the processor, and a small file is often one row group and so one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def tickets(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """One ticket per order, joined on plain keys only.

    Order lines are aggregated before they are joined. With ``text`` the whole document of the same
    key becomes the description and the opening turn of the conversation of the same key the title;
    tickets without one keep NULL, so repairs and rules have real work. No join is forced to
    broadcast: Spark picks it from the size it measures.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_shipdate").alias("first_ship"),
            F.max("l_shipdate").alias("last_ship"),
            F.count(F.lit(1)).alias("n_lines"),
            F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
            F.min("l_suppkey").alias("first_supp"),
        )
    )
    geo = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    who = table(spark, sf_dir, "customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    # Orders and their lines are the two large sides: the lines are already hashed by order, so only orders move.
    df = (
        table(spark, sf_dir, "orders")
        .join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(who, F.col("o_custkey") == F.col("c_custkey"))
    )
    title = body = F.lit(None).cast("string")
    if text:
        docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("doc_text"))
        opening = (
            table(spark, sf_dir, "conversations")
            .filter(F.col("turn") == 0)
            .select("conv_id", F.col("text").alias("conv_text"))
        )
        df = df.join(docs, F.col("doc_id") == F.col("o_orderkey"), "left").join(
            opening, F.col("conv_id") == F.col("o_orderkey"), "left"
        )
        title, body = F.col("conv_text"), F.col("doc_text")
    done = F.col("o_orderstatus") == "F"
    out = df.select(
        ticket_number("o_orderkey").alias("number"),
        F.col("o_orderdate").alias("opened_at"),
        F.when(done, F.col("first_ship")).otherwise(F.col("last_ship")).alias("resolved_at"),
        F.when(F.col("n_returned") > 0, F.col("last_ship")).otherwise(F.col("first_ship")).alias("closed_at"),
        F.col("o_orderpriority").alias("priority_raw"),
        F.when(F.col("o_totalprice") >= 375000, 1)
        .when(F.col("o_totalprice") >= 125000, 2)
        .otherwise(3)
        .alias("business_impact"),
        F.col("n_returned").cast("int").alias("urgency"),
        F.col("c_mktsegment").alias("category"),
        F.col("o_orderstatus").alias("subcategory"),
        F.col("n_name").alias("assignment_group"),
        F.col("r_name").alias("business_service"),
        F.concat(F.lit("ci-"), F.col("first_supp").cast("string")).alias("cmdb_ci"),
        F.col("c_name").alias("caller"),
        title.alias("short_description"),
        body.alias("description"),
        (F.col("n_lines") - 1).cast("int").alias("reassignment_count"),
        done.alias("made_sla"),
        (F.col("n_returned") > 0).alias("problem_flag"),
        F.col("o_orderkey").alias("ticket_key"),
    )
    return out if text else out.drop("short_description", "description")


def ticket_number(key: str):
    """Ticket number of an order key."""
    return F.concat(F.lit("INC"), F.lpad(F.col(key).cast("string"), 12, "0"))


# The same ticket table for the SQL check, as common table expressions.
TICKETS_CTE = """
li AS (SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS n_lines,
              sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_returned, min(l_suppkey) AS first_supp
       FROM lineitem GROUP BY l_orderkey),
tickets AS (
SELECT concat('INC', lpad(cast(o.o_orderkey AS varchar), 12, '0')) AS number,
       o.o_orderdate AS opened_at,
       CASE WHEN o.o_orderstatus = 'F' THEN li.first_ship ELSE li.last_ship END AS resolved_at,
       CASE WHEN li.n_returned > 0 THEN li.last_ship ELSE li.first_ship END AS closed_at,
       o.o_orderpriority AS priority_raw,
       CASE WHEN o.o_totalprice >= 375000 THEN 1 WHEN o.o_totalprice >= 125000 THEN 2 ELSE 3 END AS business_impact,
       cast(li.n_returned AS int) AS urgency,
       c.c_mktsegment AS category, o.o_orderstatus AS subcategory,
       n.n_name AS assignment_group, r.r_name AS business_service,
       CASE WHEN li.first_supp IS NULL THEN NULL ELSE concat('ci-', cast(li.first_supp AS varchar)) END AS cmdb_ci,
       c.c_name AS caller,
       cv.text AS short_description, d.text AS description,
       cast(li.n_lines - 1 AS int) AS reassignment_count,
       (o.o_orderstatus = 'F') AS made_sla, (li.n_returned > 0) AS problem_flag, o.o_orderkey AS ticket_key
FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN li ON li.l_orderkey = o.o_orderkey
LEFT JOIN documents d ON d.doc_id = o.o_orderkey
LEFT JOIN conversations cv ON cv.conv_id = o.o_orderkey AND cv.turn = 0)
"""
