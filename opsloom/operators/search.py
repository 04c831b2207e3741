"""Search over ticket texts: query resolution, embedding store, end-to-end retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from opsloom.functions.lookup import lookup_join
from opsloom.functions.ordinals import trim_ws
from opsloom.operators.embed import Embedder, fit_transform, with_semantic_text
from opsloom.operators.text import semantic_text
from opsloom.operators.vectors import knn
from opsloom.session import materialize

# The ticket a free text stands for, and its business hours.
FREE_TEXT_TICKET = {
    "number": "INC_QUERY_001", "category": "General", "subcategory": "General", "business_service": "Enterprise Core Service",
    "cmdb_ci": "ci-query-node", "priority": "P3 - Moderate", "business_impact": "3 - Low", "urgency": "3 - Low",
    "contact_type": "Self service", "location": "UNKNOWN", "vendor": "UNKNOWN", "reassignment_count": 0, "reopen_count": 0,
    "has_change_request": 0, "has_problem_id": 0, "is_duplicate": 0, "has_parent_incident": 0,
}
FREE_TEXT_HOURS = (8, 17)


def tickets_from_text(df: DataFrame, text: str, as_of) -> DataFrame:
    """Template tickets for free texts; ``as_of`` is the opening time."""
    at = F.lit(as_of).cast("timestamp_ntz")
    body = trim_ws(F.col(text))
    return df.withColumns({c: F.lit(v) for c, v in FREE_TEXT_TICKET.items() if c not in df.columns}).withColumns({
        "short_description": body, "description": body, "opened_at": at, "opened_at_hour": F.hour(at), "opened_at_dayofweek": F.weekday(at),
        "is_business_hours": F.hour(at).between(*FREE_TEXT_HOURS).cast("int"),
    })


# Text fields that a query given as a record may name.
RECORD_FIELDS = ("short_description", "description", "category", "subcategory", "business_service", "cmdb_ci", "priority")


def record_tickets(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``record``: the ticket that a JSON object describes, null for any other text.

    Fields are read by a schema; one that the record lacks has the template's value, unknown ones are ignored. A text is a
    record if it is an object that names at least one field.
    """
    schema = ", ".join(f"{c} string" for c in RECORD_FIELDS)
    body = trim_ws(F.col(text))
    read = F.when(body.startswith("{") & body.endswith("}"), F.from_json(body, schema))
    parsed = df.withColumn("__r", read)
    given = F.greatest(*[F.col(f"__r.{c}").isNotNull() for c in RECORD_FIELDS])
    field = lambda c: F.coalesce(F.col(f"__r.{c}"), F.lit(FREE_TEXT_TICKET.get(c)).cast("string")).alias(c)
    return parsed.withColumn("record", F.when(F.col("__r").isNotNull() & given, F.struct(*[field(c) for c in RECORD_FIELDS]))).drop("__r")


def resolve_queries(asked: DataFrame, store: DataFrame) -> DataFrame:
    """``(query_id, kind, semantic_text)``: a stored ticket number stands for its stored text, a record for the text of the
    ticket it describes, else the query is the text."""
    q = record_tickets(asked, "query").select("query_id", trim_ws(F.col("query")).alias("number"), "record")
    asked_for = store.select("number", "semantic_text").join(q.select("number").distinct(), "number", "left_semi")
    known = lookup_join(q, asked_for, ["number"])  # only the texts that are asked for meet the queries
    is_record = F.col("record").isNotNull()
    described = known.select("query_id", "number", F.col("semantic_text").alias("stored"), is_record.alias("is_record"), "record.*")
    return described.select(
        "query_id", F.when(F.col("stored").isNotNull(), "number").when(F.col("is_record"), "record").otherwise("text").alias("kind"),
        F.coalesce("stored", F.when(F.col("is_record"), semantic_text(described)), "number").alias("semantic_text"))


def save_vectors(df: DataFrame, path: str) -> str:
    """Vectors and their ticket fields in one table, so no positional alignment is needed."""
    df.write.mode("errorifexists").parquet(path)
    return path


def load_vectors(spark: SparkSession, path: str, column: str = "embedding") -> DataFrame:
    """Load stored vectors; mixed dimensions are an error."""
    df = spark.read.parquet(path)
    ends = df.agg(F.min(F.size(column)).alias("lo"), F.max(F.size(column)).alias("hi")).first()
    if ends["lo"] != ends["hi"]:
        raise ValueError(f"stored vectors have {ends['lo']} to {ends['hi']} dimensions")
    return df


def build_index(df: DataFrame, path: str, **options) -> tuple[Embedder, DataFrame]:
    """Embed tickets and store vectors with their fields below ``path``, one folder per dataset version."""
    texts = with_semantic_text(df)
    model, vectors = fit_transform(texts, **options)
    save_vectors(texts.join(vectors, "number"), path)
    return model, load_vectors(df.sparkSession, path)


def similar_texts(model: Embedder, index: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """Top-K stored tickets of every query (ticket number or free text)."""
    resolved = resolve_queries(asked, index).select(F.col("query_id").cast("string").alias("number"), "semantic_text")
    vectors = materialize(model.transform(resolved), "query-vectors")  # the search reads them twice
    return knn(vectors, index, k, id_col="number")


def close_notes(matches: DataFrame, notes: DataFrame, k: int = 3) -> DataFrame:
    """Close notes of similar tickets, best first: ``(query_id, rank, close_note, resolution_code, best_score, n_tickets)``.

    ``matches`` has (query_id, match_id, score), ``notes`` at most one row (match_id, close_note, resolution_code) a ticket. Blank notes are left
    out; a note with one code that several matches share, after trimming, is one row with the best score. Equal scores: more
    tickets first, then the smaller note and code. A query whose matches have no note has no row.
    """
    said = notes.select("match_id", trim_ws(F.col("close_note")).alias("close_note"), "resolution_code").filter(F.length("close_note") > 0)
    by = matches.select("query_id", "match_id", "score").join(said, "match_id").groupBy("query_id", "close_note", "resolution_code").agg(
        F.max("score").alias("best_score"), F.count(F.lit(1)).alias("n_tickets"))
    best = Window.partitionBy("query_id").orderBy(F.desc("best_score"), F.desc("n_tickets"), "close_note", F.asc_nulls_last("resolution_code"))
    return by.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= k).select(
        "query_id", "rank", "close_note", "resolution_code", "best_score", "n_tickets")


def exclude_cancelled(df: DataFrame, state: int = 8) -> DataFrame:
    """Drop cancelled tickets before training; a table without states is left alone."""
    return df.filter(F.coalesce(F.col("state").try_cast("int") != state, F.lit(True))) if "state" in df.columns else df
