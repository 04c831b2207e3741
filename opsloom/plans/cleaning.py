"""Registered queries: type enforcement, repairs, imputation, deduplication, scans of text files."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions.lookup import lookup_join
from opsloom.functions.ordinals import ORDINAL_RULES, apply_rule, parse_ordinal
from opsloom.operators import clean as C
from opsloom.operators.features import enrich, log_target, from_log_target, select_with_defaults
from opsloom.plans.base import PRIORITY_LEVEL_SQL, PRIORITY_SQL, over_repaired, over_tickets, repaired, stamp, with_priority
from opsloom.sources import files
from opsloom.sources.tables import table, tickets

Q, S = {}, {}


def _priority(spark, sf):
    words, default, *_ = ORDINAL_RULES["priority"]
    return tickets(spark, sf).select(
        "number", "priority_raw", parse_ordinal(F.col("priority_raw"), words, default).alias("parsed"),
        apply_rule("priority", F.col("priority_raw")).alias("priority"),
    )


Q["parse_ordinal_priority"] = _priority
S["parse_ordinal_priority"] = over_tickets(f"SELECT number, priority_raw, {PRIORITY_SQL} AS parsed, {PRIORITY_SQL} AS priority FROM tickets")

Q["clip_business_rules"] = lambda spark, sf: tickets(spark, sf).select(
    "number", apply_rule("business_impact", F.col("business_impact"), True).alias("business_impact"),
    apply_rule("urgency", F.col("urgency"), True).alias("urgency"),
    apply_rule("urgency", F.col("priority_raw")).alias("urgency_from_text"),
)
S["clip_business_rules"] = over_tickets("""
SELECT number, least(greatest(coalesce(business_impact, 2), 1), 3) AS business_impact,
  least(greatest(coalesce(urgency, 2), 1), 3) AS urgency,
  least(greatest(coalesce(CASE WHEN lower(priority_raw) LIKE '%sev 3%' THEN 3 WHEN lower(priority_raw) LIKE '%low%' THEN 3
     WHEN lower(priority_raw) LIKE '%sev 2%' THEN 2 WHEN lower(priority_raw) LIKE '%medium%' THEN 2
     WHEN lower(priority_raw) LIKE '%sev 1%' THEN 1 WHEN lower(priority_raw) LIKE '%high%' THEN 1
     WHEN lower(priority_raw) LIKE '%critical%' THEN 1 END,
     try_cast(nullif(regexp_extract(priority_raw, '^(\\d+)', 1), '') AS int), 2), 1), 3) AS urgency_from_text
FROM tickets""")


def _coerce(spark, sf):
    """Order priorities, flags and dates read as text and cast back without failing."""
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("string").alias("date_text"), "o_orderpriority", "o_orderstatus",
        F.col("o_totalprice").cast("string").alias("price_text"),
    )
    first = F.substring("o_orderpriority", 1, 1)
    flag = F.when(F.col("o_orderstatus") == "F", "True").when(F.col("o_orderstatus") == "O", "0")
    when = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("on "), "date_text")).otherwise(F.col("date_text"))
    return o.select(
        "o_orderkey",
        F.date_format(C.coerce(when, "datetime"), "yyyy-MM-dd HH:mm:ss").alias("opened_at"),
        C.coerce(F.col("o_orderpriority"), "integer").alias("int_or_zero"),
        C.coerce(first, "integer").alias("priority"),
        C.coerce(F.col("price_text"), "float").alias("price"),
        C.coerce(F.col("o_orderpriority"), "float").alias("not_a_number"),
        C.coerce(flag, "boolean").alias("flag"),
    )


Q["coerce_types"] = _coerce
S["coerce_types"] = """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS opened_at,
  coalesce(try_cast(o_orderpriority AS bigint), 0)::bigint AS int_or_zero, cast(left(o_orderpriority, 1) AS bigint) AS priority,
  o_totalprice AS price, try_cast(o_orderpriority AS double) AS not_a_number,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS flag
FROM orders"""

Q["repair_timestamps"] = lambda spark, sf: C.repair_timestamps(tickets(spark, sf)).select(
    "number", stamp("opened_at"), stamp("resolved_at"), stamp("closed_at"))
S["repair_timestamps"] = over_repaired("""
SELECT number, strftime(opened_at, '%Y-%m-%d %H:%M:%S') AS opened_at, strftime(resolved_at, '%Y-%m-%d %H:%M:%S') AS resolved_at,
  strftime(closed_at, '%Y-%m-%d %H:%M:%S') AS closed_at FROM rep""")

Q["strict_timestamp_filter"] = lambda spark, sf: C.repair_timestamps(tickets(spark, sf), strict=True).select(
    "number", stamp("opened_at"), stamp("resolved_at"), stamp("closed_at"))
S["strict_timestamp_filter"] = over_tickets("""
SELECT number, strftime(opened_at, '%Y-%m-%d %H:%M:%S') AS opened_at, strftime(resolved_at, '%Y-%m-%d %H:%M:%S') AS resolved_at,
  strftime(closed_at, '%Y-%m-%d %H:%M:%S') AS closed_at FROM tickets
WHERE NOT coalesce(resolved_at < opened_at, false) AND NOT coalesce(closed_at < resolved_at, false)""")


def _blanks(spark, sf):
    """Documents with their source as category and the title of their conversation as group, gaps included."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("category"))
    roles = table(spark, sf, "conversations").filter(F.col("turn") == 0).select("conv_id", F.col("role").alias("assignment_group"))
    joined = docs.join(roles, F.col("doc_id") == F.col("conv_id"), "left").withColumn(
        "category", F.when(F.col("assignment_group") == "system", "  \t").otherwise(F.col("category")))
    return C.blank_to_unknown(joined).select("doc_id", "category", "assignment_group")


Q["blank_to_unknown"] = _blanks
S["blank_to_unknown"] = """
SELECT d.doc_id, CASE WHEN c.role = 'system' OR d.source IS NULL OR trim(d.source) = '' THEN 'Unknown' ELSE d.source END AS category,
  coalesce(c.role, 'Unknown') AS assignment_group
FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id AND c.turn = 0"""

Q["normalize_strings"] = lambda spark, sf: C.trim_strings(
    table(spark, sf, "documents").select("doc_id", F.concat(F.lit(" \t"), "text", F.lit("\n ")).alias("description"))
).select("doc_id", F.md5("description").alias("digest"), F.length("description").cast("bigint").alias("chars"))
S["normalize_strings"] = r"""
SELECT doc_id, md5(regexp_replace(text, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')) AS digest,
  length(regexp_replace(text, '^[\s\x0b]+|[\s\x0b]+$', '', 'g'))::bigint AS chars FROM documents"""

# Source field -> table field.
FIELD_NAMES = {
    "number": "incident_number", "short_description": "short_description", "description": "description",
    "category": "category", "subcategory": "subcategory", "priority": "priority", "impact": "impact",
    "urgency": "urgency", "assignment_group": "assignment_group", "assigned_to": "assigned_to", "state": "state",
    "contact_type": "contact_type", "sys_created_on": "created_date", "sys_updated_on": "updated_date",
    "resolved_at": "resolved_date", "closed_at": "closed_date", "close_notes": "resolution_notes",
    "reassignment_count": "reassignment_count", "reopen_count": "reopen_count", "caller_id": "caller",
    "cmdb_ci": "configuration_item",
}
Q["rename_fields"] = lambda spark, sf: C.rename_fields(
    tickets(spark, sf).withColumnRenamed("caller", "caller_id"), FIELD_NAMES
).select("incident_number", "category", "caller", "configuration_item", "reassignment_count")
S["rename_fields"] = over_tickets("""SELECT number AS incident_number, category, caller, cmdb_ci AS configuration_item,
  reassignment_count FROM tickets""")


def _impute(spark, sf):
    df = tickets(spark, sf, text=True)
    plan = {
        "reassignment_count": "median", "urgency": "mode", "cmdb_ci": "unknown", "short_description": "text",
        "description": "text",
    }
    return C.impute(df, plan).select(
        "number", F.col("reassignment_count").cast("double").alias("reassignment_count"), "urgency", "cmdb_ci",
        "short_description", F.md5("description").alias("description_digest"), stamp("resolved_at"),
    )


Q["impute_nulls"] = _impute
S["impute_nulls"] = over_tickets("""
SELECT number, coalesce(reassignment_count::double, (SELECT quantile_cont(reassignment_count, 0.5) FROM tickets)) AS reassignment_count,
  coalesce(urgency, (SELECT urgency FROM tickets WHERE urgency IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, urgency LIMIT 1)) AS urgency,
  coalesce(cmdb_ci, 'Unknown') AS cmdb_ci, coalesce(short_description, 'Not Provided') AS short_description,
  md5(coalesce(description, 'Not Provided')) AS description_digest, strftime(resolved_at, '%Y-%m-%d %H:%M:%S') AS resolved_at
FROM tickets""")

Q["winsorize"] = lambda spark, sf: C.winsorize(
    tickets(spark, sf).withColumn("reopen_count", F.col("urgency"))
).select("number", "reassignment_count", "reopen_count")
S["winsorize"] = over_tickets("""
, q AS (SELECT quantile_cont(reassignment_count, 0.99) AS a, quantile_cont(urgency, 0.99) AS b FROM tickets),
caps AS (SELECT CASE WHEN a BETWEEN 5 AND 15 THEN a ELSE 15 END AS ca, CASE WHEN b BETWEEN 5 AND 8 THEN b ELSE 8 END AS cb FROM q)
SELECT number, CASE WHEN reassignment_count > ca THEN trunc(ca)::int ELSE reassignment_count END AS reassignment_count,
  CASE WHEN urgency > cb THEN trunc(cb)::int ELSE urgency END AS reopen_count FROM tickets, caps""")


def _orders_by_customer(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("number"), F.col("o_orderdate").alias("opened_at"), F.col("o_orderkey").alias("k"),
        F.col("o_orderstatus").alias("status"),
    )


Q["dedup_keep_latest"] = lambda spark, sf: C.keep_latest(_orders_by_customer(spark, sf)).select("number", stamp("opened_at"), "k", "status")
S["dedup_keep_latest"] = """
SELECT number, strftime(opened_at, '%Y-%m-%d %H:%M:%S') AS opened_at, k, status FROM (
  SELECT o_custkey AS number, o_orderdate AS opened_at, o_orderkey AS k, o_orderstatus AS status,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""

Q["dedup_exact"] = lambda spark, sf: C.drop_exact_copies(table(spark, sf, "documents").select("text", "lang", "source")).select(
    F.md5("text").alias("digest"), "lang", "source")
S["dedup_exact"] = "SELECT DISTINCT md5(text) AS digest, lang, source FROM documents"


def _enrich(spark, sf):
    cmdb = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("category")).agg(
        F.concat(F.lit("owner-"), F.min("c_custkey").cast("string")).alias("ci_owner"))
    shift = table(spark, sf, "nation").select(
        F.col("n_name").alias("assignment_group"), F.concat(F.lit("shift-"), F.col("n_regionkey").cast("string")).alias("shift_name"))
    df = tickets(spark, sf)
    return enrich(enrich(df, cmdb, "category"), shift, "assignment_group").select(
        "number", "category", "assignment_group", "ci_owner", "shift_name")


Q["enrich_left_join"] = _enrich
S["enrich_left_join"] = over_tickets("""
, cmdb AS (SELECT c_mktsegment AS category, concat('owner-', cast(min(c_custkey) AS varchar)) AS ci_owner FROM customer GROUP BY 1),
shift AS (SELECT n_name AS assignment_group, concat('shift-', cast(n_regionkey AS varchar)) AS shift_name FROM nation)
SELECT number, category, assignment_group, ci_owner, shift_name FROM tickets LEFT JOIN cmdb USING (category) LEFT JOIN shift USING (assignment_group)""")

Q["select_with_defaults"] = lambda spark, sf: select_with_defaults(
    tickets(spark, sf), ["number", "category", "u_caused_by", "severity", "close_notes"], ("u_caused_by",), ("close_notes",))
S["select_with_defaults"] = over_tickets("SELECT number, category, 'UNKNOWN' AS u_caused_by, 0 AS severity, '' AS close_notes FROM tickets")


def _log_target(spark, sf):
    df = repaired(spark, sf).select("number", log_target(F.col("resolution_time_hours")).alias("y"))
    return df.select("number", F.round("y", 6).alias("log_hours"), F.round(from_log_target(F.col("y")), 4).alias("hours"))


Q["log_target"] = _log_target
S["log_target"] = over_repaired("""
SELECT number, round(ln(1 + least(greatest(resolution_time_hours, 0), 168)), 6) AS log_hours,
  round(least(greatest(resolution_time_hours, 0), 168), 4) AS hours FROM rep""")

LEDGER_FILL = ("resolved_at", "cmdb_ci", "reassignment_count", "urgency", "short_description", "description")


def _ledger(spark, sf):
    return C.cleaning_ledger(tickets(spark, sf, text=True), LEDGER_FILL)


Q["cleaning_ledger"] = _ledger
S["cleaning_ledger"] = over_tickets("""
, counted AS (
""" + "\nUNION ALL ".join(
    f"SELECT 'Missing Value Imputation' AS step, '{c}' AS affected_column, count(*) FILTER ({c} IS NULL) AS records_modified FROM tickets"
    for c in LEDGER_FILL) + """
UNION ALL SELECT 'Domain Catalog Validation', 'category', count(*) FILTER (category IS NULL OR trim(category) = '') FROM tickets
UNION ALL SELECT 'Domain Catalog Validation', 'assignment_group', count(*) FILTER (assignment_group IS NULL OR trim(assignment_group) = '') FROM tickets
UNION ALL SELECT 'Timestamp Progression Correction', 'resolved_at', count(*) FILTER (resolved_at < opened_at) FROM tickets
UNION ALL SELECT 'Timestamp Progression Correction', 'closed_at', count(*) FILTER (closed_at <
   CASE WHEN resolved_at < opened_at THEN opened_at + INTERVAL 4 HOURS ELSE resolved_at END) FROM tickets
UNION ALL SELECT 'Business Rule Enforcement', 'priority', count(*) FILTER (""" + PRIORITY_LEVEL_SQL + """ NOT BETWEEN 1 AND 5) FROM tickets
UNION ALL SELECT 'Business Rule Enforcement', 'business_impact', count(*) FILTER (coalesce(business_impact, 2) NOT BETWEEN 1 AND 3) FROM tickets
UNION ALL SELECT 'Business Rule Enforcement', 'urgency', count(*) FILTER (coalesce(urgency, 2) NOT BETWEEN 1 AND 3) FROM tickets
UNION ALL SELECT 'String Normalization', 'ALL_STRINGS', count(*) FROM tickets
UNION ALL SELECT 'Duplicate Removal', 'number', count(*) - count(DISTINCT number) FROM tickets
UNION ALL SELECT 'Outlier Winsorization', 'reassignment_count', count(*) FILTER (reassignment_count >
   (SELECT CASE WHEN q BETWEEN 5 AND 15 THEN q ELSE 15 END FROM (SELECT quantile_cont(reassignment_count, 0.99) AS q FROM tickets))) FROM tickets)
SELECT step, affected_column, records_modified FROM counted WHERE records_modified > 0""")


def _clean_all(spark, sf):
    df = tickets(spark, sf, text=True).withColumnRenamed("priority_raw", "priority")
    return C.clean(df).select(
        "number", "priority", "business_impact", "urgency", "category", "assignment_group", "cmdb_ci",
        "reassignment_count", stamp("opened_at"), stamp("resolved_at"), stamp("closed_at"),
        F.length("description").cast("bigint").alias("description_chars"),
    )


Q["clean_tickets"] = _clean_all
S["clean_tickets"] = over_repaired(r"""
SELECT number, priority, least(greatest(coalesce(business_impact, 2), 1), 3) AS business_impact,
  least(greatest(coalesce(urgency, 2), 1), 3) AS urgency, category, assignment_group, coalesce(cmdb_ci, 'Unknown') AS cmdb_ci,
  least(coalesce(reassignment_count, 0), trunc((SELECT CASE WHEN q BETWEEN 5 AND 15 THEN q ELSE 15 END
     FROM (SELECT quantile_cont(coalesce(reassignment_count, 0), 0.99) AS q FROM tickets)))::int) AS reassignment_count,
  strftime(opened_at, '%Y-%m-%d %H:%M:%S') AS opened_at, strftime(resolved_at, '%Y-%m-%d %H:%M:%S') AS resolved_at,
  strftime(closed_at, '%Y-%m-%d %H:%M:%S') AS closed_at,
  length(regexp_replace(coalesce(description, 'Not Provided'), '^[\s\x0b]+|[\s\x0b]+$', '', 'g'))::bigint AS description_chars
FROM rep""")


def _csv(spark, sf):
    src = tickets(spark, sf, text=True).select("number", "category", "reassignment_count", "description")
    path = files.write_csv(src, files.scratch(spark, "csv"))
    return files.read_csv(spark, path, src.schema).select(
        "number", "category", "reassignment_count", F.md5("description").alias("digest"))


Q["scan_csv"] = _csv
S["scan_csv"] = over_tickets("SELECT number, category, reassignment_count, md5(description) AS digest FROM tickets")


def _json(spark, sf):
    src = tickets(spark, sf, text=True).select("number", "category", "reassignment_count", "made_sla", "description")
    path = files.write_json(src, files.scratch(spark, "json"))
    return files.read_json(spark, path, src.schema).select(
        "number", "category", "reassignment_count", "made_sla", F.md5("description").alias("digest"))


Q["scan_json"] = _json
S["scan_json"] = over_tickets("SELECT number, category, reassignment_count, made_sla, md5(description) AS digest FROM tickets")
