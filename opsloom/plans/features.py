"""Registered queries: row-local features and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import features as E, text as T
from opsloom.plans.base import event_tickets, over_repaired, over_tickets, repaired, sql_list
from opsloom.sources.tables import spread, table, tickets

Q, S = {}, {}

PARTS = "hour(ts) AS opened_at_hour, isodow(ts) - 1 AS opened_at_dayofweek, month(ts) AS opened_at_month, (isodow(ts) >= 6)::int AS is_weekend"
as_big = lambda *cs: [F.col(c).cast("bigint").alias(c) for c in cs]

Q["datetime_features"] = lambda spark, sf: E.date_parts(event_tickets(spark, sf)).select(
    "number", *as_big("opened_at_hour", "opened_at_dayofweek", "opened_at_month"), "is_weekend")
S["datetime_features"] = f"SELECT event_id AS number, {PARTS} FROM events"

CYCLIC = ("opened_at_hour_sin", "opened_at_hour_cos", "opened_at_dayofweek_sin", "opened_at_dayofweek_cos")
Q["cyclic_features"] = lambda spark, sf: E.cyclic(E.date_parts(event_tickets(spark, sf))).select(
    "number", *[(F.round(c, 6) + 0.0).alias(c) for c in CYCLIC])
S["cyclic_features"] = """
SELECT event_id AS number, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS opened_at_hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS opened_at_hour_cos,
  round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS opened_at_dayofweek_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS opened_at_dayofweek_cos
FROM events"""


def _calendar(spark, sf):
    ev = event_tickets(spark, sf).select(F.concat(F.lit("EVT"), F.col("number").cast("string")).alias("number"), "opened_at")
    both = ev.unionByName(tickets(spark, sf).select("number", "opened_at"))
    return E.calendar_flags(E.date_parts(both)).select("number", "is_business_hours", "is_holiday")


Q["calendar_flags"] = _calendar
S["calendar_flags"] = over_tickets(f"""
, a AS (SELECT concat('EVT', cast(event_id AS varchar)) AS number, ts AS t_at FROM events UNION ALL SELECT number, opened_at FROM tickets)
SELECT number, (isodow(t_at) <= 5 AND hour(t_at) BETWEEN 8 AND 18)::int AS is_business_hours,
  (strftime(t_at, '%m-%d') IN ({sql_list(E.HOLIDAYS)}))::int AS is_holiday FROM a""")

Q["interactions"] = lambda spark, sf: E.interactions(repaired(spark, sf)).select(
    "number", "priority_x_business_impact", "priority_x_urgency", "category_assignment_interaction")
S["interactions"] = over_repaired("""
SELECT number, priority * business_impact AS priority_x_business_impact, priority * coalesce(urgency, 2) AS priority_x_urgency,
  concat(category, '_', assignment_group) AS category_assignment_interaction FROM rep""")

Q["resolution_hours"] = lambda spark, sf: E.resolution_hours(tickets(spark, sf)).select("number", "resolution_time_hours")
S["resolution_hours"] = over_tickets("""
SELECT number, greatest(coalesce(round(date_diff('second', opened_at, resolved_at) / 3600.0, 4), 0.0), 0.0)::double AS resolution_time_hours FROM tickets""")


def _linkage(spark, sf):
    """A ticket's parent is the order of the same customer it follows; its problem record is a returned line."""
    first = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_key"))
    o = table(spark, sf, "orders").join(first, "o_custkey").select(
        F.col("o_orderkey").alias("ticket_key"),
        F.when(F.col("o_orderkey") > F.col("first_key"), F.col("first_key").cast("string")).alias("parent_incident"),
        F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_orderstatus") == "O", F.lit("CHG")).alias("change_request"),
    )
    df = tickets(spark, sf).join(o, "ticket_key")
    return E.linkage_flags(df).select("number", "has_parent_incident", "has_change_request", "has_problem_id")


Q["linkage_flags"] = _linkage
S["linkage_flags"] = over_tickets("""
, f AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT t.number, (o.o_orderkey > f.k)::int AS has_parent_incident, (o.o_orderstatus = 'O')::int AS has_change_request,
  coalesce(t.problem_flag::int, 0) AS has_problem_id
FROM tickets t JOIN orders o ON o.o_orderkey = t.ticket_key JOIN f ON f.o_custkey = o.o_custkey""")


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", F.col("text").alias("description")), "doc_id")


WORDS = "len(list_filter(regexp_split_to_array({0}, '[\\s\\x0b]+'), lambda x: x != ''))"
Q["text_stats"] = lambda spark, sf: T.text_stats(docs(spark, sf)).select("doc_id", *as_big("description_word_count", "description_char_count"))
S["text_stats"] = f"SELECT doc_id, {WORDS.format('text')}::bigint AS description_word_count, length(text) AS description_char_count FROM documents"

_NORM = r"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '<[^>]+>', ' ', 'g'),
   '(?m)^(from|to|subject|date):.*$', ' ', 'g'), '\[system error code:\s*0x[0-9a-f]+\]', ' system_error ', 'g'), '[^\p{{L}}\p{{N}}_\s\-/.]', ' ', 'g'), '\s+'),
   lambda x: x != '' AND x NOT IN ({1}))"""


def norm_sql(column: str) -> str:
    """Normalised ASCII-path text of a column in the check dialect."""
    base = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.BASE_FORMS.items())
    tokens = _NORM.format(column, sql_list(T.stop_list()))
    joined = f"array_to_string(list_transform({tokens}, lambda x: CASE x {base} ELSE x END), ' ')"
    return f"coalesce(nullif({joined}, ''), 'not provided')"


Q["normalize_text"] = lambda spark, sf: docs(spark, sf).select(
    "doc_id", F.md5(T.normalize(F.col("description"), unicode_form=False)).alias("digest"))
S["normalize_text"] = f"SELECT doc_id, md5({norm_sql('text')}) AS digest FROM documents"

Q["normalize_text_nfkc"] = lambda spark, sf: docs(spark, sf).select("doc_id", T.normalize(F.col("description")).alias("description_clean"))

Q["strip_html"] = lambda spark, sf: table(spark, sf, "pages").select(
    "page_id", F.md5(T.strip_tags(F.col("html"))).alias("digest"), F.length(T.strip_tags(F.col("html"))).cast("bigint").alias("chars"))
S["strip_html"] = """SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS digest,
  length(regexp_replace(html, '<[^>]+>', ' ', 'g'))::bigint AS chars FROM pages"""

Q["token_estimates"] = lambda spark, sf: docs(spark, sf).select(
    "doc_id", F.round(T.tokens_by_chars(F.col("description")), 4).alias("by_chars"),
    T.tokens_by_chars_int(F.col("description")).cast("bigint").alias("by_chars_int"),
    T.tokens_by_words(F.col("description")).cast("bigint").alias("by_words"))
S["token_estimates"] = f"""SELECT doc_id, round(length(text) / 4.5::double, 4) AS by_chars, (length(text) // 4)::bigint AS by_chars_int,
  ceil({WORDS.format('text')} * 1.3::double)::bigint AS by_words FROM documents"""

SEMANTIC_SQL = r"""
, parts AS (SELECT *, coalesce(nullif(regexp_replace(short_description, '^[\s\x0b]+|[\s\x0b]+$', '', 'g'), ''), 'No short description') AS sd,
   coalesce(nullif(regexp_replace(description, '^[\s\x0b]+|[\s\x0b]+$', '', 'g'), ''), 'No detailed description') AS dd FROM rep),
sem AS (SELECT *, concat('[Category: ', category, ' | Subcategory: ', subcategory, '] [Service: ', business_service, ' | CI: ',
   coalesce(cmdb_ci, 'General CI'), '] [Priority: ', cast(priority AS varchar), '] ',
   CASE WHEN starts_with(lower(dd), lower(sd)) AND length(dd) > length(sd) THEN dd WHEN lower(dd) = lower(sd) THEN sd
        ELSE concat(sd, '. ', dd) END) AS semantic_text FROM parts)
"""
Q["semantic_text"] = lambda spark, sf: repaired(spark, sf, text=True).transform(
    lambda d: d.select("number", F.md5(T.semantic_text(d)).alias("digest"), F.length(T.semantic_text(d)).cast("bigint").alias("chars")))
S["semantic_text"] = over_repaired(SEMANTIC_SQL + "SELECT number, md5(semantic_text) AS digest, length(semantic_text) AS chars FROM sem")

Q["combined_text"] = lambda spark, sf: tickets(spark, sf, text=True).transform(
    lambda d: d.select("number", F.md5(T.combined_text(d)).alias("digest")))
S["combined_text"] = over_tickets(r"""
SELECT number, md5(concat(CASE WHEN t = '' THEN 'missingtext' ELSE t END, ' safetoken')) AS digest FROM (
  SELECT number, lower(regexp_replace(concat(coalesce(short_description, ''), ' ', coalesce(description, '')), '^[\s\x0b]+|[\s\x0b]+$', '', 'g')) AS t FROM tickets)""")
