"""Registered queries: profiling aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from opsloom.operators import profile as P
from opsloom.operators.text import word_count
from opsloom.plans.base import event_tickets, over_repaired, over_tickets, repaired
from opsloom.plans.features import WORDS, docs, norm_sql
from opsloom.schema import allowed_missing
from opsloom.sources.tables import table, tickets

Q, S = {}, {}

Q["dataset_summary"] = lambda spark, sf: P.dataset_summary(tickets(spark, sf))
S["dataset_summary"] = over_tickets("""
SELECT count(*) AS total_records, 17::bigint AS total_columns, count(*) - count(DISTINCT number) AS duplicate_key_count,
  round((count(*) - count(DISTINCT number)) * 100.0 / count(*), 4)::double AS duplicate_percentage,
  count(*) FILTER (assignment_group IS NULL) AS target_missing_count FROM tickets""")

COLUMNS = """number opened_at resolved_at closed_at priority_raw business_impact urgency category subcategory assignment_group
business_service cmdb_ci caller short_description description reassignment_count made_sla problem_flag ticket_key""".split()
Q["missing_report"] = lambda spark, sf: P.missing_report(tickets(spark, sf, text=True))
S["missing_report"] = over_tickets("\nUNION ALL ".join(
    f"""SELECT '{c}' AS column_name, m AS missing_count, round(m * 100.0 / n, 2)::double AS missing_percentage, {allowed_missing(c)}::double AS expected_max_percentage,
    CASE WHEN m * 100.0 / n <= {allowed_missing(c)} THEN 'PASS' ELSE 'EXCEEDS_THRESHOLD' END AS status
    FROM (SELECT count(*) AS n, count(*) FILTER ({c} IS NULL) AS m FROM tickets)""" for c in COLUMNS))

Q["duplicate_stats"] = lambda spark, sf: P.duplicate_stats(
    table(spark, sf, "documents").select(F.col("source").alias("number"), "text", "lang"))
S["duplicate_stats"] = """
SELECT 'exact_row' AS kind, count(*) - (SELECT count(*) FROM (SELECT DISTINCT source, text, lang FROM documents)) AS duplicate_count,
  round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT source, text, lang FROM documents))) * 100.0 / count(*), 4)::double AS duplicate_pct FROM documents
UNION ALL SELECT 'key', count(*) - count(DISTINCT source), round((count(*) - count(DISTINCT source)) * 100.0 / count(*), 4)::double FROM documents"""

CATEGORICAL = ["category", "subcategory", "assignment_group", "business_service", "cmdb_ci", "caller"]
VALUE_COUNTS = ", vc AS (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, cast({c} AS varchar) AS value, count(*) AS cnt FROM rep GROUP BY 2" for c in CATEGORICAL + ["priority"]) + ")"
Q["cardinality"] = lambda spark, sf: P.cardinality(repaired(spark, sf), CATEGORICAL)
S["cardinality"] = over_repaired(VALUE_COUNTS + """
, s AS (SELECT column_name, count(value) AS unique_count, round(count(value) / sum(cnt)::double, 4) AS cardinality_ratio FROM vc GROUP BY 1),
r AS (SELECT column_name, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rank, value AS top_value, cnt AS top_count FROM vc WHERE value IS NOT NULL)
SELECT r.*, s.unique_count, s.cardinality_ratio FROM r JOIN s USING (column_name) WHERE rank <= 5 AND column_name <> 'priority'""")

Q["topn_values"] = lambda spark, sf: P.top_values(P.value_counts(repaired(spark, sf), CATEGORICAL), 10)
S["topn_values"] = over_repaired(VALUE_COUNTS + """
SELECT * FROM (SELECT column_name, value, cnt, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rank
  FROM vc WHERE value IS NOT NULL AND column_name <> 'priority') WHERE rank <= 10""")

Q["categorical_profile"] = lambda spark, sf: P.categorical_profile(repaired(spark, sf), CATEGORICAL)
S["categorical_profile"] = over_repaired(VALUE_COUNTS + """
, p AS (SELECT column_name, cnt / sum(cnt) OVER (PARTITION BY column_name)::double AS p FROM vc WHERE value IS NOT NULL AND column_name <> 'priority')
SELECT column_name, count(*) AS unique_count, round(-sum(p * log2(p)), 4) AS shannon_entropy, round(1 - sum(p * p), 4) AS gini_impurity FROM p GROUP BY 1""")

Q["class_imbalance"] = lambda spark, sf: P.class_imbalance(repaired(spark, sf), ["assignment_group", "priority", "cmdb_ci"])
S["class_imbalance"] = over_repaired(VALUE_COUNTS + """
, p AS (SELECT column_name, value, cnt, cnt / sum(cnt) OVER (PARTITION BY column_name)::double AS p,
     row_number() OVER (PARTITION BY column_name ORDER BY (value IS NULL)::int, cnt DESC, value) AS a,
     row_number() OVER (PARTITION BY column_name ORDER BY (value IS NULL)::int, cnt, value DESC) AS z FROM vc
     WHERE column_name IN ('assignment_group', 'priority', 'cmdb_ci')),
k AS (SELECT * FROM p WHERE value IS NOT NULL)
SELECT column_name, count(*) AS unique_classes, max(value) FILTER (a = 1) AS majority_class, round(max(p) FILTER (a = 1) * 100, 2) AS majority_percentage,
  max(value) FILTER (z = 1) AS minority_class, round(max(p) FILTER (z = 1) * 100, 2) AS minority_percentage,
  round(max(cnt) / min(cnt)::double, 2) AS imbalance_ratio, round(-sum(p * log2(p)), 4) AS shannon_entropy,
  round(-sum(p * log2(p)) / log2(count(*)), 4) AS normalized_entropy, round(1 - sum(p * p), 4) AS gini_impurity FROM k GROUP BY 1""")

NUMERIC = ["resolution_time_hours", "reassignment_count", "business_impact", "urgency", "priority"]


def _numeric_sql(cte: str, pairs) -> str:
    return cte + "\nUNION ALL ".join(f"""
SELECT '{c}' AS column_name, round(avg({x}), 4) AS mean, round(stddev({x}), 4) AS std, round(min({x})::double, 4) AS min, round(quantile_cont({x}::double, 0.25), 4) AS q25,
  round(quantile_cont({x}::double, 0.5), 4) AS median, round(quantile_cont({x}::double, 0.75), 4) AS q75, round(max({x})::double, 4) AS max,
  round(skewness({x}), 4) AS skewness, round(kurtosis({x}), 4) AS kurtosis, round(quantile_cont({x}::double, 0.75) - quantile_cont({x}::double, 0.25), 4) AS iqr,
  (SELECT count(*) FROM {t}, (SELECT quantile_cont({x}::double, 0.25) AS a, quantile_cont({x}::double, 0.75) AS b FROM {t}) q
    WHERE {x} < a - 1.5 * (b - a) OR {x} > b + 1.5 * (b - a)) AS outlier_count_iqr,
  round((SELECT count(*) FROM {t}, (SELECT quantile_cont({x}::double, 0.25) AS a, quantile_cont({x}::double, 0.75) AS b FROM {t}) q
    WHERE {x} < a - 1.5 * (b - a) OR {x} > b + 1.5 * (b - a)) * 100.0 / count({x}), 2)::double AS outlier_percentage
FROM {t}""" for c, x, t in pairs)


Q["numeric_profile"] = lambda spark, sf: P.numeric_profile(repaired(spark, sf), NUMERIC, rows=table(spark, sf, "orders").count())
S["numeric_profile"] = over_repaired(_numeric_sql("", [(c, c, "rep") for c in NUMERIC]))

Q["numeric_profile_lines"] = lambda spark, sf: P.numeric_profile(
    table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
S["numeric_profile_lines"] = _numeric_sql("", [(c, c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount")])

Q["boolean_profile"] = lambda spark, sf: P.boolean_profile(tickets(spark, sf))
S["boolean_profile"] = over_tickets("\nUNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) FILTER ({c}) AS true_count, count(*) FILTER (NOT {c}) AS false_count,
    round(count(*) FILTER ({c}) * 100.0 / count({c}), 2)::double AS true_percentage, round(count(*) FILTER (NOT {c}) * 100.0 / count({c}), 2)::double AS false_percentage
    FROM tickets""" for c in ("made_sla", "problem_flag")))


def _spans(spark, sf):
    df = repaired(spark, sf)
    spans = [P.datetime_span(df, c) for c in ("opened_at", "resolved_at", "closed_at")]
    return reduce(lambda a, b: a.unionByName(b), spans)


Q["datetime_span"] = _spans
S["datetime_span"] = over_repaired("\nUNION ALL ".join(
    f"""SELECT '{c}' AS column_name, strftime(min({c}), '%Y-%m-%d %H:%M:%S') AS min_timestamp, strftime(max({c}), '%Y-%m-%d %H:%M:%S') AS max_timestamp,
    round(date_diff('microsecond', min({c}), max({c})) / 86400e6, 2) AS span_days FROM rep""" for c in ("opened_at", "resolved_at", "closed_at")))

Q["datetime_profile"] = lambda spark, sf: P.arrival_histogram(event_tickets(spark, sf), "opened_at")
S["datetime_profile"] = """
SELECT 'hour' AS part, h.i AS slot, count(e.ts) AS tickets FROM range(24) h(i) LEFT JOIN events e ON hour(e.ts) = h.i GROUP BY 1, 2
UNION ALL SELECT 'weekday', h.i, count(e.ts) FROM range(7) h(i) LEFT JOIN events e ON isodow(e.ts) - 1 = h.i GROUP BY 1, 2"""

Q["text_profile"] = lambda spark, sf: P.text_profile(tickets(spark, sf, text=True), ["short_description", "description"])
S["text_profile"] = over_tickets("\nUNION ALL ".join(f"""
SELECT '{c}' AS column_name, round(avg(length(t)), 2) AS mean_char_length, max(length(t))::bigint AS max_char_length, round(avg(w), 2) AS mean_word_count,
  max(w)::bigint AS max_word_count, round(avg(length(t) // 4), 2) AS mean_token_estimate, max(length(t) // 4)::bigint AS max_token_estimate,
  count(*) FILTER (length(t) // 4 > 256) AS exceeds_256_tokens_count, round(count(*) FILTER (length(t) // 4 > 256) * 100.0 / count(*), 2)::double AS exceeds_256_tokens_percentage
FROM (SELECT coalesce({c}, '') AS t, {WORDS.format(f"coalesce({c}, '')")} AS w FROM tickets)""" for c in ("short_description", "description")))

Q["text_readiness"] = lambda spark, sf: P.text_readiness(tickets(spark, sf, text=True), ["short_description", "description"])
S["text_readiness"] = over_tickets("\nUNION ALL ".join(f"""
SELECT '{c}' AS column_name, min(length({c}))::double AS char_min, round(avg(length({c})), 2) AS char_avg, max(length({c}))::double AS char_max,
  round(avg(length({c}) / 4.5::double), 1) AS est_token_avg, round(max(length({c}) / 4.5::double), 1) AS est_token_max,
  round(count(*) FILTER (length({c}) / 4.5::double > 256) * 100.0 / count({c}), 2)::double AS exceeds_256_tokens_pct FROM tickets""" for c in ("short_description", "description")))

Q["text_reduction"] = lambda spark, sf: P.text_reduction(docs(spark, sf), ["description"], unicode_form=False)
S["text_reduction"] = f"""
WITH n AS (SELECT {WORDS.format('text')} AS a, {WORDS.format(norm_sql('text'))} AS b FROM documents)
SELECT 'description' AS column_name, round(avg(a), 2) AS raw_mean_words, round(avg(b), 2) AS clean_mean_words,
  round((sum(a) - sum(b)) * 100.0::double / greatest(sum(a), 1), 2) AS word_reduction_percentage, round(avg(ceil(a * 1.3::double)), 2) AS raw_mean_tokens_est,
  round(avg(ceil(b * 1.3::double)), 2) AS clean_mean_tokens_est, count(*) FILTER (ceil(a * 1.3::double) > 256) AS raw_exceeds_max_tokens,
  count(*) FILTER (ceil(b * 1.3::double) > 256) AS clean_exceeds_max_tokens,
  CASE WHEN count(*) FILTER (ceil(b * 1.3::double) > 256) = 0 THEN 'PASS_OPTIMIZED' ELSE 'WARNING_TRUNCATION_REQUIRED' END AS status FROM n"""

_PAIRS = [(a, b) for i, a in enumerate(P.CORRELATION_COLUMNS) for b in P.CORRELATION_COLUMNS[i + 1:]]
_PEARSON = "\nUNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4) AS pearson FROM rep" for a, b in _PAIRS)
Q["pearson_pairs"] = lambda spark, sf: P.pearson_pairs(repaired(spark, sf))
S["pearson_pairs"] = over_repaired(_PEARSON)
Q["pearson_top_pairs"] = lambda spark, sf: P.top_pairs(P.pearson_pairs(repaired(spark, sf)))
S["pearson_top_pairs"] = over_repaired(f"SELECT * FROM ({_PEARSON}) ORDER BY abs(pearson) DESC, column_a, column_b LIMIT 5")

_SP = ["priority", "business_impact", "urgency", "reassignment_count", "resolution_time_hours"]
Q["spearman_pairs"] = lambda spark, sf: P.spearman_pairs(repaired(spark, sf), _SP)
S["spearman_pairs"] = over_repaired(", full_rows AS (SELECT * FROM rep WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _SP) + "), rk AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _SP) + " FROM full_rows) " + "\nUNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4) AS spearman FROM rk" for i, a in enumerate(_SP) for b in _SP[i + 1:]))

Q["priority_sla_pivot"] = lambda spark, sf: P.priority_sla_pivot(repaired(spark, sf))
S["priority_sla_pivot"] = over_repaired("SELECT priority, count(*) FILTER (NOT made_sla) AS breached, count(*) FILTER (made_sla) AS met FROM rep GROUP BY 1")

Q["category_top10"] = lambda spark, sf: P.counts_by(tickets(spark, sf), "assignment_group", 10)
S["category_top10"] = over_tickets("SELECT assignment_group, count(*) AS tickets FROM tickets GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")

Q["hourly_arrivals"] = lambda spark, sf: P.counts_by(
    event_tickets(spark, sf).select(F.hour("opened_at").cast("bigint").alias("opened_hour")), "opened_hour")
S["hourly_arrivals"] = "SELECT hour(ts) AS opened_hour, count(*) AS tickets FROM events GROUP BY 1"

Q["wordcount_histogram"] = lambda spark, sf: P.histogram(docs(spark, sf), word_count(F.col("description")))
S["wordcount_histogram"] = f"""
WITH w AS (SELECT {WORDS.format('text')}::double AS v FROM documents), e AS (SELECT min(v) AS lo, max(v) AS hi FROM w)
SELECT least(floor((v - lo) / ((hi - lo) / 30)), 29)::bigint AS bin, round(lo + least(floor((v - lo) / ((hi - lo) / 30)), 29) * ((hi - lo) / 30), 4) AS bin_start,
  count(*) AS tickets FROM w, e GROUP BY 1, 2"""

Q["distribution_summary"] = lambda spark, sf: P.distribution_summary(repaired(spark, sf))
S["distribution_summary"] = over_repaired("""
SELECT 'category' AS measure, category AS item, count(*)::double AS amount FROM rep GROUP BY 2
UNION ALL SELECT 'assignment_group', assignment_group, count(*)::double FROM rep GROUP BY 2
UNION ALL SELECT 'priority', cast(priority AS varchar), count(*)::double FROM rep GROUP BY 2
UNION ALL SELECT 'sla_compliance_rate_pct', 'all', round(avg(made_sla::int) * 100, 2) FROM rep
UNION ALL SELECT 'avg_resolution_time_hours', 'all', round(avg(resolution_time_hours), 2) FROM rep""")

_ADV = ["priority_raw", "category", "subcategory", "assignment_group", "business_service", "cmdb_ci", "caller"]
_KEEP = [c for c in COLUMNS if c not in ("resolved_at", "closed_at", "made_sla", "reassignment_count")]
Q["prep_recommendations"] = lambda spark, sf: P.preparation_advice(tickets(spark, sf, text=True))
S["prep_recommendations"] = over_tickets(", u AS (" + "\nUNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) AS u FROM tickets" for c in _ADV) + "), g AS (" +
    "\nUNION ALL ".join(f"SELECT '{c}' AS c, count(*) FILTER ({c} IS NULL) * 100.0 / count(*) AS p FROM tickets" for c in _KEEP) + """)
SELECT c AS column_name, CASE WHEN u > 100 AND c <> 'caller' THEN 'frequency_or_target_encode' ELSE 'label_encode' END AS action FROM u WHERE (u > 100 AND c <> 'caller') OR u <= 20
UNION ALL SELECT c, 'impute_unknown' FROM g WHERE p > 5
UNION ALL SELECT unnest(['resolved_at', 'closed_at', 'made_sla', 'reassignment_count']), 'drop_leaky'
UNION ALL SELECT 'assignment_group', 'rebalance_classes' FROM (SELECT count(*) AS k FROM tickets GROUP BY assignment_group) HAVING max(k) / min(k)::double > 5
UNION ALL SELECT 'description', 'shorten_text' FROM tickets HAVING count(*) FILTER (length(description) / 4.5 > 256) > 0""")


def _trend(spark, sf):
    df = repaired(spark, sf)
    return reduce(lambda a, b: a.unionByName(b), [P.sla_trend(df, u) for u in ("day", "week", "month")])


Q["sla_trend"] = _trend
S["sla_trend"] = over_repaired("\nUNION ALL ".join(f"""
SELECT '{u}' AS unit, strftime(date_trunc('{u}', opened_at), '%Y-%m-%d') AS period, count(*) AS tickets, round(avg(made_sla::int) * 100, 2) AS sla_pct,
  round(avg(resolution_time_hours), 2) AS mean_hours FROM rep GROUP BY 2""" for u in ("day", "week", "month")))
