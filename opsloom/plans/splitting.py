"""Registered queries: splits, encoders, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import encode as N, split as X
from opsloom.plans.base import event_tickets, over_repaired, over_tickets, repaired
from opsloom.session import work_path
from opsloom.sources.snapshots import history, save_version
from opsloom.sources.tables import table, tickets

Q, S = {}, {}

HASH = "md5(concat({0}, '42'))"
RANDOM = """CASE WHEN ('0x' || substr(md5(concat(number, '42')), 1, 8))::bigint < 3006477107 THEN 'train'
  WHEN ('0x' || substr(md5(concat(number, '42')), 1, 8))::bigint < 3650722202 THEN 'val' ELSE 'test' END"""

Q["split_random"] = lambda spark, sf: X.random_split(tickets(spark, sf)).select("number", "split")
S["split_random"] = over_tickets(f"SELECT number, {RANDOM} AS split FROM tickets")

BY_RANK = "CASE WHEN rn <= floor(n * 0.70::double) THEN 'train' WHEN rn <= floor(n * 0.70::double) + floor(n * 0.15::double) THEN 'val' ELSE 'test' END AS split"
Q["split_stratified"] = lambda spark, sf: X.stratified_split(tickets(spark, sf), "assignment_group").select("number", "assignment_group", "split")
S["split_stratified"] = over_tickets(f"""
, r AS (SELECT number, assignment_group, row_number() OVER (PARTITION BY assignment_group ORDER BY {HASH.format('number')}) AS rn,
  count(*) OVER (PARTITION BY assignment_group) AS n FROM tickets) SELECT number, assignment_group, {BY_RANK} FROM r""")

Q["split_time_based"] = lambda spark, sf: X.time_split(tickets(spark, sf)).select("number", "split")
S["split_time_based"] = over_tickets(f"""
, r AS (SELECT number, row_number() OVER (ORDER BY opened_at, {HASH.format('number')}) AS rn, count(*) OVER () AS n FROM tickets)
SELECT number, {BY_RANK} FROM r""")

Q["split_events_by_time"] = lambda spark, sf: X.time_split(event_tickets(spark, sf)).select("number", "split")
S["split_events_by_time"] = f"""
WITH r AS (SELECT event_id AS number, row_number() OVER (ORDER BY ts, {HASH.format('cast(event_id AS varchar)')}) AS rn, count(*) OVER () AS n FROM events)
SELECT number, {BY_RANK} FROM r"""

Q["rare_class_grouping"] = lambda spark, sf: X.group_rare_classes(
    table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("team")), "team", "o_orderkey", least=8)
S["rare_class_grouping"] = """
SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey) < 8 THEN 'Rare / Other' ELSE cast(o_custkey AS varchar) END AS team FROM orders"""

Q["split_leakage_check"] = lambda spark, sf: X.leakage_check(
    X.random_split(table(spark, sf, "orders").withColumnRenamed("o_orderkey", "number")).withColumn("number", F.col("o_custkey")))
S["split_leakage_check"] = f"""
WITH s AS (SELECT o_custkey AS k, {RANDOM} AS split FROM (SELECT o_custkey, cast(o_orderkey AS varchar) AS number FROM orders)),
o AS (SELECT (SELECT count(*) FROM (SELECT k FROM s WHERE split = 'train' INTERSECT SELECT k FROM s WHERE split = 'val')) AS train_val_overlap,
  (SELECT count(*) FROM (SELECT k FROM s WHERE split = 'train' INTERSECT SELECT k FROM s WHERE split = 'test')) AS train_test_overlap,
  (SELECT count(*) FROM (SELECT k FROM s WHERE split = 'val' INTERSECT SELECT k FROM s WHERE split = 'test')) AS val_test_overlap)
SELECT *, CASE WHEN train_val_overlap + train_test_overlap + val_test_overlap = 0 THEN 'PASS_ZERO_LEAKAGE' ELSE 'FAIL_LEAKAGE_DETECTED' END AS status FROM o"""

Q["split_class_balance"] = lambda spark, sf: X.class_balance(X.random_split(tickets(spark, sf)), "assignment_group")
S["split_class_balance"] = over_tickets(f"""
, s AS (SELECT assignment_group AS class, {RANDOM} AS split FROM tickets), t AS (SELECT split, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT class, round(count(*) FILTER (split = 'train') * 100.0 / (SELECT n FROM t WHERE split = 'train'), 2)::double AS train_pct,
  round(count(*) FILTER (split = 'val') * 100.0 / (SELECT n FROM t WHERE split = 'val'), 2)::double AS val_pct,
  round(count(*) FILTER (split = 'test') * 100.0 / (SELECT n FROM t WHERE split = 'test'), 2)::double AS test_pct FROM s GROUP BY 1)
SELECT *, CASE WHEN greatest(abs(train_pct - val_pct), abs(train_pct - test_pct)) < 5 THEN 'BALANCED' ELSE 'SKEWED_MONITOR' END AS balance FROM p""")

Q["frequency_encode"] = lambda spark, sf: N.frequency_encode(tickets(spark, sf)).select(
    "number", "assignment_group_freq", "business_service_freq", "caller_freq")
S["frequency_encode"] = over_tickets("""
SELECT number, round(count(*) OVER (PARTITION BY assignment_group) / (count(*) OVER ())::double, 4) AS assignment_group_freq,
  round(count(*) OVER (PARTITION BY business_service) / (count(*) OVER ())::double, 4) AS business_service_freq,
  round(count(*) OVER (PARTITION BY caller) / (count(*) OVER ())::double, 4) AS caller_freq FROM tickets""")


def _apply_freq(spark, sf):
    df = X.random_split(tickets(spark, sf))
    fitted = N.fit_frequency(df.filter("split = 'train'"), ["cmdb_ci", "caller"])
    out = N.apply_frequency(df.select("number", "cmdb_ci", "caller"), fitted)
    return out.select("number", F.round("cmdb_ci", 6).alias("cmdb_ci"), F.round("caller", 6).alias("caller"))


Q["frequency_encode_apply"] = _apply_freq
S["frequency_encode_apply"] = over_tickets(f"""
, s AS (SELECT number, coalesce(cmdb_ci, 'UNKNOWN') AS cmdb_ci, coalesce(caller, 'UNKNOWN') AS caller, {RANDOM} AS split FROM tickets),
n AS (SELECT count(*)::double AS n FROM s WHERE split = 'train'),
a AS (SELECT cmdb_ci, count(*) / (SELECT n FROM n) AS f FROM s WHERE split = 'train' GROUP BY 1),
b AS (SELECT caller, count(*) / (SELECT n FROM n) AS f FROM s WHERE split = 'train' GROUP BY 1)
SELECT number, round(coalesce(a.f, 0.0001), 6) AS cmdb_ci, round(coalesce(b.f, 0.0001), 6) AS caller FROM s LEFT JOIN a USING (cmdb_ci) LEFT JOIN b USING (caller)""")


def _target(spark, sf):
    df = X.random_split(repaired(spark, sf))
    out = N.target_encode(df, df.filter("split = 'train'"), ["caller", "subcategory"], F.col("resolution_time_hours"))
    return out.select("number", F.round("caller", 4).alias("caller"), F.round("subcategory", 4).alias("subcategory"))


Q["target_encode"] = _target
S["target_encode"] = over_repaired(f"""
, s AS (SELECT number, coalesce(caller, 'UNKNOWN') AS caller, subcategory, resolution_time_hours AS y, {RANDOM} AS split FROM rep),
g AS (SELECT avg(y) AS m FROM s WHERE split = 'train'),
a AS (SELECT caller, (sum(y) + 10 * (SELECT m FROM g)) / (count(*) + 10) AS v FROM s WHERE split = 'train' GROUP BY 1),
b AS (SELECT subcategory, (sum(y) + 10 * (SELECT m FROM g)) / (count(*) + 10) AS v FROM s WHERE split = 'train' GROUP BY 1)
SELECT number, round(coalesce(a.v, (SELECT m FROM g)), 4) AS caller, round(coalesce(b.v, (SELECT m FROM g)), 4) AS subcategory
FROM s LEFT JOIN a USING (caller) LEFT JOIN b USING (subcategory)""")


def _oof(spark, sf):
    df = repaired(spark, sf).withColumn("fold", F.conv(F.substring(X.row_hash(), 1, 8), 16, 10).cast("bigint") % 3)
    out = N.target_encode_out_of_fold(df, "caller", F.col("resolution_time_hours"), F.col("fold"))
    return out.select("number", F.round("caller_te", 4).alias("caller_te"))


Q["target_encode_folds"] = _oof
S["target_encode_folds"] = over_repaired("""
, s AS (SELECT number, caller, resolution_time_hours AS y, ('0x' || substr(md5(concat(number, '42')), 1, 8))::bigint % 3 AS fold FROM rep),
f AS (SELECT fold, (SELECT avg(y) FROM s x WHERE x.fold <> k.fold) AS m FROM (SELECT DISTINCT fold FROM s) k),
c AS (SELECT s.caller, f.fold, f.m, sum(s.y) FILTER (s.fold <> f.fold) AS sy, count(*) FILTER (s.fold <> f.fold) AS n FROM s, f GROUP BY ALL)
SELECT number, round((coalesce(sy, 0) + 10 * m) / (n + 10), 4) AS caller_te FROM s JOIN c USING (caller, fold)""")


def _classes(spark, sf):
    """Shares of the assignment group, from the train tickets for all others and from earlier tickets for these; each ticket's own class and the sum are shown."""
    df = X.random_split(repaired(spark, sf)).withColumn("order", F.conv(F.substring(X.row_hash(), 1, 8), 16, 10).cast("bigint"))
    train, rest = df.filter("split = 'train'"), df.filter("split <> 'train'")
    classes, fitted = N.class_shares(train, "caller", "assignment_group")
    encoded = N.target_encode_classes(rest, fitted, "caller")
    _, ordered = N.target_encode_classes_ordered(train, "caller", "assignment_group", F.col("order"))
    own = F.get("caller_te", F.array_position(F.array(*[F.lit(k) for k in classes]), F.col("assignment_group")).cast("int") - 1)
    total = F.aggregate("caller_te", F.lit(0.0), lambda a, x: a + x)
    show = lambda d: d.select("number", "split", F.round(own, 4).alias("own_share"), F.round(total, 4).alias("total"))
    return show(encoded).unionByName(show(ordered))


Q["target_encode_classes"] = _classes
S["target_encode_classes"] = over_repaired(f"""
, s AS (SELECT number, caller AS c, assignment_group AS k, {RANDOM} AS split, ('0x' || substr(md5(concat(number, '42')), 1, 8))::bigint AS h FROM rep),
t AS (SELECT *, floor(h * {N.ORDER_BUCKETS} / 4294967296.0)::int AS b FROM s WHERE split = 'train'),
g AS (SELECT k, count(*) / (SELECT count(*) FROM t) AS p FROM t GROUP BY 1),
ck AS (SELECT c, k, count(*) AS n FROM t GROUP BY ALL), cn AS (SELECT c, count(*) AS n FROM t GROUP BY ALL),
o AS (SELECT number, split, (SELECT count(DISTINCT k) FROM t) AS classes,
  count(*) OVER (PARTITION BY c, k ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_ck,
  count(*) OVER (PARTITION BY c ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_c,
  count(*) OVER (PARTITION BY k ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_k,
  count(*) OVER (ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM t)
SELECT number, split, round((n_ck + 10 * CASE WHEN n > 0 THEN n_k / n::double ELSE 1 / classes::double END) / (n_c + 10), 4) AS own_share, 1.0::double AS total FROM o
UNION ALL
SELECT number, split, round(CASE WHEN cn.n IS NULL THEN g.p ELSE (coalesce(ck.n, 0) + 10 * g.p) / (cn.n + 10) END, 4), CASE WHEN g.p IS NULL THEN NULL ELSE 1.0::double END
FROM s LEFT JOIN g USING (k) LEFT JOIN ck ON ck.c = s.c AND ck.k = s.k LEFT JOIN cn ON cn.c = s.c WHERE split <> 'train'""")


def _snapshot(spark, sf):
    base = work_path(spark, "versions")
    df = tickets(spark, sf, text=True)
    save_version(df, base, seed=42)
    save_version(df.filter("made_sla"), base, seed=7)
    save_version(df.drop("description"), base, seed=7, file_format="csv")
    return history(spark, base).drop("written_at")


Q["snapshot_manifest"] = _snapshot
S["snapshot_manifest"] = over_tickets("""
SELECT 1::bigint AS version, count(*) AS rows, 19::bigint AS columns, 42::bigint AS seed, 'parquet' AS file_format FROM tickets
UNION ALL SELECT 2, count(*), 19, 7, 'parquet' FROM tickets WHERE made_sla
UNION ALL SELECT 3, count(*), 18, 7, 'csv' FROM tickets""")
