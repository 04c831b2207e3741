"""Properties of the physical plans that matter at scale."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from opsloom.operators import profile as P, quality as R, split as X
from opsloom.plans import registry
from opsloom.plans.base import repaired
from opsloom.sources.tables import table, tickets

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry()


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n not in ("scan_csv", "scan_json", "snapshot_manifest")))
def test_no_pairwise_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_columns_are_pruned_and_filters_pushed(spark):
    text = plan(table(spark, SF, "lineitem").filter(F.col("l_quantity") > 45).select("l_orderkey"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text and "GreaterThan(l_quantity,45.0)" in text
    assert "text" not in plan(tickets(spark, SF)).split("ReadSchema")[0] and "documents" not in plan(tickets(spark, SF))


def test_row_rules_are_one_scan(spark):
    text = plan(R.rule_report(repaired(spark, SF, text=True), ["CHK-01", "CHK-03", "CHK-09", "CHK-11"]))
    assert text.count("lineitem.parquet") == 1


def test_top_n_is_trimmed_before_the_shuffle(spark):
    text = plan(P.top_values(P.value_counts(tickets(spark, SF), ["caller", "category"]), 5))
    assert "WindowGroupLimit" in text
    assert "WindowGroupLimit" in plan(R.rule_samples(repaired(spark, SF, text=True)))


def test_row_local_work_has_no_shuffle(spark):
    events = table(spark, SF, "events").select(F.col("event_id").alias("number"), F.col("ts").alias("opened_at"))
    assert "Exchange" not in plan(X.random_split(events)) and "Exchange" not in plan(X.time_split(events))


def test_dedup_is_combined_before_the_shuffle(spark):
    from opsloom.operators.clean import keep_latest

    text = plan(keep_latest(table(spark, SF, "orders").withColumnsRenamed({"o_custkey": "number", "o_orderdate": "opened_at"})))
    assert "partial_max" in text and "Window" not in text
