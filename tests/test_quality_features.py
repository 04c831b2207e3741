import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsloom.operators import features as E, leakage as L, quality as R, text as T
from opsloom.schema import POLICY, columns_in_tier, label_of, predictors

AT = lambda s: dt.datetime.fromisoformat(s)
DDL = ("number string, opened_at timestamp_ntz, resolved_at timestamp_ntz, closed_at timestamp_ntz, priority int, category string, "
       "assignment_group string, short_description string, description string, made_sla boolean, sla_status string, "
       "resolution_time_hours double, cmdb_ci string, business_service string")


def valid(i):
    return (f"INC{i:05d}", AT("2026-01-01T10:00"), AT("2026-01-01T12:00"), AT("2026-01-01T13:00"), 2, "Network", "Ops", "t", "d", True, "Met", 2.0, "ci-1", "Core")


def report(df):
    return {r["rule_id"]: r for r in R.rule_report(df).collect()}


def test_valid_table_passes(rows):
    out = report(rows([valid(i) for i in range(100)], DDL))
    assert len(out) == 12 and all(r["passed"] for r in out.values())


def test_corrupted_table_fails(rows):
    bad = [
        ("INC1", AT("2026-01-01T10:00"), AT("2026-01-01T08:00"), AT("2026-01-01T07:00"), 99, "", "Ops", "t", None, True, "Met", -5.0, "UNKNOWN", "Core"),
        ("INC1", AT("2026-01-01T10:00"), AT("2026-01-02T10:00"), AT("2026-01-03T10:00"), 1, "Net", " ", "t", "d", True, "Met", 24.0, "ci", "Core"),
        ("INC2", AT("2026-01-01T10:00"), AT("2026-01-01T11:00"), AT("2026-01-03T10:00"), 1, "Net", "g", "", "d", False, "Breached", 1.0, "ci", None),
    ]
    out = report(rows(bad, DDL))
    assert {k: r["error_count"] for k, r in out.items()} == {
        "CHK-01": 1, "CHK-02": 2, "CHK-03": 2, "CHK-04": 1, "CHK-05": 1, "CHK-06": 1, "CHK-07": 2, "CHK-08": 2,
        "CHK-09": 1, "CHK-10": 1, "CHK-11": 1, "CHK-12": 1,
    }
    assert out["CHK-01"]["error_percentage"] == pytest.approx(4.7619)


def test_priority_domain_uses_first_character(rows):
    df = rows([("9 - x",), ("1 - High",), (None,)], "priority string")
    assert report(df)["CHK-06"]["error_count"] == 1


def test_missing_column_reports_every_row(rows):
    out = report(rows([("a",), ("b",)], "number string"))
    assert out["CHK-04"]["error_count"] == 2 and out["CHK-01"]["error_percentage"] == 100.0 and out["CHK-03"]["passed"]


def test_empty_table(rows):
    out = report(rows([], DDL))
    assert all(r["error_percentage"] == 0.0 for r in out.values())


def test_samples_are_limited(rows):
    bad = [valid(i)[:5] + (None,) + valid(i)[6:] for i in range(10)] + [valid(3)]
    got = [r for r in R.rule_samples(rows(bad, DDL)).collect()]
    assert [r["number"] for r in sorted(got, key=lambda r: r["sample_no"]) if r["rule_id"] == "CHK-04"] == ["INC00000", "INC00001", "INC00002"]
    assert [r["number"] for r in got if r["rule_id"] == "CHK-02"] == ["INC00003"]


def test_schema_gate(rows):
    out = R.schema_gate(rows([("a",)], "number string")).collect()
    assert len(out) == 37 and sum(r["present"] for r in out) == 1 and all(r["has_rows"] for r in out)


def test_leakage_rules():
    assert len(POLICY) == 36 and len(columns_in_tier("blocked")) == 7 and len(columns_in_tier("warning")) == 2
    assert len(predictors()) == 22
    with pytest.raises(ValueError):
        L.assert_predictors(["priority", "close_notes"])
    found = L.violations(["number", "close_notes", "resolution_time_hours"])
    assert found["blocked_present"] == ["close_notes"] and "category" in found["missing_required"]
    assert not any(L.violations(["close_notes"], "post_resolution_analytics").values())


def test_labels():
    assert label_of("category_Hardware") == "Category = Hardware" and label_of("priority") == "Priority"
    assert label_of("some_new") == "Some New"


def test_date_features(rows):
    df = rows([(AT("2026-01-05T08:30"),), (AT("2026-07-04T18:59"),), (AT("2026-12-25T19:00"),), (None,)], "opened_at timestamp_ntz")
    a, b, c, d = E.calendar_flags(E.cyclic(E.date_parts(df))).collect()
    assert (a["opened_at_hour"], a["opened_at_dayofweek"], a["is_business_hours"], a["is_holiday"]) == (8, 0, 1, 0)
    assert (b["is_weekend"], b["is_holiday"], b["is_business_hours"]) == (1, 1, 0)
    assert (c["is_holiday"], c["is_business_hours"]) == (1, 0)
    assert (d["opened_at_hour"], d["opened_at_dayofweek"], d["opened_at_month"], d["is_holiday"]) == (12, 0, 1, 0)
    assert a["opened_at_hour_sin"] == pytest.approx(0.8660254)


def test_hours_and_flags(rows):
    df = rows([(AT("2026-01-01T10:00"), AT("2026-01-01T12:00"), "D1", "", True), (AT("2026-01-01T10:00"), AT("2026-01-01T09:00"), None, "P", None),
               (AT("2026-01-01T10:00"), None, "", None, False)],
              "opened_at timestamp_ntz, resolved_at timestamp_ntz, duplicate_incident string, parent_incident string, problem_flag boolean")
    out = E.linkage_flags(E.resolution_hours(df)).collect()
    assert [r["resolution_time_hours"] for r in out] == [2.0, 0.0, 0.0]
    assert [(r["is_duplicate"], r["has_parent_incident"], r["has_problem_id"]) for r in out] == [(1, 0, 1), (0, 1, 0), (0, 0, 0)]


def test_log_target_round_trip(rows):
    df = rows([(0.0,), (100.0,), (500.0,), (None,)], "h double").select(E.from_log_target(E.log_target(F.col("h"))))
    assert [r[0] for r in df.collect()] == pytest.approx([0.0, 100.0, 168.0, 4.0])


def test_enrich_is_optional(rows):
    df = rows([("A", 1)], "category string, owner int")
    assert E.enrich(df, None, "category") is df
    out = E.enrich(df, rows([("A", 9), ("A", 8)], "category string, owner int"), "category")
    assert out.count() == 2 and "owner_side" in out.columns


CASES = [
    ("<b>Server</b> DOWN please check the Routers!", "server down check router"),
    ("From: a@b.c\nSubject: hi\nDatabase errors running", "database error run"),
    ("[System Error Code: 0x1F] login/failed", "system_error login/failed"),
    ("the and of", "not provided"),
    (None, "not provided"),
    ("Unknown", "unknown"),
    ("ＳＳＬ café", "ssl café"),
    ("disconnected vpn", "disconnect vpn"),
]


@pytest.mark.parametrize("raw,want", CASES)
def test_normalize(rows, raw, want):
    assert rows([(raw,)], "t string").select(T.normalize(F.col("t"))).first()[0] == want


def test_text_counts(rows):
    df = rows([("one two  three\tfour five",), (None,), ("",)], "description string")
    out = T.text_stats(df).collect()
    assert [(r["description_word_count"], r["description_char_count"]) for r in out] == [(5, 24), (0, 0), (0, 0)]


def test_semantic_text(rows):
    df = rows([("VPN down", "vpn down again"), ("VPN down", "VPN down"), ("VPN", "other"), (None, "nan")], "short_description string, description string")
    got = [r[0].split("] ")[-1] for r in df.select(T.semantic_text(df)).collect()]
    assert got == ["vpn down again", "VPN down", "VPN. other", "No short description. No detailed description"]


def test_combined_text(rows):
    df = rows([(None, None), ("A", "B c")], "short_description string, description string")
    assert [r[0] for r in df.select(T.combined_text(df)).collect()] == ["missingtext safetoken", "a b c safetoken"]
