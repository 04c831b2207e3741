import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsloom.operators import clean as C
from opsloom.functions.ordinals import ORDINAL_RULES, apply_rule, parse_ordinal
from opsloom.sources import files

T = lambda s: dt.datetime.fromisoformat(s)

DIRTY = [
    ("INC001", T("2026-01-01T10:00"), T("2026-01-01T12:00"), T("2026-01-02T12:00"), "Mail down", "text", "Network", "Net Ops", 0, 1, 0, True),
    ("INC001", T("2026-01-01T11:00"), T("2026-01-01T12:00"), T("2026-01-02T12:00"), "Mail down", "text", "Network", "Net Ops", 2, 1, 0, True),
    ("INC002", T("2026-01-02T10:00"), T("2026-01-02T08:00"), T("2026-01-02T09:00"), None, None, "  ", None, 2, 50, 25, False),
    ("INC003", T("2026-01-03T10:00"), T("2026-01-03T11:00"), T("2026-01-03T10:30"), "Disk", "  padded ", "Custom", "DB", 6, 2, 1, True),
    ("INC004", T("2026-01-04T10:00"), None, None, "Cpu", "cpu", "Hardware", "DC", None, None, None, None),
]
DDL = ("number string, opened_at timestamp_ntz, resolved_at timestamp_ntz, closed_at timestamp_ntz, short_description string, "
       "description string, category string, assignment_group string, priority int, reassignment_count int, reopen_count int, made_sla boolean")


def test_clean_all_steps(rows):
    out = {r["number"]: r for r in C.clean(rows(DIRTY, DDL)).collect()}
    assert len(out) == 4
    assert all(1 <= r["priority"] <= 5 for r in out.values())
    assert all(r["reassignment_count"] <= 15 and r["reopen_count"] <= 8 for r in out.values())
    assert all(r["resolved_at"] is None or r["resolved_at"] >= r["opened_at"] for r in out.values())
    assert out["INC002"]["resolved_at"] == T("2026-01-02T14:00") and out["INC002"]["closed_at"] == T("2026-01-03T14:00")
    assert out["INC001"]["priority"] == 2 and out["INC003"]["category"] == "Custom"
    assert out["INC002"]["category"] == "Unknown" and out["INC002"]["assignment_group"] == "Unknown"
    assert out["INC002"]["description"] == "Not Provided" and out["INC003"]["description"] == "padded"
    assert out["INC004"]["resolved_at"] is None


def test_allow_custom_keeps_blanks(rows):
    out = C.clean(rows(DIRTY, DDL), allow_custom=True).filter("number = 'INC002'").first()
    assert out["category"] == ""


def test_strict_mode_drops(rows):
    assert C.repair_timestamps(rows(DIRTY, DDL), strict=True).count() == 3


@pytest.mark.parametrize("text,want", [
    ("1 - Critical", 1), ("High", 2), ("5-LOW", 4), ("1-URGENT", 1), ("4-NOT SPECIFIED", 4), ("9", 9), (None, 3), ("??", 3), ("low high", 4),
    ("planning low", 5), ("  2 - x", 2),
])
def test_ordinal_parser(rows, text, want):
    words, default, *_ = ORDINAL_RULES["priority"]
    assert rows([(text,)], "t string").select(parse_ordinal(F.col("t"), words, default)).first()[0] == want


def test_ordinal_clip(rows):
    got = rows([("9",), ("0",), ("sev 1",)], "t string").select(apply_rule("urgency", F.col("t"))).collect()
    assert [r[0] for r in got] == [3, 1, 1]


def test_coercion(rows):
    df = rows([("x", "True", "1.5", "2026-01-01"), ("7", "0", "y", "never")], "state string, made_sla string, calendar_stc string, opened_at string")
    out = C.coerce_types(df).collect()
    assert [r["state"] for r in out] == [0, 7] and [r["made_sla"] for r in out] == [True, False]
    assert [r["calendar_stc"] for r in out] == [1.5, None] and out[1]["opened_at"] is None


def test_keep_latest_null_time_and_null_key(rows):
    df = rows([("a", T("2026-01-02T00:00"), 1), ("a", None, 2), (None, T("2026-01-01T00:00"), 3), (None, T("2026-01-03T00:00"), 4)],
              "number string, opened_at timestamp_ntz, v int")
    assert {(r["number"], r["v"]) for r in C.keep_latest(df).collect()} == {("a", 2), (None, 4)}


def test_hot_key_dedup(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("number"), F.col("id").alias("v"))
    out = C.keep_latest(df.withColumn("opened_at", F.lit(None).cast("timestamp_ntz")))
    assert out.count() == 20_001 and out.filter("number = 'hot'").first()["v"] == 29_997


def test_impute_rules(rows):
    df = rows([(1.0, 5, None), (2.0, 5, "a"), (None, None, "b"), (10.0, 4, "b")], "m double, k int, s string")
    out = C.impute(df, {"m": "median", "k": "mode", "s": "unknown"}).orderBy("m").collect()
    assert sorted(r["m"] for r in out) == [1.0, 2.0, 2.0, 10.0]
    assert sorted(r["k"] for r in out) == [4, 5, 5, 5] and {r["s"] for r in out} == {"Unknown", "a", "b"}


def test_required_columns(rows):
    with pytest.raises(ValueError):
        C.require_columns(rows([("a",)], "number string"))


@pytest.mark.parametrize("codec,want", [("utf-8", "utf-8"), ("utf-8-sig", "utf-8"), ("cp1252", "cp1252")])
def test_csv_encodings(spark, tmp_path, codec, want):
    text = "number,description\nINC1,café “quoted”\nINC2,\"line\nbreak, comma\"\n"
    (tmp_path / "t.csv").write_bytes(text.encode(codec))
    schema = "number string, description string"
    path = str(tmp_path / "t.csv")
    assert files.detect_encoding(spark, path) == want
    from pyspark.sql.types import _parse_datatype_string
    out = {r["number"]: r["description"] for r in files.read_csv(spark, path, _parse_datatype_string(schema)).collect()}
    assert out == {"INC1": "café “quoted”", "INC2": "line\nbreak, comma"}


def test_csv_latin1(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b"number,description\nA,x\x81\xe9\n")
    assert files.detect_encoding(spark, str(tmp_path / "t.csv")) == "latin-1"


def test_json_array_and_object(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"number": "A"}, {"number": "B"}]')
    (tmp_path / "b.json").write_text('{"number": "C"}')
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType([StructField("number", StringType())])
    got = {r["number"] for n in ("a", "b") for r in files.read_json(spark, str(tmp_path / f"{n}.json"), schema, multi_line=True).collect()}
    assert got == {"A", "B", "C"}


def test_ledger_counts_clips_types_and_trims(rows):
    df = rows([("INC1", "9 - other", "0", "5", "2026-01-01 10:00:00", "g "), ("INC2", "2 - High", None, "low", "bad", None)],
              "number string, priority string, business_impact string, urgency string, opened_at string, assignment_group string")
    df = df.withColumns({"category": F.lit("a"), "resolved_at": F.lit(None).cast("timestamp_ntz"), "closed_at": F.lit(None).cast("timestamp_ntz"), "opened_at": F.expr("try_cast(opened_at AS timestamp_ntz)")})
    found = {(r["step"], r["affected_column"]): r["records_modified"] for r in C.cleaning_ledger(df.withColumn("made_sla", F.lit("1")), ()).collect()}
    assert found["Business Rule Enforcement", "priority"] == 1 and found["Business Rule Enforcement", "business_impact"] == 1
    assert found["Business Rule Enforcement", "urgency"] == 1
    assert found["String Normalization", "ALL_STRINGS"] == 2 and found["Data Type Enforcement", "made_sla"] == 2
