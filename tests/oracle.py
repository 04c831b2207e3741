"""Run a registered query on Spark and its SQL on DuckDB, and compare the two row multisets."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

from opsloom.sources.tables import TABLES


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark_df, con, sql: str) -> dict:
    names = sorted(spark_df.columns)
    got = [tuple(_cell(r[c]) for c in names) for r in spark_df.collect()]
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    raw = rel.fetchall()
    if sorted(cols) != names:
        return {"ok": False, "why": f"columns {names} vs {sorted(cols)}"}
    order = [cols.index(c) for c in names]
    want = [tuple(_cell(r[i]) for i in order) for r in raw]
    a, b = Counter(got), Counter(want)
    loose = [c for c in names if type_family(dict(spark_df.dtypes)[c]) != type_family(types[c])]
    if a == b and not loose:
        return {"ok": True, "rows": len(got)}
    return {
        "ok": False, "rows": (len(got), len(want)), "columns": names, "types": loose,
        "only_spark": list((a - b).items())[:3], "only_sql": list((b - a).items())[:3],
    }


def type_family(t: str) -> str:
    t = t.lower()
    for fam, keys in {
        "bigint": ["bigint"], "int": ["int", "integer"], "double": ["double", "number"], "string": ["string", "varchar"],
        "bool": ["bool"], "ts": ["timestamp"],
    }.items():
        if any(t.startswith(k) for k in keys):
            return fam
    return t
