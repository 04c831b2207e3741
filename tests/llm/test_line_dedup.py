from opsloom.llm import line_dedup as M
from tests.llm.helpers import LOWER, SCHEMA, check_sql, documents, empty, odd_rows, same_rows

WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    key = lambda x: x.strip(WHITE).translate(LOWER)
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def test_sql(spark):
    check_sql(spark, M, "op5_line_dedup")


def test_odd_texts_and_other_columns(spark):
    want = brute(odd_rows(documents(spark)))
    assert same_rows(want, M.line_dedup(documents(spark)).collect())
    assert same_rows(want, M.line_dedup(documents(spark, clash=True)).collect())
    assert M.line_dedup(empty(spark)).count() == 0


def test_positions(spark):
    shared = "a line that two documents share"
    texts = [shared, f"{shared}\nb\n{shared}", f"top\n  {shared.upper()} \n\nlast\n{shared}", f"x\n{shared}"]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(2, "another text of the same id", "en", "s", 1)], SCHEMA)
    assert same_rows(brute(odd_rows(df)), M.line_dedup(df).collect())
