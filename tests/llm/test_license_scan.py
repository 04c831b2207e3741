import re

from opsloom.llm import license_scan as M
from tests.llm.helpers import LOWER, SCHEMA, SMALL, check_sql, documents, empty, odd_rows, same_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows):
    out = []
    for i, t in rows:
        text = (t or "").translate(LOWER)
        w = WORD.findall(text)
        at = [(k, label) for p, label in M.PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        found = []
        for label, s in M.TEMPLATES:
            own, width = set(s.split()), len(s.split())
            found += [(label, len(own.intersection(w[k:k + width])) / len(own)) for k in range(len(w)) if w[k] in own]
        found = [(label, c) for label, c in found if c >= M.THRESHOLD - 1e-9]
        base = {label for _, label in at}
        places = [k for k, _ in at]
        out.append((i, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | {x for x, _ in found})), 1.0 if at else max([c for _, c in found], default=0.0)))
    return out


def test_sql(spark):
    check_sql(spark, M, "op7_license_scan")


def test_odd_texts_and_thresholds(spark):
    notice = M.TEMPLATES[2][1].split()
    extra = [" ".join(notice[:k]).upper() + ", tail" for k in range(10, len(notice) + 1)] + [
        "Under the MIT license under-the/mit.LICENSE under the mit", "cc by nc cc BY nc\nLicensed under CC BY-NC 4.0.", "apache license version 2.0", " ".join(reversed(notice))]
    df = documents(spark).union(spark.createDataFrame([(500 + i, t, "en", "s", 1) for i, t in enumerate(extra)], SCHEMA))
    want = brute(odd_rows(df))
    assert same_rows(want, M.license_scan(df).collect()) and {w[6] for w in want} >= {"bsd", "mit", "cc-by-nc", "apache-2", ""}
    assert same_rows(brute(odd_rows(documents(spark))), M.license_scan(documents(spark, clash=True)).collect())
    assert M.license_scan(empty(spark)).count() == 0


def test_wrapped_notices(spark):
    """Notices wrapped at any column, with comment marks, in the midst of other words, equal to windows by brute force."""
    before, after = "some other words stand here and more of the same".split(), "tail of the file with further text".split()
    texts = []
    for _, notice in M.TEMPLATES:
        w = [*before, *notice.split(), *after]
        texts += ["\n".join(" * " + " ".join(w[i:i + n]).capitalize() for i in range(0, len(w), n)) for n in (1, 3, 5, 8, 12)]
        texts += ["\n".join(x for i, x in enumerate(w) if i % 3), "\n".join(x for i, x in enumerate(w) if i % 7), "\n".join(notice.split()[:3] + ["x"] * 40 + notice.split()[3:])]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    want = [(r[0], r[6]) for r in brute([(i, t) for i, t, *_ in rows])]
    got = [(r["doc_id"], r["labels"]) for r in M.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert same_rows(want, got) and sum(bool(x) for _, x in want) > 40


def test_words_far_apart_are_no_notice(spark):
    filler = " ".join(f"filler{i}" for i in range(300))
    text = f"released {filler} under {filler} the {filler} license {filler} mit"
    near = "released x under the mit license"
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in M.license_scan(spark.createDataFrame([(1, text, "en", "s", 1), (2, near, "en", "s", 1)], SCHEMA)).collect()}
    assert got[1] == ("", 0.0) and got[2] == ("mit", 1.0)


def test_sql_knows_wrapped_notices(spark, tmp_path):
    """The registered SQL and the query on a table with wrapped and scattered notices."""
    from tests.oracle import compare, connect

    texts = [n for _, n in M.TEMPLATES] + [n.replace(" ", "\n", 3).replace("the", "x the", 1) for _, n in M.TEMPLATES] + ["released " + "y " * 40 + "under the mit"]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    con = connect(SMALL)
    con.execute(f"create or replace view documents as select * from '{tmp_path}/documents.parquet'")
    assert compare(M.op7_license_scan(spark, str(tmp_path)), con, M.S["op7_license_scan"])["ok"]
