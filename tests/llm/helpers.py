"""Small inputs and brute-force results of the corpus tests."""

import re
from functools import cache

from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOWER = {65 + i: 97 + i for i in range(26)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ("kept", "key", "pos", "rank", "host", "size", "copies", "digest", "row_hash", "text_hash", "words", "lines", "tag", "h", "node", "shard", "rows", "count", "label")

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak near the quiet river bank at dusk"
ODD = [
    None, "", " \t\n ", "a", "one\ntwo\n\nthree", PROSE, PROSE, PROSE.upper(), PROSE + " again", PROSE.replace("seven", "eight"),
    "é ñ ü " * 3000, "x y　z", "TAB\tand\x0bVT\x0cFF\r\nend", "tick " * 400, PROSE + "\n" + PROSE + "\nshort\nshort",
    "zürich ÀÉ groß 's don't <|endoftext|> 12,5% ", "Released under the MIT License.\nx", "w" * 30000,
]


def documents(spark, texts=ODD, clash=False):
    """Rows for the texts; the last two repeat earlier rows, one has no id, and sources and languages hold nulls."""
    rows = [(10 + i, t, (None, "en", "de")[i % 3], (None, "s1", "s1", "s2")[i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[0], (None, PROSE + " extra words for a row without any id", "en", "s9", 1)] if len(rows) > 5 else []
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHES if clash else ():
        df = df.selectExpr("*", f"'x' AS {c}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same_rows(a, b):
    """Two results as sorted lists of rows."""
    key = lambda rows: sorted((tuple((v is None, str(v)) for v in r) for r in rows))
    return key(a) == key(b)


def check_sql(spark, module, name, sf=SMALL):
    result = compare(module.Q[name](spark, sf), connect(sf), module.S[name])
    assert result["ok"], result


@cache
def given(sf=SMALL):
    return connect(sf).execute("select doc_id, text, source from documents order by doc_id").fetchall()


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def odd_rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]
