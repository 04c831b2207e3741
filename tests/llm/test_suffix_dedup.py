import random

import pytest

from opsloom.llm import suffix_dedup as M
from tests.llm.helpers import ODD, SCHEMA, SMALL, documents, empty, given, odd_rows, same_rows


def brute(rows):
    """(id, bytes, removed, spans, rest); equal rows are one document, rows without an id stay."""
    seen, done, out = set(), {}, []
    for i, t in sorted({(i, t or "") for i, t in rows if i is not None}):
        data = t.encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k:k + 100] in seen:
                gone[k:k + 100] = b"\1" * 100
            seen.add(data[k:k + 100])
        spans = sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1]))
        done[i, t] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g))
    for i, t in rows:
        data = (t or "").encode()
        out.append((i, *(done[i, t or ""] if i is not None else (len(data), 0, 0, data))))
    return out


def plain(df):
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["data"])) for r in df.collect()]


def test_given_table(spark):
    from opsloom.llm.common import documents as table

    got = plain(M.suffix_dedup(table(spark, SMALL)))
    assert same_rows(brute([(i, t) for i, t, _ in given()]), got) and any(r[2] for r in got)


def test_odd_texts(spark):
    want = brute(odd_rows(documents(spark)))
    assert same_rows(want, plain(M.suffix_dedup(documents(spark))))
    assert same_rows(want, plain(M.suffix_dedup(documents(spark, clash=True))))
    assert M.suffix_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [M.HOT_ROWS, 3])
def test_shared_passages_and_periods(spark, monkeypatch, hot):
    monkeypatch.setattr(M, "HOT_ROWS", hot)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [text(n) for n in (90, 99, 100, 101, 160, 700)]
    texts = [text(rng.randrange(80)) + rng.choice(passages) + text(rng.randrange(80)) + rng.choice(passages) + text(rng.randrange(40)) for _ in range(80)]
    texts += [rng.choice(("ab", "xyz", "k" * 30 + "m")) * rng.randrange(1, 120) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    assert same_rows(brute(odd_rows(df)), plain(M.suffix_dedup(df)))
