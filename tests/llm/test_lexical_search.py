import math
import re
from collections import Counter

import numpy as np

from opsloom.llm import lexical_search as M
from tests.llm.helpers import LOWER, ODD, SMALL, check_sql, documents, empty, odd_rows, same_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, asked in wanted.items():
        scored = []
        for i, c in docs:
            m = 10 + 90 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return out


def items(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "item_id bigint, text string")
    return df.selectExpr("*", "'x' AS doc_id", "'x' AS score", "'x' AS term", "1 AS rank") if clash else df


ASKED = [(1, "quick brown FOX, river"), (2, "mit license"), (3, None), (4, "nowhere"), (5, "Zürich é groß don t"), (6, "tick"), (6, "owls"), (7, "one"), (None, "dog dusk")]


def test_given_table(spark):
    check_sql(spark, M, "op11_lexical_search")


def test_odd_texts(spark):
    docs = documents(spark, clash=True)
    want = brute(odd_rows(docs), ASKED)
    got = M.search(M.build_index(docs), items(spark, ASKED, True))
    assert same_rows(want, [tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()])
    assert M.search(M.build_index(empty(spark)), items(spark, ASKED)).count() == 0
    assert M.search(M.build_index(docs), items(spark, [])).count() == 0
    assert M.search(M.build_index(docs), items(spark, [(1, "")])).count() == 0


def test_small_segments_and_blocks(spark, monkeypatch):
    """Many segments, blocks of items and strata; ties over segments; ten of very many equal documents."""
    monkeypatch.setattr(M, "BLOCK_TERMS", 4)
    rng = np.random.default_rng(11)
    words = [f"w{int(x)}" for x in rng.zipf(1.4, 6000) % 97]
    texts, at = [], 0
    while at < len(words):
        n = int(rng.integers(1, 40))
        texts.append(" ".join(words[at:at + n]))
        at += n
    texts += ["w3 w5 rare"] * 60
    asked = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 97, 6))) for i in range(25)] + [(99, "rare w3")]
    docs = documents(spark, texts)
    want = brute(odd_rows(docs), asked)
    index = M.build_index(docs)
    for size in (7, 64):
        monkeypatch.setattr(M, "SEGMENT_DOCS", size)
        rows = M.counted(docs).withColumn("m", M.F.expr(f"{M.SLOPE} * n * {index.n_docs} div {index.n_terms} + {M.LEAST}"))
        parts = [M.segment(*map(list, zip(*[(r["doc_id"], r["m"], bytes(r["terms"]), bytes(r["tfs"])) for r in chunk]))) for chunk in _chunks(rows.collect(), size)]
        small = M.LexicalIndex(spark.createDataFrame(parts, M.SEGMENT), index.n_docs, index.n_terms)
        assert same_rows(want, [tuple(r) for r in M.search(small, items(spark, asked)).collect()])
    assert same_rows(want, [tuple(r) for r in M.search(index, items(spark, asked)).collect()])


def _chunks(rows, size):
    return [rows[i:i + size] for i in range(0, len(rows), size)]


def test_visits_are_pruned(monkeypatch):
    """Strata below the tenth score are not opened, and the result is that of all visits."""
    rng = np.random.default_rng(1)
    docs = [[f"t{int(x)}".encode() for x in rng.zipf(1.3, int(n)) % 200] for n in rng.integers(3, 300, 3000)]
    counts = [Counter(d) for d in docs]
    total = sum(map(len, docs))
    ms = [10 + 90 * len(d) * len(docs) // total for d in docs]
    names = [c.split()[0] for c in M.SEGMENT.split(", ")]
    row = dict(zip(names, M.segment(list(range(len(docs))), ms, [b" ".join(c) for c in counts], [np.array(list(c.values()), np.int32).tobytes() for c in counts])))
    row["ids"] = M.pa.array(row["ids"], M.pa.int64())
    asked = {f"t{i}".encode(): n for n, i in enumerate(range(0, 200, 9))}
    here = M.Segment(row, asked)
    seen = []
    spread = M.ranges
    monkeypatch.setattr(M, "ranges", lambda a, b: seen.append(int((b - a).sum())) or spread(a, b))
    terms, weights = np.arange(len(asked)), np.arange(1, len(asked) + 1) * 300
    place, score = here.best(terms, weights, 1, 10, False)
    opened = sum(seen)
    all_scores = sorted(((sum(int(w) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in zip(asked, weights.tolist()) if c[t]), -i) for i, (c, m) in enumerate(zip(counts, ms))), reverse=True)[:10]
    assert [(-int(p), int(s)) for p, s in zip(place, score)] == [(i, s) for s, i in all_scores]
    seen.clear()
    here.best(terms, weights, 1, len(docs), False)
    assert opened < sum(seen)


def test_stored_tables_are_read_in_bounded_parts(spark, tmp_path):
    """Row groups, splits and decoded batches are bounded by bytes or rows, and the session's own settings come back."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n) for n in names]
    with M.small_scans(spark):
        assert [int(spark.conf.get(n)) <= M.STORED_BYTES for n in names] == [True] * 3 and int(spark.conf.get(names[1])) == M.SCAN_ROWS
        noise = lambda batches: (pa.RecordBatch.from_arrays([pa.array([os.urandom(10**6)])], ["x"]) for b in batches for _ in range(b.num_rows))
        rows = spark.range(0, 60, 1, 1).mapInArrow(noise, "x binary")  # 60 MB in one part
        kept = M.stored(rows, "row-groups")
        sizes = [g.total_byte_size for f in kept.inputFiles() for m in [pq.read_metadata(f.removeprefix("file://"))] for g in map(m.row_group, range(m.num_row_groups))]
        assert len(sizes) > 1 and kept.count() == 60
    assert [spark.conf.get(n) for n in names] == before
