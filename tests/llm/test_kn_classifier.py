import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.llm import kn_classifier as M
from opsloom.session import work_base
from opsloom.sources.tables import table
from tests.llm.helpers import ODD, SCHEMA, documents, empty, same_rows, words

LABELS = "doc_id bigint, quality int, toxic int"


def brute(trusted, scored):
    """Log perplexities of the texts ``scored`` under interpolated modified Kneser-Ney pairs of ``trusted``."""
    code = lambda t: [M.plain(w) for w in words(t)]
    pairs = Counter()
    for t in trusted:
        w = ["<s>", *code(t)]
        pairs.update(zip(w, w[1:]))
    known = {w for t in trusted for w in code(t)}

    def d(of):
        n1, n2, n3, n4 = (max(of.count(k), 1) for k in range(1, 5))
        y = n1 / (n1 + 2 * n2)
        return [0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)))]

    high, follow = d(list(pairs.values())), Counter(w for _, w in pairs)
    low, total, back = d(list(follow.values())), Counter(), Counter()
    for (v, _), c in pairs.items():
        total[v] += c
        back[v] += high[min(c, 3)]
    spread = sum(low[min(c, 3)] for c in follow.values()) / (len(follow) + 1)
    out = []
    for t in scored:
        w = ["<s>", *(x if x in known else "<unk>" for x in code(t))]
        cost = 0.0
        for v, x in zip(w, w[1:]):
            c = pairs[v, x]
            lower = (max(follow[x] - low[min(follow[x], 3)], 0) + spread) / sum(follow.values())
            p = (max(c - high[min(c, 3)], 0) / total[v] + back[v] / total[v] * lower) if total[v] else lower
            cost -= math.log(p)
        out.append(cost / (len(w) - 1) if len(w) > 1 else None)
    return out


def test_perplexity_equals_brute_force(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(("The", "cat", "sat", "on", "mats,", "and", "dogs", "ran.")) for _ in range(rng.randrange(3, 60)))
    rows = [(i, text() if i % 9 else text() + " unheard words", "en", "s", 1) for i in range(80)]
    labels = [(i, 1, 0) for i in range(40)] + [(40, 1, 1), (41, 0, 0), (999, 1, 0), (42, None, 0)]
    out = {r["doc_id"]: r for r in M.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()}
    held = {r[0] for r in spark.range(40).filter(F.pmod(F.xxhash64("id"), F.lit(M.HELD)) == 0).collect()}
    want = brute([t for i, t, *_ in rows if i < 40 and i not in held], [t for _, t, *_ in rows])
    for (i, t, *_), log_ppl in zip(rows, want):
        assert out[i]["n_words"] == len(words(t)) and out[i]["perplexity"] == pytest.approx(math.exp(log_ppl), rel=1e-4)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = {r["doc_id"]: r["kept"] for r in M.classify(docs, labels.filter("doc_id % 2 = 0")).collect()}
    held = [(r["quality"], out[r["doc_id"]]) for r in labels.filter("doc_id % 2 = 1 AND toxic = 0").collect()]
    good, bad = [k for q, k in held if q == 1], [k for q, k in held if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.4 * len(bad) and len(out) == docs.count()


def test_odd_texts(spark):
    labels = spark.createDataFrame([(15, 1, 0), (16, 1, 0), (18, 1, None), (None, 1, 0)], LABELS)
    a, b = M.classify(documents(spark), labels).collect(), M.classify(documents(spark, clash=True), labels).collect()
    assert same_rows(a, b) and len(a) == len(ODD) + 3
    assert all((r["perplexity"] is None) == (r["n_words"] == 0) and (r["n_words"] or not r["kept"]) for r in a)
    assert M.classify(empty(spark), labels).count() == 0
    none = M.classify(documents(spark), labels.filter("doc_id < 0")).collect()
    assert all(r["kept"] == (r["n_words"] > 0) for r in none)


def test_rare_words_beyond_any_vocabulary(spark):
    """More trusted types than 16-bit ids: the rare ones keep their pairs and the result is that of the full model."""
    types = 85_534
    texts = [" ".join(f"w{i + j} x{i + j}" for j in range(100)) for i in range(0, types // 2, 100)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], LABELS)
    out = {r["doc_id"]: r["perplexity"] for r in M.classify(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    held = {r[0] for r in spark.range(len(texts)).filter(F.pmod(F.xxhash64("id"), F.lit(M.HELD)) == 0).collect()}
    trusted = [t for i, t in enumerate(texts) if i not in held]
    known = {w for t in trusted for w in words(t)}
    assert len(known) > 65_535
    low, high = min(out[i] for i in held), max(p for i, p in out.items() if i not in held)
    assert max(p for i, p in out.items() if i not in held) == pytest.approx(min(p for i, p in out.items() if i not in held), rel=1e-3)
    assert low > 5 * high


def test_disk_is_bounded(spark):
    """Stored tables and the shuffle files that are left take at most 1.5 times the stored documents."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    size = lambda paths: sum(f.stat().st_size for p in paths for f in ([Path(p)] if Path(p).is_file() else Path(p).rglob("*")) if f.is_file())
    used = lambda: size([work_base(spark), *[d.getPath() for d in blocks.localDirs()]])
    sf = "/root/testdata/sf0.1"
    docs, labels, before = table(spark, sf, "documents"), table(spark, sf, "labels"), used()
    out = M.classify(docs, labels)
    assert used() - before <= 1.5 * size([f"{sf}/documents.parquet"])
    assert out.count() == docs.count()


def test_parts_do_not_change_the_result(spark, monkeypatch):
    """One word in three and its pairs are very common; whatever the number of parts, words and pairs are counted alike."""
    rng = random.Random(2)
    rows = [(i, " ".join("the" if rng.random() < 0.3 else f"w{int(rng.paretovariate(0.7))}" for _ in range(200)), "en", "s", 1) for i in range(60)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, 1, 0) for i in range(40)], LABELS)
    few = M.classify(docs, labels).collect()
    monkeypatch.setattr(M, "PART_WORDS", 100)
    assert same_rows(few, M.classify(docs, labels).collect())


def test_packed_numbers_come_back():
    wide = np.array([0, 2**64 - 1, 5], np.uint64)
    a, b, c = M.unpacked(M.packed(wide, np.empty(0, np.int64), np.array([-1, 300, 0])))
    assert a.view(np.uint64).tolist() == wide.tolist() and len(b) == 0 and c.tolist() == [-1, 300, 0]
    every = np.unique(np.random.default_rng(3).integers(1, 300, (5000, 2)) @ np.array([1 << 32, 1]))
    for parts in (1, 3, 12):
        v, w = every >> 32, every & M.LOW
        part = np.where(v < M.FREQUENT * parts + M.FIRST, v + w, v) % parts
        for p in range(parts):
            pairs = every[part == p]
            back, times = M.unpacked_pairs(M.packed_pairs(pairs, np.arange(len(pairs)), p, parts), p, parts)
            assert back.tolist() == pairs.tolist() and times.tolist() == list(range(len(pairs)))
    assert all(len(x) == 0 for x in M.unpacked_pairs(M.packed_pairs(every[:0], every[:0], 0, 3), 0, 3))
