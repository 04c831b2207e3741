import random

import numpy as np
import pyarrow as pa

from opsloom.llm import near_dedup as M
from opsloom.llm.components import components
from opsloom.llm.shingles import shingle_sets
from tests.llm.helpers import ODD, SCHEMA, SMALL, documents, empty, given, odd_rows, same_rows, shingles


def brute(rows):
    """(id, set size, component) with every pair of documents compared; rows of one id are one document."""
    sets = [(i, frozenset(shingles(t))) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and i is not None and j is not None and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return [(i, len(x), None if i is None else root(i)) for i, x in sets]


def test_given_table(spark):
    want = [(i, n, c, i == c) for i, n, c in brute([(i, t) for i, t, _ in given()])]
    assert same_rows(want, M.Q["op2_near_dedup"](spark, SMALL).collect())
    assert any(i != c for i, _, c, _ in want)


def test_groups_edits_and_odd_texts(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    texts = []
    for k in range(60):  # near copies of one text, some beyond the threshold of each other
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"x{k}_{rng.randrange(9)}"
        texts.append(" ".join(w))
    shared = " ".join(f"p{i}" for i in range(60))  # a passage that is half of many unlike documents
    texts += [shared + " " + " ".join(f"q{k}_{i}" for i in range(60)) for k in range(50)]
    df = documents(spark, ODD).union(spark.createDataFrame([(1000 + i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA))
    want = [(i, n, c, i == c) for i, n, c in brute(odd_rows(df))]
    assert same_rows(want, M.near_dedup(df).collect())


def test_repeated_ids_have_the_links_of_all_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (7, a), (7, b), (9, b), (9, None), (7, ""), (11, c), (12, c + " more"), (None, a), (12, b + " x"), (20, None), (3, "c d")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    want = [(i, n, c, i == c) for i, n, c in brute(rows)]
    assert {c for i, _, c, _ in want if i in (5, 7, 9, 11, 12)} == {5}
    assert same_rows(want, M.near_dedup(df).collect())


def test_crowded_groups_of_far_copies(spark, monkeypatch):
    """Copies edited so much that some have links to few or none of their group, by way of the prefix filter alone."""
    monkeypatch.setattr(M, "LEADER_ROUNDS", 1)
    monkeypatch.setattr(M, "SMALL_BUCKET", 1)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(90):
        w = list(base)
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(len(w))] = f"y{k % 30}_{rng.randrange(3)}"
        texts.append(" ".join(w[:rng.randrange(90, 121)]))
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    want = [(i, n, c, i == c) for i, n, c in brute(rows)]
    assert len({c for _, _, c, _ in want}) > 3
    assert same_rows(want, M.near_dedup(df).collect())


def test_group_of_edited_copies_is_not_expanded_into_pairs(spark, monkeypatch):
    """Copies that link to the least edited of their group join it by way of hubs, before the join across components."""
    monkeypatch.setattr(M, "LEADER_ROUNDS", 1)
    monkeypatch.setattr(M, "SMALL_BUCKET", 1)
    made, across = [], M.across

    def counted(rows):
        out = across(rows)
        if "place" in rows.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(M, "across", counted)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for k in range(160):
        w = list(base)
        for _ in range(1 if k % 4 else 4):
            w[rng.randrange(len(w))] = f"y{k}"
        texts.append(" ".join(w))
    rows = [((i * 83) % 997, t) for i, t in enumerate(texts)]
    want = [(i, n, c, i == c) for i, n, c in brute(rows)]
    assert same_rows(want, M.near_dedup(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)).collect())
    assert made and max(made) <= 2 * len(rows), made


def test_empty_and_other_columns(spark):
    assert M.near_dedup(empty(spark)).count() == 0
    assert M.near_dedup(documents(spark, [None, ""], clash=True)).select("n_shingles").distinct().collect()[0][0] == 0


def test_stop_is_the_posterior_bound():
    # P(J >= t | m of n) under a uniform prior, by integration of the Beta density on a fine grid.
    x = (np.arange(200_000) + 0.5) / 200_000
    for n in (64, 448):
        m = M.hopeless(n)
        for k, under in ((m, True), (m + 1, False)):
            density = np.exp(k * np.log(x) + (n - k) * np.log(1 - x))
            assert (density[x >= 0.75].sum() / density.sum() < M.MISS) == under


def test_signatures_estimate_similarity():
    a = np.unique(np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64))
    sig = M.sign([a[:2000], a[500:2500]])
    assert abs((sig[0] == sig[1]).mean() - 1500 / 2500) < 0.12


def test_sets_of_sliced_arrays():
    texts = ["à b c d e f à"] * 3 + ["x"] + [t or "" for t in ODD]
    for part in (pa.array(texts).slice(2), pa.array(texts, pa.large_string()).slice(3)):
        assert [len(s) for s in shingle_sets(part)] == [len(shingles(t)) for t in part.to_pylist()]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(900, 901), (901, 900), (5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 60)} | {900: 900, 901: 900}
