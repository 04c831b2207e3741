import numpy as np
import pytest

from opsloom.llm import mixing as M
from tests.llm.helpers import ODD, SMALL, documents, empty, given, same_rows, words


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def check(rows, size_of, source_of):
    sizes = {}
    for i in size_of:
        sizes[source_of[i]] = sizes.get(source_of[i], 0) + size_of[i]
    target, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        assert r["size"] == size_of[r["doc_id"]] and r["source_size"] == sizes[source_of[r["doc_id"]]]
        assert r["target"] == pytest.approx(target[source_of[r["doc_id"]]], abs=1e-6)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source_of[r["doc_id"]]] += r["taken"]
    for s in sizes:
        longest = max([size_of[i] for i in size_of if source_of[i] == s])
        assert abs(taken[s] - target[s]) <= max(longest, 1)


def test_given_table(spark):
    rows = M.Q["op10_mixing"](spark, SMALL).collect()
    check(rows, {i: len(words(t)) for i, t, _ in given()}, {i: s for i, _, s in given()})
    assert len(rows) == len(given()) and same_rows(rows, M.Q["op10_mixing"](spark, SMALL).collect())


def test_odd_texts(spark):
    a, b = M.mix(documents(spark)).collect(), M.mix(documents(spark, clash=True)).collect()
    assert same_rows(a, b) and len(a) == len(ODD) + 3
    assert all(r["copies"] == 0 for r in a if r["size"] == 0)
    assert {r["source"] for r in a} == {None, "s1", "s2", "s9"}
    assert M.mix(empty(spark)).count() == 0


def test_knapsack_is_exact_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 40, rng.integers(1, 7)))
        counts = rng.integers(1, 5, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 5))
        sums = {0}
        for size, n in zip(lengths, counts):
            sums = {s + k * int(size) for s in sums for k in range(n + 1)}
        take = M._knapsack(lengths, counts, budget)
        assert (take <= counts).all() and (take * lengths).sum() == max(s for s in sums if s <= budget)
        take = M.fit_counts(lengths, counts, budget)
        assert (take <= counts).all() and 0 <= budget - (take * lengths).sum() <= max(lengths.max(), budget - (lengths * counts).sum())
