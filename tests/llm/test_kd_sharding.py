import zlib
from collections import Counter, defaultdict

from opsloom.llm import kd_sharding as M
from tests.llm.helpers import SCHEMA, SMALL, documents, empty, given, odd_rows, same_rows


def test_given_table(spark):
    rows = M.Q["op6_kd_sharding"](spark, SMALL).collect()
    size = {i: len((t or "").encode()) + 16 for i, t, _ in given()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(i, size[i], zlib.crc32((t or "").encode())) for i, t, _ in given()}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_near_equal_bytes_and_whole_groups(spark):
    rows = [(i, f"text {i} " + "x" * (i * 37 % 900), ("en", "de")[i % 2], f"s{i % 7}", 1) for i in range(4000)]
    rows += [(10_000 + i, "a copy of one short text", "en", f"s{i % 7}", 1) for i in range(30)]
    rows += [(20_000 + i, "copies that outweigh a shard " * 20, "en", "s1", 1) for i in range(1500)]
    out = M.kd_shards(spark.createDataFrame(rows, SCHEMA), 16).collect()
    load = Counter()
    for r in out:
        load[r["shard"]] += r["size"]
    mean = sum(load.values()) / 16
    assert len(load) == 16 and max(load.values()) < 1.05 * mean and min(load.values()) > 0.95 * mean
    assert len({r["shard"] for r in out if 10_000 <= r["doc_id"] < 10_030}) == 1 and len(out) == len(rows)


def test_cuts_equal_a_plain_recursion(spark):
    units = M.units_of(M.sized(spark.createDataFrame([(i, "y" * (i * i % 501), "en", f"s{i % 5}", 1) for i in range(300)], SCHEMA)), 1e9)[1].collect()
    want = sorted((u["d_length"], u["bytes"]) for u in units)
    half, at = sum(b for _, b in want) / 2, 0
    frame = M.units_of(M.sized(spark.createDataFrame([(i, "y" * (i * i % 501), "en", f"s{i % 5}", 1) for i in range(300)], SCHEMA)), 1e9)[1].selectExpr("*", "0 AS node")
    cut = M.quantile_keys(frame, {0: ("d_length", want[0][0], want[-1][0], half)}, 0.0)[0]
    below = sum(b for k, b in want if k < cut)
    best = min((abs(sum(b for _, b in want[:k]) - half) for k in range(len(want) + 1)))
    assert abs(below - half) == best


def test_odd_texts(spark):
    a, b = M.kd_shards(documents(spark), 5).collect(), M.kd_shards(documents(spark, clash=True).drop("shard"), 5).collect()
    assert same_rows([(r["doc_id"], r["size"], r["shard"]) for r in a], [(r["doc_id"], r["size"], r["shard"]) for r in b])
    assert sorted(r["size"] for r in a) == sorted(len((t or "").encode()) + 16 for _, t in odd_rows(documents(spark)))
    assert M.kd_shards(empty(spark)).count() == 0
