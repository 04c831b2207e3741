"""Spelling variants: exact neighbours at one edit from a trie-node pair dictionary, and the form each word goes back to.

Every distinct word is a path in a forward trie and, read backwards, in a reversed trie. All nodes get a number, so a word
with one position skipped is a pair of integers: the node of what stands before it and the reversed node of what stands
after it. Words that differ by one replaced code point share the pair of the skipped position; a word with one code point
more has, at the inserted position, the pair that the shorter word has between two of its code points. Both are equal
pairs of integers and nothing else is, so the join is exact and no word is compared with another.

* Tries are numbered from sorted words: ``repartitionByRange`` and a sort put words with common prefixes side by side, a
  path takes over its predecessor's nodes as far as both agree, and new nodes are counted on. Where a partition begins,
  the path that is open at the end of the one before is carried over; only one path per partition reaches the driver.
* A pair names the word around the position but for one code point, so a group holds at most one word per letter of the
  alphabet, and at most one shorter word. Within a group no pairs are made: each word learns how many others there are and
  which of them comes first. Words are numbered by falling count, then by code points, so the first is the least number.
* Of equal code points in a row only the first counts as inserted: every pair of words is met once.
* Counts of forms at least double from step to step, so chains to the root are short; they are followed by doubling.

Defined results: a null text has no words; a row without an id counts as one with an empty id; rows that repeat an id or
each other are all counted; an empty table, or one without frequent words, gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from opsloom.llm.common import ascii_lower, documents, text_of
from opsloom.session import written

Q, S = {}, {}

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 5, 3
RATIO = 2  # how many times more frequent a form is
ONE_IN = 97  # of the runs lose a code point
PARTITION_NODES = 1 << 40


def injured(run, key):
    """``run``, without one code point where the checksum ``key`` says so."""
    at = key % F.char_length(run)
    return F.when(key % ONE_IN == 0, F.concat(F.substring(run, 1, at.cast("int")), F.substring(run, (at + 2).cast("int"), F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, injure: bool = True, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """``word``, ``n``: frequent words of whole texts; with ``injure`` one run in ``ONE_IN`` loses a code point first."""
    runs = F.regexp_extract_all(ascii_lower(text_of()), F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    key = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    words = rows.select((injured(F.col("run"), key) if injure else F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= count)


def in_order(df: DataFrame, *order) -> DataFrame:
    """Range partitions, each sorted."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def shared(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def trie(words: DataFrame, parts: int | None = None) -> DataFrame:
    """``id``, ``nodes`` (number of the root and of every prefix of ``word``) and ``fresh`` (whether a code point differs from
    the one before), for distinct words."""
    def number(batches):
        pid = TaskContext.get().partitionId()
        last, path, used = "", [0], pid * PARTITION_NODES
        for batch in batches:
            texts = batch.column("word").to_pylist()
            nodes, fresh = [], []
            for word in texts:
                k = shared(last, word)
                path = path[:k + 1] + list(range(used + 1, used + 1 + len(word) - k))
                used += len(word) - k
                last = word
                nodes.append(path)
                fresh.append([i == 0 or word[i - 1] != c for i, c in enumerate(word)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([pid] * len(texts), pa.int32()), batch.column("word"), pa.array(nodes, pa.list_(pa.int64())), pa.array(fresh, pa.list_(pa.bool_()))],
                ["id", "pid", "word", "nodes", "fresh"])

    order = ([parts] if parts else []) + [F.col("word")]
    ranged = words.select("id", "word").repartitionByRange(*order).sortWithinPartitions("word")
    local = written(ranged.mapInArrow(number, "id bigint, pid int, word string, nodes array<bigint>, fresh array<boolean>"), "trie")
    ends = local.groupBy("pid").agg(F.min("word").alias("first"), F.max("word").alias("last"), F.max_by("nodes", "word").alias("nodes"))
    carried, last, path = [], "", [0]  # one word and path per partition
    for r in sorted(ends.collect(), key=lambda r: r["pid"]):
        # The first word of a partition numbers its nodes 1, 2, ...: the ones it shares with the word before have a number already.
        k = shared(last, r["first"])
        known = path[1:k + 1]
        carried.append((r["pid"], known))
        path = [known[x % PARTITION_NODES - 1] if 0 < x % PARTITION_NODES <= k else x for x in r["nodes"]]
        last = r["last"]
    known = F.broadcast(words.sparkSession.createDataFrame(carried, "pid int, known array<bigint>"))
    place = lambda x: F.least(x % PARTITION_NODES, F.size("known") + 1).cast("int") - 1
    nodes = F.transform("nodes", lambda x: F.coalesce(F.get("known", place(x)), x))
    return written(local.join(known, "pid").select("id", nodes.alias("nodes"), "fresh"), "trie-nodes")


def pairs(words: DataFrame) -> DataFrame:
    """Pairs (``p``, ``s``) of nodes around every position of every word (``id``, ``word``): with a code point skipped
    (``gap`` false; ``fresh`` where it differs from the one before) and between code points (``gap`` true)."""
    forward = trie(words)
    backward = trie(words.select("id", F.reverse("word").alias("word"))).select("id", F.col("nodes").alias("back"))
    both = forward.join(backward, "id")
    n = F.size("fresh")
    node = lambda column, i: F.get(F.col(column), i)
    skipped = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(node("nodes", i).alias("p"), node("back", n - 1 - i).alias("s"), F.lit(False).alias("gap"), node("fresh", i).alias("fresh")))
    between = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(node("nodes", i).alias("p"), node("back", n - i).alias("s"), F.lit(True).alias("gap"), F.lit(False).alias("fresh")))
    return both.select("id", F.explode(F.concat(skipped, between)).alias("k")).select("id", "k.p", "k.s", "k.gap", "k.fresh")


def neighbours(words: DataFrame) -> DataFrame:
    """``id``, ``n_near`` and ``first_near`` (least id) of the words that have another one at one edit."""
    group = Window.partitionBy("p", "s").orderBy("gap", "id")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = pairs(words).select(
        "id", "gap", "fresh",
        F.count_if(~F.col("gap")).over(whole).alias("same"), F.count_if("fresh").over(whole).alias("longer"),
        F.min(F.when(F.col("gap"), F.col("id"))).over(whole).alias("shorter"),
        F.min(F.when(~F.col("gap"), F.col("id"))).over(whole).alias("first"),
        F.min(F.when(F.col("fresh"), F.col("id"))).over(whole).alias("first_longer"),
        F.lead(F.struct("gap", "id")).over(group).alias("next"))
    other = F.when(F.col("first") != F.col("id"), F.col("first")).otherwise(F.when(~F.col("next.gap"), F.col("next.id")))
    here = row.select(
        "id",
        F.when(F.col("gap"), F.col("longer")).otherwise(F.col("same") - 1 + (F.col("fresh") & F.col("shorter").isNotNull()).cast("int")).alias("near"),
        F.when(F.col("gap"), F.col("first_longer")).otherwise(F.least(other, F.when(F.col("fresh"), F.col("shorter")))).alias("first_near"))
    return here.filter("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("first_near").alias("first_near"))


def roots(links: DataFrame) -> DataFrame:
    """``id``, ``root``: the end of the chain of ``form`` that starts at each id. Every round doubles the steps taken."""
    links = written(links.select("id", F.col("form").alias("root")), "variant-links")
    while True:
        ahead = links.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = written(links.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-links")
        links = step.select("id", "root")
        if step.filter("moved").isEmpty():
            return links


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of distinct words with their counts (``word``, ``n``)."""
    words = written(in_order(counts.select("word", "n"), F.desc("n"), F.asc("word")).withColumn("id", F.monotonically_increasing_id()), "variant-words")
    near = written(neighbours(words), "variant-near")
    best = words.select(F.col("id").alias("first_near"), F.col("n").alias("form_n"))
    known = words.join(near, "id").join(best, "first_near")
    links = written(known.filter(F.col("form_n") >= ratio * F.col("n")).select("id", F.col("first_near").alias("form"), "form_n"), "variant-forms")
    name = lambda key, out: words.select(F.col("id").alias(key), F.col("word").alias(out))
    chain = links.join(roots(links).withColumnRenamed("root", "end"), "id").join(name("form", "form_word"), "form").join(name("end", "root_word"), "end")
    out = words.join(near.select("id", "n_near"), "id", "left").join(chain.select("id", "form_word", "root_word", "form_n"), "id", "left")
    return out.select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, injure: bool = False) -> DataFrame:
    """Variants among the frequent words of documents."""
    return variants(word_counts(docs, injure))


def op12_spelling_variants(spark, sf_dir):
    return spelling_variants(documents(spark, sf_dir), injure=True)


Q["op12_spelling_variants"] = op12_spelling_variants
