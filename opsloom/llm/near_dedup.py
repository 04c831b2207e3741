"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal shingle sets form one class, and classes are compared by their smallest document.

* Candidates: the signature of a class is cut into bands; classes that share a band meet in a bucket. With 64 bands of
  7 values a pair at the threshold of 0.75 shares no bucket with a chance of 1e-4, a pair at 0.8 with 2e-7; a pair at 0.5,
  as documents with a shared passage are, shares one with a chance of 0.4 and a pair at 0.3 with 0.01.
* No bucket is expanded into all pairs. In each round a bucket proposes one member as its leader, the same one in all
  buckets that hold it, and a member of another component is compared with the leaders it shares most buckets with;
  buckets whose members are one component leave. A small bucket that still holds several components after the leader
  rounds is compared across its components; members of crowded ones, which share a passage more often than they are near
  copies, are instead compared where they share one of the foremost shingles of their sets (prefix filter), which finds
  every link among them exactly. A shingle that only one component holds can't link two, so these come first, then rare
  ones. From the places of a shared shingle follows how much two sets can share at most (positional filter); a row that
  even the smallest set under its shingle rules out is dropped before the join, as is a shingle left to one component.
  Before the join, each shingle proposes as hub the set whose shingles are the most common ones, which is the least edited
  of a group of copies, and its members are compared with it; what the hubs join into one component is not compared again.
* Verification: signatures of a pair are compared batch by batch. With a uniform prior the similarity after m matches in
  n is Beta(m + 1, n - m + 1); a pair goes as soon as the chance of a similarity at the threshold or above is under
  ``MISS``. Survivors are confirmed on full shingle sets: in every round each class's best edge, whichever end it is, and
  after the leader rounds and each later join only what would still join two components.

Defined results: a null text or one without words has an empty set and is linked with nothing; a row without an id is
linked with nothing, its component is null and it stays; rows that repeat an id are one document with the links of each
of their texts; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from opsloom.llm.common import documents, small_batches, text_of
from opsloom.llm.components import components, small
from opsloom.llm.shingles import shingle_sets
from opsloom.session import written

Q, S = {}, {}

WORDS = 5
THRESHOLD = 75  # percent
BANDS, ROWS = 64, 7
BATCH = 64
MISS = 1e-6
LEADER_ROUNDS = 3
LEADERS = 3  # leaders that a member is compared with in a round
NARROWINGS = 3
HUB_ROUNDS = 6  # at most; none is left out of the join that follows
HUB_CHOICE = 4  # from the second round on a hub is the best of one set in so many
SMALL_BUCKET = 8
_SEED = np.random.default_rng(2)
_A = (_SEED.integers(0, 2**31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_B = (_SEED.integers(0, 2**31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)


def sign(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures of non-empty sets, the low 8 bits of each value (equal by chance once in 256, which can only keep a
    pair alive longer); worked in pieces that stay in the processor's cache."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint8)
    lo = 0
    while lo < len(sets):
        hi, n = lo, 0
        while hi < len(sets) and (hi == lo or n + len(sets[hi]) <= 65_536):
            n += len(sets[hi])
            hi += 1
        flat = (np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[lo:hi - 1]])]).astype(np.int64)
        for k in range(BANDS * ROWS):
            v = flat * _A[k]
            v ^= v >> np.uint32(16)
            v *= _B[k]
            out[lo:hi, k] = np.minimum.reduceat(v, starts)
        lo = hi
    return out


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``set_key`` (128-bit hash of the set, null when empty) and ``sig``."""
    def rows(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo in range(0, batch.num_rows, 500):
                sets = list(shingle_sets(batch.column("text").slice(lo, 500), WORDS))
                full = [s for s in sets if len(s)]
                sigs = iter(sign(full)) if full else iter(())
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, 500), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.data) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary()),
                ], ["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, n_shingles bigint, set_key binary, sig binary")


def hopeless(n: int, threshold: float = THRESHOLD / 100, miss: float = MISS) -> int:
    """The most matches in ``n`` values at which the chance of a similarity of ``threshold`` or more is under ``miss``; -1 if none.

    Under a uniform prior that chance is P(Bin(n + 1, threshold) <= m).
    """
    chance, m = 0.0, -1
    for k in range(n + 1):
        chance += comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
        if chance >= miss:
            break
        m = k
    return m


def sift(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) that outlive the sequential comparison, with their ``matches`` in the whole signature."""
    stops = [(n, hopeless(n)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def compare(batches):
        for batch in batches:
            read = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
            a, b = read("sig_a"), read("sig_b")
            alive, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in stops:
                matches[alive] += (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
                alive, done = alive[matches[alive] > least], n
            take = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take), pa.array(matches[alive])], ["a", "b", "matches"])

    side = lambda c: sigs.select(F.col("cid").alias(c), F.col("sig").alias(f"sig_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(compare, "a bigint, b bigint, matches bigint")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    def check(batches):
        for batch in batches:
            keep = []
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                for i, (x, y) in enumerate(zip(shingle_sets(part.column("text_a"), WORDS), shingle_sets(part.column("text_b"), WORDS))):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= THRESHOLD * (len(x) + len(y) - both):
                        keep.append(lo + i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], ["a", "b"])

    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a bigint, b bigint")


def alike(a: str, b: str):
    """Sizes of sets that can reach the threshold at all."""
    return 100 * F.least(a, b) >= THRESHOLD * F.greatest(a, b)


def ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


class Linker:
    """State of the rounds: components so far and pairs that wait for a check on full sets; all held in tables."""

    def __init__(self, docs: DataFrame, sigs: DataFrame):
        self.docs, self.sigs = docs, sigs
        self.labels, self.waiting, self.size = None, None, 0

    def component(self, df: DataFrame, column: str, out: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(out, F.col(column))
        named = small(self.labels.select(F.col("id").alias("__v"), F.col("component").alias("__c")), self.size)
        return df.join(named, F.col(column) == F.col("__v"), "left").withColumn(out, F.coalesce("__c", column)).drop("__v", "__c")

    def add(self, pairs: DataFrame) -> None:
        """Confirm pairs on full sets and join what is linked."""
        ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "survivor-ids")
        n = ids.count()
        if not n:
            return
        texts = written(self.docs.join(small(ids, n), "doc_id", "left_semi"), "survivor-texts")  # each text of an id
        self.join(confirm(pairs, texts))

    def join(self, links: DataFrame) -> None:
        """Make one component of all that ``links`` (``a``, ``b``) connect."""
        links = written(links, "links")
        if links.isEmpty():
            return
        if self.labels is None:
            self.labels = written(components(links), "labels")
        else:
            both = self.component(self.component(links, "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
            joined = written(components(both), "joined")
            old = self.labels.join(small(joined.withColumnRenamed("id", "__i").withColumnRenamed("component", "__c"), joined.count()), F.col("component") == F.col("__i"), "left")
            old = old.select("id", F.coalesce("__c", "component").alias("component"))
            new = joined.join(self.labels.select("id"), "id", "left_anti")
            self.labels = written(old.unionByName(new), "labels")
        self.size = self.labels.count()

    def between(self, pairs: DataFrame) -> DataFrame:
        both = self.component(self.component(pairs, "a", "ca"), "b", "cb")
        return both.filter(F.col("ca") != F.col("cb")).drop("ca", "cb")

    def examine(self, pairs: DataFrame) -> None:
        """Sift the pairs; confirm each class's best, at either end, and let the others wait."""
        left = written(sift(pairs, self.sigs), "survivors")
        ends = left.select(F.col("a").alias("v"), "*").union(left.select(F.col("b").alias("v"), "*"))
        best = ends.groupBy("v").agg(F.max(F.struct("matches", "a", "b")).alias("e")).select("e.a", "e.b").distinct()
        self.add(written(best, "best"))
        self.waiting = left if self.waiting is None else self.waiting.union(left)

    def settle(self) -> None:
        """Confirm everything that waits and may still join two components."""
        if self.waiting is not None:
            left, self.waiting = self.waiting, None
            self.add(written(self.between(left).select("a", "b").distinct(), "rest"))


def buckets(rows: DataFrame, linker: Linker) -> tuple[DataFrame, DataFrame]:
    """Rows (``key``, ``cid``, ``comp``) of buckets that hold several components, and those buckets (``key``, ``n``, ``leader``)."""
    rows = linker.component(rows.select("key", "cid", "n_set", "rnd"), "cid", "comp")
    by = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                 F.min(F.struct(F.xxhash64("rnd", "cid").alias("h"), "cid", "comp", "n_set")).alias("leader"))
    by = written(by.filter(F.col("lo") != F.col("hi")).select("key", "n", F.col("leader.cid").alias("leader"), F.col("leader.comp").alias("leader_comp"), F.col("leader.n_set").alias("leader_set")), "buckets")
    return rows, by


def across(rows: DataFrame) -> DataFrame:
    """Pairs of rows with one key, of different components, whose sizes allow a link; with ``place``, whose places do."""
    placed = "place" in rows.columns
    other = rows.select("key", F.col("cid").alias("other"), F.col("comp").alias("other_comp"), F.col("n_set").alias("other_set"), *([F.col("place").alias("other_place")] if placed else []))
    fit = (F.col("cid") < F.col("other")) & (F.col("comp") != F.col("other_comp")) & alike("n_set", "other_set")
    if placed:
        left = F.least(F.col("n_set") - F.col("place"), F.col("other_set") - F.col("other_place")) + 1
        fit = fit & (left >= least_shared(F.col("n_set") + F.col("other_set")))
    return rows.join(other, "key").filter(fit).select(F.col("cid").alias("a"), F.col("other").alias("b"))


def least_shared(sizes):
    """Shingles that two sets at the threshold share at least, from the sum of their sizes."""
    return F.ceil(sizes * THRESHOLD / (100 + THRESHOLD) - 1e-9)


PREFIX = ["key", "cid", "n_set", "comp", "place", "common"]


def narrowed(rows: DataFrame) -> DataFrame:
    """Rows whose place still allows a link with the smallest set under their key, under keys of several components."""
    by = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n_set").alias("least_set"))
    by = by.filter("lo <> hi").select("key", "least_set")
    smallest = F.greatest(F.col("least_set"), F.ceil(F.col("n_set") * THRESHOLD / 100))
    fit = F.col("n_set") - F.col("place") + 1 >= least_shared(F.col("n_set") + smallest)
    return written(rows.join(by, "key").filter(fit).select(*PREFIX), "prefixes")


def prefix_rows(docs: DataFrame, crowded: DataFrame) -> DataFrame:
    """Keys for classes that share crowded buckets: the rarest quarter of each set (``key`` is a shingle).

    Two sets at the threshold share one of their ``n - ceil(threshold * n) + 1`` first shingles, whatever the order, so
    nothing is lost; a passage that stands in many documents is no key unless it is most of the document.
    """
    def explode(batches):
        for batch in batches:
            cid = batch.column("cid").to_numpy()
            for lo in range(0, batch.num_rows, 500):
                sets = list(shingle_sets(batch.column("text").slice(lo, 500), WORDS))
                flat = np.concatenate([s.view(np.int64) for s in sets])
                sizes = np.array([len(s) for s in sets], np.int64)
                own = np.array([xxhash.xxh3_64_intdigest(s.data) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, sizes)) for x in (cid[lo:lo + 500], own, sizes)] + [pa.array(flat)], ["cid", "own", "n_set", "key"])

    n = crowded.count()
    texts = docs.select(F.col("doc_id").alias("cid"), "text").join(small(crowded.select("cid").distinct(), n), "cid", "left_semi")
    rows = written(texts.mapInArrow(explode, "cid bigint, own bigint, n_set bigint, key bigint"), "crowded-shingles")
    comps = crowded.select("cid", "comp").distinct()
    rows = rows.join(small(comps, n), "cid")
    counts = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("df"), (F.min("comp") != F.max("comp")).alias("links")), "crowded-counts")
    first = F.dense_rank().over(Window.partitionBy("cid", "own").orderBy("links", "df", "key"))  # equal rows of the table rank alike
    prefix = F.col("n_set") - F.ceil(F.col("n_set") * THRESHOLD / 100) + 1
    common = F.avg("df").over(Window.partitionBy("cid", "own"))
    ranked = rows.join(counts, "key").withColumn("place", first).withColumn("common", common).filter(F.col("links") & (F.col("place") <= prefix))
    return written(ranked.select(*PREFIX), "prefixes")


def possible_pairs(rows: DataFrame) -> int:
    """Pairs of rows with one key and different components."""
    by = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return by.agg(F.sum(F.expr("CAST(n AS DECIMAL(38,0)) * n - same"))).first()[0] or 0


def hub_pairs(rows: DataFrame, rnd: int) -> DataFrame:
    """Pairs of a row and the hub of its key: at most one a row."""
    chosen = F.lit(rnd == 0) | (F.pmod(F.xxhash64(F.lit(rnd), F.col("cid")), F.lit(HUB_CHOICE)) == 0)
    hubs = rows.groupBy("key").agg(F.max(F.struct(chosen.alias("chosen"), "common", "cid", "comp", "n_set")).alias("h"))
    hubs = hubs.select("key", F.col("h.cid").alias("hub"), F.col("h.comp").alias("hub_comp"), F.col("h.n_set").alias("hub_set"))
    met = rows.join(hubs, "key").filter((F.col("comp") != F.col("hub_comp")) & alike("n_set", "hub_set"))
    met = met.groupBy("cid", "hub").agg(F.count(F.lit(1)).alias("times"))
    best = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("times"), "hub"))  # a set has a hub in each key at most
    return met.withColumn("rank", best).filter(F.col("rank") <= LEADERS).select(*ordered("cid", "hub")).distinct()


def gathered(rows: DataFrame, linker: Linker) -> DataFrame:
    """Prefix rows after the hub rounds, which go on while they join something and a join could make more pairs than there
    were rows at first."""
    enough, examined, joined = rows.count(), None, True
    for rnd in range(HUB_ROUNDS + 1):
        for _ in range(NARROWINGS):
            rows = narrowed(rows)
        if rnd == HUB_ROUNDS or not joined or possible_pairs(rows) <= enough:
            break
        before = linker.labels
        pairs = hub_pairs(rows, rnd)
        pairs = written(pairs if examined is None else pairs.join(examined, ["a", "b"], "left_anti"), "hub-pairs")
        examined = pairs if examined is None else examined.union(pairs)
        linker.examine(pairs)
        linker.settle()
        joined = linker.labels is not before
        rows = linker.component(rows.drop("comp"), "cid", "comp")
    return rows


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: ``n_shingles``, ``component_id`` and ``kept``."""
    with small_batches(docs.sparkSession):
        return _near_dedup(docs)


def _near_dedup(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", text_of().alias("text"))
    rows = written(signed(docs), "signatures")
    named = rows.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = written(named.groupBy("set_key").agg(F.min("doc_id").alias("cid")), "classes")
    own = named.join(classes.withColumnRenamed("set_key", "__k"), F.col("doc_id") == F.col("cid")).filter(F.col("set_key") == F.col("__k"))
    sigs = written(own.dropDuplicates(["cid", "set_key"]).select("cid", F.col("n_shingles").alias("n_set"), "sig"), "class-signatures")
    linker = Linker(docs, sigs)
    band = lambda i: F.xxhash64(F.lit(i), F.substring("sig", 1 + ROWS * i, ROWS))
    members = sigs.select("cid", "n_set", F.explode(F.array(*[band(i) for i in range(BANDS)])).alias("key"))
    for rnd in range(LEADER_ROUNDS):
        members, by = buckets(members.withColumn("rnd", F.lit(rnd)), linker)
        members = written(members.join(by, "key").select("key", "cid", "n_set", "n", "comp", "leader", "leader_comp", "leader_set"), "members")
        met = members.filter((F.col("comp") != F.col("leader_comp")) & alike("n_set", "leader_set")).groupBy("cid", "leader").agg(F.count(F.lit(1)).alias("times"))
        best = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("times"), "leader"))  # a member has a leader in each band at most
        pairs = met.withColumn("rank", best).filter(F.col("rank") <= LEADERS).select(*ordered("cid", "leader")).distinct()
        linker.examine(pairs)
    linker.settle()
    members, by = buckets(members.withColumn("rnd", F.lit(LEADER_ROUNDS)), linker)
    members = written(members.join(by, "key").select("key", "cid", "n_set", "n", "comp"), "members")
    few = members.filter(F.col("n") <= SMALL_BUCKET).select("key", "cid", "n_set", "comp")
    many = members.filter(F.col("n") > SMALL_BUCKET).select("cid", "n_set").distinct()
    linker.examine(across(few).distinct())
    linker.settle()
    prefixes = gathered(prefix_rows(docs, written(linker.component(many, "cid", "comp"), "crowded")), linker)
    linker.examine(across(prefixes).distinct())
    linker.settle()
    linker.join(same_id(named, classes))
    found = linker.component(classes, "cid", "component_id").select("set_key", "component_id")
    out = rows.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    # An empty text of an id that has other texts.
    empty = rows.filter("set_key IS NULL AND doc_id IS NOT NULL").select("doc_id").distinct()
    other = named.join(empty, "doc_id", "left_semi").join(found, "set_key").groupBy("doc_id").agg(F.min("component_id").alias("__other"))
    out = out.join(other, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "__other", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def same_id(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes of the different texts of one id."""
    several = named.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).filter("lo <> hi").select("doc_id")
    sets = named.select("doc_id", "set_key").join(several, "doc_id", "left_semi").distinct().join(classes, "set_key")
    least = sets.groupBy("doc_id").agg(F.min("cid").alias("a"))
    return sets.join(least, "doc_id").filter("a <> cid").select("a", F.col("cid").alias("b")).distinct()


def op2_near_dedup(spark, sf_dir):
    return near_dedup(documents(spark, sf_dir))


Q["op2_near_dedup"] = op2_near_dedup
