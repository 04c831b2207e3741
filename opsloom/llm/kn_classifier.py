"""Quality classifier: perplexity under an n-gram model of trusted text.

The model is an interpolated modified Kneser-Ney bigram model over all words of trusted documents (labels with quality 1
and toxic 0), named by 64-bit hashes, and one unknown word for those that never occur there. Nothing it gathers is capped
or held by the driver. Texts are coded once, in slices that stay where they are stored; a slice asks, part by part, for the
ids of its distinct words, for the counts of its distinct pairs of known words, and for the numbers of its known words, and
gets as many answers in the order in which it asked. A part of words or pairs adds up what the trusted texts of all slices
hold of them, so that one question counts and is answered. Ids grow with rarity, and what travels are gaps between sorted
ids, in compressed byte planes: one to two bytes a pair. A slice's documents are then costed in one task.

One trusted document in ``HELD`` (by the hash of its id) is kept out of the counts, so that its perplexity is that of new
text. Per language the threshold is the ``QUANTILE`` of these documents' log perplexities, on a grid of a thousandth; its
distance to their mean is drawn to that of all languages together, which counts as ``HELD_PRIOR`` more documents. Short
documents are drawn to the language's mean by ``PRIOR_WORDS`` words before they are compared.

Defined results: a null text or one without words has no perplexity and isn't kept; a null language, or one without
trusted documents, is held to the threshold of all trusted documents, and without any trusted document everything with
words is kept; a label without a document is ignored and null labels aren't trusted; rows that repeat an id are scored
each by its own text, equal rows under the smallest language they name; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from opsloom.llm.common import documents, shuffles_removed, small_batches, text_of
from opsloom.llm.shingles import fresh
from opsloom.session import work_path, written
from opsloom.sources.tables import table

Q, S = {}, {}

START, FIRST = 1, 2  # ids of a text's start and of the first word; 0 stands for unknown words
LOW = 0xFFFFFFFF
FREQUENT = 16  # so many words of each part deal their pairs out by both words
ZSTD = pa.Codec("zstd")
QUANTILE = 0.995
PRIOR_WORDS = 20
HELD = 5
HELD_PRIOR = 200  # held-out documents that a language's own quantile is weighed against
PART_WORDS = 8_000_000
SLICE_BYTES = 8_000_000
GRID = 1000
BROADCAST_IDS = 1_000_000


def plain(word: str) -> str:
    """The word with its first letter lower-cased and one closing mark removed."""
    word = word[:-1] if len(word) > 1 and word[-1] in ".,;:" else word
    return word[:1].lower() + word[1:]


def coded_words(texts: pa.Array, code_of):
    """Per stretch of texts: index of the first, ids of its words by ``code_of`` (a list of words to ids), and bounds."""
    texts = pc.fill_null(fresh(texts), "")
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES)))
        words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(fresh(texts[at:end])))
        bounds = np.asarray(words.offsets).astype(np.int64)
        bounds -= bounds[0]
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy(zero_copy_only=False)
        empty = np.fromiter((not n for n in names), bool, len(names))
        if empty.any():
            real = ~empty[code]
            bounds, code = np.concatenate([[0], np.cumsum(real)])[bounds], code[real]
        yield at, code_of(names), code, bounds
        at = end


def word_hashes(names: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(plain(n).encode()) for n in names), np.uint64, len(names))


def contexts_of(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The word before every word; a text starts after ``START``."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[bounds[:-1][bounds[:-1] < bounds[1:]]] = START
    return before


def packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers as byte planes as wide as the largest needs, compressed."""
    head, planes = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a).astype(np.uint64, copy=False)
        width = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
        head += [len(a), width]
        planes.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return np.array(head, np.int64).tobytes() + ZSTD.compress(b"".join(planes), asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8).reshape(-1, 2).tolist()
    raw = np.frombuffer(ZSTD.decompress(data[8 + 16 * n:], sum(k * w for k, w in head), asbytes=True), np.uint8)
    out, at = [], 0
    for k, width in head:
        a = np.zeros((k, 8), np.uint8)
        a[:, :width] = raw[at:at + k * width].reshape(width, k).T
        out.append(a.view(np.int64).ravel())
        at += k * width
    return out


def gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def found(known: np.ndarray, value: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values of ``asked`` in sorted ``known``, else 0."""
    if not len(known):
        return np.zeros(len(asked), np.int64)
    spot = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[spot] == asked, value[spot], 0)


def added(keys: list[np.ndarray], *values: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct keys, sorted, and the sums of each of ``values`` by key."""
    key, at = np.unique(np.concatenate([*keys, np.empty(0, keys[0].dtype if keys else np.int64)]), return_inverse=True)
    out = [np.zeros(len(key), np.int64) for _ in values]
    for total, v in zip(out, values):
        np.add.at(total, at, np.concatenate([*v, np.empty(0, np.int64)]))
    return [key, *out]


class Slice:
    """Coded texts of one row of ``slices``: its words by falling count, their codes, and its texts."""

    def __init__(self, data: bytes):
        hashes, self.code, self.n_words, self.known_id, self.text_hash, self.train = unpacked(data)
        self.hashes = hashes.view(np.uint64)
        self.bounds = np.concatenate([[0], np.cumsum(self.n_words)])

    def trained(self) -> np.ndarray:
        return np.repeat(self.train, self.n_words)

    def word_parts(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Words by part and hash, and where each part begins."""
        part = (self.hashes % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((self.hashes, part))
        return order, np.searchsorted(part[order], np.arange(parts + 1))

    def ids(self, parts: int, answers: dict[int, bytes]) -> np.ndarray:
        rank = self.by_word(parts, answers)
        return id_of(rank, (self.hashes % np.uint64(parts)).astype(np.int64), parts)

    def by_word(self, parts: int, answers: dict[int, bytes], column: int = 0, of: np.ndarray | None = None) -> np.ndarray:
        """An answered value of every word (0 without one); ``of`` says which words were asked for."""
        order, cuts = self.word_parts(parts)
        out = np.zeros(len(self.hashes), np.int64)
        for p, data in answers.items():
            at = order[cuts[p]:cuts[p + 1]]
            out[at if of is None else at[of[at] > 0]] = unpacked(data)[column]
        return out

    def pairs(self, ids: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
        """Word and word before, by id, of every place; which places hold known pairs, the place of each among the
        distinct pairs ordered by part, these pairs, and where each part begins."""
        words = ids[self.code]
        before = contexts_of(words, self.bounds)
        known = (before > 0) & (words > 0)
        asked, place = np.unique((before[known] << 32) | words[known], return_inverse=True)
        v, w = asked >> 32, asked & LOW
        part = np.where(v < FREQUENT * parts + FIRST, v + w, v) % parts  # pairs of a frequent word go to all parts
        order = np.argsort(part, kind="stable")
        to = np.empty(len(order), np.int64)
        to[order] = np.arange(len(order))
        return words, before, known, to[place], asked[order], np.searchsorted(part[order], np.arange(parts + 1))


def packed_pairs(pairs: np.ndarray, times: np.ndarray, part: int, parts: int) -> bytes:
    """Pairs of one part: what the part tells of a rare first word, or of the word after a frequent one, is left out."""
    v, w = pairs >> 32, pairs & LOW
    limit = FREQUENT * parts + FIRST
    heads, first, n = np.unique(v, return_index=True, return_counts=True)
    w = np.where(v < limit, w // parts, w)
    step = gaps(w)
    step[first] = w[first]
    return packed(gaps(np.where(heads < limit, heads, limit + heads // parts)), n, step, times)


def unpacked_pairs(data: bytes, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    heads, n, step, times = unpacked(data)
    limit = FREQUENT * parts + FIRST
    heads = np.cumsum(heads)
    heads = np.where(heads < limit, heads, (heads - limit) * parts + part)
    v, first, w = np.repeat(heads, n), np.cumsum(n) - n, np.cumsum(step)
    w -= np.repeat(w[first] - step[first], n)
    return (v << 32) | np.where(v < limit, w * parts + (part - v) % parts, w), times


def slices(rows: DataFrame) -> DataFrame:
    """``slice``, ``tokens``, ``data``: the coded texts, stored once in buckets of the slice, so they are never shuffled."""
    spark = rows.sparkSession

    def stretch(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= SLICE_BYTES:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def code(batches):
        number = TaskContext.get().partitionId() << 32
        for t in stretch(batches):
            columns = [t.column(c).to_numpy().astype(np.int64) for c in ("known_id", "text_hash", "train")]
            texts = t.column("text").cast(pa.large_string()).combine_chunks()
            for at, ids, surface, bounds in coded_words(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts, word_hashes):
                if not len(surface):
                    continue
                hashes, word = np.unique(ids, return_inverse=True)
                n = np.bincount(word[surface], minlength=len(hashes))
                order = np.argsort(-n, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                n_words = np.diff(bounds)
                data = packed(hashes[order], rank[word][surface], n_words, *[c[at:at + len(n_words)] for c in columns])
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(surface)]), pa.array([data], pa.binary())], ["slice", "tokens", "data"])
                number += 1
        pa.default_memory_pool().release_unused()

    path = work_path(spark, "kn-slices")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    made = rows.select("known_id", "text_hash", F.col("train").cast("bigint").alias("train"), "text").mapInArrow(code, "slice bigint, tokens bigint, data binary")
    with small_batches(spark):
        made.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "slice").option("path", path).saveAsTable(name)
    return spark.table(name)


ANSWER = "slice bigint, kind int, part int, data binary, sums array<bigint>"
WORD, PAIR, COST, TYPE, SUM = range(5)


def answers(rows: list[tuple]) -> pa.Table:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["slice", "kind", "part", "data", "sums"])


def asks(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["part", "slice", "data"])


ASK = "part int, slice bigint, data binary"


def word_ids(texts: DataFrame, parts: int) -> DataFrame:
    """For the words of every slice their ranks from 1, by falling count in trusted texts within a part; 0 for the others."""
    def ask(batches):
        for batch in batches:
            for number, data in zip(batch.column("slice").to_pylist(), batch.column("data")):
                s = Slice(data.as_py())
                n = np.bincount(s.code[s.trained() > 0], minlength=len(s.hashes))
                order, cuts = s.word_parts(parts)
                yield from asks([(p, number, packed(gaps(s.hashes[order[lo:hi]]), n[order[lo:hi]])) for p, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if lo < hi]).to_batches()

    def answer(table):
        part, asked, n = table.column("part")[0].as_py(), [], []
        for data in table.column("data"):
            h, k = unpacked(data.as_py())
            asked.append(np.cumsum(h.view(np.uint64), dtype=np.uint64))
            n.append(k)
        known, total = added([h[k > 0] for h, k in zip(asked, n)], [k[k > 0] for k in n])
        rank = np.empty(len(known), np.int64)
        rank[np.lexsort((known, -total))] = np.arange(1, len(known) + 1)
        if (len(known) + 1) * parts >> 31:
            raise ValueError("more words than 31-bit ids")
        return answers([(s, WORD, part, packed(found(known, rank, h)), None) for s, h in zip(table.column("slice").to_pylist(), asked)])

    return texts.select("slice", "data").mapInArrow(ask, ASK).groupBy("part").applyInArrow(answer, ANSWER)


def id_of(rank: np.ndarray, part: int, parts: int) -> np.ndarray:
    return np.where(rank > 0, (rank - 1) * parts + part + FIRST, 0)


def by_part(table: pa.Table, kind: int) -> dict[int, bytes]:
    rows = zip(table.column("kind").to_pylist(), table.column("part").to_pylist(), table.column("data"))
    return {p: data.as_py() for k, p, data in rows if k == kind}


def pair_counts(texts: DataFrame, ids: DataFrame, parts: int) -> DataFrame:
    """For the pairs of every slice their counts in trusted texts. Besides, for each part of words: ids, and what this part
    of pairs adds to their total as a context, to their pairs seen once, twice and more often, and to the words they
    follow; and sums over the pairs: how many were seen once to four times, and the start's total and pairs."""
    def ask(left, right):
        number, s = left.column("slice")[0].as_py(), Slice(left.column("data")[0].as_py())
        _, _, known, place, pairs, cuts = s.pairs(s.ids(parts, by_part(right, WORD)), parts)
        times = np.bincount(place[s.trained()[known] > 0], minlength=len(pairs))
        return asks([(p, number, packed_pairs(pairs[lo:hi], times[lo:hi], p, parts)) for p, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if lo < hi])

    def answer(table):
        part, asked, n = table.column("part")[0].as_py(), [], []
        for data in table.column("data"):
            pairs, k = unpacked_pairs(data.as_py(), part, parts)
            asked.append(pairs[k > 0])
            n.append(k[k > 0])
        known, total = added(asked, n)
        del asked, n
        out = [(s, PAIR, part, packed(found(known, total, unpacked_pairs(data.as_py(), part, parts)[0])), None) for s, data in zip(table.column("slice").to_pylist(), table.column("data"))]
        level = np.minimum(total, 3)
        stats = [total, *[(level == k).astype(np.int64) for k in (1, 2, 3)]]
        context, *stats = added([known >> 32], *[[x] for x in stats])
        start = context == START
        sums = [int((total == k).sum()) for k in range(1, 5)] + [int(x[start].sum()) for x in stats]
        word, follow = np.unique(known & LOW, return_counts=True)
        none = [np.zeros(len(word), np.int64)]
        word, *stats = added([context[~start], word], *[[x[~start], *none] for x in stats], [np.zeros(int((~start).sum()), np.int64), follow])
        to = (word - FIRST) % parts
        out += [(-1, TYPE, int(p), packed(gaps((word[to == p] - FIRST) // parts + 1), *[x[to == p] for x in stats]), None) for p in np.unique(to)]
        return answers([*out, (-1, SUM, part, None, sums)])

    made = texts.select("slice", "data").groupBy("slice").cogroup(ids.groupBy("slice")).applyInArrow(ask, ASK)
    return made.groupBy("part").applyInArrow(answer, ANSWER)


def word_counts(ids: DataFrame, stats: DataFrame) -> DataFrame:
    """For the known words of every slice their numbers as in ``pair_counts``, and sums over the words: how many, the words
    they follow, and how many follow one to four words."""
    def answer(table):
        part = table.column("part")[0].as_py()
        rows = list(zip(table.column("kind").to_pylist(), table.column("slice").to_pylist(), table.column("data")))
        parts = [unpacked(data.as_py()) for kind, _, data in rows if kind == TYPE]
        word, *stats = added([np.cumsum(p[0]) for p in parts], *[[p[i] for p in parts] for i in range(1, 6)])
        out = []
        for kind, s, data in rows:
            if kind == WORD:
                asked = unpacked(data.as_py())[0]
                out.append((s, COST, part, packed(*[found(word, x, asked[asked > 0]) for x in stats]), None))
        follow = stats[-1]
        sums = [int((follow > 0).sum()), int(follow.sum()), *[int((follow == k).sum()) for k in range(1, 5)]]
        return answers([*out, (-1, SUM, part, None, sums)])

    return ids.union(stats).groupBy("part").applyInArrow(answer, ANSWER)


def sums_of(df: DataFrame, n: int) -> list[int]:
    row = df.filter(F.col("kind") == SUM).agg(*[F.sum(F.col("sums")[i]) for i in range(n)]).first()
    return [x or 0 for x in row]


def discounts(of: list[int]) -> np.ndarray:
    """D1, D2, D3+ from the numbers of types seen once to four times, at place 0 none."""
    n1, n2, n3, n4 = (max(x, 1) for x in of)
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))])


def scored(rows: DataFrame) -> DataFrame:
    """``known_id``, ``text_hash``, ``words``, ``cost`` of every row of ``rows`` with words, under the pairs of those with ``train``."""
    spark = rows.sparkSession
    with shuffles_removed(spark):
        texts = slices(rows)
        tokens = texts.agg(F.sum("tokens")).first()[0] or 0
        parts = max(2 * spark.sparkContext.defaultParallelism, -(-tokens // PART_WORDS))
        ids = written(word_ids(texts, parts), "kn-ids")
        pairs = written(pair_counts(texts, ids, parts), "kn-pairs")
        counts = written(word_counts(ids, pairs.filter(F.col("kind") == TYPE)), "kn-words")
    *of, start_total, s1, s2, s3 = sums_of(pairs, 8)
    types, seen, *follows = sums_of(counts, 6)
    high, low = discounts(of), discounts(follows)
    base = 1.0 / (types + 1)  # all types and the unknown word
    rest = float(low[1] * follows[0] + low[2] * follows[1] + low[3] * (types - follows[0] - follows[1])) * base
    unknown = rest / seen if seen else base

    def cost(left, right):
        s = Slice(left.column("data")[0].as_py())
        ids, words = by_part(right, WORD), by_part(right, COST)
        ids, asked = s.ids(parts, ids), by_part(right, PAIR)
        total, n1, n2, n3, follow = (s.by_word(parts, words, i, ids) for i in range(5))
        word, before, known, place, pairs, cuts = s.pairs(ids, parts)
        n = np.zeros(len(pairs), np.int64)
        for p, data in asked.items():
            n[cuts[p]:cuts[p + 1]] = unpacked(data)[0]
        weight = lambda total, *n: np.where(total > 0, sum(k * d for k, d in zip(n, high[1:])) / np.maximum(total, 1), 1.0)
        lower = np.where(ids > 0, (np.maximum(follow - low[np.minimum(follow, 3)], 0.0) + rest) / max(1, seen), unknown)
        back = weight(total, n1, n2, n3)
        last = np.concatenate([[0], s.code[:-1]])
        starts = before == START
        totals = np.where(starts, start_total, total[last])
        p = np.where(starts, weight(np.array(start_total), *map(np.array, (s1, s2, s3))), back[last]) * lower[s.code]
        times = n[place]
        p[known] += np.maximum(times - high[np.minimum(times, 3)], 0.0) / np.maximum(totals[known], 1)
        full = s.n_words > 0
        costs = np.add.reduceat(-np.log(p), s.bounds[:-1][full])
        return pa.table([pa.array(x) for x in (s.known_id[full], s.text_hash[full], s.n_words[full], costs)], names=["known_id", "text_hash", "words", "cost"])

    answered = ids.union(pairs).union(counts).filter("slice >= 0").select("slice", "kind", "part", "data")
    return texts.select("slice", "data").groupBy("slice").cogroup(answered.groupBy("slice")).applyInArrow(cost, "known_id bigint, text_hash bigint, words bigint, cost double")


def thresholds(scores: DataFrame, quantile: float) -> DataFrame:
    """Per language, and over all of them (``all``): mean log perplexity and threshold of the held-out documents."""
    held = scores.filter("held AND n_words > 0")
    every = held.select(F.lit(None).cast("string").alias("lang"), "log_ppl", "n_words", F.lit(True).alias("all"))
    by = ["all", "lang"]
    rows = written(held.select("lang", "log_ppl", "n_words", F.lit(False).alias("all")).union(every), "kn-held")
    means = rows.groupBy(*by).agg((F.sum((F.col("log_ppl") * F.col("n_words")).cast("decimal(30,6)")) / F.sum("n_words")).cast("double").alias("mean"))
    drawn = rows.join(means.select(F.col("all").alias("__a"), F.col("lang").alias("__l"), "mean"), (F.col("all") == F.col("__a")) & F.col("lang").eqNullSafe(F.col("__l")))
    cell = F.floor((F.col("log_ppl") * F.col("n_words") + F.col("mean") * PRIOR_WORDS) / (F.col("n_words") + PRIOR_WORDS) * GRID).cast("bigint")
    cells = drawn.groupBy(*by, "mean", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*by)  # cells of the grid, not documents
    ranked = cells.withColumn("upto", F.sum("n").over(whole.orderBy("cell"))).withColumn("total", F.sum("n").over(whole))
    cut = written(ranked.groupBy(*by, "mean").agg(
        F.min(F.when(F.col("upto") >= F.col("total") * quantile, F.col("cell") + 1)).alias("at"), F.max("total").alias("total")), "kn-quantiles")
    above = F.col("at") / float(GRID) - F.col("mean")
    pooled = cut.filter("all").select(above.alias("above")).first()
    drawn = (F.col("total") * above + HELD_PRIOR * (pooled["above"] if pooled else 0.0)) / (F.col("total") + HELD_PRIOR)
    return written(cut.select(*by, "mean", (F.col("mean") + drawn).alias("cut")), "kn-thresholds")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row per document: ``lang``, ``n_words``, ``perplexity``, ``threshold`` (as a perplexity) and ``kept``."""
    spark = docs.sparkSession
    good = labels.filter("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("__good")).distinct()
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    rows = docs.select("doc_id", "lang", text_of().alias("text")).join(good, F.col("doc_id") == F.col("__good"), "left").select(
        "doc_id", "lang", F.col("__good").isNotNull().alias("trusted"), (F.pmod(F.xxhash64("__good"), F.lit(HELD)) == 0).alias("held"), F.coalesce("doc_id", F.lit(-1)).alias("known_id"), F.xxhash64("text").alias("text_hash"), "text")
    sums = scored(rows.withColumn("train", F.col("trusted") & ~F.col("held"))).groupBy("known_id", "text_hash").agg(
        F.sum("words").alias("words"), F.sum(F.round("cost", 6).cast("decimal(30,6)")).alias("cost"))
    same = rows.groupBy("known_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("doc_id"), F.min("lang").alias("lang"), F.max("held").alias("held"))
    scores = same.join(sums, ["known_id", "text_hash"], "left").select(  # equal rows have been added up
        "doc_id", "lang", "held", "rows", F.coalesce((F.col("words") / F.col("rows")).cast("bigint"), F.lit(0)).alias("n_words"),
        (F.col("cost").cast("double") / F.col("words")).alias("log_ppl"))
    with shuffles_removed(spark):
        scores = written(scores, "kn-scores")
    cut = thresholds(scores, quantile)
    per_lang = cut.filter(~F.col("all")).select(F.col("lang").alias("__l"), "mean", "cut")
    overall = cut.filter("all").select("mean", "cut").first()
    mean, limit = (overall["mean"], overall["cut"]) if overall else (0.0, float("inf"))
    joined = scores.join(F.broadcast(per_lang) if per_lang.count() <= 10_000 else per_lang, F.col("lang").eqNullSafe(F.col("__l")), "left")
    mean, limit = F.coalesce("mean", F.lit(mean)), F.coalesce("cut", F.lit(limit))
    drawn = (F.col("log_ppl") * F.col("n_words") + mean * PRIOR_WORDS) / (F.col("n_words") + PRIOR_WORDS)
    kept = F.coalesce((F.col("n_words") > 0) & (drawn < limit), F.lit(False))
    joined = joined.withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
    return joined.select("doc_id", "lang", "n_words", F.round(F.exp("log_ppl"), 4).alias("perplexity"), F.round(F.exp(limit), 4).alias("threshold"), kept.alias("kept"))


def op3_quality_classifier(spark, sf_dir):
    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


Q["op3_quality_classifier"] = op3_quality_classifier
