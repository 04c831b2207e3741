"""Token counts of whole texts by heap-and-linked-list byte-pair merging.

The characters of a text are a linked list of symbols. All adjacent pairs that make a piece of the vocabulary wait in a
heap, lowest rank first and, among equal ranks, leftmost first; the top is merged, its neighbours make new pairs, and pairs
whose symbols have changed meanwhile are passed over. The count is the number of initial symbols less the merges; a
character that the vocabulary lacks counts as its UTF-8 bytes until a merge takes it in. No identifiers are made.

Pairs never reach across places where no piece can lie, so a text is cut there and every distinct unit is merged once per
worker: before a blank that follows something else, around line breaks and tabs, and after a Latin letter or digit that
neither follows. Each cut is made only if no piece of the vocabulary contradicts (at worst the text stays whole). Units and
texts may have any length: the heap is n log n. One pass over the documents without a shuffle; a worker holds the
vocabulary and a bounded memory of units.

Vocabularies of the library's BPE kind are supported whose normaliser leaves texts alone (blanks become the blank mark, one
is put in front) and which fall back to bytes; others are refused.

Defined results: a null text is empty; an empty text has 0 tokens; rows that repeat an id, or have none, are counted each
by its own text; strings of special pieces inside texts are ordinary text; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from opsloom.llm.common import documents, text_of

Q, S = {}, {}

LIMIT = 4096
BLANK = "▁"
ALONE = "\n\t\r"
ROWS = 256  # texts turned into Python strings at a time
WORD = "A-Za-z0-9\u00c0-\u024f"
UNIT_CHARS, KNOWN_CHARS = 64, 6_000_000  # longest unit that is remembered, characters remembered in all


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def merges(symbols: list[str], ranks: dict[str, int], width: list[int]) -> int:
    """Tokens of a list of initial symbols, each of which counts as its ``width`` while it stands alone.

    An entry of the heap is one number: rank, place of the left symbol, size of the pair. A symbol only grows, so a pair
    whose size is what it was has the same two symbols.
    """
    n = len(symbols)
    total = sum(width)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    rank_of = ranks.get
    heap = []
    for i in range(n - 1):
        pair = symbols[i] + symbols[i + 1]
        rank = rank_of(pair)
        if rank is not None:
            heap.append((rank << 40 | i) << 24 | len(pair))
    heapify(heap)
    while heap:
        top = heappop(heap)
        i, size = top >> 24 & 0xFFFFFFFFFF, top & 0xFFFFFF
        j = right[i]
        if j == n or not symbols[i] or len(symbols[i]) + len(symbols[j]) != size:
            continue
        merged = symbols[i] = symbols[i] + symbols[j]
        symbols[j] = ""
        total -= width[i] + width[j] - 1
        width[i] = 1
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            pair = merged + symbols[k]
            rank = rank_of(pair)
            if rank is not None:
                heappush(heap, (rank << 40 | i) << 24 | len(pair))
        h = left[i]
        if h >= 0:
            pair = symbols[h] + merged
            rank = rank_of(pair)
            if rank is not None:
                heappush(heap, (rank << 40 | h) << 24 | len(pair))
    return total


class Units(dict):
    """Tokens of units, counted when first asked for; short ones are remembered up to a bounded size."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces = {i: model.id_to_piece(i) for i in range(model.get_piece_size())}
        plain = [i for i in pieces if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        probe = "  AÉﬁ ½\t\n　x  "
        if sum(map(model.is_byte, pieces)) != 256 or SentencePieceNormalizer(model_file=path).normalize(probe) != BLANK + probe.replace(" ", BLANK):
            raise ValueError("this vocabulary changes texts or has no bytes to fall back to")
        order = {x: n for n, x in enumerate(sorted({-model.get_score(i) for i in plain}))}
        self.ranks = {pieces[i]: order[-model.get_score(i)] for i in plain}
        long = [p for p in self.ranks if len(p) > 1]
        alone = "".join(c for c in ALONE if not any(c in p for p in long))
        ends = re.compile(f"[{WORD}][^{WORD}]")
        if any(BLANK in p.lstrip(BLANK) for p in long):
            unit = r"[\s\S]+"
        elif any(map(ends.search, long)):
            unit = f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+"
        else:
            unit = f"{BLANK}*[^{WORD}{BLANK}{alone}]*[{WORD}]+|{BLANK}*[^{WORD}{BLANK}{alone}]+|{BLANK}+"
        self.unit = re.compile(unit + (f"|[{alone}]" if alone else ""))
        self.chars = 0

    def __missing__(self, unit: str) -> int:
        if unit in self.ranks and len(unit) == 1:
            n = 1
        else:
            symbols = list(unit)
            n = merges(symbols, self.ranks, [1 if c in self.ranks else len(c.encode()) for c in symbols])
        if len(unit) <= UNIT_CHARS:
            if self.chars > KNOWN_CHARS:  # texts have changed since the memory was filled
                self.clear()
                self.chars = 0
            self.chars += len(unit)
            self[unit] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.unit.findall(BLANK + text.replace(" ", BLANK))))


@lru_cache(maxsize=1)
def units(path: str) -> Units:
    return Units(path)


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every row."""
    path = vocabulary or vocabulary_file()

    def run(batches):
        known = units(path)
        for batch in batches:
            texts = batch.column("text")
            counts = [known.count(t) for lo in range(0, len(texts), ROWS) for t in texts.slice(lo, ROWS).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir))


Q["op13_token_counts"] = op13_token_counts
