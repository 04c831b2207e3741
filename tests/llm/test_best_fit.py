import random
import zlib
from array import array
from collections import defaultdict

import pyarrow as pa
from tokenizers import Tokenizer

from opsloom.llm import best_fit as M
from opsloom.llm.word_ids import WordIds
from tests.llm.helpers import ODD, SMALL, documents, empty, given, odd_rows, same_rows

TOKENIZER = Tokenizer.from_file(M.tokenizer_file())


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, texts):
    """Every document's pieces are its ids in order, and sequences are gapless and not too long."""
    want, sequences = [], defaultdict(list)
    for i, t in texts:
        ids = ids_of(t)
        want += [(i, k, s, len(ids[s:s + 2048]), zlib.crc32(array("I", ids[s:s + 2048]).tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert same_rows(want, [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows])
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return sequences


def decreasing(lengths, capacity):
    """Sequences of best-fit decreasing, piece by piece."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - n)
    return len(gaps)


def test_given_table(spark):
    rows = M.Q["op9_best_fit"](spark, SMALL).collect()
    sequences = check(rows, [(i, t) for i, t, _ in given()])
    assert len(sequences) == decreasing([r["length"] for r in rows], 2048) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_odd_texts(spark):
    rows = M.pack(documents(spark)).collect()
    check(rows, odd_rows(documents(spark)))
    assert len(M.pack(documents(spark, clash=True)).collect()) == len(rows)
    assert M.pack(empty(spark)).count() == 0
    with_ids = M.pack(documents(spark), with_ids=True).collect()
    assert all(zlib.crc32(array("I", r["ids"]).tobytes()) == r["ids_crc32"] for r in with_ids)


def test_rounds_equal_piece_by_piece_packing():
    rng = random.Random(4)
    for _ in range(80):
        capacity = rng.choice((10, 50, 100))
        lengths = [min(capacity, max(1, int(rng.expovariate(4 / capacity)))) for _ in range(rng.randrange(1, 300))]
        counts = defaultdict(int)
        for n in lengths:
            counts[n] += 1
        plan, used = M.plan_rounds(counts, capacity), defaultdict(int)
        for size in counts:
            rows = sorted(map(tuple, plan[plan[:, 0] == size]), key=lambda r: r[1])
            for rank in range(counts[size]):
                row = [r for r in rows if r[1] <= rank][-1]
                k = rank - row[1]
                assert row[4] + k % row[3] * size + size <= capacity
                used[row[2] + k // row[3]] += size
        assert max(used.values()) <= capacity and len(used) == decreasing(lengths, capacity)


def test_word_ids_equal_the_tokenizer(monkeypatch):
    from opsloom.llm import word_ids as W

    monkeypatch.setattr(W, "SLICE_BYTES", 5000)
    monkeypatch.setattr(W, "CACHED_WORDS", 50)
    texts = [t for _, t, _ in given()][:60] + ODD + [
        "İstanbul ΣΑΣ ½ ² x² naïve 'S 'LL it's <|ENDOFTEXT|> a<|endoftext|>b <|startoftext|>", "日本語 テスト é́ ​ zero break \x85 \x01\x7f", "ǅ ĳ ŉ ß ẞ ﬁ"]
    coder, arr = WordIds(M.tokenizer_file()), pa.array([None, *texts]).slice(1)
    for at, flat, bounds in coder.slices(arr):
        for k in range(len(bounds) - 1):
            assert flat[bounds[k]:bounds[k + 1]].tolist() == ids_of(texts[at + k])[:-1], texts[at + k][:80]


def test_frequent_words_outlive_a_change_of_the_cache(monkeypatch):
    from opsloom.llm import word_ids as W

    monkeypatch.setattr(W, "CACHED_WORDS", 50)
    coder = WordIds(M.tokenizer_file())
    met, model = [], coder.model

    class Counting:
        def tokenize(self, piece):
            met.append(piece)
            return model.tokenize(piece)

    coder.model = Counting()
    letters = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(676)]
    coder.of(["common", *letters[:60]])
    coder.of(letters[60:130])
    assert coder.of(["common"]) == [W.pack_ids(ids_of("common")[:-1])]
    assert met.count("common") == 1 and len(coder.words) <= 51 and len(coder.older) <= 51
