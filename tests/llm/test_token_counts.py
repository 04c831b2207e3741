import random

import pytest
from sentencepiece import SentencePieceProcessor

from opsloom.llm import token_counts as M
from tests.llm.helpers import ODD, SMALL, documents, empty, given, odd_rows, same_rows

LIBRARY = SentencePieceProcessor(model_file=M.vocabulary_file())
MORE = [
    " a  b\n\tc <s> é ½ ﬁ 中", "▁x▁▁y", " ", "   ", "\n", "\n\n  \n a", "<0x41> </s> <unk>", "a" * 5000, "aaaa 한국어 " * 50,
    "\U0001f600‍\U0001f469 é", "x\x00y\x00", "\r\n a \r", " 　 z", "def f(x):\n        return x\n", " " * 1000 + "end", "中文" * 2000, "=" * 777,
]


def expected(text):
    return len(LIBRARY.encode(text or ""))


def test_given_table(spark):
    rows = M.Q["op13_token_counts"](spark, SMALL).collect()
    want = [(i, len((t or "").encode()), expected(t), expected(t) > 4096) for i, t, _ in given()]
    assert same_rows(want, [tuple(r) for r in rows])


def test_odd_texts(spark):
    texts = ODD + MORE
    rows = M.token_counts(documents(spark, texts, clash=True)).collect()
    want = [(i, len((t or "").encode()), expected(t), expected(t) > 4096) for i, t in odd_rows(documents(spark, texts))]
    assert same_rows(want, [tuple(r) for r in rows])
    assert M.token_counts(empty(spark)).count() == 0
    assert M.token_counts(documents(spark), limit=3).filter("over_limit").count() == M.token_counts(documents(spark)).filter("n_tokens > 3").count()


def test_random_texts():
    known, rng = M.Units(M.vocabulary_file()), random.Random(13)
    pieces = [LIBRARY.id_to_piece(i) for i in range(LIBRARY.get_piece_size())]
    for _ in range(1500):
        text = "".join(rng.choice(pieces if rng.random() < 0.6 else list(" \n▁abéß中\U0001f600.,<>")) for _ in range(rng.randint(1, 40)))
        assert known.count(text) == expected(text), repr(text)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(M, "KNOWN_CHARS", 100)
    known = M.Units(M.vocabulary_file())
    for k in range(200):
        text = f"word{k} other{k * k} last"
        assert known.count(text) == expected(text)
        assert known.chars <= 200


def test_merge_takes_in_a_character_without_a_piece():
    assert M.merges(list("aé"), {"ab": 1, "b": 5}, [1, 2]) == 3
    assert M.merges(list("éb"), {"éb": 1, "b": 2}, [2, 1]) == 1


def test_other_kinds_are_refused():
    import public_tokenizers

    with pytest.raises(Exception):
        M.Units(public_tokenizers.path("word_bpe_49k.json"))
