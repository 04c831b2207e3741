import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given as examples, settings, strategies as st

from opsloom.llm import spelling_variants as M
from tests.llm.helpers import LOWER, ODD, SMALL, documents, empty, given, odd_rows, same_rows

RUN = re.compile("[A-Za-zÀ-ÿ]+")
COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def counted(rows, injure=True):
    seen = Counter()
    for i, text in rows:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            seen[run[:h % len(run)] + run[h % len(run) + 1:] if injure and h % 97 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    by_length = defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    form, n_near = {}, {}
    for w, n in counts.items():
        found = [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if near(w, v)]
        n_near[w] = len(found)
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], counts[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def test_given_table(spark):
    got = rows_of(M.Q["op12_spelling_variants"](spark, SMALL))
    want = brute(counted([(i, t) for i, t, _ in given()]))
    assert same_rows(want, got)
    assert any(r[1] for r in got) and any(r[4] > 1 for r in got)


def test_odd_texts(spark):
    texts = ODD + ["colour colour colour color Color cölor coloor olour colour colour " * 3, "aaaaa aaaaaa aaaaaaa aaaaa aaaaaa aaaaaaa aaaaa aaaaaa aaaaaaa", "z" * 9000 + " " + "z" * 9001, "ÿÀ×÷ß" * 5]
    for injure in (True, False):
        got = rows_of(M.spelling_variants(documents(spark, texts, clash=True), injure))
        assert same_rows(brute(counted(odd_rows(documents(spark, texts)), injure)), got)
    assert rows_of(M.spelling_variants(empty(spark))) == []
    assert rows_of(M.spelling_variants(documents(spark, ["few words here"]))) == []


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n bigint")


def test_long_words_and_ties(spark):
    long = "lang" * 3000
    counts = {long: 5, long + "x": 5, "y" + long: 10, long[:-1]: 20, "abcde": 3, "abcdf": 3, "abcdg": 6, "abcd": 6, "bcdef": 3}
    assert same_rows(brute(counts), rows_of(M.variants(table(spark, counts))))


def test_chain_goes_to_the_root(spark):
    words = ["aaaaaaaaaa"[:k] + "bbbbbbbbbbbb"[k:12] for k in range(12)]
    counts = {w: 2 ** (k + 2) for k, w in enumerate(words)}
    got = rows_of(M.variants(table(spark, counts)))
    assert same_rows(brute(counts), got) and len({r[2] for r in got}) == 1


@settings(max_examples=6, deadline=None)
@examples(st.lists(st.text("abé", min_size=1, max_size=7), min_size=1, max_size=120, unique=True), st.integers(0, 9))
def test_random_words(spark, words, seed):
    counts = {w: 3 + (len(w) * 7 + i * seed) % 11 for i, w in enumerate(words)}
    assert same_rows(brute(counts), rows_of(M.variants(table(spark, counts))))


def test_trie_numbers_do_not_depend_on_partitions(spark):
    words = sorted({w for i, t, _ in given() for w in RUN.findall(t or "")})[:4000] + ["z" * 300]
    df = spark.createDataFrame(list(enumerate(words)), "id bigint, word string")
    shapes = []
    for parts in (1, 7, 61):
        numbers, named = {}, {}
        for r in M.trie(df, parts).collect():
            word = words[r["id"]]
            assert len(r["nodes"]) == len(word) + 1 and r["fresh"] == [i == 0 or word[i - 1] != c for i, c in enumerate(word)]
            for d, x in enumerate(r["nodes"]):
                assert numbers.setdefault(x, word[:d]) == word[:d] and named.setdefault(word[:d], x) == x
        shapes.append(len(numbers))
    assert len(set(shapes)) == 1
