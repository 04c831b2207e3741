"""Token ids of whole texts, word by word.

The tokenizers of this kind drop white space and never look across it, so a text's ids are its words' ids one after the
other. Words are dictionary-encoded per slice of a batch and only new words meet the tokenizer; a bounded cache of words
lives in the worker. Results equal those of the whole text, which the tests check.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from opsloom.llm.shingles import fresh

SLICE_BYTES = 3_000_000
CACHED_WORDS = 250_000  # of up to 40 characters, and as many of before the last change: some 100 MB
LONGEST_CACHED = 40
PLAIN_ROWS = 1 << 14  # words that are cut in one go

PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")
# Characters that lower-case one to one and that composition leaves alone: words of these need no full normalisation.
PLAIN = regex.compile(r"[!-~\u00a1-\u012f\u0131-\u024f]+")


def pack_ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _byte_names() -> dict[int, str]:
    """How byte-level vocabularies write a byte: printable Latin-1 as itself, the others as characters from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds:
    """Ids of words under one tokenizer file as little-endian unsigned 32-bit bytes, with a bounded cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.names = _byte_names()
        self.words: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}  # the words cached before the last change
        self.pieces: dict[str, bytes] = {"\n": b""}
        self.passed = 0  # words met since the cache is full
        self.special = regex.compile("|".join(regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        known = self.pieces
        out = list(map(known.get, pieces))
        for i, ids in enumerate(out):
            if ids is None:
                piece = pieces[i]
                ids = known.get(piece)  # met earlier in this list
                if ids is None:
                    named = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.names)
                    ids = pack_ids([t.id for t in self.model.tokenize(named)])
                    if len(known) < CACHED_WORDS and len(piece) <= LONGEST_CACHED:
                        known[piece] = ids
                out[i] = ids
        return out

    def _plain(self, words: list[str]) -> Iterator[bytes]:
        """Ids of plain words: all are cut in one go, a line break tells one from the next."""
        pieces = PIECES.findall("\n".join(words).lower())
        ids = self._pieces(pieces)
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        breaks = [i for i, piece in enumerate(pieces) if piece == "\n"]
        bounds = [0, *ends[breaks].tolist(), int(ends[-1]) if ids else 0]
        flat = b"".join(ids)
        return (flat[a:b] for a, b in zip(bounds, bounds[1:]))

    def of(self, words: list[str]) -> list[bytes]:
        if self.passed > CACHED_WORDS:  # the words have changed since the cache was filled
            self.older, self.words, self.pieces, self.passed = self.words, {"": b""}, {"\n": b""}, 0
        known, older, room = self.words, self.older, max(0, CACHED_WORDS - len(self.words))
        out = list(map(known.get, words))
        plain, odd = [], []
        for i, ids in enumerate(out):
            if ids is None:
                word = words[i]
                ids = out[i] = older.get(word)
                if ids is None:
                    (plain if PLAIN.fullmatch(word) and not ("<" in word and self.special.search(word)) else odd).append(i)
                else:  # still met: it outlives the next change of the cache
                    if room > 0:
                        known[word] = ids
                    room -= 1
        for lo in range(0, len(plain), PLAIN_ROWS):
            part = plain[lo:lo + PLAIN_ROWS]
            for i, ids in zip(part, self._plain([words[i] for i in part])):
                out[i] = ids
                if room > 0 and len(words[i]) <= LONGEST_CACHED:
                    known[words[i]] = ids
                room -= 1
        self.passed += max(0, -room)
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)):
            out[i] = pack_ids(e.ids)
        return out

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For stretches of ``texts``: index of the first, ids of all in a row, and the bounds of each text's ids."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES)))
            part = pc.fill_null(fresh(texts[at:end]), "")
            words = pc.ascii_split_whitespace(part)
            plain = words.flatten()
            if not pc.any(pc.match_substring(part, "<|")).as_py():  # else lower-casing could make a special token
                plain = pc.ascii_lower(plain)
            bounds = np.asarray(words.offsets) - words.offsets[0].as_py()
            coded = plain.dictionary_encode()
            if isinstance(coded, pa.ChunkedArray):
                coded = coded.combine_chunks()
            code = coded.indices.to_numpy(zero_copy_only=False)
            ids = self.of(coded.dictionary.to_pylist())
            flat = np.frombuffer(b"".join(ids), "<u4")
            width = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            first = np.cumsum(width) - width
            n = width[code]
            ends = np.concatenate([[0], np.cumsum(n)])
            index = np.repeat((first[code] - ends[:-1]).astype(np.int32), n) + np.arange(ends[-1], dtype=np.int32)  # a slice has fewer ids than that
            yield at, flat[index], ends[bounds]
            at = end
        pa.default_memory_pool().release_unused()


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
