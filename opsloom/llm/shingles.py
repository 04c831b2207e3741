"""Word shingle sets of whole texts, as sorted distinct 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 3_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)  # odd multipliers, one for each place in a shingle


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


def fresh(texts: pa.Array) -> pa.Array:
    """The strings in buffers of their own: some kernels misread arrays that start inside a buffer."""
    return texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, and the bounds of each text's words. A-Z are lower-cased."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    bounds = np.asarray(words.offsets).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    bounds = bounds - bounds[0]
    empty = np.fromiter((not w for w in names), bool, len(names))
    if empty.any():
        real = ~empty[code]
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        code = code[real]
    return hashed[code], bounds


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """One array per text: the sorted distinct hashes of its runs of ``size`` words; with fewer words the whole text is
    the only one; without words it is empty."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES)))
        words, bounds = word_hashes(fresh(texts[at:end]))
        n = max(0, len(words) - size + 1)
        runs = np.zeros(n, np.uint64)
        for k in range(size):
            runs += words[k:k + n] * _MIX[k]
        runs = _mixed(runs)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo >= size:
                yield np.unique(runs[lo:hi - size + 1])
            elif hi > lo:
                yield _mixed((words[lo:hi] * _MIX[:hi - lo]).sum(dtype=np.uint64, keepdims=True) + np.uint64(hi - lo))
            else:
                yield np.empty(0, np.uint64)
        at = end
    pa.default_memory_pool().release_unused()
