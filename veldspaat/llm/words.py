"""Words and word shingles of whole Arrow batches.

A word is a longest run of Unicode letters and digits, lower-cased. Combining marks end a word: texts aren't normalised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_GAP = r"[^\p{L}\p{Nd}]+"


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the offsets where each text's words begin (one more than texts).

    A null text has no words.
    """
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())), _GAP)
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    counted = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(full.to_numpy(zero_copy_only=False), out=counted[1:])
    return flat.filter(full), counted[bounds]


def word_codes(flat: pa.Array) -> np.ndarray:
    """64-bit hash of each word; each distinct word of the batch is hashed once."""
    encoded = flat.dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in encoded.dictionary.to_pylist()], np.uint64)
    return hashes[encoded.indices.to_numpy()] if len(flat) else np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(codes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of ``width`` consecutive words of each text, as sorted 64-bit hashes: (hashes, offsets)."""
    n = len(codes) - width + 1
    texts = len(offsets) - 1
    if n <= 0:
        return np.empty(0, np.uint64), np.zeros(texts + 1, np.int64)
    value = np.zeros(n, np.uint64)
    for k in range(width):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
    text = np.repeat(np.arange(texts), np.diff(offsets))[:n]
    inside = np.arange(n) + width <= offsets[text + 1]
    value, text = value[inside], text[inside]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(texts + 1))
