"""Words of whole texts as Arrow arrays, found on their bytes: no Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z to a-z on bytes; in UTF-8 no other character has such bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(text: bytes) -> np.ndarray:
    """The bytes of a text, A-Z lower-cased."""
    return LOWER[np.frombuffer(text, np.uint8)]


def words_of(text: np.ndarray, in_word: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The maximal runs of bytes that ``in_word`` (256 booleans) allows, and where each begins."""
    inside = in_word[text]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts = edges[::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(edges[1::2] - starts, out=offsets[1:])
    kept = np.ascontiguousarray(text[inside])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]), starts


def coded(words: pa.LargeBinaryArray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """A number for each word, and the distinct words by number."""
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
