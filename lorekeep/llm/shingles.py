"""Word shingles of many texts at once, hashed in numpy without a Python object a word."""

from __future__ import annotations

import numpy as np

from .decontaminate import TO_WORDS
from .hashing import mix, run_hashes

SHINGLE = 5
#: A shingle is its hash's upper bits; a batch's text number takes the rest while sorting.
ID_BITS = 52
MAX_TEXTS = 1 << (64 - ID_BITS)
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts in a row, and where each text's words begin (and the last one's end)."""
    raw = [x.encode() for x in texts]
    stops = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)))
    data = np.frombuffer(b" ".join([*raw, b""]).translate(TO_WORDS), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    return run_hashes(data, begin, end), np.searchsorted(begin, np.concatenate([[0], stops]))


def shingled(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: ids and counts, text by text, where each text's begin (and the last one's end), and two
    hashes of every text's word sequence. A text of fewer words, but not none, is one shingle.
    """
    assert len(texts) <= MAX_TEXTS
    hashes, bounds = word_hashes(texts)
    n_words = np.diff(bounds)
    text = np.repeat(np.arange(len(texts)), n_words)
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], n_words)
    whole = np.zeros((2, len(texts)), np.uint64)
    if len(hashes):
        some = n_words > 0
        for k in range(2):
            terms = mix(hashes + U(k * 2 + 1) * mix(place.astype(np.uint64) + U(k)))
            whole[k][some] = np.add.reduceat(terms, bounds[:-1][some])
    rolled = np.zeros(len(hashes), np.uint64)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    left = np.repeat(n_words, n_words) - place
    for k in range(SHINGLE):
        part = padded[k : k + len(hashes)] * U((2 * k + 3) * BASE & (1 << 64) - 1)
        rolled += np.where(left > k, part, U(0))
    starts = (left >= SHINGLE) | (place == 0)
    keys = np.sort((text[starts].astype(np.uint64) << U(ID_BITS)) | (mix(rolled[starts]) >> U(64 - ID_BITS)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(keys)))
    distinct = keys[first]
    begins = np.searchsorted(distinct >> U(ID_BITS), np.arange(len(texts) + 1, dtype=np.uint64))
    return distinct & U((1 << ID_BITS) - 1), counts, begins, whole[0], whole[1]
