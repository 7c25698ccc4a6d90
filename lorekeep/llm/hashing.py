"""64-bit hashes of many byte runs at once, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
#: Runs of more bytes are hashed one by one, by BLAKE2b.
LONG = 512
SEED_1, SEED_2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
ODD = U(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def run_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each data[begin:end]. Eight bytes at a time go through two chains of mixing steps, one joined
    by exclusive or, one by a sum; so no linear relation between runs survives, as it does in polynomial
    hashes.
    """
    length = end - begin
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    one, two = mix(length.astype(U) ^ SEED_1), mix(length.astype(U) * ODD + SEED_2)
    own, at = np.flatnonzero(length <= LONG), 0
    while len(own):
        own = own[length[own] > at]
        x, left = words[begin[own] + at], length[own] - at
        short = left < 8
        x[short] &= (U(1) << (left[short].astype(U) * U(8))) - U(1)
        one[own], two[own] = mix(one[own] ^ x), mix(two[own] + x * ODD)
        at += 8
    out = mix(one + (two ^ (two >> U(29))) * ODD)
    for k in np.flatnonzero(length > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[begin[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out
