"""Byte-level BPE encoding and decoding.

Pre-tokenisation is a finite-state scan over code-point classes (``scan``), not
a regular expression. The slices it locates feed pair merging, whose results
are cached. Decoding gathers the tokens' bytes by retained offsets.

Defined results: a null text counts as empty; an empty text has no tokens, and
the digests of no bytes; repeated rows give repeated results; an empty table
gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, scan

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct slices whose ids a worker keeps; beyond it the cache starts anew.
CACHE_SIZE = 700_000
#: Slices of more bytes are merged each time they occur.
CACHE_BYTES = 64


class Codec:
    def __init__(self, name: str = VOCABULARY, cache_size: int = CACHE_SIZE) -> None:
        with open(public_tokenizers.path(name), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        by_id = sorted((b, a) for a, b in self.ranks.items())
        size = by_id[-1][0] + 1
        lengths = np.zeros(size, np.int64)
        for b, a in by_id:
            lengths[b] = len(a)
        self.lengths, self.offsets = lengths, np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = np.frombuffer(b"".join(a for _, a in by_id), np.uint8)
        self.cache_size = cache_size
        self.cached = Cached(self)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one slice: the lowest-ranked pair, leftmost first, is merged until none is left."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 200:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = 1 << 40
        scores = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = min(scores)
            if best == none:
                break
            k = scores.index(best)
            parts[k] += parts.pop(k + 1)
            scores.pop(k)
            if k:
                scores[k - 1] = ranks.get(parts[k - 1] + parts[k], none)
            if k < len(scores):
                scores[k] = ranks.get(parts[k] + parts[k + 1], none)
        return [ranks[x] for x in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """As merge, with a heap and linked parts, for slices of any length."""
        import heapq

        ranks, n = self.ranks, len(piece)
        ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or ends[i] >= end or ends[i] >= n or ends[ends[i]] != end:
                continue
            alive[ends[i]] = False
            ends[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (j := before[i]) >= 0 and (r := ranks.get(piece[j:end])) is not None:
                heapq.heappush(heap, (r, j, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "\0".join(texts) + "\0"
        stops = np.cumsum(lengths + 1) - 1
        starts = scan.spaced().starts(scan.classify(scan.code_points(joined), stops))
        cuts = starts.tolist()
        firsts = np.searchsorted(starts, np.concatenate([[0], stops[:-1] + 1])).tolist()
        lasts = np.searchsorted(starts, stops).tolist()
        get, out = self.cached.__getitem__, []
        for first, last in zip(firsts, lasts, strict=True):
            at = cuts[first : last + 1]  # the last begins at the break after the text
            out.append(b"".join([get(joined[a:b]) for a, b in zip(at, at[1:], strict=False)]))
        if len(self.cached) > self.cache_size:
            self.cached.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids, gathered by the tokens' offsets."""
        array = np.frombuffer(ids, "<u4")
        lengths = self.lengths[array]
        total = int(lengths.sum())
        shift = self.offsets[array] - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(array) else lengths
        return self.bytes[np.repeat(shift, lengths) + np.arange(total)].tobytes()


class Cached(dict):
    """Ids of slices, by slice."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        out = np.array(self.codec.merge(raw), "<u4").tobytes()
        if len(raw) <= CACHE_BYTES:
            self[piece] = out
        return out


@cache
def codec(name: str = VOCABULARY) -> Codec:
    return Codec(name)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes and, if ``ids``, the ids themselves
    (array<int>). No shuffle: a narrow map over whole texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for rows, texts in common.slices(batches):
            coded = own.encode(texts)
            plain = [own.decode(x) for x in coded]
            columns = [
                rows.column(0).cast(pa.int64()),
                pa.array([len(x) // 4 for x in coded], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                pa.array([hashlib.sha256(x).hexdigest() for x in plain]),
                pa.array(list(map(len, plain)), pa.int64()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"]
            if ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in coded], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return common.project(docs, "doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if ids else ""))
