"""Token counts by a compiled finite-state tokenizer.

Two machines in a row. The first splits normalised text into pieces: its state
maps over chunks compose by a parallel prefix scan (``scan``). The second is a
deterministic transducer over the bytes of a piece whose transitions carry the
number of tokens they emit: reading one more byte changes the count of the
prefix's tokens by the transition's annotation. It is compiled from the merges:
the tokens of a prefix end in exactly one token t, the one whose left
neighbour, the last token of the prefix without t, stays apart from t when the
pair is merged on its own. A later token can only begin where the bytes read
since then begin a vocabulary entry; so a state is the longest such suffix, with
the last token and the count at each of its places. There are finitely many, and
they are compiled when first reached. White space returns both machines to their start, hence a
blank-delimited chunk's map is a constant and is kept with its count; the
counts of a batch's chunks compose by a prefix sum.

Counts are the library's for word_bpe_49k.json without added special tokens;
special strings inside texts count as one token each, its default.

Defined results: a null text counts as empty and has no bytes and no tokens;
repeated rows give repeated results; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from . import common, scan

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Kept chunk maps and transitions of a worker; beyond them they are compiled anew.
KEPT_CHUNKS, KEPT_MOVES = 500_000, 800_000
#: Chunks of more characters are not kept.
KEPT_CHARS = 48
END = "Ā"  # marks the last byte of a piece, which no byte is

WHITE = "".join(map(chr, scan.WHITE_SPACE))
SPLIT_WHITE = re.compile(f"[{re.escape(WHITE)}]+")
#: str.split() takes these for white space; the vocabulary's patterns don't.
SEPARATORS = re.compile("[\x1c-\x1f]")


@cache
def newer() -> list[str]:
    """Characters that Python's Unicode tables, older than the library's, don't know, in the planes that have any."""
    return [chr(c) for c in range(0x40000) if unicodedata.category(chr(c)) == "Cn"]


@cache
def library_classes() -> np.ndarray:
    """scan.base_classes(), with newer characters as the library's own expressions class them."""
    out, line = scan.base_classes().copy(), "".join(newer())
    for pattern, kind in ((r"\p{L}+", scan.LETTER), (r"\p{N}+", scan.NUMBER)):
        for piece, _ in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(line):
            out[[ord(c) for c in piece]] = kind
    return out


@cache
def newer_lower() -> dict[int, str]:
    """What the library lower-cases and Python doesn't."""
    lowered = normalizers.Lowercase().normalize_str("\n".join(newer())).split("\n")
    return {ord(c): x for c, x in zip(newer(), lowered, strict=True) if c != x}


@cache
def newer_upper() -> re.Pattern[str]:
    return re.compile(f"[{''.join(map(chr, newer_lower()))}]")


def byte_alphabet() -> dict[str, str]:
    """The printable stand-in of every byte in byte-level vocabularies, as one-character text of that byte's number."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + k): chr(b) for k, b in enumerate(moved)}


class Transducer:
    def __init__(self, name: str = VOCABULARY) -> None:
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            spec = json.load(f)
        suffix, letters = spec["model"]["end_of_word_suffix"], byte_alphabet()

        def plain(token: str) -> str:
            ends = token.endswith(suffix)
            return "".join(letters[c] for c in (token[: -len(suffix)] if ends else token)) + END * ends

        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = re.compile("|".join(map(re.escape, self.special)))
        self.ranks = {tuple(map(plain, pair)): k for k, pair in enumerate(spec["model"]["merges"])}
        tokens = {plain(t) for t in spec["model"]["vocab"] if t not in self.special}
        self.tokens = tokens
        #: What tokens begin with, short of the whole token.
        self.beginnings = {t[:k] for t in tokens for k in range(1, len(t))}
        self._spines: dict[str, tuple[list, list] | None] = {}
        self.reset()
        self.counts = Chunks(self)

    def reset(self) -> None:
        #: Of every state: its last token. State 0 is the start.
        self.last: list[str] = [""]
        #: Of every state: how many of the bytes read begin a token, at most.
        self.depth: list[int] = [0]
        #: state << 9 | byte (256 more if it ends the piece): the next state << 8 | tokens emitted + 128.
        self.moves: dict[int, int] = {}
        self.states: dict[tuple, int] = {}

    def spines(self, token: str) -> tuple[list, list] | None:
        """The parts that stand at a token's left and at its right edge while its bytes are merged, each with the
        rank of the merge that ends it; None for tokens that merging never yields.
        """
        if token in self._spines:
            return self._spines[token]
        ranks, none, never = self.ranks, 1 << 40, 1 << 41
        parts = [*token[:-2], token[-2:]] if token[-1] == END else list(token)
        left, right = [], []
        while len(parts) > 1:
            scores = [ranks.get(p, none) for p in zip(parts, parts[1:], strict=False)]
            best = min(scores)
            if best == none:
                break
            k = scores.index(best)
            if k == 0:
                left.append((parts[0], best))
            if k == len(parts) - 2:
                right.append((parts[-1], best))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        whole = parts == [token] and token in self.tokens
        out = self._spines[token] = ([*left, (token, never)], [*right, (token, never)]) if whole else None
        return out

    def apart(self, a: str, b: str) -> bool:
        """Whether two tokens stay apart as neighbours: no merge across the border comes before those that end
        its parts (the left of two equal ones comes first). A merge's rank is always above those of its parts.
        """
        ranks = self.ranks
        for x, x_ends in self.spines(a)[1]:
            for y, y_ends in self.spines(b)[0]:
                rank = ranks.get((x, y))
                if rank is not None and rank < x_ends and rank <= y_ends:
                    return False
        return True

    def step(self, word: str, n: int, path: list[int], ends: bool) -> tuple[str, int]:
        """The last token once word[:n] is read, and the place where it begins."""
        mark, tokens = END * ends, self.tokens
        for start in range(n - 1 - self.depth[path[-1]], n):
            token = word[start:n] + mark
            if token in tokens and self.spines(token) and (not start or self.apart(self.last[path[start]], token)):
                return token, start
        raise ValueError(f"no token ends {word[:n]!r}")

    def count(self, piece: bytes) -> int:
        """Tokens of a piece."""
        moves, state, total = self.moves, 0, 0
        for byte in piece[:-1]:
            move = moves.get(state << 9 | byte)
            if move is None:
                return self.compiled(piece.decode("latin-1"))
            state = move >> 8
            total += move & 255
        move = moves.get(state << 9 | 256 | piece[-1])
        if move is None:
            return self.compiled(piece.decode("latin-1"))
        return total + (move & 255) - 128 * len(piece)

    def compiled(self, word: str) -> int:
        """As count, for one character a byte; transitions that are missing are added on the way."""
        path, totals, moves, state = [0], [0], self.moves, 0
        for n in range(1, len(word)):
            key = state << 9 | ord(word[n - 1])
            move = moves.get(key)
            if move is None:
                token, start = self.step(word, n, path, False)
                move = moves[key] = self.state(
                    word,
                    n,
                    path,
                    totals,
                    token,
                    totals[start] + 1,
                ) << 8 | (totals[start] + 1 - totals[-1] + 128)
            state = move >> 8
            path.append(state)
            totals.append(totals[-1] + (move & 255) - 128)
        key = state << 9 | 256 | ord(word[-1])
        if key not in moves:
            _, start = self.step(word, len(word), path, True)
            moves[key] = totals[start] + 1 - totals[-1] + 128
        return totals[-1] + (moves[key] & 255) - 128

    def state(self, word: str, n: int, path: list[int], totals: list[int], token: str, total: int) -> int:
        """The state after word[:n], whose last token is ``token`` and whose count is ``total``."""
        low = n - 1 - self.depth[path[-1]]
        while low < n and word[low:n] not in self.beginnings:
            low += 1
        key = (word[low:n], token, tuple(self.last[s] for s in path[low:]), tuple(t - total for t in totals[low:]))
        found = self.states.setdefault(key, len(self.last))
        if found == len(self.last):
            self.last.append(token)
            self.depth.append(n - low)
        return found

    def compile(self, chunks: list[str]) -> None:
        """Adds the counts of chunks to the kept ones."""
        for at in range(0, len(chunks), 20_000):
            some = chunks[at : at + 20_000]
            for chunk, n in zip(some, self.tallied(some), strict=True):
                self.counts[chunk] = n

    def tallied(self, chunks: list[str]) -> list[int]:
        """Tokens of chunks without white space: pieces by the first machine, counts by the second, prefix sums over both."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        stops = np.cumsum(lengths + 1) - 1
        joined = "\n".join(chunks) + "\n"
        starts = scan.bare().starts(scan.classify(scan.code_points(joined), stops, library_classes()))
        breaks = np.zeros(len(joined), bool)
        breaks[stops] = True
        cuts, real = starts.tolist(), ~breaks[starts]
        emitted = [
            self.count(joined[a:b].encode()) if use else 0 for a, b, use in zip(cuts, cuts[1:] + [len(joined)], real.tolist(), strict=True)
        ]
        sums = np.concatenate([[0], np.cumsum(emitted)])
        return np.diff(sums[np.searchsorted(starts, np.concatenate([[0], stops + 1]))]).tolist()

    def count_texts(self, texts: list[str]) -> list[int]:
        chunks, ends, fixed = [], [], []
        for text in texts:
            extra = 0
            if "<|" in text:
                parts = self.split_special.split(text)
                extra = len(parts) - 1
            else:
                parts = [text]
            for part in parts:
                chunks += normalised(part)
            ends.append(len(chunks))
            fixed.append(extra)
        if len(self.counts) > KEPT_CHUNKS:
            self.counts.clear()
        if len(self.moves) > KEPT_MOVES:
            self.reset()
        missing = [c for c in set(chunks).difference(self.counts) if len(c) <= KEPT_CHARS]
        self.compile(missing)
        counts = np.fromiter(map(self.counts.__getitem__, chunks), np.int64, len(chunks))
        sums = np.concatenate([[0], np.cumsum(counts)])[np.array([0, *ends])]
        return (np.diff(sums) + np.array(fixed, np.int64)).tolist()


class Chunks(dict):
    """Counts by chunk; long chunks are counted each time."""

    def __init__(self, machine: Transducer) -> None:
        super().__init__()
        self.machine = machine

    def __missing__(self, chunk: str) -> int:
        return self.machine.tallied([chunk])[0]


def normalised(text: str) -> list[str]:
    """Chunks between white space, in canonical composition and lower case (character by character)."""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if newer_upper().search(text):
            text = text.translate(newer_lower())
    if SEPARATORS.search(text):
        return [x for x in SPLIT_WHITE.split(text) if x]
    return text.split()


@cache
def transducer(name: str = VOCABULARY) -> Transducer:
    return Transducer(name)


def count(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. No shuffle: a narrow map over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for rows, texts in common.slices(batches):
            counts = machine.count_texts(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).cast(pa.int64()),
                    pa.array([len(x.encode()) for x in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts]),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return common.project(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
