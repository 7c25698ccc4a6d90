"""Language-model scoring: a gated recurrent network with a class-factored softmax.

Tokens are runs of other than white space, ASCII letters lower-cased, then one
end. Every token's count in the training texts is exact: a fixed number of
head tokens, frequent in a bounded sample, is counted in tables of fixed size;
all others go, as 64-bit hashes, to buckets whose number grows with the input,
and each bucket counts its tokens and adds up their terms by document. So
nothing that grows with the vocabulary is gathered in one place.

The network reads a small vocabulary, the most frequent words by exact count;
all other words are one open class. Its output is factored: class, then word
within class. Within the open class a word has its add-one share of that class
by the exact counts, and all words that never occurred are one word, as in the
base score; both scores are log probabilities over the same outcomes, and the
base is the model without context.

The network is trained in numpy by truncated backpropagation; the state is
carried from window to window, and started anew with each document. It starts
from a bounded sample; then every task goes on from there over all its training
texts, whole, and the networks are averaged, weighted by their tokens. (Which
texts meet in a task depends on how the scan deals the files, so scores differ
slightly with it.) Scoring runs a batch's documents in step, in windows, the
state carried, so every document's log-likelihood is that of its whole text.

Defined results: a null or blank text is the end alone; repeated rows give
repeated results; without training texts N and V are 0; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import run_hashes

SAMPLE, SAMPLE_CHARS = 6_000, 50_000
HEAD_BITS, HEAD = 20, 1 << 17
HEAD_PART = 1 << 14
#: Documents for each bucket of rarer tokens.
BUCKET_DOCS = 4_000
HIDDEN, CLASSES, PER_CLASS = 24, 32, 32
OPEN = CLASSES  # the class of all other words
WINDOW, LANES, RATE, CLIP = 32, 64, 0.01, 1.0
#: Lanes and learning rate of the tasks' training.
TASK_LANES, TASK_RATE = 256, 0.003
#: Numbers of a network that are averaged together.
NETWORK_PART = 1 << 13
SCORE_CHARS, SCORE_WINDOW = 6 << 20, 64
U = np.uint64

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def lowered(texts: list[str]) -> tuple[bytes, np.ndarray]:
    """All texts in a row, lower-cased, a space after each; and where each ends."""
    raw = [x.encode() for x in texts]
    return b" ".join([*raw, b""]).translate(LOWER), np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)))


def token_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


@dataclass
class Head:
    """The head tokens' hashes in a table addressed by their upper bits; of tokens that would share a place, the first stays."""

    hashes: np.ndarray

    def __post_init__(self) -> None:
        self.table, self.number = np.zeros(1 << HEAD_BITS, U), np.full(1 << HEAD_BITS, -1, np.int64)
        place = (self.hashes >> U(64 - HEAD_BITS)).astype(np.int64)
        _, first = np.unique(place, return_index=True)
        self.table[place[first]], self.number[place[first]] = self.hashes[first], first

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each token's number, or -1."""
        place = (hashes >> U(64 - HEAD_BITS)).astype(np.int64)
        number = self.number[place]
        return np.where((self.table[place] == hashes) & (number >= 0), number, -1)


def one_numbering(slices: Iterator[tuple[pa.RecordBatch, list[str]]]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts slices where a task reads on in another file, whose row numbers are far from the last one's."""
    for rows, own in slices:
        row = rows.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(row >> 33)) + 1).tolist(), len(own)]
        for a, b in zip(cuts, cuts[1:]):
            yield rows.slice(a, b - a), own[a:b]


PASS = "part int, salt int, counts binary, first long"


def gathered(texts: DataFrame, head: Head, buckets: int) -> DataFrame:
    """One pass over all texts. Rows with part < 0: sums over training texts, by fixed tables (-1: tokens, texts;
    -2 and on: head tokens). Others: a bucket's rarer tokens, packed: hashes, then places of their rows
    counted from ``first``, the lowest bit telling training texts.
    """
    shared = texts.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens, trained = np.zeros(HEAD, np.int64), 0, 0
        salt = TaskContext.get().partitionId()
        for rows, own in one_numbering(common.slices(batches)):
            data, ends = lowered(own)
            array = np.frombuffer(data, np.uint8)
            begin, end = token_places(array)
            hashes = run_hashes(array, begin, end)
            text = np.searchsorted(ends, begin, "right")
            train = ~np.array(rows.column(1).to_pylist(), bool)
            number = shared.value.find(hashes)
            known, learnt = number >= 0, train[text]
            total += np.bincount(number[known & learnt], minlength=HEAD)
            tokens += int(learnt.sum()) + int(train.sum())
            trained += int(train.sum())
            hashes, text = hashes[~known], text[~known]
            row = np.array(rows.column(0).to_pylist(), np.int64)
            low = row.min()
            places = ((row[text] - low).astype(U) << U(1)) | train[text].astype(U)
            bucket = (hashes % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            hashes, places, bucket = hashes[order], places[order].astype("<u4"), bucket[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else bucket
            last = np.append(first[1:], len(bucket))
            packed = [
                hashes[a:b].tobytes() + places[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)
            ] if len(bucket) else []
            n = len(packed)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[first], pa.int32()),
                    pa.array([salt] * n, pa.int32()),
                    pa.array(packed, pa.binary()),
                    pa.array([low] * n, pa.int64()),
                ],
                ["part", "salt", "counts", "first"],
            )
        tables = [np.array([tokens, trained], np.int64), *total.reshape(-1, HEAD_PART)]
        n = len(tables)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(-1, -1 - n, -1), pa.int32()),
                pa.array([salt] * n, pa.int32()),
                pa.array([x.tobytes() for x in tables], pa.binary()),
                pa.array([0] * n, pa.int64()),
            ],
            ["part", "salt", "counts", "first"],
        )

    return texts.select("row", "held_out", "text").mapInArrow(run, PASS)


def bucket_sums(packed: DataFrame, cut: int) -> DataFrame:
    """Per bucket and row: the sum of log10(c + 1) over its rarer tokens and how many have c > 0. row -1: the
    bucket's distinct training tokens; row -2: the count of one of them (hash), if above ``cut``.
    """

    def run(group: pa.Table) -> pa.Table:
        hashes, rows, train = [], [], []
        for packed, first in zip(group["counts"].to_pylist(), group["first"].to_pylist(), strict=True):
            n = len(packed) // 12
            hashes.append(np.frombuffer(packed, "<u8", n))
            places = np.frombuffer(packed, "<u4", n, n * 8)
            rows.append((places >> 1).astype(np.int64) + first)
            train.append(places & 1)
        h, row, learnt = np.concatenate(hashes), np.concatenate(rows), np.concatenate(train)
        order = np.argsort(h)
        h, row, learnt = h[order], row[order], learnt[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        counts = np.add.reduceat(learnt.astype(np.int64), first)
        count = np.repeat(counts, np.diff(np.append(first, len(h))))
        found, at = np.unique(row, return_inverse=True)
        sums, known = np.bincount(at, np.log10(count + 1.0)), np.bincount(at, count > 0)
        n, own = len(found), counts > cut
        places = np.concatenate([found, [-1], np.full(own.sum(), -2)]).astype(np.int64)
        numbers = np.concatenate([known, [(counts > 0).sum()], counts[own]]).astype(np.int64)
        names = pa.array(np.concatenate([np.zeros(n + 1, np.int64), h[first][own].view(np.int64)]))
        return pa.table(
            {"row": places, "tail_sum": pa.array(np.concatenate([sums, np.zeros(len(places) - n)])), "tail_known": numbers, "hash": names}
        )

    return packed.groupBy("part").applyInArrow(run, "row long, tail_sum double, tail_known long, hash long")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """A GRU over word numbers. Word k is in class k // PER_CLASS; word 0 is the end, word CLASSES * PER_CLASS stands for all others."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        h, f = HIDDEN, np.float32
        scale = lambda *s: (rng.standard_normal(s) * 0.1).astype(f)
        self.p = {
            "x": scale(CLASSES * PER_CLASS + 1, 3 * h),
            "u": scale(h, 3 * h),
            "b": np.zeros(3 * h, f),
            "c": scale(h, CLASSES + 1),
            "cb": np.zeros(CLASSES + 1, f),
            "w": scale(CLASSES, h, PER_CLASS),
            "wb": np.zeros((CLASSES, PER_CLASS), f),
        }
        self.squares = {k: np.full_like(v, 1e-8) for k, v in self.p.items()}

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """x: the input's part of the gates. The new state and what the gates were."""
        n, hu = HIDDEN, h @ self.p["u"]
        gates = sigmoid(x[:, : 2 * n] + hu[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(x[:, 2 * n :] + r * hu[:, 2 * n :])
        return new + z * (h - new), z, r, new, hu[:, 2 * n :]

    def log_probabilities(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of each target word (of the open class: of the class alone)."""
        cls = y // PER_CLASS
        logits = h @ self.p["c"] + self.p["cb"]
        out = logits[np.arange(len(y)), cls] - log_sum(logits)
        order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        for k in range(CLASSES):
            own = order[bounds[k] : bounds[k + 1]]
            if len(own):
                inner = h[own] @ self.p["w"][k] + self.p["wb"][k]
                out[own] += inner[np.arange(len(own)), y[own] % PER_CLASS] - log_sum(inner)
        return out

    def train(self, stream: np.ndarray, most: int = LANES, rate: float = RATE, least: float = 0.1) -> None:
        """Truncated backpropagation over one stream of words in which ends (0) close texts, every word of it,
        read in up to ``most`` lanes; the rate falls to ``least`` of it.
        """
        n = len(stream) - 1
        if n < 1:
            return
        lanes = min(max(n // WINDOW, 1), most)
        steps = -(-n // lanes)
        x, y = np.zeros(lanes * steps, np.int64), np.full(lanes * steps, -1, np.int64)  # -1: the last lane is filled up
        x[:n], y[:n] = stream[:-1], stream[1:]
        x, y = x.reshape(lanes, steps).T, y.reshape(lanes, steps).T
        h = np.zeros((lanes, HIDDEN), np.float32)
        squares, windows = self.squares, -(-steps // WINDOW)
        for k in range(windows):
            at = slice(k * WINDOW, (k + 1) * WINDOW)
            h, grads = self.gradients(x[at], y[at], h)
            for name, g in grads.items():
                np.clip(g, -CLIP, CLIP, out=g)
                squares[name] = 0.99 * squares[name] + 0.01 * g * g
                self.p[name] -= rate * (1 - (1 - least) * k / windows) * g / (np.sqrt(squares[name]) + 1e-6)

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Targets below 0 don't count."""
        p, n, steps, lanes = self.p, HIDDEN, *x.shape
        before, z, r, new, hn, states = np.empty((6, steps, lanes, n), h.dtype)
        ends = (x == 0)[:, :, None]  # an end starts a new text
        inputs = (p["x"] + p["b"])[x]
        for t in range(steps):
            np.copyto(before[t], h)
            np.copyto(before[t], 0, where=ends[t])
            h, z[t], r[t], new[t], hn[t] = self.step(inputs[t], before[t])
            states[t] = h

        grads = {k: np.zeros_like(v) for k, v in p.items()}
        order = np.argsort(y.ravel() // PER_CLASS, kind="stable")  # void targets first, then class by class
        flat, target = states.reshape(-1, n)[order], y.ravel()[order]
        void = int(np.searchsorted(target // PER_CLASS, 0))
        flat, target, order = flat[void:], target[void:], order[void:]
        cls, at = target // PER_CLASS, np.arange(len(target))
        scale = h.dtype.type(1 / lanes)
        soft = softmax(flat @ p["c"] + p["cb"])
        soft[at, cls] -= 1
        soft *= scale
        grads["c"], grads["cb"] = flat.T @ soft, soft.sum(0)
        back = soft @ p["c"].T
        bounds = np.searchsorted(cls, np.arange(CLASSES + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            own = slice(bounds[k], bounds[k + 1])
            inner = softmax(flat[own] @ p["w"][k] + p["wb"][k])
            inner[np.arange(len(inner)), target[own] % PER_CLASS] -= 1
            inner *= scale
            grads["w"][k], grads["wb"][k] = flat[own].T @ inner, inner.sum(0)
            back[own] += inner @ p["w"][k].T
        d = np.zeros((steps * lanes, n), h.dtype)
        d[order] = back
        d = d.reshape(steps, lanes, n)

        # What each gate's error is for one of the state's, of all steps at once.
        to_z, to_new, to_r = (before - new) * z * (1 - z), (1 - z) * (1 - new * new), hn * r * (1 - r)
        through, into = np.empty((steps, lanes, 3 * n), h.dtype), np.empty((steps, lanes, n), h.dtype)
        carry, turned = np.zeros((lanes, n), h.dtype), np.ascontiguousarray(p["u"].T)
        for t in range(steps - 1, -1, -1):
            dh = d[t] + carry
            dn = np.multiply(dh, to_new[t], out=into[t])
            g = through[t]
            np.multiply(dh, to_z[t], out=g[:, :n])
            np.multiply(dn, to_r[t], out=g[:, n : 2 * n])
            np.multiply(dn, r[t], out=g[:, 2 * n :])
            carry = dh * z[t] + g @ turned
            np.copyto(carry, 0, where=ends[t])
        grads["u"] = before.reshape(-1, n).T @ through.reshape(-1, 3 * n)
        through[:, :, 2 * n :] = into
        words, rows = x.ravel(), through.reshape(-1, 3 * n)
        grads["b"] = rows.sum(0)
        order = np.argsort(words, kind="stable")
        found, first = np.unique(words[order], return_index=True)
        grads["x"][found] = np.add.reduceat(rows[order], first, axis=0)
        return h, grads


def log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Scorer:
    network: Network
    vocabulary: np.ndarray  # hashes of the words, numbered from 1

    def __post_init__(self) -> None:
        self.order = np.argsort(self.vocabulary)
        self.sorted = self.vocabulary[self.order]

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Each token's number in the vocabulary, or that of all others."""
        other = CLASSES * PER_CLASS
        if not len(self.sorted):
            return np.full(len(hashes), other)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at] + 1, other)

    def stream(self, texts: list[str]) -> np.ndarray:
        """The texts' words in a row, an end (0) before the first and after each."""
        data, ends = lowered(texts)
        array = np.frombuffer(data, np.uint8)
        begin, end = token_places(array)
        out = np.zeros(len(begin) + len(texts) + 1, np.int64)
        out[np.arange(len(begin)) + np.searchsorted(ends, begin, "right") + 1] = self.words(run_hashes(array, begin, end))
        return out

    def fit(self, texts: list[str]) -> None:
        parts, at = [np.zeros(1, np.int64)], 0
        while at < len(texts):  # in slices, as hashing takes many times a slice's size
            upto, chars = at, 0
            while upto < len(texts) and chars < common.SLICE_CHARS:
                chars += len(texts[upto])
                upto += 1
            parts.append(self.stream(texts[at:upto])[1:])
            at = upto
        self.network.train(np.concatenate(parts))

    def score(self, words: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
        """The natural log probability of every text, of words of the open class that of the class alone. text: of each word, in order."""
        out = np.zeros(n_texts)
        sizes = np.bincount(text, minlength=n_texts) + 1  # with the end
        flat = np.zeros(len(words) + n_texts, np.int64)
        starts = np.cumsum(sizes) - sizes
        flat[np.arange(len(words)) + text] = words  # each text's end is 0
        lanes = np.argsort(-sizes, kind="stable")
        lengths, at = sizes[lanes], starts[lanes]
        h = np.zeros((n_texts, HIDDEN), np.float32)
        table = self.network.p["x"] + self.network.p["b"]
        inputs = np.zeros(n_texts, np.int64)
        for low in range(0, int(lengths[0]) if len(lengths) else 0, SCORE_WINDOW):
            states, targets, who = [], [], []
            for t in range(low, min(low + SCORE_WINDOW, int(lengths[0]))):
                n = int(np.searchsorted(-lengths, -t, "left"))  # lanes longer than t
                y = flat[at[:n] + t]
                h = self.network.step(table[inputs[:n]], h[:n])[0]
                states.append(h)
                targets.append(y)
                who.append(lanes[:n])
                inputs = y
            lane = np.concatenate(who)
            out += np.bincount(lane, self.network.log_probabilities(np.concatenate(states), np.concatenate(targets)), minlength=n_texts)
        return out


def frequent(texts: list[str], most: int) -> np.ndarray:
    """The hashes of the texts' most frequent tokens, the most frequent first."""
    found, at = [], 0
    while at < len(texts):
        upto, chars = at, 0
        while upto < len(texts) and chars < common.SLICE_CHARS:
            chars += len(texts[upto])
            upto += 1
        data, _ = lowered(texts[at:upto])
        at = upto
        array = np.frombuffer(data, np.uint8)
        found.append(np.unique(run_hashes(array, *token_places(array)), return_counts=True))
    every = np.concatenate([x for x, _ in found]) if found else np.zeros(0, U)
    hashes, back = np.unique(every, return_inverse=True)
    counts = np.bincount(back, np.concatenate([c for _, c in found]) if found else None, minlength=len(hashes))
    return hashes[np.lexsort((hashes, -counts))][:most]


def trained_on_all(texts: DataFrame, scorer: Scorer) -> Network:
    """The scorer's network, trained on in every task over all its training texts; the mean of the tasks'
    networks, weighted by their tokens.
    """
    shared, names = texts.sparkSession.sparkContext.broadcast(scorer), list(scorer.network.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, tokens = copy.deepcopy(shared.value.network), 0
        for _, own in common.slices(batches):
            stream = shared.value.stream(own)
            network.train(stream, TASK_LANES, TASK_RATE, 1.0)
            tokens += len(stream) - 1
        if tokens:
            flat = np.concatenate([network.p[k].ravel() for k in names]).astype("<f8") * tokens
            tables = [np.append(tokens, flat[at : at + NETWORK_PART]).astype("<f8").tobytes() for at in range(0, len(flat), NETWORK_PART)]
            salts = [TaskContext.get().partitionId()] * len(tables)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(tables)), pa.int32()), pa.array(salts, pa.int32()), pa.array(tables, pa.binary())],
                ["part", "salt", "counts"],
            )

    parts = common.settled(texts.where(~F.col("held_out")).select("text").mapInArrow(run, "part int, salt int, counts binary"), "networks")
    found = [x for _, x in sorted((r[0], np.frombuffer(r[1], "<f8")) for r in common.summed_tables(parts, "<f8").collect())]
    common.dropped(parts)
    if found:
        flat, at = np.concatenate([x[1:] / x[0] for x in found]), 0
        for k in names:
            own = scorer.network.p[k]
            scorer.network.p[k] = flat[at : at + own.size].reshape(own.shape).astype(np.float32)
            at += own.size
    return scorer.network


def score(docs: DataFrame, held_out: int = 2, mod: int = 7) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, docs = docs.sparkSession, common.numbered(common.project(docs, "doc_id", "text"))
    texts = docs.select(F.col(common.ROW).alias("row"), "doc_id", (common.remainder("doc_id", mod) == held_out).alias("held_out"), "text")
    n_docs = docs.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20))
    chance = int(min(1.0, 1.2 * SAMPLE / max(n_docs, 1)) * (1 << 20))
    short = texts.where(~F.col("held_out") & (F.char_length("text") <= SAMPLE_CHARS) & (place < chance))
    sample = short.select(place.alias("place"), "row", "text").toArrow().sort_by([("place", "ascending"), ("row", "ascending")])
    sample = sample["text"].to_pylist()

    head = Head(frequent(sample, HEAD))
    packed = common.settled(gathered(texts, head, max(32, n_docs // BUCKET_DOCS)), "tokens")
    found = {r[0]: np.frombuffer(r[1], "<i8") for r in common.summed_tables(packed.where("part < 0")).collect()}
    counts = np.concatenate([found[-2 - k] for k in range(HEAD // HEAD_PART)]) if found else np.zeros(HEAD, np.int64)
    tokens, trained = (int(x) for x in found[-1]) if found else (0, 0)
    counts = counts[: len(head.hashes)]

    # The vocabulary: the most frequent words of all training texts, those of the head or any that exceed them.
    words = CLASSES * PER_CLASS - 1
    cut = int(np.sort(counts)[::-1][:words][-1]) if len(counts) >= words else 0
    tail = common.settled(bucket_sums(packed.where("part >= 0"), cut), "tail")
    common.dropped(packed)
    distinct = int((counts > 0).sum()) + (trained > 0) + (tail.where("row = -1").agg(F.sum("tail_known")).first()[0] or 0)
    more = tail.where("row = -2").orderBy(F.desc("tail_known"), "hash").limit(words).select("hash", "tail_known").toArrow()
    every = np.concatenate([head.hashes, more["hash"].to_numpy().view(U)])
    exact = np.concatenate([counts, more["tail_known"].to_numpy()]).astype(np.int64)
    chosen = np.lexsort((every, -exact))[:words]
    chosen = chosen[exact[chosen] > 0]

    scorer = Scorer(Network(), every[chosen])
    scorer.fit(sample)
    del sample
    trained_on_all(texts, scorer)

    log_counts = np.log10(counts + 1.0)
    open_counts = log_counts.copy()
    open_counts[chosen[chosen < len(counts)]] = 0
    in_tail = np.append(0.0, np.where(chosen >= len(counts), np.log10(exact[chosen] + 1.0), 0.0))  # by word; tail sums hold them
    open_total = float(np.log10(max(tokens - trained - int(exact[chosen].sum()), 0) + distinct - (trained > 0) - len(chosen) + 1))
    shared = spark.sparkContext.broadcast((scorer, head, log_counts, open_counts, counts > 0, in_tail))
    end_term, end_known = float(np.log10(trained + 1.0)), int(trained > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, top, terms, open_terms, known, in_tail = shared.value
        for rows, texts_ in common.slices(batches, chars=SCORE_CHARS):
            data, ends = lowered(texts_)
            array = np.frombuffer(data, np.uint8)
            begin, end = token_places(array)
            n, text = len(texts_), np.searchsorted(ends, begin, "right")
            hashes = run_hashes(array, begin, end)
            number, word = top.find(hashes), own.words(hashes)
            head_, closed = number >= 0, word < CLASSES * PER_CLASS
            sums = np.bincount(text[head_], terms[number[head_]], minlength=n) + end_term
            knows = np.bincount(text[head_], known[number[head_]], minlength=n).astype(np.int64) + end_known
            inside = np.bincount(text[head_], open_terms[number[head_]], minlength=n).astype(np.float64)
            inside -= np.bincount(text[closed], in_tail[word[closed]], minlength=n)
            inside -= open_total * np.bincount(text[~closed], minlength=n)
            columns = [
                pa.array(np.bincount(text, minlength=n) + 1, pa.int64()),
                pa.array(knows),
                pa.array(sums),
                pa.array(inside + own.score(word, text, n) / np.log(10)),
            ]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1).cast(pa.int64()), rows.column(2), *columns],
                ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_sum", "head_score"],
            )

    scored = texts.mapInArrow(
        run,
        "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_sum double, head_score double",
    )
    by_row = tail.where("row >= 0").groupBy("row").agg(F.sum("tail_sum").alias("tail_sum"), F.sum("tail_known").alias("tail_known"))
    tail_sum = F.coalesce("tail_sum", F.lit(0.0))
    return scored.join(by_row, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_sum") + tail_sum - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1)))).alias("base_score"),
        (F.col("head_score") + tail_sum).alias("score"),
    )
