"""Language identification by mixture inference.

A text is a mixture of languages: each of its words comes from one of them,
with a likelihood from that language's letter n-grams: each letter, and the mark
at the word's end, given the two, the one or none of the letters before it,
interpolated. Expectation-maximisation over the text's words
estimates the languages' proportions. The set of languages is selected by
penalised likelihood: starting from all, the least one is dropped as long as
the Bayesian information criterion falls. The prediction is the largest
proportion's language; its proportion is the score.

N-gram counts are learnt from a sample of labelled training texts, bounded by
``SAMPLE`` texts, an equal number for each language (all where it has fewer),
chosen by a hash of their ids; the hashed tables have a fixed size, and only
they are broadcast. Every text is read whole, in a narrow map.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
ties go to the language first in order; without training texts everything is
``und``; repeated rows give repeated results; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import mix

SAMPLE = 20_000
BUCKET_BITS = 16
ORDERS = 3
#: The orders' weights, and what is added to every count.
WEIGHTS, LEAST = (0.1, 0.3, 0.6), 0.01
STEPS = 6
UNKNOWN = "und"
#: Distinct words whose likelihoods a worker keeps.
KEPT_WORDS = 400_000
#: Runs of letters; digits and underscores are no letters.
WORDS = re.compile(r"[^\W\d_]+")
BATCH_CHARS = 1 << 20


def letters(text: str) -> list[str]:
    """Runs of letters; a few hold other numerals only, see has_letter."""
    return WORDS.findall(text.lower())


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed buckets of the n-grams that end at each letter or end mark, a row an order; those of the letters
    before it, likewise; and each place's word.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    text = " " + " ".join(words) + " "
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    place = np.arange(1, len(points))
    word = np.repeat(np.arange(len(words)), lengths)
    inside = place - 1 - np.repeat(np.cumsum(lengths) - lengths, lengths)
    found, before = np.empty((2, ORDERS, len(place)), np.int64)
    context = np.zeros(len(place), np.uint64)
    for k in range(ORDERS):
        if k:
            context = context * np.uint64(0x100000001B3) + np.where(
                inside + 1 >= k,
                points[np.maximum(place - k, 0)],
                np.uint64(32),
            ) + np.uint64(1)
        before[k] = bucket(context)
        found[k] = bucket((context ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) + points[place])
    return found, before, word


def bucket(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # order, bucket, language: log counts of n-grams, with the order's weight
    contexts: np.ndarray  # likewise, of what is before their last letter
    kept: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """The log likelihood of every word in every language."""
        found, before, word = grams(words)
        scores = np.logaddexp.reduce([self.logs[k][found[k]] - self.contexts[k][before[k]] for k in range(ORDERS)])
        out = np.zeros((len(words), len(self.languages)), np.float32)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        out[:] = np.add.reduceat(scores, starts, axis=0)
        return out

    def table(self, words: list[str]) -> np.ndarray:
        """Each word's row in self.rows; 0 for those without a letter."""
        if self.rows is None or len(self.kept) > KEPT_WORDS:
            self.kept, self.rows = {}, np.zeros((1, len(self.languages)), np.float32)
        fresh = set(words).difference(self.kept.keys())
        real = [w for w in fresh if has_letter(w)]
        if real:
            at = len(self.rows)
            self.kept.update(zip(real, range(at, at + len(real)), strict=True))
            self.rows = np.concatenate([self.rows, self.likelihoods(real)])
        self.kept.update((w, 0) for w in fresh.difference(real))
        return np.fromiter(map(self.kept.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str]) -> list[tuple[str, float, list[str], list[float]]]:
        out: list[tuple[str, float, list[str], list[float]]] = [(UNKNOWN, 0.0, [], [])] * len(texts)
        if not self.languages:
            return out
        owned = [letters(x) for x in texts]
        rows = self.table([w for own in owned for w in own])
        text = np.repeat(np.arange(len(texts)), list(map(len, owned)))
        keys = np.sort((text * len(self.rows) + rows)[rows > 0])
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys
        counts = np.diff(np.append(first, len(keys)))  # a word counts as often as it occurs
        text, logs = keys[first] // len(self.rows), self.rows[keys[first] % len(self.rows)]
        some, begins = np.unique(text, return_index=True)
        if not len(some):
            return out
        proportions = mixtures(logs, counts, begins)
        for k, p in zip(some.tolist(), proportions, strict=True):
            order = np.argsort(-p, kind="stable")
            chosen = [i for i in order if p[i] > 0]
            out[k] = (
                self.languages[order[0]],
                float(min(1.0, p[order[0]])),
                [self.languages[i] for i in chosen],
                [float(p[i]) for i in chosen],
            )
        return out


def mixtures(logs: np.ndarray, counts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Proportions of the languages in every text, whose words' rows begin at ``begins``; EM for each size of the
    set, the least language dropped each time, and the set with the lowest criterion kept.
    """
    n, k = len(begins), logs.shape[1]
    sizes = np.diff(np.append(begins, len(logs)))
    text = np.repeat(np.arange(n), sizes)
    peak = logs.max(1, keepdims=True)
    p = np.exp(logs - peak).astype(np.float32)
    weights = np.add.reduceat(counts, begins).astype(np.float64)
    base = np.add.reduceat(counts * peak[:, 0].astype(np.float64), begins)
    times, tiny = counts.astype(np.float32), np.float32(1e-37)

    def likelihood(pi: np.ndarray) -> np.ndarray:
        return np.maximum(np.einsum("ij,ij->i", p, pi.astype(np.float32)[text]), tiny)

    alive = np.ones((n, k), bool)
    best, chosen = np.full(n, np.inf), np.zeros((n, k))
    for size in range(k, 0, -1):
        pi = alive / alive.sum(1, keepdims=True)
        for _ in range(STEPS if size > 1 else 1):
            pi = pi * np.add.reduceat(p * (times / likelihood(pi))[:, None], begins, axis=0) / weights[:, None]
            pi = np.where(alive, np.maximum(pi, 1e-12), 0)
            pi /= pi.sum(1, keepdims=True)
        fit = base + np.add.reduceat(counts * np.log(likelihood(pi).astype(np.float64)), begins)
        criterion = (size - 1) * np.log(np.maximum(weights, 2)) - 2 * fit
        better = criterion < best
        best = np.where(better, criterion, best)
        chosen[better] = pi[better]
        least = np.where(alive, pi, np.inf).argmin(1)
        if size > 1:
            alive[np.arange(n), least] = False
    return chosen


def train(docs: DataFrame, held_out: int = 2, sample: int = SAMPLE) -> Model:
    labelled = common.project(docs, "doc_id", "text", "lang").where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (common.remainder("doc_id", 4) != held_out)
    )
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toArrow()
    names, share = sizes["lang"].to_pylist(), sample / max(sizes.num_rows, 1)
    quotas = docs.sparkSession.createDataFrame([(lang, int(min(1.0, share / n) * (1 << 20))) for lang, n in zip(names, sizes["n"].to_pylist(), strict=True)], "lang string, quota int")  # a row a language
    chosen = labelled.join(F.broadcast(quotas), "lang").where(
        F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < F.col("quota")
    ).select("lang", "text")
    size = 1 << BUCKET_BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for rows, texts in common.slices(batches, chars=BATCH_CHARS):
            by: dict[str, list[str]] = {}
            for lang, text in zip(rows.column(0).to_pylist(), texts, strict=True):
                by.setdefault(lang, []).extend(letters(text))
            for lang, words in by.items():
                total = tables.setdefault(lang, np.zeros((2, ORDERS, size), np.uint32))
                if words:
                    for own, places in zip(total, grams(words)[:2], strict=True):
                        for k in range(ORDERS):
                            own[k] += np.bincount(places[k], minlength=size).astype(np.uint32)
        if tables:
            salts = pa.array([TaskContext.get().partitionId()] * len(tables), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(tables)), salts, pa.array([t.tobytes() for t in tables.values()], pa.binary())],
                ["part", "salt", "counts"],
            )

    parts = chosen.mapInArrow(counted, "part string, salt int, counts binary")
    tables = sorted(
        ((r[0], np.frombuffer(r[1], "<u4").reshape(2, ORDERS, size)) for r in common.summed_tables(parts, "<u4").collect()),
        key=lambda x: x[0],
    )
    if not tables:
        return Model([], *np.zeros((2, ORDERS, size, 0), np.float32))
    counts, before = np.moveaxis(np.stack([x for _, x in tables]), 0, -1)
    letters_ = int((counts[0] > 0).any(1).sum()) + 1
    weight = np.log(WEIGHTS)[:, None, None]
    return Model(
        [x for x, _ in tables],
        (weight + np.log(counts + LEAST)).astype(np.float32),
        np.log(before + LEAST * letters_).astype(np.float32),
    )


def identify(docs: DataFrame, held_out: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, languages, proportions."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, held_out))
    texts = common.project(docs, "doc_id", "text").select("doc_id", (common.remainder("doc_id", 4) == held_out).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own in common.slices(batches, chars=BATCH_CHARS):
            lang, score, names, shares = zip(*model.value.predict(own), strict=True)
            columns = [
                rows.column(0).cast(pa.int64()),
                rows.column(1),
                pa.array(lang),
                pa.array(score, pa.float64()),
                pa.array(names, pa.list_(pa.string())),
                pa.array(shares, pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "languages", "proportions"])

    return texts.mapInArrow(
        run,
        "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>",
    )
