"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are a text's words and their beginnings of 4 to 7 bytes, each as
``ln(1 + count)``. Grades are ordered: 0 not toxic, 1 toxic, 2 severe; the
labels tell toxic from not, and toxic training texts with more than the median
of telling features are severe. One weight vector is shared by all thresholds:
``P(grade >= k) = sigmoid(w.x - theta_k)``. A document's expected severity is
the sum of these over k; it is rejected if P(toxic) is above ``THRESHOLD``.

The model is fitted on a sample of labelled rows, bounded by ``SAMPLE``; a row
is in it by a hash of its doc_id. Equal texts count once, with the highest of
their labels. Features are chosen by
the lower bound of their log odds, at most ``FEATURES`` of them; so the model's
size is bounded, and only the model is broadcast. Every document is then read
whole in a narrow map.

Defined results: null and wordless texts have no features, and so the model's
base severity; label rows without doc_id or toxic are ignored; of several
labels of a document the highest counts; without labels of both kinds nothing
is toxic (severity 0); repeated rows give repeated results; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontaminate import TO_WORDS
from .hashing import run_hashes

SAMPLE = 20_000
FEATURES = 4096
LEAST_COUNT, LEAST_ODDS = 4, 1.5
BEGINNINGS = (4, 5, 6, 7)
ROUNDS, RATE, PENALTY = 600, 0.1, 1e-5
#: Of P(toxic): to keep a toxic document counts four times as much as to reject a clean one.
THRESHOLD = 0.2
BATCH_CHARS = 1 << 20


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hash of the feature, for every word and every beginning of a longer word."""
    raw = [x.encode() for x in texts]
    stops = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)))
    data = np.frombuffer(b" ".join([*raw, b""]).translate(TO_WORDS), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    text = np.searchsorted(stops, begin, "right")
    texts_of, hashes = [text], [run_hashes(data, begin, end)]
    for k in BEGINNINGS:
        long = end - begin > k
        texts_of.append(text[long])
        hashes.append(~run_hashes(data, begin[long], begin[long] + k))  # a beginning is no word
    return np.concatenate(texts_of), np.concatenate(hashes)


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' features among the model's: text, feature, ln(1 + count)."""
        text, hashes = features(texts)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
        text, hashes = text[maybe], hashes[maybe]
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        good = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        pairs, counts = np.unique(text[good] * max(len(self.hashes), 1) + at[good], return_counts=True)
        return pairs // max(len(self.hashes), 1), pairs % max(len(self.hashes), 1), np.log1p(counts)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """P(grade >= k), a row for each text."""
        text, feature, value = self.vectors(texts)
        score = np.bincount(text, self.weights[feature] * value, minlength=len(texts)) if len(text) else np.zeros(len(texts))
        return sigmoid(score[:, None] - self.thresholds)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch gradient steps (Adam) on the penalised likelihood."""
    n, top = len(grades), 2
    theta = np.concatenate([np.zeros(n_features), [1.0, 0.0]])  # weights, first threshold, log of the gap
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    bounds = np.array([-np.inf, np.inf])
    for step in range(1, ROUNDS + 1):
        w, low, gap = theta[:-2], theta[-2], np.exp(theta[-1])
        cuts = np.array([bounds[0], low, low + gap, bounds[1]])
        score = np.bincount(rows, w[columns] * values, minlength=n)
        upper, lower = sigmoid(score - cuts[grades]), sigmoid(score - cuts[grades + 1])  # P(>= grade), P(> grade)
        p = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
        slope = -(d_upper - d_lower) / n
        grad = np.empty_like(theta)
        grad[:-2] = np.bincount(columns, slope[rows] * values, minlength=n_features) + PENALTY * w
        by_cut = [(np.where(grades == k, d_upper, 0) - np.where(grades + 1 == k, d_lower, 0)).sum() / n for k in range(1, top + 1)]
        grad[-2], grad[-1] = sum(by_cut), by_cut[1] * gap
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta = theta - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-2], np.array([theta[-2], theta[-2] + np.exp(theta[-1])])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    labels = common.project(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        (F.max("toxic") > 0).cast("int").alias("toxic")
    )
    share = min(1.0, sample / max(labels.count(), 1))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = common.project(docs, "doc_id", "text").where("text is not null").join(
        F.broadcast(chosen),
        "doc_id",
    ).groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text")
    texts = common.settled(texts, "labelled")
    total = dict.fromkeys((0, 1), 0) | {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    if not total[0] or not total[1]:
        return None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own in common.slices(batches, chars=BATCH_CHARS):
            toxic = np.array(rows.column(0).to_pylist(), np.int64)
            text, hashes = features(own)
            order = np.lexsort((text, hashes))
            text, hashes = text[order], hashes[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
            found, at = np.unique(hashes[new], return_inverse=True)
            bad = np.bincount(at, toxic[text[new]], minlength=len(found)).astype(np.int64)
            every = np.bincount(at, minlength=len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(bad), pa.array(every - bad)],
                ["feature", "bad", "good"],
            )

    counts = texts.mapInArrow(counted, "feature long, bad long, good long").groupBy("feature").agg(
        F.sum("bad").alias("bad"),
        F.sum("good").alias("good"),
    )
    odds = F.log((F.col("bad") + 0.5) / (total[1] + 1)) - F.log((F.col("good") + 0.5) / (total[0] + 1)) - F.sqrt(
        1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5)
    )
    best = counts.where(F.col("bad") >= LEAST_COUNT).withColumn("odds", odds).where(F.col("odds") > LEAST_ODDS).orderBy(
        F.desc("odds"),
        F.desc("bad"),
        "feature",
    ).limit(FEATURES)
    hashes = np.sort(np.array([r[0] for r in best.select("feature").collect()], np.int64).view(np.uint64))
    if not len(hashes):
        return None
    shape = Model(hashes, np.zeros(len(hashes)), np.zeros(2))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own in common.slices(batches, chars=BATCH_CHARS):
            text, feature, value = shape.vectors(own)
            bounds = np.searchsorted(text, np.arange(len(own) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int32()), *lists], ["toxic", "features", "vals"])

    found = texts.mapInArrow(vectors, "toxic int, features array<int>, vals array<float>").toArrow()
    sizes = np.array([len(x) for x in found["features"].to_pylist()])
    order = np.lexsort((sizes, found["toxic"].to_numpy()))
    found = found.take(pa.array(order))
    toxic, sizes = found["toxic"].to_numpy(), sizes[order]
    columns = np.array([k for x in found["features"].to_pylist() for k in x], np.int64)
    values = np.array([k for x in found["vals"].to_pylist() for k in x])
    grades = np.where(toxic == 1, 1 + (sizes > np.median(sizes[toxic == 1])), 0)
    weights, thresholds = fit(np.repeat(np.arange(len(sizes)), sizes), columns, values, grades, len(hashes))
    return Model(hashes, weights, thresholds)


def grade(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: row, doc_id, p_toxic, p_severe, severity, rejected."""
    texts = common.project(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own in common.slices(batches, chars=BATCH_CHARS):
            p = model.value.probabilities(own) if model.value else np.zeros((len(own), 2))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(1).cast(pa.int64()),
                    pa.array(p[:, 0]),
                    pa.array(p[:, 1]),
                    pa.array(p.sum(1)),
                    pa.array(p[:, 0] > THRESHOLD),
                ],
                ["row", "doc_id", "p_toxic", "p_severe", "severity", "rejected"],
            )

    return texts.mapInArrow(run, "row long, doc_id long, p_toxic double, p_severe double, severity double, rejected boolean")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without rejected documents."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return common.narrowed(
        docs,
        lambda texts: [True] * len(texts) if model.value is None else (model.value.probabilities(texts)[:, 0] <= THRESHOLD).tolist(),
        BATCH_CHARS,
    )
