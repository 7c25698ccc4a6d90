"""Benchmark decontamination with training suffix arrays.

The training texts are the shards: every run of documents that a task holds
becomes a suffix array over its words. The windows of all benchmark suffixes,
each distinct one once, are looked up in it by binary search; equal ranges give
all places of a window. Where windows occur, a second suffix array, over the hit
words and the items that hit them, gives the longest verbatim match and its
place from the common prefixes of neighbours. A suffix of the training text that
can't match (one of its first words is in no item) is left out of the first
array, which makes it sparse and changes no answer.

The benchmark is the query set. It goes to the shards in blocks of at most
``BLOCK_CHARS`` characters; that bound, not the benchmark's size, is what is
broadcast. With one block nothing is shuffled; with more, each document's
partial results are merged by row.

Defined results: null and wordless texts have no words and no hits; an item
without words or with a null text never occurs; an item without an id hits
words, but is in no list of items; items that share an id count once; matches
shorter than a window are not reported as longest; repeated rows give repeated
results; empty tables give no rows or no hits; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
BLOCK_CHARS = 8_000_000

#: ASCII letters are lower-cased; what belongs to no word becomes a space. Bytes of other characters belong to words.
TO_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


class Queries:
    """One block of the benchmark: its items' words as one array of numbers, and its distinct windows by length,
    each with the items (by row) that hold it.
    """

    def __init__(self, items: list[tuple[int | None, list[bytes]]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        flat: list[int] = []
        by_size: dict[int, list[tuple[int, int]]] = {}
        begins = []
        for row, (_, own) in enumerate(items):
            begins.append(len(flat))
            flat += [number(w, len(self.vocabulary) + 1) for w in own]
            size = min(WINDOW, len(own))
            by_size.setdefault(size, []).extend((begins[-1] + k, row) for k in range(len(own) - size + 1))
            flat.append(0)
        self.ids, self.begins = np.array(flat or [0], np.int32), np.array([*begins, len(flat)], np.int64)
        self.names = [name for name, _ in items]
        #: By size: the distinct windows in order, and of each its items: where they begin in the list, and the list.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, found in by_size.items():
            array = np.array(found, np.int64)
            keys, at = np.unique(suffixes(self.ids, array[:, 0], size), return_inverse=True)
            pairs = np.unique(np.stack([at, array[:, 1]]), axis=1)
            self.windows[size] = (keys, np.searchsorted(pairs[0], np.arange(len(keys) + 1)), pairs[1])

    def words_of(self, row: int) -> np.ndarray:
        return self.ids[self.begins[row] : self.begins[row + 1] - 1]


def suffixes(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` words from each place, as byte strings whose order is that of the words."""
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    rows = padded[at[:, None] + np.arange(depth)].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * depth}").ravel()


def known_run(ids: np.ndarray) -> np.ndarray:
    """From each place, how many words on end are known."""
    n = len(ids)
    zeros = np.flatnonzero(ids == 0)
    if not len(zeros):
        return np.arange(n, 0, -1)
    nearest = np.searchsorted(zeros, np.arange(n))
    return np.append(zeros, n)[nearest] - np.arange(n)


class Shard:
    """A suffix array over the words of a run of documents, for one block of queries."""

    def __init__(self, queries: Queries, texts: list[list[bytes]]) -> None:
        self.queries, get = queries, queries.vocabulary.get
        flat: list[int] = []
        starts = []
        for own in texts:
            starts.append(len(flat))
            flat += [get(w, 0) for w in own]
            flat.append(0)
        self.starts, self.ids = np.array(starts, np.int64), np.array(flat, np.int32)

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of windows: place in the shard, words, the window's number among those of its size."""
        found = []
        run = known_run(self.ids)
        for size, (keys, _, _) in self.queries.windows.items():
            able = np.flatnonzero((run >= size) & (self.ids != 0))
            if not len(able):
                continue
            array = suffixes(self.ids, able, size)
            order = np.argsort(array, kind="stable")
            array, able = array[order], able[order]
            low, high = np.searchsorted(array, keys, "left"), np.searchsorted(array, keys, "right")
            hit = np.flatnonzero(high - low)
            if not len(hit):
                continue
            counts = (high - low)[hit]
            offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            found.append((able[np.repeat(low[hit], counts) + offset], np.full(counts.sum(), size), np.repeat(hit, counts)))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def matches(self, longest: bool = True) -> list[tuple[list[tuple[int, int]], list[int], int, int]]:
        """Per document: hit ranges of words (disjoint, in order), ids of items, words of the longest verbatim
        match, its first word (0 and -1 if not asked for).
        """
        place, size, window = self.places()
        out: list[tuple[list[tuple[int, int]], list[int], int, int]] = [([], [], 0, -1)] * len(self.starts)
        if not len(place):
            return out
        order = np.argsort(place, kind="stable")
        place, size, window = place[order], size[order], window[order]
        document = np.searchsorted(self.starts, place, "right") - 1
        documents, first = np.unique(document, return_index=True)
        pieces: list[tuple[int, int, int]] = []  # document, place, end
        rows: dict[int, np.ndarray] = {}
        for k, a, b in zip(documents.tolist(), first.tolist(), [*first[1:].tolist(), len(place)], strict=True):
            ends = np.maximum.accumulate(place[a:b] + size[a:b])
            cuts = np.flatnonzero(place[a + 1 : b] > ends[:-1]) + 1
            pieces += [
                (k, int(x), int(y)) for x, y in zip(place[a:b][np.append(0, cuts)], ends[np.append(cuts - 1, b - a - 1)], strict=True)
            ]
            rows[k] = self._items(size[a:b], window[a:b])
        best = self._longest(pieces, np.unique(np.concatenate(list(rows.values())))) if longest else {}
        for k, own in itertools.groupby(pieces, lambda x: x[0]):
            start = int(self.starts[k])
            ranges = [(x - start, y - start) for _, x, y in own]
            names = sorted({name for r in rows[k].tolist() if (name := self.queries.names[r]) is not None})
            length, at = best.get(k, (0, start - 1))
            out[k] = (ranges, names, length, at - start)
        return out

    def _items(self, size: np.ndarray, window: np.ndarray) -> np.ndarray:
        """The rows of all items that hold one of the windows."""
        found = []
        for n in np.unique(size).tolist():
            _, begins, items = self.queries.windows[n]
            found += [items[begins[w] : begins[w + 1]] for w in np.unique(window[size == n]).tolist()]
        return np.unique(np.concatenate(found))

    def _longest(self, pieces: list[tuple[int, int, int]], items: np.ndarray) -> dict[int, tuple[int, int]]:
        """Per document: words and place of the longest stretch of its pieces that an item has, too (the first of the longest)."""
        texts = [self.ids[a:b] for _, a, b in pieces] + [self.queries.words_of(r) for r in items.tolist()]
        sizes = np.array([len(x) for x in texts])
        starts = np.cumsum(sizes + 1) - sizes - 1
        line = np.empty(sizes.sum() + len(sizes), np.int64)
        for at, x in zip(starts.tolist(), texts, strict=True):
            line[at : at + len(x)] = x
        line[starts + sizes] = len(self.queries.vocabulary) + 1 + np.arange(len(sizes))  # every border is unlike all others
        order, ranks = suffix_array(line, int(sizes.max()))
        query = np.arange(len(line)) >= starts[len(pieces)]
        is_query = query[order]
        at = np.arange(len(line))
        before = np.maximum.accumulate(np.where(is_query, at, -1))
        after = np.minimum.accumulate(np.where(is_query, at, len(line))[::-1])[::-1]
        mine = np.flatnonzero(~is_query)
        length = np.zeros(len(line), np.int64)
        for near in (before[mine], after[mine]):
            real = (near >= 0) & (near < len(line))
            own = order[mine[real]]
            length[own] = np.maximum(length[own], common_prefix(ranks, own, order[near[real]]))
        out: dict[int, tuple[int, int]] = {}
        for (k, a, b), start in zip(pieces, starts.tolist(), strict=False):
            own = length[start : start + b - a]
            top = int(own.argmax())
            if own[top] > out.get(k, (0, 0))[0]:
                out[k] = (int(own[top]), a + top)
        return out


def suffix_array(line: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes by prefix doubling, and every level's ranks: level k ranks the 2 ** k words from
    each place. longest: words between two borders, at most.
    """
    ranks = [np.unique(line, return_inverse=True)[1].astype(np.int64)]
    while 1 << len(ranks) - 1 <= longest:
        last, step = ranks[-1], 1 << len(ranks) - 1
        follows = np.append(last[step:], np.full(min(step, len(last)), -1))
        ranks.append(np.unique(last * (len(last) + 1) + follows + 1, return_inverse=True)[1].astype(np.int64))
    return np.argsort(ranks[-1], kind="stable"), ranks


def common_prefix(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b share, from the levels' ranks."""
    n, out = len(ranks[0]), np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + out, b + out
        inside = (x < n) & (y < n)
        same = np.zeros(len(a), bool)
        same[inside] = ranks[k][x[inside]] == ranks[k][y[inside]]
        out[same] += 1 << k
    return out


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[Queries]:
    """The benchmark in blocks; read row by row, so the driver holds one block."""
    items: list[tuple[int | None, list[bytes]]] = []
    total = 0
    for row in common.project(benchmark, "item_id", "text").where("text is not null").toLocalIterator():
        if own := words(row[1]):
            items.append((None if row[0] is None else int(row[0]), own))
            total += len(row[1])
        if total >= chars:
            yield Queries(items)
            items, total = [], 0
    if items:
        yield Queries(items)


PARTIAL = "row long, doc_id long, n_words long, starts array<long>, ends array<long>, items array<long>, longest long, longest_at long"
RESULT = "row long, doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_at long, items array<long>"


def _partial(docs: DataFrame, queries: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in common.slices(batches):
            own = [words(x) for x in texts]
            found = Shard(queries.value, own).matches()
            longs = lambda x: pa.array(x, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(1).cast(pa.int64()),
                    pa.array(list(map(len, own)), pa.int64()),
                    longs([[a for a, _ in x[0]] for x in found]),
                    longs([[b for _, b in x[0]] for x in found]),
                    longs([x[1] for x in found]),
                    pa.array([x[2] for x in found], pa.int64()),
                    pa.array([x[3] for x in found], pa.int64()),
                ],
                ["row", "doc_id", "n_words", "starts", "ends", "items", "longest", "longest_at"],
            )

    return docs.mapInArrow(run, PARTIAL)


def _results(partial: DataFrame) -> DataFrame:
    """Joins a row's ranges, counts the words in them and decides."""
    ranges = F.array_sort(F.arrays_zip("starts", "ends"))
    covered = F.aggregate(
        ranges,
        F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda acc, r: F.struct(
            F.greatest(acc["to"], r["ends"]).alias("to"),
            (acc["n"] + F.greatest(r["ends"] - F.greatest(acc["to"], r["starts"]), F.lit(0))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    items = F.array_distinct("items")
    named = F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ",")
    counted = partial.select(
        "row",
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(named.cast("binary"), 256).alias("items_sha256"),
        "longest",
        "longest_at",
        F.array_sort(items).alias("items"),
    )
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def search(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of docs: row, doc_id, n_words, n_hit, n_items, items_sha256, longest, longest_at, items, contaminated."""
    shared = [docs.sparkSession.sparkContext.broadcast(x) for x in blocks(benchmark, block_chars)]
    docs = common.project(docs, "doc_id", "text")
    if len(shared) < 2:  # one scan numbers the rows
        texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        return _results(_partial(texts, shared[0] if shared else docs.sparkSession.sparkContext.broadcast(Queries([]))))
    return _searched(common.numbered(docs), common.ROW, shared)


def _searched(docs: DataFrame, row: str, shared: list[Broadcast]) -> DataFrame:
    """search() of numbered rows, each block in a scan of its own."""
    texts = docs.select(F.col(row).alias("row"), "doc_id", "text")
    parts = [_partial(texts, x) for x in shared]
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionAll(x)
    best = F.max_by(F.struct("longest", "longest_at"), F.struct("longest", -F.col("longest_at")))
    whole = whole.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")],
        best.alias("best"),
    )
    return _results(whole.select("row", "doc_id", "n_words", "starts", "ends", "items", "best.longest", "best.longest_at"))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated documents."""
    own = list(itertools.islice(blocks(benchmark), 2))
    if len(own) < 2:  # one block decides alone
        shared = docs.sparkSession.sparkContext.broadcast(own[0] if own else Queries([]))

        def clean(texts: list[str]) -> list[bool]:
            tokens = [words(x) for x in texts]
            hits = [sum(b - a for a, b in m[0]) for m in Shard(shared.value, tokens).matches(longest=False)]
            return [not (h > 0 and SHARE * h >= len(w)) for h, w in zip(hits, tokens, strict=True)]

        return common.narrowed(docs, clean)
    row = common.unused(docs, common.ROW)
    docs = common.numbered(docs, row)
    shared = [docs.sparkSession.sparkContext.broadcast(x) for x in blocks(benchmark)]
    bad = _searched(docs, row, shared).where("contaminated").select(F.col("row").alias(row))
    return docs.join(bad, row, "left_anti").drop(row)
