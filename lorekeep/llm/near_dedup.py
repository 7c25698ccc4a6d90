"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles,
banded, verified by weighted Jaccard similarity.

Shingles are five words. A shingle weighs ``(1 + ln tf) * idf``, with ``idf = 1
+ ln(1 / max(df / N, 1 / RARE)) / ln(RARE)``: 1 where every document has it, 2
where at most one in ``RARE`` have (for N below RARE: one document). So a shingle's weight depends on the share
of documents that hold it, not on the corpus's size. Document frequencies are
exact: a first pass counts shingles in ``2 ** DF_BITS`` hashed buckets, a second
counts each shingle of the buckets that hold at least ``N / RARE``; all others
are rare for certain. What is broadcast are the common shingles, at most
``RARE`` times the shingles of a mean document, however many documents there are.

Documents with the same words form one node. A node's ``SAMPLES`` consistent
weighted samples make ``BANDS`` bands; nodes with an equal band meet in a
bucket. Buckets of up to ``SMALL`` nodes compare all pairs. In larger ones
every node meets the bucket's leader, the node whose bands are the most
frequent (an original among its copies); a leader's partners are dealt to as many tasks
as their number asks for, with the leader's row in each. Once components are
known, the nodes
that are not in the bucket's largest component are a query set: in blocks they
meet the bucket's nodes, in blocks, and only links are emitted. Whatever is
left uncompared is in one component already, so no link between components is
lost, and no bucket emits all its pairs. Verified pairs (weighted
Jaccard of the whole shingle sets >= ``SIMILARITY``) join components.

Defined results: a null or wordless text is alike no other and is its own
class; texts of fewer than five words are one shingle; a class is named by its
smallest doc_id (nulls first); of repeated rows one is kept; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, shingles
from .hashing import mix

SIMILARITY = 0.8
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
SMALL = 16
#: Nodes of a query block and of a block that it meets.
QUERY_BLOCK, BLOCK = 256, 512
RARE = 500
DF_BITS, DF_PART = 20, 1 << 16
#: Partners of a leader that meet it in one task.
SPREAD = 1024
POOL_BITS = 14
WANTED_BITS = 22
#: Characters of the texts that are shingled at once.
BATCH_CHARS = 1 << 20


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for rows, texts in common.slices(batches, chars=BATCH_CHARS):
        for at in range(0, len(texts), shingles.MAX_TEXTS):
            yield rows.slice(at, shingles.MAX_TEXTS), texts[at : at + shingles.MAX_TEXTS]


@dataclass
class Idf:
    """The common shingles (sorted ids of ID_BITS) and their idf; all others have RAREST."""

    ids: np.ndarray
    values: np.ndarray

    def __post_init__(self) -> None:
        self.hot = np.zeros(1 << DF_BITS, bool)
        self.hot[(self.ids >> np.uint64(shingles.ID_BITS - DF_BITS)).astype(np.int64)] = True

    def of(self, ids: np.ndarray, bits: int = shingles.ID_BITS) -> np.ndarray:
        """bits: those of ids, which are the upper bits of the shingles' ids."""
        out = np.full(len(ids), RAREST, np.float32)
        maybe = np.flatnonzero(self.hot[(ids >> ids.dtype.type(bits - DF_BITS)).astype(np.int64)])
        if len(maybe):
            own, some = self.ids >> np.uint64(shingles.ID_BITS - bits), ids[maybe].astype(np.uint64)
            at = np.minimum(np.searchsorted(own, some), len(own) - 1)
            out[maybe] = np.where(own[at] == some, self.values[at], RAREST)
        return out


RAREST = np.float32(2)


def bucket_of(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(shingles.ID_BITS - DF_BITS)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Shingles of documents by hashed bucket, and all documents. Every task sums its documents into one table of
    fixed size; the tables are summed part by part.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << DF_BITS, np.int32), 0
        for _, own in runs(batches):
            total += np.bincount(bucket_of(shingles.shingled(own)[0]), minlength=1 << DF_BITS).astype(np.int32)
            n += len(own)
        if n:
            parts = [x.astype("<i8").tobytes() for x in total.reshape(-1, DF_PART)]
            salt = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(-1, len(parts)), pa.int32()),
                    pa.array([salt] * (len(parts) + 1), pa.int32()),
                    pa.array([np.int64(n).tobytes(), *parts], pa.binary()),
                ],
                ["part", "salt", "counts"],
            )

    parts = texts.select("text").mapInArrow(counted, "part int, salt int, counts binary")
    found = {r[0]: np.frombuffer(r[1], "<i8") for r in common.summed_tables(parts).collect()}
    if not found:
        return np.zeros(1 << DF_BITS, np.int64), 0
    return np.concatenate([found[k] for k in range((1 << DF_BITS) // DF_PART)]), int(found[-1][0])


def frequencies(texts: DataFrame) -> Idf:
    """The exact document frequencies of all shingles that at least one document in RARE has, as idf."""
    counts, n = bucket_counts(texts)
    least = max(n / RARE, 2.0)
    able = texts.sparkSession.sparkContext.broadcast(np.packbits(counts >= least))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(able.value).view(bool)
        for _, own in runs(batches):
            ids = shingles.shingled(own)[0]
            found, n = np.unique(ids[hot[bucket_of(ids)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n, pa.int64())], ["id", "n"])

    by_id = texts.select("text").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = by_id.where(F.col("n") >= least).orderBy("id").toArrow()
    return Idf(found["id"].to_numpy().astype(np.uint64), idf(found["n"].to_numpy(), n))


def idf(df: np.ndarray, n: int) -> np.ndarray:
    rare = max(1 / RARE, 1 / max(n, 2))
    return (1 + np.log(np.clip(df / max(n, 1), rare, 1)) / np.log(rare)).astype(np.float32)


@cache
def pools() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every sample: r and ln c (Gamma(2, 1)) and beta (uniform) by a shingle's hashed place, and the multiplier that hashes it."""
    rng = np.random.Generator(np.random.Philox(8))
    shape = (SAMPLES, 1 << POOL_BITS)
    r, c, beta = rng.gamma(2, 1, shape), rng.gamma(2, 1, shape), rng.random(shape)
    return r.astype(np.float32), np.log(c).astype(np.float32), beta.astype(np.float32), rng.integers(
        1,
        1 << 63,
        SAMPLES,
        np.uint64,
    ) * np.uint64(2) + np.uint64(1)


def weights(ids: np.ndarray, counts: np.ndarray, idf: Idf, bits: int = shingles.ID_BITS) -> np.ndarray:
    return (1 + np.log(counts, dtype=np.float32)) * idf.of(ids, bits)


def bands(ids: np.ndarray, weight: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The bands of every text that has shingles, as 64-bit hashes. begins: where each such text's shingles begin."""
    u, log = np.uint64, np.log(weight)
    r_all, c_all, beta_all, multipliers = pools()
    out = np.zeros((BANDS, len(begins)), np.uint64)
    low = ids & u(0xFFFFFFFF)
    for k in range(SAMPLES):
        at = ((ids * multipliers[k]) >> u(64 - POOL_BITS)).astype(np.int64)
        r, beta = r_all[k].take(at), beta_all[k].take(at)
        t = np.floor(log / r + beta)
        score = c_all[k].take(at) - r * (t - beta + 1)
        order = score.view(np.int32).astype(np.int64)
        order = np.where(order < 0, -1 - (order & 0x7FFFFFFF), order) + (1 << 31)
        sample = (low * u(0x9E3779B1) + (t.astype(np.int64) & 0xFFFF).astype(np.uint64)) & u(0xFFFFFFFF)
        best = np.minimum.reduceat((order.astype(np.uint64) << u(32)) | sample, begins) & u(0xFFFFFFFF)
        out[k // ROWS] = mix(out[k // ROWS] * u(31) + best + u(k + 1))
    return out


SIGNED = "row long, doc_id long, key1 long, key2 long, bands array<long>"


def signed(texts: DataFrame, idf: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own in runs(batches):
            ids, counts, begins, key1, key2 = shingles.shingled(own)
            some = np.diff(begins) > 0
            made = np.zeros((len(own), BANDS), np.int64)
            if some.any():
                made[some] = bands(ids, weights(ids, counts, idf.value), begins[:-1][some]).T.astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made[some].ravel()))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1).cast(pa.int64()), pa.array(key1.astype(np.int64)), pa.array(key2.astype(np.int64)), lists],
                ["row", "doc_id", "key1", "key2", "bands"],
            )

    return texts.mapInArrow(run, SIGNED)


def shingle_sets(texts: DataFrame, admitted: Broadcast) -> DataFrame:
    """Per row whose slot is admitted: node, its distinct shingles (sorted, 4 bytes each) and their counts. The
    texts aren't shuffled; some rows too many pass, as slots are shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(admitted.value, np.uint8)).view(bool)
        passing = (b.filter(pa.array(bits[b.column(2).to_numpy()])) for b in batches)
        for rows, own in runs(passing):
            ids, counts, begins, _, _ = shingles.shingled(own)
            short = (ids >> np.uint64(shingles.ID_BITS - 32)).astype("<u4")
            counts = np.minimum(counts, 0xFFFFFFFF).astype("<u4")
            plain = [b"" if c.max(initial=0) <= 1 else c.tobytes() for c in np.split(counts, begins[1:-1])]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([x.tobytes() for x in np.split(short, begins[1:-1])], pa.binary()), pa.array(plain, pa.binary())],
                ["node", "ids", "counts"],
            )

    return texts.select("row", "text", "slot").mapInArrow(run, "node long, ids binary, counts binary")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted shingle sets with weights."""
    (i, v), (j, w) = a, b
    at = np.searchsorted(j, i)
    at[at == len(j)] = 0
    same = j[at] == i if len(j) else np.zeros(len(i), bool)
    common_weight = np.minimum(v[same], w[at[same]]).sum(dtype=np.float64)
    total = v.sum(dtype=np.float64) + w.sum(dtype=np.float64) - common_weight
    return float(common_weight / total) if total else 0.0


def verified(pairs: DataFrame, sets: DataFrame, idf: Broadcast, least: float) -> DataFrame:
    """pairs: a, b, salt, copies. Those whose similarity is at least ``least``. b's set is there ``copies``
    times, and a pair meets the one of its salt, so a leader's many partners are spread; a has few pairs.
    """
    sides = sets.select(F.col("node").alias("b"), F.col("ids").alias("b_ids"), F.col("counts").alias("b_counts"))
    copies = pairs.groupBy("b").agg(F.max("copies").alias("copies"))
    hubs = sides.join(copies, "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    others = sets.select(F.col("node").alias("a"), F.col("ids").alias("a_ids"), F.col("counts").alias("a_counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def weighed(ids: pa.Scalar, counts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
            x, n = np.frombuffer(ids.as_py(), "<u4"), np.frombuffer(counts.as_py(), "<u4")
            return x, weights(x, n if len(n) else np.ones(len(x), np.uint32), idf.value, 32)

        for rows in batches:
            table = {c: rows.column(rows.schema.get_field_index(c)) for c in rows.schema.names}
            weigh = lambda x, k: weighed(table[f"{x}_ids"][k], table[f"{x}_counts"][k])  # noqa: B023, E731
            good = [similarity(weigh("a", k), weigh("b", k)) >= least for k in range(rows.num_rows)]
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([table[c].filter(mask) for c in ("a", "b", "salt")], ["a", "b", "salt"])

    joined = pairs.drop("copies").join(others, "a").join(hubs, ["b", "salt"]).select(
        "a",
        "b",
        "salt",
        "a_ids",
        "a_counts",
        "b_ids",
        "b_counts",
    )
    return joined.mapInArrow(run, "a long, b long, salt int")


def links(queries: pa.Table, others: pa.Table, idf: Idf, least: float) -> pa.Table:
    """Links between two blocks (node, label, ids, counts) across labels: shared weights are added up posting by posting."""

    def postings(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = [np.frombuffer(x, "<u4") for x in block["ids"].to_pylist()]
        counts = [
            np.frombuffer(c, "<u4") if c else np.ones(len(x), np.uint32) for x, c in zip(ids, block["counts"].to_pylist(), strict=True)
        ]
        flat = np.concatenate(ids)
        weight = weights(flat, np.concatenate(counts), idf, 32).astype(np.float64)
        owner = np.repeat(np.arange(len(ids)), list(map(len, ids)))
        return flat, owner, weight, np.bincount(owner, weight, minlength=len(ids))

    ids, owner, weight, total = postings(queries)
    order = np.argsort(ids, kind="stable")
    ids, owner, weight = ids[order], owner[order], weight[order]
    node, label = queries["node"].to_numpy(), queries["label"].to_numpy()
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, others.num_rows, 64):
        part = others.slice(at, 64)
        ids2, owner2, weight2, total2 = postings(part)
        low, high = np.searchsorted(ids, ids2, "left"), np.searchsorted(ids, ids2, "right")
        n = high - low
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        shared = np.bincount(
            owner[place] * part.num_rows + np.repeat(owner2, n),
            np.minimum(weight[place], np.repeat(weight2, n)),
            minlength=len(node) * part.num_rows,
        ).reshape(len(node), -1)
        alike = (shared >= least * (total[:, None] + total2[None, :] - shared)) & (label[:, None] != part["label"].to_numpy()[None, :])
        i, j = np.nonzero(alike)
        a, b = node[i], part["node"].to_numpy()[j]
        found_a.append(np.minimum(a, b))
        found_b.append(np.maximum(a, b))
    return pa.table({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})


def crossed(split: DataFrame, sets: DataFrame, idf: Broadcast, least: float) -> DataFrame:
    """split: bucket, node, label, main, n, n_rest. Links between the nodes outside a bucket's main component and
    all its nodes, blocks against blocks.
    """
    queries, blocks = F.ceil(F.col("n_rest") / QUERY_BLOCK).cast("int"), F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.xxhash64("node", "bucket")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = split.where("label <> main").select(
        "bucket",
        "node",
        "label",
        F.pmod(own, queries).cast("int").alias("q"),
        every(blocks).alias("m"),
    )
    right = split.select("bucket", "node", "label", F.pmod(own, blocks).cast("int").alias("m"), every(queries).alias("q"))
    names = ["bucket", "q", "m", "node", "label", "ids", "counts"]
    by = lambda x, side: x.join(sets, "node").select(*[F.col(c).alias(c + side) for c in names]).groupBy(*[c + side for c in names[:3]])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        return links(a.rename_columns(names), b.rename_columns(names), idf.value, least)

    return by(left, "").cogroup(by(right, "_other")).applyInArrow(run, "a long, b long").distinct()


def led(crowds: DataFrame, leaders: DataFrame) -> DataFrame:
    """Pairs (a: member, b: leader, salt, copies) of crowded buckets; leaders: bucket, n, leader. A bucket's
    members are dealt to as many salts as SPREAD allows.
    """
    copies = F.ceil(F.col("n") / SPREAD).cast("int")
    dealt = crowds.select("bucket", F.col("node").alias("a"), F.pmod(F.xxhash64("node"), copies).cast("int").alias("salt"))
    heads = leaders.select(
        "bucket",
        F.col("leader").alias("b"),
        copies.alias("copies"),
        F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"),
    )
    return dealt.join(heads, ["bucket", "salt"]).where("a <> b").groupBy("a", "b").agg(
        F.max("salt").alias("salt"),
        F.max("copies").alias("copies"),
    )


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Per row: row, doc_id, class_id, class_size, kept."""
    return classed(common.numbered(common.project(docs, "doc_id", "text")), common.ROW, least)


def classed(docs: DataFrame, row: str, least: float = SIMILARITY) -> DataFrame:
    """classes() of rows that are numbered already."""
    spark = docs.sparkSession
    texts = docs.select(F.col(row).alias("row"), "doc_id", "text")
    idf = spark.sparkContext.broadcast(frequencies(texts))
    rows = common.settled(signed(texts, idf), "signed")
    worded = rows.where(F.size("bands") > 0)
    nodes = common.settled(
        worded.groupBy("key1", "key2").agg(
            F.min("row").alias("node"),
            F.min(F.struct("doc_id", "row")).alias("first"),
            F.count(F.lit(1)).alias("copies"),
        ),
        "nodes",
    )

    own = worded.select(F.col("row").alias("node"), "bands").join(nodes.select("node"), "node")
    dealt = own.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("bucket"))
    met = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = common.settled(dealt.join(met.hint("merge"), "bucket"), "members")  # merged, so that Spark splits a large bucket's partition
    crowds = members.where(F.col("n") > SMALL)
    central = members.groupBy("node").agg(F.sum("n").alias("met"))
    best = crowds.join(central, "node").groupBy("bucket").agg(F.max(F.struct("met", "node")).alias("best"), F.max("n").alias("n"))
    leaders = best.select("bucket", "n", F.col("best.node").alias("leader"))

    few = members.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("ns"))
    others = F.transform("ns", lambda x, i: F.transform(F.slice("ns", i + 2, F.lit(SMALL)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    few = few.select(F.explode(F.flatten(others)).alias("p")).select("p.a", "p.b").distinct()
    pairs = common.settled(
        few.select("a", "b", F.lit(0).alias("salt"), F.lit(1).alias("copies")).unionByName(led(crowds, leaders)),
        "pairs",
    )
    wanted = pairs.select(F.col("a").alias("row")).unionAll(pairs.select(F.col("b").alias("row"))).distinct()
    slot = F.pmod(F.xxhash64("row"), F.lit(1 << WANTED_BITS))
    admitted = spark.sparkContext.broadcast(common.bitmap(wanted.select(slot.alias("slot")), WANTED_BITS))
    sets = common.settled(shingle_sets(texts.withColumn("slot", slot), admitted), "sets")
    edges = common.settled(verified(pairs, sets, idf, least), "edges")
    labels = components.components(edges)

    placed = crowds.join(labels, "node", "left").select("bucket", "n", "node", F.coalesce("label", "node").alias("label"))
    largest = placed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("bucket").agg(
        F.max(F.struct("size", "label")).alias("most"),
        F.count(F.lit(1)).alias("parts"),
    )
    torn = largest.where("parts > 1").select("bucket", F.col("most.label").alias("main"), F.col("most.size").alias("size"))
    split = placed.join(torn.hint("merge"), "bucket").withColumn("n_rest", F.col("n") - F.col("size"))
    split = common.settled(split, "split")
    more = common.settled(crossed(split, sets, idf, least).withColumn("salt", F.lit(0)), "edges")
    if more.limit(1).count():
        labels = components.components(edges.unionByName(more))

    labelled = common.settled(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    common.dropped(members, pairs, sets, edges, split, more, nodes)
    named = labelled.groupBy("label").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size"))
    by_key = labelled.select("key1", "key2", "label").join(named, "label").select("key1", "key2", "first", "class_size")
    return rows.where(F.size("bands") == 0).select("row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept")).unionAll(
        worded.join(by_key, ["key1", "key2"]).select(
            "row",
            "doc_id",
            F.col("first.doc_id").alias("class_id"),
            "class_size",
            (F.col("row") == F.col("first.row")).alias("kept"),
        )
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, with all its columns."""
    row = common.unused(docs, common.ROW)
    docs = common.numbered(docs, row)
    kept = classed(common.project(docs, "doc_id", "text", row), row).where("kept").select(F.col("row").alias(row)).hint("merge")
    return docs.join(kept, row, "left_semi").drop(row)
