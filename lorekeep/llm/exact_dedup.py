"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame operations only.

Every partition's rows become one run: its distinct digests, sorted, each with
its count and its best row. Runs then meet in binomial rounds. In a round the
runs whose numbers agree but for their lowest bits are merged:
rows are dealt by (merged run, digest), so that neither a large run nor a
frequent digest makes one task wait, sorted, and folded by a sort aggregate -
a multiway merge. A group's rows in a round are at most the runs that meet,
however many copies there are. A digest is never trusted alone: rows merge only
if SHA-256, a second hash and the length of the normalised text all agree, at
every level. The winners go down the same tree: first to the runs' entries,
then within each run to its rows, so a group of copies that holds a third of
all rows stays spread over its runs.

Defined results: a null text counts as empty, and all empty texts are equal;
of rows that tie on length and doc_id (repeated rows) exactly one is kept; a
null doc_id sorts before all others; an empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters that normalisation deletes.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Runs meet 2 ** FAN_BITS at a time, or more where that would take more than ROUNDS rounds.
FAN_BITS, ROUNDS = 3, 3
KEY = ["sha", "second", "size"]


def normalised(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digests(docs: DataFrame, row: Column) -> DataFrame:
    """One small row per document; the only pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.char_length(text).alias("chars"), normalised(text).alias("plain"), row.alias("row"))
    return rows.select(
        "doc_id",
        "chars",
        F.sha2(F.col("plain").cast("binary"), 256).alias("sha"),
        F.xxhash64("plain").alias("second"),
        F.octet_length("plain").cast("long").alias("size"),
        F.spark_partition_id().alias("run"),
        "row",
    )


def merged(runs: DataFrame, bits: int) -> DataFrame:
    """Merges the runs that differ in their lowest ``bits`` bits only."""
    into = runs.withColumn("run", F.shiftright("run", bits))
    dealt = into.repartition(F.col("run"), F.col("sha")).sortWithinPartitions("run", *KEY)
    return dealt.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("copies").alias("copies"))


def resolve(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, row."""
    return resolved(common.project(docs, "doc_id", "text"), F.monotonically_increasing_id())


def resolved(docs: DataFrame, row: Column) -> DataFrame:
    """resolve() with the rows' numbers in ``row``, which is read once only."""
    rows = common.settled(digests(docs, row), "digests")
    best = F.struct((-F.col("chars")).alias("order"), F.col("doc_id").alias("id"), F.col("row").alias("at"))
    first = rows.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("copies"))
    first = common.settled(first, "runs")
    last = rows.agg(F.max("run")).first()[0] or 0
    level = first
    bits = max(FAN_BITS, -(-int(last).bit_length() // ROUNDS))
    while last > 0:
        level, last = merged(level, bits), last >> bits
    winners = level.select(*KEY, "best", "copies")
    entries = first.select("run", *KEY).join(winners, KEY)
    return rows.join(entries, ["run", *KEY]).select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("row") == F.col("best.at")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("row"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    row = common.unused(docs, common.ROW)
    docs = common.numbered(docs, row)
    kept = resolved(common.project(docs, "doc_id", "text", row), F.col(row)).where("kept").select(F.col("row").alias(row)).hint("merge")
    return docs.join(kept, row, "left_semi").drop(row)
