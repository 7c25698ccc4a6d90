"""Positions for appended events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.plans.settle import settled


def numbered(rows: DataFrame, order: str, out: str, start: int) -> DataFrame:
    """Consecutive numbers past ``start`` in global order, without gathering the rows: they are ranged and sorted
    by order, numbered within each range, and shifted by the ranges' sizes, of which there is one a range.
    """
    ranged = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    own = settled(ranged.select("*", F.spark_partition_id().alias("range_"), local.alias("place_")))
    sizes = own.groupBy("range_").agg(F.count(F.lit(1)).alias("size_"))
    before = W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select("range_", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("shift_"))
    return own.join(F.broadcast(shift), "range_").withColumn(
        out,
        F.lit(start) + F.col("shift_") + F.col("place_") + 1,
    ).drop("range_", "place_", "shift_")


def appended(new: DataFrame, heads: DataFrame, last_sequence: int, order: str) -> DataFrame:
    """new events with version (their stream's head and on) and sequence (past the log's last), both in input order."""
    sequenced = numbered(new, order, "sequence", last_sequence)
    place = F.row_number().over(W.partitionBy("stream_id").orderBy(order))
    return sequenced.join(heads, "stream_id", "left").withColumn("version", F.coalesce("head", F.lit(0)) + place).drop("head")
