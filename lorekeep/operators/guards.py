"""Checks that a log or a batch must pass, as set operations: each returns the rows that fail, or every row with its verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ANY, EXACT, EMPTY = "any", "exact", "empty"


def expected_after(version: Column) -> Column:
    """What a writer that has read up to ``version`` expects."""
    return F.when(version == 0, EMPTY).otherwise(EXACT)


def version_matches(kind: Column, expected: Column, head: Column) -> Column:
    return F.when(kind == ANY, True).when(kind == EMPTY, head == 0).otherwise(head == expected)


def expectations(commands: DataFrame, heads: DataFrame, closed: DataFrame) -> DataFrame:
    """commands: stream_id, expected_kind, expected_version. Adds head and outcome. Closed goes before the expectation."""
    out = commands.join(heads, "stream_id", "left").withColumn("head", F.coalesce("head", F.lit(0).cast("long"))).join(
        closed.select("stream_id", F.lit(True).alias("closed")),
        "stream_id",
        "left",
    )
    verdict = F.when(F.col("closed"), "closed").when(
        version_matches(F.col("expected_kind"), F.col("expected_version"), F.col("head")),
        "accepted",
    ).otherwise("conflict")
    return out.withColumn("outcome", verdict).drop("closed")


def repeated_streams(batch: DataFrame) -> DataFrame:
    """batch: batch_id, stream_id, one row an append. The streams that a batch names more than once."""
    return batch.groupBy("batch_id", "stream_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def read_verdict(after: Column, first_kept: Column) -> Column:
    """A read that would miss cut events is refused."""
    return F.when(after + 1 < first_kept, "truncated").otherwise("ok")


def cut_plan(cut: Column, head: Column, first_kept: Column) -> Column:
    return F.when(cut > head + 1, "error").when(cut <= first_kept, "noop").otherwise("cut")


def kept(log: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """The log without events before their stream's cut."""
    cuts = lifecycle.select("stream_id", "first_kept")
    return log.join(cuts, "stream_id", "left").where(F.col("version") >= F.coalesce("first_kept", F.lit(1))).drop("first_kept")


def gaps(log: DataFrame) -> DataFrame:
    """Events whose version isn't their predecessor's plus one (a stream's first: 1)."""
    reached = F.coalesce(F.lag("version").over(W.partitionBy("stream_id").orderBy("version")), F.lit(0).cast("long"))
    return log.select("stream_id", "version", reached.alias("reached")).where("version <> reached + 1")


def delivery_faults(batches: DataFrame) -> DataFrame:
    """batches: batch_id, ord, sequence, checkpoint, scanned. Per batch: events that don't come after the one
    before or the checkpoint, and whether scanned lies below either.
    """
    before = F.coalesce(F.lag("sequence").over(W.partitionBy("batch_id").orderBy("ord")), F.col("checkpoint"))
    checked = batches.withColumn("bad", (F.col("sequence") <= before).cast("long"))
    return checked.groupBy("batch_id").agg(
        F.sum("bad").alias("unordered"),
        F.max("sequence").alias("upper"),
        (F.max("scanned") < F.greatest(F.max("sequence"), F.max("checkpoint"))).alias("scan_behind"),
    )


def fresh_deliveries(delivered: DataFrame) -> DataFrame:
    """delivered: delivery, stream_id, version. Without redeliveries: versions at or below what was applied before."""
    order = W.partitionBy("stream_id").orderBy("delivery").rowsBetween(W.unboundedPreceding, -1)
    return delivered.withColumn(
        "applied",
        F.coalesce(F.max("version").over(order), F.lit(0).cast("long")),
    ).where("version > applied").drop("applied")


def lease_held(renewed: Column, acquired: Column, now: Column, ttl_ms: Column, grace: Column, max_grace: Column) -> Column:
    """A lease holds within ttl * grace of its renewal and ttl * max_grace of its acquisition."""
    age = lambda since: F.timestamp_diff("MILLISECOND", since, now)
    return (age(renewed) < ttl_ms * grace) & (age(acquired) < ttl_ms * max_grace)
