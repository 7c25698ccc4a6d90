"""Reads over the log. Lower bounds are exclusive. Bounds and types reach the scan; top-k reads keep k rows a task, never a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.upcast import BuiltLadder, Chain
from lorekeep.operators.predicates import EventFilter, Query
from lorekeep.schema import position


def stream(log: DataFrame, stream_id: str, after: int = 0) -> DataFrame:
    """One stream's events past a version, in order; an unknown stream has none."""
    return log.where((F.col("stream_id") == stream_id) & (F.col("version") > position(after))).orderBy("version")


def after(log: DataFrame, sequence: int, limit: int | None = None) -> DataFrame:
    out = log.where(F.col("sequence") > position(sequence)).orderBy("sequence")
    return out if limit is None else out.limit(limit)


def selected(log: DataFrame, query: Query, sequence: int = 0) -> DataFrame:
    return log.where((F.col("sequence") > position(sequence)) & query.column()).orderBy("sequence")


def scan_window(log: DataFrame, sequence: int, scan_limit: int) -> DataFrame:
    """One row: bound, the last sequence that a scan of scan_limit rows (one at least) looks at; null if there are none."""
    return log.select("sequence").where(
        F.col("sequence") > position(sequence)
    ).orderBy("sequence").limit(max(1, scan_limit)).agg(F.max("sequence").alias("bound"))


def filtered(log: DataFrame, where: EventFilter, sequence: int, limit: int, scan_limit: int = 4096) -> DataFrame:
    """At most limit matching events among the next scan_limit."""
    if where.is_all():
        return after(log, sequence, max(0, min(limit, max(1, scan_limit))))
    bound = F.broadcast(scan_window(log, sequence, scan_limit))  # one row
    looked = log.where(
        (F.col("sequence") > position(sequence)) & where.column()
    ).join(bound, F.col("sequence") <= F.col("bound")).drop("bound")
    return looked.orderBy("sequence").limit(limit)


def filtered_progress(log: DataFrame, where: EventFilter, sequence: int, limit: int, scan_limit: int = 4096) -> DataFrame:
    """One row: n_events, upper (last match), scanned: how far the read has come - the last match if limit was
    reached, else the whole window.
    """
    found = filtered(log, where, sequence, limit, scan_limit).agg(F.count(F.lit(1)).alias("n_events"), F.max("sequence").alias("upper"))
    scanned = F.when(
        (F.col("n_events") >= limit) & (F.lit(limit) > 0),
        F.col("upper"),
    ).otherwise(F.coalesce("bound", F.lit(position(sequence)))).alias("scanned")
    return found.join(F.broadcast(scan_window(log, sequence, scan_limit))).select("n_events", "upper", scanned)


def tag_index(log: DataFrame) -> DataFrame:
    """A row for each tag of each event."""
    return log.select(F.explode("tags").alias("tag"), "sequence")


def mapped(log: DataFrame, payload: Column) -> DataFrame:
    """Another payload for each event; its positions, and all else, stay."""
    return log.withColumn("payload", payload)


def typed(log: DataFrame, chain: Chain) -> DataFrame:
    """Raw events with payloads of today's shape. An event that the chain can't read fails the whole read."""
    return mapped(log, chain.column(F.col("event_type"), F.col("payload")))


def versioned(log: DataFrame, ladder: BuiltLadder) -> DataFrame:
    """As typed, each event climbing from its own schema version."""
    return mapped(log, ladder.column(F.col("event_type"), F.col("schema_version"), F.col("payload")))


def polled(
    log: DataFrame,
    sequence: int,
    limit: int,
    where: EventFilter | None = None,
    upcast: Chain | BuiltLadder | None = None,
    scan_limit: int = 4096,
) -> tuple[DataFrame, int]:
    """A source's poll: at most limit events past ``sequence``, filtered, then upcast; and how far it has looked,
    which is acknowledged even if no event matched.
    """
    where = where or EventFilter()
    progress = filtered_progress(log, where, sequence, limit, scan_limit).first()
    found = filtered(log, where, sequence, limit, scan_limit)
    if upcast is not None:
        found = typed(found, upcast) if isinstance(upcast, Chain) else versioned(found, upcast)
    return found, progress.scanned
