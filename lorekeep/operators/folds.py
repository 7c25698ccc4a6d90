"""Ordered left folds.

Commutative folds need nothing from here: they are plain aggregates, combined
before the shuffle. For the others there are two ways:

* ``folded`` (``seeded`` on top of snapshots): a stream's events are sorted in
  one array and folded inside the JVM. Right for streams that fit a row.
* ``streamed`` (``streamed_on`` on top of snapshots, ``scanned`` for a row an
  event): streams may be of any length; rows are clustered by stream, sorted by
  Spark (which spills), and folded batch by batch, one state in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Step = Callable[[Column, Column], Column]


def folded(
    log: DataFrame,
    key: str | list[str],
    order: str,
    fields: list[str],
    init: Column,
    step: Step,
    finish: Callable[[Column], Column] | None = None,
    out: str = "state",
) -> DataFrame:
    """Per key: the state after all events in order. init may use columns of the key only."""
    keys = [key] if isinstance(key, str) else key
    events = log.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias("events"))
    return events.select(*keys, F.aggregate("events", init, step, *([finish] if finish else [])).alias(out))


def seeded(log: DataFrame, snapshots: DataFrame, fields: list[str], seed: Callable[[Column], Column], step: Step) -> DataFrame:
    """Per stream: the snapshot's state with only later events folded in. snapshots: stream_id, version, state;
    log and snapshots meet once, by stream.
    """
    s = snapshots.select("stream_id", F.col("version").alias("base"), F.col("state").alias("seed"))
    rows = log.join(s, "stream_id", "left").where(F.col("version") > F.coalesce("base", F.lit(0)))
    delta = rows.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("version", *fields))).alias("events"))
    both = s.join(delta, "stream_id", "full")
    return both.select(
        "stream_id",
        F.aggregate(F.coalesce("events", F.array().cast(delta.schema["events"].dataType)), seed(F.col("seed")), step).alias("state"),
        F.greatest(F.coalesce("base", F.lit(0)), F.coalesce(F.element_at("events", -1)["version"], F.lit(0))).alias("version"),
    )


def clustered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with each key's in one task, sorted by key and order. Dealt by the key's hash, not by the key: where rows
    are dealt by key already, Spark drops a second dealing as redundant, and then may swap a join below for one
    that leaves a key's rows in several tasks, as a Python step states no need of them in one.
    """
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)


def streamed(
    log: DataFrame,
    key: str,
    order: str,
    fields: list[str],
    init: Callable[[], Any],
    step: Callable[[Any, tuple], Any],
    schema: str,
    result: Callable[[Any], tuple],
) -> DataFrame:
    """As folded, for streams of any length. schema: of the result's columns after the key."""
    rows = clustered(log.select(key, order, *fields), key, order)
    names = [f.name for f in log.sparkSession.createDataFrame([], schema).schema]
    kind = dict(log.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []
        started = False
        for batch in batches:
            for k, *values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not started or k != current:
                    if started:
                        done.append((current, *result(state)))
                    current, state, started = k, init(), True
                state = step(state, tuple(values))
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip([key, *names], r, strict=True)) for r in done])
                done = []
        if started:
            yield pa.RecordBatch.from_pylist([dict(zip([key, *names], (current, *result(state)), strict=True))])

    return rows.mapInArrow(run, f"{key} {kind}, {schema}")


def streamed_on(
    log: DataFrame,
    snapshots: DataFrame,
    fields: list[str],
    seed: Callable[[Any], Any],
    step: Callable[[Any, tuple], Any],
    schema: str,
    result: Callable[[Any], tuple],
) -> DataFrame:
    """As seeded, for streams of any length. snapshots: stream_id, version, state; seed(state, null for none) ->
    the start; a result is (state, version of the last event or the snapshot).
    """
    base = snapshots.select("stream_id", F.col("version").alias("base"))
    later = log.join(base, "stream_id", "left").where(F.col("version") > F.coalesce("base", F.lit(0)))
    kind = dict(snapshots.dtypes)["state"]
    rows = later.select("stream_id", "version", F.lit(None).cast(kind).alias("seed_"), F.lit(False).alias("first_"), *fields)
    voids = [F.lit(None).cast(dict(log.dtypes)[f]).alias(f) for f in fields]
    rows = rows.unionByName(snapshots.select("stream_id", "version", F.col("state").alias("seed_"), F.lit(True).alias("first_"), *voids))

    def on(acc: tuple, row: tuple) -> tuple:
        version, start, first, *values = row
        return (seed(start), version) if first else (step(acc[0], (version, *values)), version)

    return streamed(rows, "stream_id", "version", ["seed_", "first_", *fields], lambda: (seed(None), 0), on, schema, result)


def optional(default: Column, step: Step) -> Step:
    """A step for states that may be null: the first event meets the default. With a null ``init``, keys without events have no state."""
    return lambda state, e: step(F.coalesce(state, default), e)


@dataclass(frozen=True)
class SnapshotPolicy:
    """A snapshot is due once so many events have been committed since the last one."""

    every: int

    def is_due(self, committed: Column, base: Column) -> Column:
        return committed - base >= self.every


def until(log: DataFrame, bound: Column, at: str) -> DataFrame:
    """Each stream's prefix before its first event later than bound; it stops there and doesn't skip. An event
    without a time that it reaches is an error.
    """
    order = W.partitionBy("stream_id").orderBy("version").rowsBetween(W.unboundedPreceding, W.currentRow)
    late = F.coalesce(F.max(F.col(at) > bound).over(order), F.lit(False))
    known = F.when(F.col(at).isNull(), F.raise_error(F.concat(F.lit("no timestamp in "), F.col("stream_id")))).otherwise(F.lit(True))
    return log.withColumn("late", late).where(~F.col("late")).where(known).drop("late")


def history(log: DataFrame, amount: Column) -> DataFrame:
    """The state at every version, for commutative folds: a running sum."""
    order = W.partitionBy("stream_id").orderBy("version").rowsBetween(W.unboundedPreceding, W.currentRow)
    return log.select("stream_id", "version", F.sum(amount).over(order).alias("state"))


def heads(log: DataFrame, lifecycle: DataFrame | None = None) -> DataFrame:
    """stream_id, head: the greatest version ever, cut streams by their recorded head."""
    own = log.groupBy("stream_id").agg(F.max("version").alias("last"))
    if lifecycle is None:
        return own.select("stream_id", F.col("last").alias("head"))
    return own.join(lifecycle.select("stream_id", F.col("head").alias("recorded")), "stream_id", "full").select(
        "stream_id",
        F.greatest(F.coalesce("last", F.lit(0)), F.coalesce("recorded", F.lit(0))).alias("head"),
    )


def scanned(
    log: DataFrame,
    key: str,
    order: str,
    fields: list[str],
    init: Callable[[], Any],
    step: Callable[[Any, tuple], tuple[Any, tuple]],
    schema: str,
) -> DataFrame:
    """As streamed, with a row for each event: step returns the new state and the row's columns after key and order."""
    rows = clustered(log.select(key, order, *fields), key, order)
    kinds = dict(log.dtypes)
    names = [key, order, *[f.name for f in log.sparkSession.createDataFrame([], schema).schema]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, started = None, None, False
        for batch in batches:
            made = []
            for k, *values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not started or k != current:
                    current, state, started = k, init(), True
                state, row = step(state, tuple(values))
                made.append((k, values[0], *row))
            if made:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in made])

    return rows.mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {schema}")
