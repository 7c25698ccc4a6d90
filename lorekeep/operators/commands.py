"""Deciding commands in bulk.

Commands of one stream are decided in order against the state that the earlier
ones left. ``executed`` is the way for streams of any length: events and
commands of a stream are sorted together by Spark, and read row by row with one
state in memory. ``decided`` folds inside the JVM and keeps a stream's commands
and outcomes in one row; it is for streams of some thousand commands at most.
Commands that span streams are checked against conditions: a condition holds if
no event after its position matches its query.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.operators.folds import clustered

COMMITTED, REJECTED, NOOP, ALREADY = "committed", "rejected", "noop", "already_committed"


def decided(commands: DataFrame, key: str, order: str, fields: list[str], init: Column, decide) -> DataFrame:
    """decide(state, command) -> struct<state, outcome>. Per command: key, order, outcome, the state after it."""
    grouped = commands.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("cs"))
    row = f"array<struct<ord:{dict(commands.dtypes)[order]},outcome:string,state:bigint>>"
    start = F.struct(init.alias("state"), F.array().cast(row).alias("done"))

    def step(acc: Column, c: Column) -> Column:
        made = decide(acc["state"], c)
        one = F.struct(c[order].alias("ord"), made["outcome"].alias("outcome"), made["state"].alias("state"))
        return F.struct(made["state"].alias("state"), F.concat(acc["done"], F.array(one)).alias("done"))

    return grouped.select(key, F.explode(F.aggregate("cs", start, step, lambda acc: acc["done"])).alias("d")).select(
        key,
        F.col("d.ord").alias(order),
        F.col("d.outcome").alias("outcome"),
        F.col("d.state").alias("state"),
    )


def withdraw(balance: Column, amount: Column) -> Column:
    """A withdrawal that the balance doesn't cover is rejected."""
    return F.when(balance >= amount, balance - amount).otherwise(balance)


def first_by_key(commands: DataFrame, order: str) -> DataFrame:
    """commands with an idempotency_key: the first of each key and stream commits, later ones get its position.
    Without a key each commits.
    """
    keyed = W.partitionBy("stream_id", "idempotency_key")
    first = F.when(F.col("idempotency_key").isNull(), F.col(order)).otherwise(F.min(order).over(keyed))
    return commands.withColumn("committed_at", first).withColumn(
        "outcome",
        F.when(F.col(order) == F.col("committed_at"), COMMITTED).otherwise(ALREADY),
    )


def unseen(commands: DataFrame, log: DataFrame) -> DataFrame:
    """Commands whose key isn't in the log of their stream."""
    done = log.where(F.col("idempotency_key").isNotNull()).select("stream_id", "idempotency_key")
    return commands.join(done, ["stream_id", "idempotency_key"], "left_anti")


@dataclass(frozen=True)
class Rejection:
    """What decide returns, or raises, for a command that the state doesn't allow."""

    reason: str


@dataclass(frozen=True)
class Decider:
    """How a stream's state comes about and what it allows, in plain Python over dicts.

    apply(state, event) -> state. decide(state, command) -> a list of new
    events (dicts with event_type, payload and, if wanted, tags), an empty list
    for nothing to do, or a Rejection. State must be JSON where it is stored.
    """

    init: Callable[[], Any]
    apply: Callable[[Any, dict], Any]
    decide: Callable[[Any, dict], list[dict] | Rejection]


DECIDED = "stream_id string, ord long, outcome string, reason string, expected_version long, committed_version long, state string, events array<struct<event_type:string,payload:string,tags:array<string>>>"
NEW_EVENTS = pa.list_(pa.struct([("event_type", pa.string()), ("payload", pa.string()), ("tags", pa.list_(pa.string()))]))


def executed(log: DataFrame, commands: DataFrame, decider: Decider, snapshots: DataFrame | None = None) -> DataFrame:
    """commands: ord, stream_id, name, payload, and idempotency_key if commands are keyed. Per command what becomes of it: stream_id, ord, outcome, reason, expected_version (the head that was read), committed_version (its last event's), the state after it as JSON, and its events.

    A command whose key an event of its stream has, or an earlier command, is
    not decided again: it has that commit's version. Snapshots (stream_id,
    version, state as JSON) spare the events up to their version, but for streams
    with keyed commands, whose whole past is read.
    """
    keyed = "idempotency_key" in commands.columns
    asked = commands.select(
        "ord",
        "stream_id",
        F.col("name").alias("event_type"),
        "payload",
        (F.col("idempotency_key") if keyed else F.lit(None).cast("string")).alias("key"),
    )
    streams = asked.groupBy("stream_id").agg(F.max(F.col("key").isNotNull()).alias("keyed"))
    events = log.join(streams, "stream_id")
    rows = []
    if snapshots is not None:
        base = snapshots.join(streams.where(~F.col("keyed")), "stream_id").select(
            "stream_id",
            F.col("version").alias("base"),
            F.col("state").alias("base_state"),
        )
        events = events.join(base.select("stream_id", "base"), "stream_id", "left").where(F.col("version") > F.coalesce("base", F.lit(0)))
        rows.append(
            base.select(
                "stream_id",
                F.lit(0).alias("phase"),
                F.col("base").alias("place"),
                F.lit(None).cast("string").alias("event_type"),
                F.col("base_state").alias("payload"),
                F.lit(None).cast("string").alias("key"),
            )
        )
    rows.append(
        events.select(
            "stream_id",
            F.lit(1).alias("phase"),
            F.col("version").alias("place"),
            "event_type",
            "payload",
            F.col("metadata.idempotency_key").alias("key"),
        )
    )
    rows.append(asked.select("stream_id", F.lit(2).alias("phase"), F.col("ord").alias("place"), "event_type", "payload", "key"))
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.unionByName(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, state, version, keys = None, None, 0, {}
        for batch in batches:
            made = []
            for name, phase, place, kind, payload, key in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if name != stream:
                    stream, state, version, keys = name, decider.init(), 0, {}
                if phase == 0:
                    state, version = json.loads(payload), place
                    continue
                if phase == 1:
                    state, version = decider.apply(state, {"event_type": kind, "payload": payload, "version": place}), place
                    if key is not None:
                        keys[key] = place  # of a commit's events the last one counts
                    continue
                read, new, reason, committed = version, [], None, None
                if key is not None and key in keys:
                    outcome, committed = ALREADY, keys[key]
                else:
                    result = decider.decide(state, {"name": kind, "payload": payload, "ord": place})
                    if isinstance(result, Rejection):
                        outcome, reason = REJECTED, result.reason
                    elif not result:
                        outcome = NOOP
                    else:
                        outcome = COMMITTED
                        for event in result:
                            version += 1
                            new.append({"event_type": event["event_type"], "payload": event.get("payload"), "tags": event.get("tags", [])})
                            state = decider.apply(state, {**new[-1], "version": version})
                        committed = version
                        if key is not None:
                            keys[key] = version
                made.append((stream, place, outcome, reason, read, committed, json.dumps(state), new))
            if made:
                columns = list(zip(*made, strict=True))
                arrays = [
                    pa.array(c, t) for c, t in zip(
                        columns,
                        (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), NEW_EVENTS),
                        strict=True,
                    )
                ]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in DECIDED.split(", ")])

    return clustered(whole, "stream_id", "phase", "place").mapInArrow(run, DECIDED)


def conflicts(conditions: DataFrame, log: DataFrame) -> DataFrame:
    """conditions: condition_id, after, items: array<struct<types:array<string>, tags:array<string>>>. Per condition: the highest matching sequence past ``after`` (null: it holds).

    Only the last event that matches an item can decide, so an item meets
    aggregates, not events: the last sequence by type for items without tags, by
    (tag, type) for items with one tag. Items with more tags are made distinct
    first; each meets the events of its rarest tag.
    """
    item = conditions.select("condition_id", "after", F.explode("items").alias("i"))
    types, tags = F.col("i.types"), F.col("i.tags")
    last = F.max("sequence").alias("sequence")
    by_type = log.groupBy("event_type").agg(last)
    by_tag = log.select(
        "sequence",
        "event_type",
        F.explode(F.array_distinct("tags")).alias("tag"),
    ).groupBy("tag", "event_type").agg(last, F.count(F.lit(1)).alias("n"))

    bare = item.where((F.size(tags) == 0) & (F.size(types) == 0)).join(F.broadcast(by_type.agg(last))).select("condition_id", "after", "sequence")  # one row
    typed = item.where(
        (F.size(tags) == 0) & (F.size(types) > 0)
    ).withColumn("event_type", F.explode("i.types")).join(by_type, "event_type").select("condition_id", "after", "sequence")
    single = item.where(F.size(tags) == 1).withColumn("tag", F.element_at("i.tags", 1))
    exact = single.where(F.size(types) > 0).withColumn("event_type", F.explode("i.types")).join(by_tag, ["tag", "event_type"])
    any_type = single.where(F.size(types) == 0).join(by_tag.groupBy("tag").agg(last), "tag")
    one = exact.select("condition_id", "after", "sequence").unionAll(any_type.select("condition_id", "after", "sequence"))

    many = item.where(F.size(tags) > 1).withColumn("q", F.struct(F.array_sort(types).alias("types"), F.array_sort(tags).alias("tags")))
    sizes = by_tag.groupBy("tag").agg(F.sum("n").alias("n"))
    asked = many.select("q").distinct()
    rarest = asked.withColumn("tag", F.explode("q.tags")).join(sizes, "tag", "left").groupBy("q").agg(
        F.min_by("tag", F.coalesce("n", F.lit(0))).alias("tag")
    )
    events = log.select("sequence", "event_type", F.col("tags").alias("own"), F.explode(F.array_distinct("tags")).alias("tag"))
    fits = F.forall("q.tags", lambda t: F.array_contains("own", t)) & (
        (F.size("q.types") == 0) | F.array_contains("q.types", F.col("event_type"))
    )
    met = rarest.join(events, "tag").where(fits).groupBy("q").agg(last)
    several = many.join(met, "q").select("condition_id", "after", "sequence")

    held = bare.unionAll(typed).unionAll(one).unionAll(several).where(F.col("sequence") > F.col("after"))
    top = held.groupBy("condition_id").agg(F.max("sequence").alias("conflict"))
    return conditions.select("condition_id", "after").join(top, "condition_id", "left")


def reactions(log: DataFrame, saga: str, react: Column) -> DataFrame:
    """react: array<struct<command, target, amount>> of an event. One row for each command, its key ``saga:sequence:index``."""
    rows = log.select("sequence", F.posexplode(react).alias("index", "c"))
    return rows.select(
        F.concat_ws(":", F.lit(saga), F.col("sequence").cast("string"), F.col("index").cast("string")).alias("idempotency_key"),
        "sequence",
        F.col("index").cast("long").alias("index"),
        "c.*",
    )
