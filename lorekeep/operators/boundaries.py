"""Decisions over several streams, or over whatever a query selects.

A fixed boundary names its streams; each stream's state is folded once for all
commands that need it. A dynamic boundary is a query; the events of each
distinct query are folded once for all decisions that ask it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.folds import clustered
from lorekeep.operators.predicates import Query


def lined_up(asked: DataFrame) -> DataFrame:
    """asked: ord, streams, ...; each command's streams sorted, each once."""
    return asked.withColumn("streams", F.array_sort(F.array_distinct("streams")))


def first_in_line(asked: DataFrame) -> DataFrame:
    """The commands that come first, by ord, on every one of their streams: these don't touch each other."""
    places = asked.select("ord", F.explode("streams").alias("stream_id"))
    first = places.groupBy("stream_id").agg(F.min("ord").alias("ord"))
    able = first.groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(able, "ord").where(F.col("n") == F.size("streams")).drop("n")


def joined(asked: DataFrame, states: DataFrame, state: str = "state") -> DataFrame:
    """asked with ``states``: map<stream_id, state> of its streams; streams without a state are not in it (written to only)."""
    places = asked.select("ord", F.explode("streams").alias("stream_id"))
    met = places.join(states.select("stream_id", F.col(state).alias("s")), "stream_id")
    maps = met.groupBy("ord").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stream_id", "s")))).alias("states"))
    none = F.create_map().cast(maps.schema["states"].dataType)
    return asked.join(maps, "ord", "left").withColumn("states", F.coalesce("states", none))


def decided(asked: DataFrame, states: DataFrame, decide: Callable[[Column, DataFrame], Column]) -> DataFrame:
    """decide(states, command's columns by name) -> array<struct<stream_id, event_type, payload>>: null rejects,
    empty does nothing. An event of a stream outside the command's boundary is an error.
    """
    rows = joined(asked, states)
    rows = rows.withColumn("events", decide(F.col("states"), rows))
    inside = F.forall("events", lambda e: F.array_contains("streams", e["stream_id"]))
    outcome = F.when(F.col("events").isNull(), "rejected").when(F.size("events") == 0, "noop").when(inside, "committed").otherwise(
        F.raise_error("an event outside the boundary")
    )
    return rows.withColumn("outcome", outcome)


def appends(done: DataFrame) -> DataFrame:
    """The events of committed commands: by stream, in the order of the decisions and, inside one, as it listed them."""
    rows = done.where("outcome = 'committed'").select("ord", F.posexplode("events").alias("place", "e"))
    return rows.select(F.struct(F.col("e.stream_id").alias("stream_id"), "ord", "place").alias("ord"), "e.*")


def checked(events: DataFrame, query: Query) -> DataFrame:
    """events as they are; reading one that the query doesn't select, or that has no position, is an error."""
    fits = F.coalesce(query.column(), F.lit(False)) & (F.col("sequence") > 0)
    return events.where(
        F.when(fits, True).otherwise(
            F.raise_error(F.concat(F.lit("event outside the query: "), F.coalesce(F.col("sequence").cast("string"), F.lit("?"))))
        )
    )


def queried(
    decisions: DataFrame,
    log: DataFrame,
    fields: list[str],
    init: Callable[[], Any],
    step: Callable[[Any, tuple], Any],
    schema: str,
    result: Callable[[Any], tuple],
) -> DataFrame:
    """decisions: decision_id, after, types (array, empty: any), tag. Per decision: decision_id, read (the last event it rests on, 0: none) and the columns of ``schema``: the fold, in order, of the events up to ``after`` that have its tag and one of its types.

    Decisions that ask for the same events stand among them in order of
    position, and take the fold's state as it passes: each event is folded once
    for all of them, one state in memory. step and result as in ``folds.streamed``;
    an event's tuple begins with its sequence.
    """
    asked = decisions.withColumn("types", F.array_sort(F.array_distinct("types")))
    distinct = asked.select("tag", "types").distinct()
    names = [f for f in fields if f not in ("sequence", "event_type")]
    events = log.select("sequence", "event_type", F.explode(F.array_distinct("tags")).alias("tag"), *names)
    fits = (F.size("types") == 0) | F.array_contains("types", F.col("event_type"))
    met = events.join(distinct, "tag").where(fits)
    group = F.concat_ws("\n", "tag", "types").alias("group")
    own = dict(met.dtypes)
    void = [F.lit(None).cast(own[f]).alias(f) for f in fields if f != "sequence"]
    rows = met.select(
        group,
        F.col("sequence").alias("place"),
        F.lit(0).alias("phase"),
        F.lit(None).cast(dict(asked.dtypes)["decision_id"]).alias("decision_id"),
        *[f for f in fields if f != "sequence"],
    )
    rows = rows.unionByName(asked.select(group, F.col("after").alias("place"), F.lit(1).alias("phase"), "decision_id", *void))
    kinds = ", ".join(["decision_id " + dict(asked.dtypes)["decision_id"], "read long", schema])
    out_names = [f.name for f in log.sparkSession.createDataFrame([], kinds).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, read = None, None, 0
        for batch in batches:
            made = []
            for name, place, phase, decision, *values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if name != current:
                    current, state, read = name, init(), 0
                if phase == 0:
                    state, read = step(state, (place, *values)), place
                else:
                    made.append(dict(zip(out_names, (decision, read, *result(state)), strict=True)))
            if made:
                yield pa.RecordBatch.from_pylist(made)

    return clustered(rows, "group", "place", "phase").mapInArrow(run, kinds)
