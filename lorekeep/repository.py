"""Commands executed against a store: load, fold, decide, append; again on a conflict."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.errors import Conflict, QueryConflict, Unavailable
from lorekeep.functions import metadata as meta
from lorekeep.operators import boundaries, commands, folds
from lorekeep.operators.commands import Decider
from lorekeep.operators.folds import SnapshotPolicy
from lorekeep.operators.predicates import Query
from lorekeep.operators.views import View
from lorekeep.plans.settle import settled
from lorekeep.schema import METADATA, NEW_EVENT, columns
from lorekeep.sources.store import EventStore

SNAPSHOTS = columns("stream_id string, version long, state string")
RETRIES, NEVER = 3, 0


@dataclass
class Repository:
    """One kind of stream: its decider, its store, and what is kept with it.

    All commands of a call are decided in one job, those of a stream in the
    order of ``ord``; all their events are appended in one commit. If another
    writer was faster on one of the streams, all are loaded and decided anew, at
    most ``retries`` times.
    """

    store: EventStore
    decider: Decider
    retries: int = RETRIES
    snapshots: SnapshotPolicy | None = None
    inline: tuple[View, ...] = ()
    stamp: Callable[[DataFrame], DataFrame] | None = None
    _table: str = field(default="snapshots", repr=False)

    def snapshot_rows(self) -> DataFrame:
        return self.store.table(self._table, SNAPSHOTS)

    def execute(self, asked: DataFrame) -> DataFrame:
        """asked: ord, stream_id, name, payload, and idempotency_key and metadata if there are any. Per command:
        stream_id, ord, outcome, reason, expected_version, committed_version, state, events.
        """
        asked = settled(self.stamp(asked) if self.stamp else asked)
        metrics = self.store.metrics
        with metrics.timed("commands.execute"):
            for attempt in range(self.retries + 1):
                if attempt:
                    metrics.add("commands.retries")
                at = self.store.manifest()
                log = self.store.log(at).select("stream_id", "version", "event_type", "payload", "metadata")
                known = self.snapshot_rows() if self.snapshots else None
                done = settled(commands.executed(log, asked, self.decider, known))
                try:
                    self._append(done, asked)
                except (Conflict, Unavailable) as error:
                    if attempt == self.retries:
                        raise error
                    continue
                for row in done.groupBy("outcome").count().collect():
                    metrics.add(f"commands.{row.outcome}", row["count"])
                if self.snapshots:
                    self._offer(done)
                return done
        raise AssertionError("unreachable")

    def _append(self, done: DataFrame, asked: DataFrame) -> None:
        committed = done.where(F.col("outcome") == commands.COMMITTED)
        asks = committed.groupBy("stream_id").agg(F.min("expected_version").alias("expected_version"))
        asks = asks.withColumn("expected_kind", F.when(F.col("expected_version") == 0, "empty").otherwise("exact"))
        if not asks.limit(1).count():
            return
        self.store.append_batch(new_events(committed, asked), settled(asks), inline=self.inline)

    def _offer(self, done: DataFrame) -> None:
        """Snapshots where they are due, by the streams' states after the call; a failure here fails no command."""
        last = done.where(F.col("committed_version").isNotNull()).groupBy("stream_id").agg(
            F.max("committed_version").alias("version"),
            F.max_by("state", "ord").alias("state"),
        )
        known = self.snapshot_rows().select("stream_id", F.col("version").alias("base"))
        due = last.join(known, "stream_id", "left").where(
            self.snapshots.is_due(F.col("version"), F.coalesce("base", F.lit(0)))
        ).select("stream_id", "version", "state")
        try:
            due = settled(due)
            if due.limit(1).count():
                self.store.upsert(self._table, SNAPSHOTS, due, ["stream_id"], "version")
        except Exception as error:  # noqa: BLE001
            self.last_offer_error = error

    def load(self, streams: DataFrame | None = None, at_version: int | None = None, until=None) -> DataFrame:
        """stream_id, version, state (JSON) of all streams, or those named; up to a version, or to the first event later than a time."""
        log = self.store.log().select("stream_id", "version", "event_type", "payload", F.col("metadata.timestamp").alias("timestamp"))
        if streams is not None:
            log = log.join(streams.select("stream_id").distinct(), "stream_id", "left_semi")
        if at_version is not None:
            log = log.where(F.col("version") <= at_version)
        if until is not None:
            log = folds.until(log, F.lit(until), "timestamp")
        decider = self.decider

        def step(acc, e):
            version, kind, payload = e
            return decider.apply(acc[0], {"event_type": kind, "payload": payload, "version": version}), version

        return folds.streamed(
            log,
            "stream_id",
            "version",
            ["event_type", "payload"],
            lambda: (decider.init(), 0),
            step,
            "state string, version long",
            lambda acc: (json.dumps(acc[0]), acc[1]),
        )

    def execute_boundary(self, asked: DataFrame, decide) -> DataFrame:
        """Commands over several streams each: asked has ord, streams (array<string>) and further fields; decide(states, command) -> array<struct<stream_id, event_type, payload>>, null for a rejection. states: map<stream_id, state JSON>.

        Commands that share a stream are taken one after another: a round
        decides and appends those that come first on all their streams.
        """
        left, out = settled(boundaries.lined_up(asked)), None
        while left.limit(1).count():
            now = settled(boundaries.first_in_line(left))
            names = now.select(F.explode("streams").alias("stream_id")).distinct()
            for attempt in range(self.retries + 1):
                states = self.load(names)
                done = settled(boundaries.decided(now, states, decide))
                rows = boundaries.appends(done)
                heads = names.join(states.select("stream_id", "version"), "stream_id", "left")
                asks = heads.join(rows.select("stream_id").distinct(), "stream_id").select(
                    "stream_id",
                    F.when(F.col("version").isNull(), "empty").otherwise("exact").alias("expected_kind"),
                    F.coalesce("version", F.lit(0)).alias("expected_version"),
                )
                try:
                    if rows.limit(1).count():
                        self.store.append_batch(settled(complete(rows)), settled(asks), inline=self.inline)
                    break
                except Conflict:
                    self.store.metrics.add("commands.retries")
                    if attempt == self.retries:
                        raise
            part = done.select("ord", "outcome")
            out = part if out is None else out.unionByName(part)
            left = settled(left.join(now.select("ord"), "ord", "left_anti"))
        return out

    def execute_query(self, query: Query, fold, decide, validate: Query | None = None, acknowledged: int = 0) -> int | None:
        """One decision over whatever the query selects: fold(events) -> state, decide(state) -> DataFrame of
        events (as NEW_EVENT, with ord), or None. The append is refused, and all is read anew, if past
        max(read, acknowledged) an event came that ``validate`` (as a rule the query itself) selects. The
        commit's last sequence.
        """
        for attempt in range(self.retries + 1):
            at = self.store.manifest()
            events = boundaries.checked(self.store.log(at).where(query.column()), query)
            read = events.agg(F.max("sequence")).first()[0] or 0
            new = decide(fold(events))
            if new is None:
                return None
            asks = new.select("stream_id").distinct().select(
                "stream_id",
                F.lit("any").alias("expected_kind"),
                F.lit(0).cast("long").alias("expected_version"),
            )
            try:
                return self.store.append_if(new, asks, validate or query, max(read, acknowledged)).last_sequence
            except QueryConflict:
                self.store.metrics.add("commands.retries")
                if attempt == self.retries:
                    raise
        return None


def new_events(committed: DataFrame, asked: DataFrame) -> DataFrame:
    """The events of committed commands as they are appended: by stream, in the order of their commands; a
    command's key and metadata go to each of its events.
    """
    given = ["ord", "stream_id", *[c for c in ("idempotency_key", "metadata") if c in asked.columns]]
    rows = committed.select("stream_id", "ord", F.posexplode("events").alias("place", "e")).join(asked.select(*given), ["stream_id", "ord"])
    own = F.col("metadata") if "metadata" in given else F.lit(None).cast(METADATA)
    if "idempotency_key" in given:
        own = meta.with_key(own, F.col("idempotency_key"))
    order = F.struct("stream_id", "ord", "place")
    return complete(rows.select(order.alias("ord"), "stream_id", "e.event_type", "e.payload", "e.tags", own.alias("metadata")))


def complete(rows: DataFrame) -> DataFrame:
    """rows with the columns of NEW_EVENT that they lack."""
    defaults = {"schema_version": F.lit(1), "tags": F.array().cast("array<string>"), "metadata": F.lit(None), "payload": F.lit(None)}
    return rows.select(
        "ord",
        *[(F.col(f.name) if f.name in rows.columns else defaults[f.name]).cast(f.dataType).alias(f.name) for f in NEW_EVENT.fields],
    )
