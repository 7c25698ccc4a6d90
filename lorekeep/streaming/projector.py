"""Projections that run to the log's head and stop, or on and on.

A batch is applied, then acknowledged: the checkpoint moves only after all its
events are in. A batch may come again after a failure, so what is applied must
be keyed by sequence; views are.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.errors import EventRejected, LeaseLost
from lorekeep.operators import views
from lorekeep.operators.predicates import EventFilter
from lorekeep.operators.views import View, checkpoint_key
from lorekeep.plans.settle import dropped, settled
from lorekeep.schema import columns
from lorekeep.sources.store import EventStore
from lorekeep.streaming.source import LogSource


VIEWS = columns("view_name string, view_id string, version long, value long")
CHECKPOINTS = columns("name string, sequence long, at long")
PARKED = columns("subscription string, sequence long, stream_id string, error string, attempts long, at long")
REJECTED = columns("sequence long, stream_id string, error string")
LEASES = columns("name string, holder string, renewed long, acquired long, at long")


def now_ms() -> int:
    return time.time_ns() // 1_000_000


@dataclass
class Lease:
    """One holder a name: within ttl * grace of its last renewal and ttl * max_grace of its acquisition."""

    store: EventStore
    name: str
    holder: str
    ttl_ms: int = 5000
    grace: int = 3
    max_grace: int = 12
    clock: Callable[[], int] = now_ms
    renewed: int = 0

    def acquire(self) -> bool:
        return self._hold(new=True)

    def renew(self) -> None:
        if not self._hold(new=False):
            raise LeaseLost(self.name)

    def renew_if_due(self) -> None:
        """Before a fetch: only once a time to live has gone by."""
        if self.clock() - self.renewed >= self.ttl_ms:
            self.renew()

    def _hold(self, new: bool) -> bool:
        now, won = self.clock(), False

        def change(old: DataFrame, _) -> DataFrame:
            nonlocal won
            row = old.where(F.col("name") == self.name).first()
            mine = row is not None and row.holder == self.holder
            held = row is not None and row.renewed is not None and now - row.renewed < self.ttl_ms * self.grace and now - row.acquired < self.ttl_ms * self.max_grace
            won = (mine and held) if not new else (mine or not held)
            if not won:
                return old
            acquired = now if new else row.acquired
            return old.where(F.col("name") != self.name).unionByName(
                self.store.spark.createDataFrame([(self.name, self.holder, now, acquired, now)], LEASES)
            )

        self.store.put("leases", LEASES, change)
        if won:
            self.renewed = now
        return won

    def release(self) -> None:
        self.store.put("leases", LEASES, lambda old, _: old.where(~((F.col("name") == self.name) & (F.col("holder") == self.holder))))


@dataclass
class ViewProjection:
    """A view that sums ``amount`` per ``key`` (null: the event passes by), newest sequence wins."""

    store: EventStore
    name: str
    key: Column
    amount: Column

    def apply(self, events: DataFrame) -> None:
        def change(old: DataFrame, _) -> DataFrame:
            own = old.where(F.col("view_name") == self.name)
            fresh = views.unapplied(events, own, self.key)
            delta = fresh.groupBy("view_id").agg(F.max("sequence").alias("version"), F.sum(self.amount.cast("long")).alias("value"))
            sums = own.select("view_id", "version", "value").unionByName(delta).groupBy("view_id").agg(
                F.max("version").alias("version"),
                F.sum("value").alias("value"),
            )
            return old.where(F.col("view_name") != self.name).unionByName(
                sums.select(F.lit(self.name).alias("view_name"), "view_id", "version", "value")
            )

        self.store.put("views", VIEWS, change)


@dataclass
class FoldedProjection:
    """A view of any fold (``views.View``), kept in a side table of its own."""

    store: EventStore
    view: View

    def apply(self, events: DataFrame) -> None:
        self.store.put(self.view.table, self.view.schema, lambda old, _: self.view.applied(events, old))

    def rows(self) -> DataFrame:
        return self.store.table(self.view.table, self.view.schema)


@dataclass
class Projector:
    """Applies the log from its checkpoint in batches of at most ``batch`` events; while it is behind and ``apply`` doesn't raise, each batch may be four times the last one, up to ``largest``.

    where: only matching events are applied; the checkpoint still moves past
    the others. An event is rejected if ``poison`` (an error's text, null for
    good events) says so, or if ``apply`` raises; the events that make it raise
    are found by halving the batch. What ``poison`` rejects stays in tables, so it may
    be any share of a batch. Rejected events are tried again after
    ``retry_ms``. Halt (retries None) stops at the first rejected event, nothing
    past it acknowledged; with retries, those rejected more often than that, one
    time after another, are parked, and the rest goes on.
    """

    store: EventStore
    name: str
    apply: Callable[[DataFrame], None]
    poison: Column | None = None
    retries: int | None = None
    batch: int = 128
    version: int = 1
    lease: Lease | None = None
    where: EventFilter = field(default_factory=EventFilter)
    idle_ms: int = 100
    retry_ms: int = 1000
    caught_up: Callable[[int], None] | None = None
    parking: bool = True
    largest: int = 1 << 20

    def __post_init__(self) -> None:
        if self.retries is not None and not self.parking:
            raise ValueError("events can only be parked where a store of parked events is allowed")
        self._size = self.batch

    def key(self) -> str:
        return checkpoint_key(self.name, self.version)

    def checkpoint(self) -> int:
        row = self.store.table("checkpoints", CHECKPOINTS).where(F.col("name") == self.key()).first()
        return row.sequence if row else 0

    def acknowledge(self, sequence: int) -> None:
        if self.lease:
            self.lease.renew()  # always before the checkpoint moves
        row = self.store.spark.createDataFrame([(self.key(), sequence, now_ms())], CHECKPOINTS)
        self.store.put("checkpoints", CHECKPOINTS, lambda old, _: old.where(F.col("name") != self.key()).unionByName(row))

    def run(self) -> int:
        """To the head as it is now; the last sequence acknowledged."""
        if self.lease and not self.lease.acquire():
            raise LeaseLost(self.lease.name)
        at = self.checkpoint()
        while (upto := self._batch(at)) is not None:
            at = upto
        return at

    def follow(self, stop: threading.Event) -> int:
        """On and on until ``stop``; then what is under way is finished, and one closing read made. A commit in
        this process ends an idle sleep early, but no pause after a failure.
        """
        if self.lease and not self.lease.acquire():
            raise LeaseLost(self.lease.name)
        at, failed = self.checkpoint(), False
        while True:
            closing = stop.is_set()
            seen = self.store.committed.last
            try:
                upto = self._batch(at)
            except LeaseLost as error:
                raise LeaseLost(self.lease.name, at) from error
            except Exception:
                if self.retries is None or closing or failed:  # a second failure in a row ends it
                    raise
                failed = True
                stop.wait(self.retry_ms / 1000)
                continue
            failed = False
            if upto is not None:
                at = upto
            elif closing:
                return at
            else:
                if self.caught_up:
                    self.caught_up(at)
                self.store.committed.wait(seen, self.idle_ms / 1000)

    def _batch(self, at: int) -> int | None:
        """Applies and acknowledges the next batch; its upper bound, or None at the head."""
        if self.lease:
            self.lease.renew_if_due()
        manifest, metrics = self.store.manifest(), self.store.metrics
        metrics.set("projector.lag", max(0, manifest.last_sequence - at))
        if at >= manifest.last_sequence:
            return None
        with metrics.timed("projector.batch"):
            window = self.store.log(manifest).where(F.col("sequence") > at)
            if not self.where.is_all():
                window = window.where(self.where.column())
            upto, n, full = self._bound(window, at, manifest.last_sequence)
            events = window.where(F.col("sequence") <= upto)
            made: list[DataFrame] = []
            try:
                rejected, bad, raised = self._try(events, n, at, made)
                for _ in range(self.retries or 0):
                    if not bad:
                        break
                    time.sleep(self.retry_ms / 1000)
                    again = events.join(rejected.select("sequence"), "sequence", "left_semi")
                    rejected, bad, more = self._try(again, bad, at, made)
                    raised = raised or more
                if bad:
                    self.park(rejected, bad)
            finally:
                dropped(*made)
            metrics.add("projector.events_applied", n - bad)
            self._size = min(self._size * 4, max(self.largest, self.batch)) if full and not raised else self.batch
            self.acknowledge(upto)
        return upto

    def _bound(self, window: DataFrame, at: int, last: int) -> tuple[int, int, bool]:
        """The next batch's last sequence, its number of events, and whether there is more past it."""
        if not self.where.is_all():
            ends = window.select("sequence").orderBy("sequence").limit(self._size).agg(F.max("sequence"), F.count(F.lit(1))).first()
            full = ends[1] == self._size
            return ends[0] if full else last, ends[1], full
        upto = min(at + self._size, last)  # positions are distinct: no more events than that, and none to sort
        n = window.where(F.col("sequence") <= upto).count()
        if not n and upto < last:  # all of them cut: on to the next one that is kept
            least = window.agg(F.min("sequence")).first()[0]
            upto = last if least is None else least - 1
        return upto, n, upto < last

    def _try(self, events: DataFrame, n: int, at: int, made: list[DataFrame]) -> tuple[DataFrame | None, int, bool]:
        """Applies what can be applied of n events; those rejected (columns of REJECTED), how many, and whether
        ``apply`` raised. ``made`` gets the rows that are settled for it.
        """
        rejected, bad = None, 0
        if not n:
            return rejected, bad, False
        tried = events
        if self.poison is not None:
            judged = events.select("sequence", "stream_id", self.poison.alias("error")).where("error IS NOT NULL")
            if self.retries is None:
                first = judged.orderBy("sequence").first()
                if first:
                    self._halt(events, at, first.sequence, first.error)
            else:
                rejected, bad = self._kept(judged, made)
            events = events.where(self.poison.isNull())
        raised: dict[int, str] = {}
        if bad < n:
            try:
                self.apply(events)
            except LeaseLost:
                raise
            except Exception as error:
                numbers = sorted(r.sequence for r in events.select("sequence").collect())
                self._narrow(events, numbers, error, raised, at)
        if raised:
            why = self.store.spark.createDataFrame(list(raised.items()), "sequence long, error string")
            thrown = tried.select("sequence", "stream_id").join(F.broadcast(why), "sequence")
            rejected, bad = self._kept(thrown.unionByName(rejected) if bad else thrown, made)
        self.store.metrics.add("projector.rejections", bad)
        return rejected, bad, bool(raised)

    @staticmethod
    def _kept(rows: DataFrame, made: list[DataFrame]) -> tuple[DataFrame, int]:
        out = settled(rows.select(*[F.col(f.name).cast(f.dataType) for f in REJECTED.fields]))
        made.append(out)
        return out, out.count()

    def _narrow(self, events: DataFrame, numbers: list[int], error: Exception, rejected: dict[int, str], at: int) -> None:
        if isinstance(error, EventRejected) and error.sequence in numbers:
            cut = numbers.index(error.sequence)
            parts = [numbers[:cut], numbers[cut : cut + 1], numbers[cut + 1 :]]
        else:
            parts = [numbers[: len(numbers) // 2], numbers[len(numbers) // 2 :]] if len(numbers) > 1 else [numbers]
        for part in parts:
            if part == numbers or isinstance(error, EventRejected) and part == [error.sequence]:
                if self.retries is None:
                    self._halt(events, at, part[0] if part else at + 1, str(error), applied=True)
                rejected[part[0]] = str(error)
            elif part:
                try:
                    self.apply(events.where(F.col("sequence").between(part[0], part[-1])))
                except LeaseLost:
                    raise
                except Exception as inner:
                    self._narrow(events, part, inner, rejected, at)

    def _halt(self, events: DataFrame, at: int, sequence: int, reason: str, applied: bool = False) -> None:
        if not applied:
            self.apply(events.where(F.col("sequence") < sequence))
        if sequence - 1 > at:
            self.acknowledge(sequence - 1)
        raise EventRejected(sequence, reason)

    def park(self, rejected: DataFrame, n: int) -> None:
        """rejected: n rows of REJECTED, each tried as often as it may be."""
        rows = rejected.select(
            F.lit(self.name).alias("subscription"),
            "sequence",
            "stream_id",
            "error",
            F.lit((self.retries or 0) + 1).cast("long").alias("attempts"),
            F.lit(now_ms()).alias("at"),
        )
        self.store.upsert("parked", PARKED, rows, ["subscription", "sequence"], "at")
        self.store.metrics.add("projector.events_parked", n)

    def parked(self) -> DataFrame:
        """Oldest first."""
        return self.store.table("parked", PARKED).where(F.col("subscription") == self.name).orderBy("sequence")

    def unpark(self, sequence: int) -> None:
        self.store.put(
            "parked",
            PARKED,
            lambda old, _: old.where(~((F.col("subscription") == self.name) & (F.col("sequence") == sequence))),
        )

    def rebuild(self, version: int, apply: Callable[[DataFrame], None]) -> Projector:
        """A run of the same projection from the log's start to its head under a checkpoint of its own; the old one's stays."""
        new = Projector(
            self.store,
            self.name,
            apply,
            self.poison,
            self.retries,
            self.batch,
            version,
            self.lease,
            self.where,
            self.idle_ms,
            self.retry_ms,
        )
        new.run()
        return new


def stream_to(spark: SparkSession, path: str, checkpoint: str, apply: Callable[[DataFrame], None], **options: str) -> None:
    """Structured Streaming over what a store has committed, to the head, then stop; Spark's offset log is the checkpoint."""
    spark.dataSource.register(LogSource)
    rows = spark.readStream.format("lorekeep").options(path=path, **options).load()
    query = rows.writeStream.foreachBatch(lambda batch, _: apply(batch)).option(
        "checkpointLocation",
        checkpoint,
    ).trigger(availableNow=True).start()
    query.awaitTermination()
