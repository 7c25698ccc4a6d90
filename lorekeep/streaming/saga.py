"""Sagas: events are reacted to by commands, in order, each with a key of its own, so that a redelivered event does nothing twice."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.errors import EventRejected
from lorekeep.operators import commands
from lorekeep.plans.settle import settled
from lorekeep.repository import Repository


@dataclass
class Saga:
    """react: array<struct<command, target, payload>> of an event, null or empty for none.

    The commands of a batch of events are decided first and appended then. The
    first one that is rejected, by (sequence, index), stops the saga: commands
    before it are executed, it and later ones are not, and the projector
    acknowledges nothing from its event on.
    """

    name: str
    repository: Repository
    react: Column
    dispatch: Callable[[DataFrame], DataFrame] | None = None

    def commands(self, events: DataFrame) -> DataFrame:
        rows = events.select("sequence", F.posexplode(self.react).alias("index", "c"))
        key = F.concat_ws(":", F.lit(self.name), F.col("sequence").cast("string"), F.col("index").cast("string"))
        order = F.shiftleft("sequence", 16) + F.col("index")
        return rows.select(
            order.alias("ord"),
            "sequence",
            "index",
            F.col("c.target").alias("stream_id"),
            F.col("c.command").alias("name"),
            F.col("c.payload").alias("payload"),
            key.alias("idempotency_key"),
        )

    def apply(self, events: DataFrame) -> None:
        asked = settled(self.commands(events))
        log = self.repository.store.log().select("stream_id", "version", "event_type", "payload", "metadata")
        tried = commands.executed(log, asked, self.repository.decider)
        bad = tried.where(F.col("outcome") == commands.REJECTED).orderBy("ord").limit(1).collect()
        able = asked.where(F.col("ord") < bad[0].ord) if bad else asked
        if able.limit(1).count():
            (self.dispatch or self.repository.execute)(able.drop("sequence", "index"))
        if bad:
            raise EventRejected(bad[0].ord >> 16, bad[0].reason or "rejected")
