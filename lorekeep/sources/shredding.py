"""A store whose payloads are sealed on the way in and opened on the way out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions import shred, shred_json
from lorekeep.operators.predicates import Query
from lorekeep.operators.views import View
from lorekeep.plans.settle import settled
from lorekeep.schema import columns
from lorekeep.sources.store import EventStore, Manifest

KEYS = columns("subject string, key binary")
PARKED = columns("subscription string, sequence long, payload string, error string, attempts long, at long")


class ShreddingStore:
    """Every way in seals, every way out opens: events, snapshots and other side tables, parked events."""

    def __init__(self, store: EventStore) -> None:
        self.store = store

    def keys(self) -> DataFrame:
        return self.store.table("subject_keys", KEYS)

    def _sealed(self, rows: DataFrame, key: str, column: str = "payload") -> DataFrame:
        """Creates the keys that are missing, then seals; an erased subject is an error."""
        need = settled(shred_json.subjects(rows, column))
        self.store.put("subject_keys", KEYS, lambda old, _: shred.created_keys(old, need))
        return settled(shred_json.sealed(rows, self.keys(), key, column))

    def append(self, stream_id: str, events: DataFrame, kind: str = "any", expected: int = 0) -> Manifest:
        return self.store.append(stream_id, self._sealed(events, "ord"), kind, expected)

    def append_batch(
        self,
        events: DataFrame,
        asks: DataFrame,
        query: Query | None = None,
        after: int = 0,
        inline: tuple[View, ...] = (),
    ) -> Manifest:
        return self.store.append_batch(self._sealed(events, "ord"), asks, query, after, inline)

    def append_if(self, events: DataFrame, asks: DataFrame, query: Query, after: int) -> Manifest:
        return self.append_batch(events, asks, query, after)

    def log(self, at: Manifest | None = None) -> DataFrame:
        return shred_json.opened(self.store.log(at), self.keys(), "sequence")

    def stream(self, stream_id: str, after: int = 0) -> DataFrame:
        return shred_json.opened(self.store.stream(stream_id, after), self.keys(), "sequence").orderBy("version")

    def manifest(self, commit: int | None = None) -> Manifest:
        return self.store.manifest(commit)

    def upsert(self, name: str, schema: T.StructType, rows: DataFrame, keys: list[str], by: str, column: str | None = None) -> Manifest:
        """As the store's; ``column`` holds JSON that is sealed, a snapshot's state or a view's value. Rows are
        named by the first of their keys.
        """
        return self.store.upsert(name, schema, self._sealed(rows, keys[0], column) if column else rows, keys, by)

    def table(self, name: str, schema: T.StructType, key: str, column: str, at: Manifest | None = None) -> DataFrame:
        return shred_json.opened(self.store.table(name, schema, at), self.keys(), key, column)

    def park(self, rows: DataFrame) -> Manifest:
        """rows: subscription, sequence, payload, error, attempts, at. Of a sequence the newest stays."""
        return self.store.upsert("parked-payloads", PARKED, self._sealed(rows, "sequence"), ["subscription", "sequence"], "at")

    def parked(self, subscription: str) -> DataFrame:
        own = self.store.table("parked-payloads", PARKED).where(F.col("subscription") == subscription)
        return shred_json.opened(own, self.keys(), "sequence").orderBy("sequence")

    def unpark(self, subscription: str, sequence: int) -> Manifest:
        gone = (F.col("subscription") == subscription) & (F.col("sequence") == sequence)
        return self.store.put("parked-payloads", PARKED, lambda old, _: old.where(~gone))

    def erase(self, subject: str) -> Manifest:
        """Deletes a subject's key for good; again, or for an unknown subject, is fine."""
        gone = self.store.spark.createDataFrame([(subject,)], "subject string")
        return self.store.put("subject_keys", KEYS, lambda old, _: shred.erased(old, gone))

    def erased(self, subject: str) -> bool:
        return self.keys().where((F.col("subject") == subject) & F.col("key").isNull()).count() > 0
