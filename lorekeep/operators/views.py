"""Views: values folded per key from the log, kept by newest-wins upserts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Newest row per key: an aggregate, combined before the shuffle, rather than a sorted window.


def newest(rows: DataFrame, keys: list[str], by: str, values: list[str]) -> DataFrame:
    """Per key the row with the greatest ``by``."""
    return rows.groupBy(*keys).agg(
        F.max(by).alias(by),
        F.max_by(F.struct(*values), by).alias("kept"),
    ).select(*keys, by, *[F.col(f"kept.{v}").alias(v) for v in values])


def upserted(stored: DataFrame, changes: DataFrame, keys: list[str], by: str, values: list[str]) -> DataFrame:
    """stored with changes, each key keeping its newest row; at equal positions the stored one stays."""
    tagged = stored.select(*keys, by, *values, F.lit(1).alias("own")).unionByName(changes.select(*keys, by, *values, F.lit(0).alias("own")))
    best = tagged.groupBy(*keys).agg(F.max(F.struct(by, "own")).alias("at"), F.max_by(F.struct(*values), F.struct(by, "own")).alias("kept"))
    return best.select(*keys, F.col(f"at.{by}").alias(by), *[F.col(f"kept.{v}").alias(v) for v in values])


def unapplied(log: DataFrame, views: DataFrame, key: Column) -> DataFrame:
    """Events that a view has yet to see: those with a key and past the key's stored sequence."""
    seen = views.select("view_id", F.col("version").alias("seen"))
    return log.withColumn("view_id", key).where(F.col("view_id").isNotNull()).join(seen, "view_id", "left").where(
        F.col("sequence") > F.coalesce("seen", F.lit(0))
    ).drop("seen")


def touched(log: DataFrame, keys: dict[str, Column], *by: str) -> DataFrame:
    """The view rows that events touch, by commit or whatever ``by`` names; one pass for all views."""
    pairs = F.filter(
        F.array(*[F.struct(F.lit(n).alias("view_name"), k.cast("string").alias("view_id")) for n, k in keys.items()]),
        lambda x: x["view_id"].isNotNull(),
    )
    return log.select(*by, F.explode(pairs).alias("p")).select(*by, "p.*").distinct()


def fanned_out(log: DataFrame, views: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Several sum views (key, amount) from one pass over the log."""
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("view_name"),
                k.cast("string").alias("view_id"),
                v.cast("long").alias("amount"),
            ) for n, (k, v) in views.items()
        ]
    )
    every = log.select("sequence", F.explode(F.filter(rows, lambda x: x["view_id"].isNotNull())).alias("p"))
    return every.groupBy("p.view_name", "p.view_id").agg(F.max("sequence").alias("version"), F.sum("p.amount").alias("value"))


def checkpoint_key(name: str, schema_version: int) -> str:
    """A rebuilt projection's checkpoint is its own."""
    return f"{name}@v{schema_version}"


@dataclass(frozen=True)
class View:
    """A value per key, folded from the log in order of sequence.

    key: the row that an event belongs to (null: the event passes by). step:
    (value, event) -> the new value, a Column of the type ``kind``; null takes
    the row away, and the next event starts from ``init`` again. fields: the
    columns that step reads. A row's version is the last sequence it has seen.
    """

    name: str
    key: Column
    kind: str
    init: Column
    step: Callable[[Column, Column], Column]
    fields: tuple[str, ...]

    @property
    def table(self) -> str:
        return f"view-{self.name}"

    @property
    def schema(self) -> T.StructType:
        return T._parse_datatype_string(f"view_id string, version long, value {self.kind}")

    def changed(self, events: DataFrame, stored: DataFrame) -> DataFrame:
        """The rows that unseen events touch, folded on from what is stored: view_id, version, value (null:
        gone). Stored rows and events meet once, by key.
        """
        fields = [f for f in self.fields if f != "sequence"]
        rows = unapplied(events, stored, self.key).groupBy("view_id").agg(
            F.array_sort(F.collect_list(F.struct("sequence", *fields))).alias("es")
        )
        both = rows.join(stored.select("view_id", "value"), "view_id", "left")
        start, void = self.init.cast(self.kind), F.lit(None).cast(self.kind)
        step = lambda value, e: self.step(F.coalesce(value, start), e).cast(self.kind)
        value = F.aggregate("es", F.coalesce("value", void), step)
        return both.select("view_id", F.element_at("es", -1)["sequence"].alias("version"), value.alias("value"))

    def applied(self, events: DataFrame, stored: DataFrame) -> DataFrame:
        """The view after the events."""
        changed = self.changed(events, stored)
        kept = stored.join(changed.select("view_id"), "view_id", "left_anti")
        return kept.unionByName(changed.where(F.col("value").isNotNull()))


def fetched(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """stored: view_name, view_id and more; the rows named by wanted (view_name, view_id), each once."""
    return stored.join(wanted.select("view_name", "view_id").distinct(), ["view_name", "view_id"], "left_semi")
