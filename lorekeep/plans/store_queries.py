"""Registered queries through a store of their own: what was appended, projected and parked, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import views
from lorekeep.operators.commands import executed
from lorekeep.plans.log_queries import query
from lorekeep.plans.settle import settled, shared_dir
from lorekeep.plans.workflow_queries import account
from lorekeep.repository import complete
from lorekeep.schema import padded, snake_case, variant
from lorekeep.sources import logs
from lorekeep.sources.store import EventStore
from lorekeep.streaming.projector import PARKED, VIEWS, Projector, ViewProjection

#: The log as it stands in the store: the odd sequences were appended first, then the even ones.
STORED = """, o AS (SELECT *, row_number() OVER (ORDER BY sequence % 2 = 0, sequence) AS place FROM user_log),
stored AS (SELECT place, stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY place) AS number, event_type, amount FROM o)"""


def balance() -> views.View:
    amount = lambda e: e["payload"].cast("long")
    step = lambda value, e: F.when(e["event_type"] == "click", value + amount(e)).when(e["event_type"] == "purchase", value - amount(e)).otherwise(value)
    return views.View("balance", F.col("stream_id"), "long", F.lit(0).cast("long"), step, ("event_type", "payload"))


def stored(spark: SparkSession, d: str, inline: tuple[views.View, ...] = ()) -> EventStore:
    """The users' events in a new store, in two commits."""
    store = EventStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    rows = logs.flat_log(spark, d).select(
        F.col("sequence").alias("ord"),
        "stream_id",
        "event_type",
        F.col("amount").cast("string").alias("payload"),
        "tags",
    )
    for odd in (1, 0):
        part = complete(rows.where(F.col("ord") % 2 == odd))
        asks = settled(
            part.select("stream_id").distinct().select(
                "stream_id",
                F.lit("any").alias("expected_kind"),
                F.lit(0).cast("long").alias("expected_version"),
            )
        )
        store.append_batch(part, asks, inline=inline)
    return store


@query(STORED + " SELECT place AS sequence, stream_id, number AS version, event_type, CAST(amount AS VARCHAR) AS payload FROM stored")
def stored_log(spark, d) -> DataFrame:
    return stored(spark, d).log().select("sequence", "stream_id", "version", "event_type", "payload")


@query(STORED + """ SELECT stream_id AS view_id, max(place) AS version,
  CAST(sum(CASE event_type WHEN 'click' THEN amount WHEN 'purchase' THEN -amount ELSE 0 END) AS BIGINT) AS value FROM stored GROUP BY 1""")
def inline_view(spark, d) -> DataFrame:
    """Balances that were committed together with the events."""
    view = balance()
    return stored(spark, d, (view,)).table(view.table, view.schema)


@query(
    STORED + " SELECT stream_id AS view_id, max(place) AS version, CAST(sum(amount) AS BIGINT) AS value FROM stored WHERE event_type <> 'error' GROUP BY 1"
)
def projected_view(spark, d) -> DataFrame:
    """A projection to the head of the log; events that it rejects are parked."""
    store = projected(spark, d)
    return store.table("views", VIEWS).select("view_id", "version", "value")


@query(
    STORED + " SELECT place AS sequence, stream_id, 'an error' AS error, CAST(2 AS BIGINT) AS attempts FROM stored WHERE event_type = 'error'"
)
def parked_events(spark, d) -> DataFrame:
    """What a projection rejected as often as it may."""
    return projected(spark, d).table("parked", PARKED).select("sequence", "stream_id", "error", "attempts")


def projected(spark: SparkSession, d: str) -> EventStore:
    store = stored(spark, d)
    view = ViewProjection(store, "sums", F.col("stream_id"), F.col("payload"))
    poison = F.when(F.col("event_type") == "error", F.lit("an error"))
    Projector(store, "sums", view.apply, poison, retries=1, batch=1 << 16, retry_ms=1).run()
    return store


@query(""", c AS (SELECT *, CASE WHEN version % 3 <> 0 THEN 'key-' || version // 4 END AS key FROM user_log WHERE event_type = 'click')
SELECT stream_id, version AS ord, CASE WHEN key IS NULL OR version = min(version) OVER (PARTITION BY stream_id, key) THEN 'committed' ELSE 'already_committed' END AS outcome FROM c""")
def keyed_commands(spark, d) -> DataFrame:
    """Of commands with the same key only the first is decided."""
    key = F.when(F.col("version") % 3 != 0, F.concat(F.lit("key-"), F.expr("version div 4").cast("string")))
    rows = logs.user_log(spark, d).where("event_type = 'click'")
    asked = rows.select(
        F.col("version").alias("ord"),
        "stream_id",
        F.lit("click").alias("name"),
        F.lit("1").alias("payload"),
        key.alias("idempotency_key"),
    )
    none = spark.createDataFrame(
        [],
        "stream_id string, version long, event_type string, payload string, metadata struct<idempotency_key:string>",
    )
    return executed(none, asked, account()).select("stream_id", "ord", "outcome")


@query(
    """SELECT sequence, upper(event_type[1:1]) || event_type[2:] AS name, 'event_' || event_type AS snake, printf('%016x', sequence) AS position FROM user_log"""
)
def names_as_text(spark, d) -> DataFrame:
    """An event's name out of its tagged payload, in snake case; positions whose text sorts as they do."""
    name = F.initcap("event_type")
    payload = F.concat(F.lit('{"'), name, F.lit('": {"amount": '), F.col("amount").cast("string"), F.lit("}}"))
    rows = logs.flat_log(spark, d).select("sequence", variant(payload).alias("name"))
    return rows.select(
        "sequence",
        "name",
        snake_case(F.concat(F.lit("Event"), F.col("name"))).alias("snake"),
        padded(F.col("sequence")).alias("position"),
    )
