"""Metadata of events and commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlay(interaction: Column, event: Column) -> Column:
    """The interaction's ids and time go before the event's; the idempotency key is the interaction's alone."""
    merged = [F.coalesce(interaction[x], event[x]).alias(x) for x in ("causation_id", "correlation_id", "timestamp")]
    return F.struct(merged[0], merged[1], interaction["idempotency_key"].alias("idempotency_key"), merged[2])


def of_ids(causation: Column, correlation: Column) -> Column:
    return F.struct(
        causation.alias("causation_id"),
        correlation.alias("correlation_id"),
        F.lit(None).cast("string").alias("idempotency_key"),
        F.lit(None).cast("timestamp_ntz").alias("timestamp"),
    )


def with_key(metadata: Column, key: Column) -> Column:
    return F.struct(
        metadata["causation_id"].alias("causation_id"),
        metadata["correlation_id"].alias("correlation_id"),
        key.alias("idempotency_key"),
        metadata["timestamp"].alias("timestamp"),
    )
