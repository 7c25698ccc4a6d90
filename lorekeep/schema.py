"""The event log's shape. The log is one table, ordered by ``sequence``; a stream is its rows with one ``stream_id``, ordered by ``version``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Positions are unsigned in the model; bounds beyond a signed 64-bit integer saturate.
MAX_POSITION = (1 << 63) - 1
START, EMPTY = 0, 0

METADATA = T.StructType(
    [
        T.StructField(x, T.StringType()) for x in ("causation_id", "correlation_id", "idempotency_key")
    ] + [T.StructField("timestamp", T.TimestampNTZType())]
)

LOG = T.StructType(
    [
        T.StructField("sequence", T.LongType(), False),
        T.StructField("stream_id", T.StringType(), False),
        T.StructField("version", T.LongType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("schema_version", T.IntegerType(), False),
        T.StructField("payload", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("metadata", METADATA),
    ]
)
NEW_EVENT = T.StructType([f for f in LOG.fields if f.name not in ("sequence", "version")])


def columns(text: str) -> T.StructType:
    """A schema from ``name kind, name kind``, of strings, longs and booleans; no session is needed."""
    kinds = {"string": T.StringType(), "long": T.LongType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split() for x in text.split(", "))])


def position(n: int) -> int:
    """A bound as it is stored: saturated, never negative."""
    return max(0, min(n, MAX_POSITION))


def stream_id(name: str, key: Column) -> Column:
    return F.concat(F.lit(f"{name}-"), key.cast("string"))


def aggregate_key(name: str, stream: Column) -> Column:
    """The inverse of stream_id: null for another name's streams and for a bare or empty key."""
    rest = F.substring(stream, len(name) + 2, 1 << 30)
    return F.when(F.startswith(stream, F.lit(f"{name}-")) & (rest != ""), rest)


def tag(kind: str, value: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), value.cast("string"))


def padded(at: Column) -> Column:
    """A position as text whose order is the positions': sixteen hexadecimal digits."""
    return F.lpad(F.lower(F.hex(at)), 16, "0")


def snake_case(name: Column) -> Column:
    """``OrderPlaced`` and ``HTTPRequest`` as ``order_placed`` and ``http_request``."""
    broken = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(broken)


def variant(payload: Column) -> Column:
    """The event's name in a payload that is tagged by it: ``{"Deposited": {...}}``, or a bare ``"Closed"``."""
    return F.coalesce(F.element_at(F.json_object_keys(payload), 1), F.get_json_object(F.concat(F.lit('{"x":'), payload, F.lit("}")), "$.x"))
