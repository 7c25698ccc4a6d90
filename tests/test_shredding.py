"""Sensitive fields in payloads through the shredding store; scenarios."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import shred_json
from lorekeep.operators import folds
from lorekeep.schema import NEW_EVENT, columns
from lorekeep.sources.shredding import PARKED, ShreddingStore
from lorekeep.sources.store import EventStore
from lorekeep.testing import Scenario


def plain(subject, value):
    return {"$sensitive": "plain", "subject": subject, "value": value}


def test_only_the_outermost_fields_are_taken():
    payload = json.dumps({"a": [plain("s", {"$sensitive": "plain", "subject": "t", "value": 1})], "b": {"c": {"$sensitive": "shredded"}}, "d": 1})
    assert [(f["path"], f["state"]) for f in shred_json.taken(payload)] == [('["a", 0]', "plain"), ('["b", "c"]', "shredded")]
    assert json.loads(shred_json.put_back(payload, shred_json.taken(payload))) == json.loads(payload)


def test_payloads_are_sealed_opened_and_erased(spark, tmp_path):
    raw = EventStore(spark, f"file://{tmp_path}/store")
    store = ShreddingStore(raw)
    payloads = [json.dumps({"Registered": {"name": plain("u1", "Ann"), "n": 1}}), json.dumps({"Registered": {"names": [plain("u2", {"first": "Bob"})]}}), json.dumps({"Ordered": {"total": 3}})]
    schema = "ord long, stream_id string, event_type string, schema_version int, payload string, tags array<string>, metadata " + NEW_EVENT["metadata"].dataType.simpleString()
    events = spark.createDataFrame([(k, "c-1", "E", 1, p, [], None) for k, p in enumerate(payloads)], schema)
    asks = spark.createDataFrame([("c-1", "any", 0)], "stream_id string, expected_kind string, expected_version long")
    store.append_batch(events, asks)
    stored = " ".join(r.payload for r in raw.log().collect())
    assert "Ann" not in stored and "Bob" not in stored and "AES-256-GCM" in stored
    assert [json.loads(r.payload) for r in store.stream("c-1").collect()] == [json.loads(p) for p in payloads]
    store.erase("u1")
    store.erase("u1")
    read = [json.loads(r.payload) for r in store.log().orderBy("sequence").collect()]
    assert read[0] == {"Registered": {"name": {"$sensitive": "shredded"}, "n": 1}} and read[1:] == [json.loads(p) for p in payloads[1:]]
    assert store.erased("u1") and not store.erased("u2")
    with pytest.raises(Exception, match="no key"):
        store.append_batch(events, asks)


def test_snapshots_and_parked_events_are_sealed_too(spark, tmp_path):
    raw = EventStore(spark, f"file://{tmp_path}/store")
    store = ShreddingStore(raw)
    kind = columns("stream_id string, version long, state string")
    state = json.dumps({"owner": plain("u1", "Ann")})
    store.upsert("snapshots", kind, spark.createDataFrame([("c-1", 3, state)], kind), ["stream_id"], "version", "state")
    store.park(spark.createDataFrame([("s", 7, state, "bad", 2, 1), ("s", 9, "{}", "bad", 1, 1)], PARKED))
    assert "Ann" not in str(raw.table("snapshots", kind).collect()) + str(raw.table("parked-payloads", PARKED).collect())
    assert json.loads(store.table("snapshots", kind, "stream_id", "state").first().state) == json.loads(state)
    assert [(r.sequence, json.loads(r.payload)) for r in store.parked("s").collect()] == [(7, json.loads(state)), (9, {})]
    store.erase("u1")
    store.unpark("s", 9)
    assert json.loads(store.parked("s").first().payload) == {"owner": {"$sensitive": "shredded"}} and store.parked("s").count() == 1


def test_scenarios(spark):
    given = Scenario(spark, "stream_id string, version long, amount long").given(("a", 1, 5), ("a", 2, 7))
    given.when(lambda log: folds.history(log, F.col("amount"))).then(("a", 1, 5), ("a", 2, 12))
    given.when(lambda log: log.select(F.raise_error(F.lit("refused")))).then_fails("refused")
