"""Predicates, folds, upcasting, shredding, dispatch: their rules on small tables."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.functions import shred, upcast
from lorekeep.operators import commands, folds, guards, reads, views
from lorekeep.operators.positions import numbered
from lorekeep.operators.predicates import EventFilter, Query, QueryItem
from lorekeep.schema import MAX_POSITION, position


@pytest.fixture(scope="module")
def log(spark):
    rows = [(k + 1, f"{'a%' if k % 2 else 'a_'}-{k % 3}", ["X", "Y", "Z"][k % 3], [f"k:{k % 4}", f"m:{k % 2}"], k * 10) for k in range(60)]
    return spark.createDataFrame(rows, "sequence long, stream_id string, event_type string, tags array<string>, amount long")


def found(df):
    return [r.sequence for r in df.orderBy("sequence").collect()]


items = st.builds(QueryItem, st.lists(st.sampled_from("XYZ"), max_size=2).map(tuple), st.lists(st.sampled_from(["k:0", "k:1", "m:0", "m:1"]), max_size=2).map(tuple))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(items, max_size=3).map(tuple), st.integers(0, 70))
def test_queries_select_what_their_items_say(log, own, after):
    query = Query(own)
    want = [r.sequence for r in log.collect() if r.sequence > after and any((not i.types or r.event_type in i.types) and set(i.tags) <= set(r.tags) for i in own)]
    assert found(reads.selected(log, query, after)) == sorted(want)


def test_no_items_and_the_empty_item(log):
    assert found(log.where(Query().column())) == [] and len(found(log.where(Query.all().column()))) == 60
    assert EventFilter().is_all() and len(found(log.where(EventFilter().column()))) == 60


def test_prefixes_are_literal(log):
    assert all(s % 2 == 1 for s in found(log.where(EventFilter(("a_",)).column())))


@pytest.mark.parametrize(("limit", "scan", "want"), [(5, 4096, (5, 13, 13)), (100, 10, (4, 10, 10)), (0, 10, (0, None, 10)), (5, 0, (1, 1, 1))])
def test_filtered_reads_report_how_far_they_came(log, limit, scan, want):
    assert tuple(reads.filtered_progress(log, EventFilter((), ("X",)), 0, limit, scan).first()) == want


def test_a_filtered_read_past_the_end(log):
    assert tuple(reads.filtered_progress(log, EventFilter(), 60, 5).first()) == (0, None, 60)


def test_positions_saturate():
    assert position(1 << 70) == MAX_POSITION and position(-4) == 0


def test_numbers_are_consecutive_in_order(spark):
    rows = spark.createDataFrame([(x * 7919 % 1000, x) for x in range(500)], "ord long, x long").repartition(7)
    got = [(r.ord, r.sequence) for r in numbered(rows, "ord", "sequence", 40).orderBy("ord").collect()]
    assert [s for _, s in got] == list(range(41, 541))


def test_until_stops_and_does_not_skip(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("s", 1, at(1)), ("s", 2, at(9)), ("s", 3, at(2)), ("t", 1, at(5)), ("u", 1, at(7)), ("u", 2, None)]
    log = spark.createDataFrame(rows, "stream_id string, version long, at timestamp_ntz")
    bound = F.lit(at(5))
    assert [(r.stream_id, r.version) for r in folds.until(log, bound, "at").orderBy("stream_id").collect()] == [("s", 1), ("t", 1)]
    with pytest.raises(Exception, match="no timestamp"):
        folds.until(log.where("version = 2 and stream_id = 'u'"), bound, "at").collect()


def test_snapshots_seed_a_fold(spark):
    log = spark.createDataFrame([("s", v, v * 10) for v in range(1, 6)] + [("n", 1, 7)], "stream_id string, version long, amount long")
    snaps = spark.createDataFrame([("s", 3, 1000), ("gone", 4, 5)], "stream_id string, version long, state long")
    got = folds.seeded(log, snaps, ["amount"], lambda s: F.coalesce(s, F.lit(0).cast("long")), lambda s, e: s + e["amount"])
    assert {r.stream_id: (r.state, r.version) for r in got.collect()} == {"s": (1090, 5), "n": (7, 1), "gone": (5, 4)}


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["in", "out"]), st.integers(0, 50)), max_size=12))
def test_bulk_decisions_equal_a_loop(spark, asked):
    frame = spark.createDataFrame([("s", k, a, n) for k, (a, n) in enumerate(asked)], "stream_id string, ord long, event_type string, amount long")

    def decide(balance, c):
        fits = (c["event_type"] == "in") | (balance >= c["amount"])
        after = F.when(c["event_type"] == "in", balance + c["amount"]).otherwise(commands.withdraw(balance, c["amount"]))
        return F.struct(after.alias("state"), F.when(fits, commands.COMMITTED).otherwise(commands.REJECTED).alias("outcome"))

    got = [(r.outcome, r.state) for r in commands.decided(frame, "stream_id", "ord", ["event_type", "amount"], F.lit(0).cast("long"), decide).orderBy("ord").collect()]
    balance, want = 0, []
    for kind, n in asked:
        ok = kind == "in" or balance >= n
        balance = balance + n if kind == "in" else balance - n if ok else balance
        want.append(("committed" if ok else "rejected", balance))
    assert got == want


def test_ladders_are_checked_when_built():
    up = lambda p: p
    for ladder, kind in ((upcast.Ladder().rung("A", 1, up).rung("A", 1, up), "duplicate rung"), (upcast.Ladder().rung("A", 2, up), "missing base"), (upcast.Ladder().rung("A", 1, up).rung("A", 3, up), "dangling version")):
        with pytest.raises(upcast.LadderError) as e:
            ladder.build()
        assert e.value.kind == kind


def test_ladders_refuse_what_they_do_not_know(spark):
    ladder = upcast.Ladder().rung("A", 1, lambda p: F.concat(p, F.lit("+"))).build()
    read = lambda t, v: spark.range(1).select(ladder.column(F.lit(t), F.lit(v), F.lit("p")).alias("x")).first().x
    assert read("A", 1) == "p+" and read("A", 2) == "p"
    for t, v in (("A", 3), ("A", 0), ("B", 1)):
        with pytest.raises(Exception, match="unknown"):
            read(t, v)


def test_shredding(spark):
    keys = shred.created_keys(spark.createDataFrame([], "subject string, key binary"), spark.createDataFrame([("u1",), ("u2",)], "subject string")).collect()
    keys = spark.createDataFrame(keys, "subject string, key binary")
    rows = spark.createDataFrame([(1, "u1", "Ann"), (2, "u2", "Bob")], "id long, subject string, name string").select("id", shred.plain(F.col("subject"), F.col("name")).alias("f"))
    sealed = spark.createDataFrame(shred.sealed(rows, keys, "f").collect(), rows.schema)
    assert all(r.f.state == "sealed" and r.f.value not in ("Ann", "Bob") for r in sealed.collect())
    assert {r.id: r.f.value for r in shred.opened(sealed, keys, "f").collect()} == {1: "Ann", 2: "Bob"}
    gone = spark.createDataFrame(shred.erased(keys, spark.createDataFrame([("u1",)], "subject string")).collect(), keys.schema)
    after = {r.id: (r.f.state, r.f.value) for r in shred.opened(sealed, gone, "f").collect()}
    assert after == {1: ("shredded", None), 2: ("plain", "Bob")}
    assert {r.subject: r.key for r in shred.created_keys(gone, keys).collect()}["u1"] is None  # erased stays erased
    with pytest.raises(Exception, match="no key"):
        shred.sealed(rows, gone, "f").collect()
    swapped = sealed.withColumn("f", F.struct(F.lit("sealed").alias("state"), F.lit("u2").alias("subject"), F.col("f.value").alias("value"), F.col("f.algorithm").alias("algorithm")))
    with pytest.raises(Exception):  # another's value is forged, not erased
        shred.opened(swapped.where("id = 1"), keys, "f").collect()


def test_newest_wins_and_ties_stay(spark):
    make = lambda rows: spark.createDataFrame(rows, "view_id string, version long, value string")
    got = views.upserted(make([("a", 5, "old"), ("b", 5, "old"), ("c", 5, "old")]), make([("a", 6, "new"), ("b", 4, "new"), ("c", 5, "new"), ("d", 1, "new")]), ["view_id"], "version", ["value"])
    assert {r.view_id: r.value for r in got.collect()} == {"a": "new", "b": "old", "c": "old", "d": "new"}


def test_closed_goes_before_the_expectation(spark):
    asks = spark.createDataFrame([("a", "exact", 9), ("b", "empty", 0), ("c", "any", 0), ("d", "exact", 2)], "stream_id string, expected_kind string, expected_version long")
    heads = spark.createDataFrame([("a", 1), ("d", 2)], "stream_id string, head long")
    got = {r.stream_id: r.outcome for r in guards.expectations(asks, heads, spark.createDataFrame([("a",)], "stream_id string")).collect()}
    assert got == {"a": "closed", "b": "accepted", "c": "accepted", "d": "accepted"}


def test_names_and_positions_as_text(spark):
    from lorekeep.schema import padded, snake_case, variant

    row = spark.createDataFrame([("OrderPlaced", "HTTPRequest2Done", 255, '{"Deposited": {"amount": 1}}', '"Closed"')], "a string, b string, n long, p string, q string")
    got = row.select(snake_case(F.col("a")), snake_case(F.col("b")), padded(F.col("n")), variant(F.col("p")), variant(F.col("q"))).first()
    assert tuple(got) == ("order_placed", "http_request2_done", "00000000000000ff", "Deposited", "Closed")


def test_streamed_folds_keep_a_stream_in_one_task_when_a_join_becomes_a_broadcast(spark):
    own = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 700, 1, 4).select(F.expr("concat('s-', id % 7) AS stream_id"), F.expr("id div 7 + 1 AS version"), F.expr("id AS amount"))
        newest = views.newest(folds.history(rows, F.col("amount")).where("version % 10 = 0 AND version < 60"), ["stream_id"], "version", ["state"])
        done = folds.streamed_on(rows, newest, ["amount"], lambda s: s or 0, lambda t, e: t + e[1], "state long, version long", lambda acc: acc)
        assert sorted(tuple(r) for r in done.collect()) == [(f"s-{k}", sum(range(k, 700, 7)), 100) for k in range(7)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
