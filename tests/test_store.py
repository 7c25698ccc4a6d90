"""The store's contract: positions, conflicts, atomic batches, conditions, lifecycle, concurrency; and projections over it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lorekeep.errors import Conflict, DuplicateStream, EventRejected, LeaseLost, QueryConflict, StreamClosed, Truncated, UnaskedStream
from lorekeep.operators.predicates import Query, QueryItem
from lorekeep.schema import NEW_EVENT
from lorekeep.sources.store import EventStore, Manifest
from lorekeep.operators.predicates import EventFilter
from lorekeep.operators.views import View
from lorekeep.schema import LOG
from lorekeep.streaming.projector import VIEWS, FoldedProjection, Lease, Projector, ViewProjection, stream_to
from lorekeep.streaming.source import LogSource


@pytest.fixture
def store(spark, tmp_path):
    return EventStore(spark, f"file://{tmp_path}/store")


def events(spark, rows):
    """rows: (stream_id, event_type, payload, tags)."""
    full = [(k, s, t, 1, p, tags, None) for k, (s, t, p, tags) in enumerate(rows)]
    schema = "ord long, stream_id string, event_type string, schema_version int, payload string, tags array<string>, metadata " + NEW_EVENT["metadata"].dataType.simpleString()
    return spark.createDataFrame(full, schema)


def asks(spark, *rows):
    return spark.createDataFrame(list(rows), "stream_id string, expected_kind string, expected_version long")


def add(store, stream, *payloads, kind="any", expected=0):
    return store.append(stream, events(store.spark, [(stream, "Added", p, [f"p:{p}"]) for p in payloads]), kind, expected)


def rows(df):
    return [(r.sequence, r.stream_id, r.version, r.payload) for r in df.orderBy("sequence").collect()]


def test_positions_conflicts_and_bounds(store):
    add(store, "a-1", "1", "2")
    add(store, "b-1", "3", kind="empty")
    add(store, "a-1", "4", kind="exact", expected=2)
    assert rows(store.log()) == [(1, "a-1", 1, "1"), (2, "a-1", 2, "2"), (3, "b-1", 1, "3"), (4, "a-1", 3, "4")]
    assert [r.version for r in store.stream("a-1", 1).collect()] == [2, 3]
    assert store.stream("none").count() == 0
    with pytest.raises(Conflict) as e:
        add(store, "a-1", "5", kind="exact", expected=2)
    assert e.value.actual == 3
    with pytest.raises(Conflict):  # an empty append still checks
        add(store, "a-1", kind="empty")
    assert store.log().count() == 4


def test_batches_are_atomic_and_numbered_in_input_order(store, spark):
    mixed = events(spark, [("a-1", "X", "1", []), ("b-1", "X", "2", []), ("a-1", "X", "3", [])])
    store.append_batch(mixed, asks(spark, ("a-1", "empty", 0), ("b-1", "any", 0)))
    assert rows(store.log()) == [(1, "a-1", 1, "1"), (2, "b-1", 1, "2"), (3, "a-1", 2, "3")]
    with pytest.raises(Conflict):
        store.append_batch(mixed, asks(spark, ("a-1", "any", 0), ("b-1", "empty", 0)))
    with pytest.raises(DuplicateStream):
        store.append_batch(mixed, asks(spark, ("a-1", "any", 0), ("a-1", "any", 0)))
    assert store.log().count() == 3


def test_conditional_append(store, spark):
    add(store, "a-1", "1", "2")
    query = Query((QueryItem(("Added",), ("p:2",)),))
    new = events(spark, [("c-1", "Added", "9", [])])
    with pytest.raises(QueryConflict) as e:
        store.append_if(new, asks(spark, ("c-1", "any", 0)), query, 1)
    assert e.value.sequence == 2
    store.append_if(new, asks(spark, ("c-1", "any", 0)), query, 2)
    store.append_if(new, asks(spark, ("c-1", "any", 0)), Query(), 0)
    assert store.log().where("stream_id = 'c-1'").count() == 2


def test_closing_and_cutting(store):
    add(store, "a-1", "1", "2", "3")
    store.close("a-1")
    store.close("a-1")
    store.close("new-1")
    for stream in ("a-1", "new-1"):
        with pytest.raises(StreamClosed):  # before the expectation
            add(store, stream, "4", kind="exact", expected=99)
    assert store.stream("a-1").count() == 3
    add(store, "b-1", "1", "2", "3")
    store.truncate("b-1", 3)
    store.truncate("b-1", 2)  # never backwards
    with pytest.raises(Truncated) as e:
        store.stream("b-1")
    assert e.value.first == 3
    assert [r.version for r in store.stream("b-1", 2).collect()] == [3]
    store.truncate("b-1", 4)
    add(store, "b-1", "4", kind="exact", expected=3)
    assert [(r.version, r.sequence) for r in store.stream("b-1", 3).collect()] == [(4, 7)]
    with pytest.raises(ValueError):
        store.truncate("b-1", 6)


def test_the_slower_of_two_writers_prepares_anew(store):
    add(store, "a-1", "1")
    seen = []

    def slow(m: Manifest):
        seen.append(m.commit)
        if len(seen) == 1:
            add(store, "a-1", "2")
        return Manifest(0, m.last_sequence, list(m.events), dict(m.tables))

    store.transact(slow)
    assert seen == [1, 2] and store.log().count() == 2


def test_readers_keep_their_manifest(store):
    pinned = add(store, "a-1", "1")
    add(store, "a-1", "2")
    assert store.log(pinned).count() == 1 and store.log().count() == 2


def sums(store, name):
    return {r.view_id: (r.version, r.value) for r in store.table("views", VIEWS).where(F.col("view_name") == name).collect()}


def test_projection_resumes_parks_and_is_safe_to_replay(store):
    add(store, "a-1", "1", "2", "13", "4")
    view = ViewProjection(store, "sum", F.col("stream_id"), F.col("payload"))
    poison = F.when(F.col("payload") == "13", F.lit("unlucky"))
    halting = Projector(store, "sum", view.apply, poison)
    with pytest.raises(EventRejected):
        halting.run()
    assert halting.checkpoint() == 2 and sums(store, "sum") == {"a-1": (2, 3)}
    parking = Projector(store, "sum", view.apply, poison, retries=2, batch=1, retry_ms=1)
    assert parking.run() == 4
    assert [(r.sequence, r.error, r.attempts) for r in parking.parked().collect()] == [(3, "unlucky", 3)]
    assert sums(store, "sum") == {"a-1": (4, 7)}
    add(store, "b-1", "5")
    assert parking.run() == 5
    view.apply(store.log().where("payload <> '13'"))  # again, all of it
    assert sums(store, "sum") == {"a-1": (4, 7), "b-1": (5, 5)}
    parking.unpark(3)
    parking.unpark(3)
    assert parking.parked().count() == 0
    rebuilt = Projector(store, "sum", ViewProjection(store, "sum2", F.col("stream_id"), F.lit(1)).apply, version=2)
    assert rebuilt.key() == "sum@v2" and rebuilt.run() == 5 and sums(store, "sum2")["a-1"] == (4, 4)


def test_leases(store):
    clock = [0]
    a, b = (Lease(store, "p", h, ttl_ms=10, grace=3, max_grace=12, clock=lambda: clock[0]) for h in "ab")
    assert a.acquire() and not b.acquire()
    clock[0] = 29
    a.renew()
    clock[0] = 60
    assert b.acquire()
    with pytest.raises(LeaseLost):
        a.renew()
    with pytest.raises(LeaseLost):
        Projector(store, "p", lambda _: None, lease=a).run()
    b.release()
    assert a.acquire()


def test_streaming_over_the_store(store, spark, tmp_path):
    add(store, "a-1", "1", "2")
    seen: list[int] = []
    go = lambda: stream_to(spark, store.path, str(tmp_path / "offsets"), lambda df: seen.extend(r.sequence for r in df.collect()))
    go()
    add(store, "a-1", "3")
    go()
    assert sorted(seen) == [1, 2, 3]


def test_events_of_streams_without_an_expectation_are_refused(store, spark):
    add(store, "x-1", "1")
    both = events(spark, [("y-1", "X", "1", []), ("x-1", "X", "2", [])])
    with pytest.raises(UnaskedStream):
        store.append_batch(both, asks(spark, ("y-1", "any", 0)))
    assert store.log().count() == 1


def test_streams_see_neither_lost_writers_files_nor_cut_versions(store, spark, tmp_path):
    add(store, "a-1", "1", "2", "3")
    add(store, "b-1", "4")
    store.log().where("version = 1").write.parquet(f"{store.path}/events/{9:020d}-orphan")
    store.truncate("a-1", 3)
    seen: list[int] = []
    stream_to(spark, store.path, str(tmp_path / "o1"), lambda df: seen.extend(r.sequence for r in df.collect()))
    assert sorted(seen) == [3, 4] == sorted(r.sequence for r in store.log().collect())
    seen.clear()
    stream_to(spark, store.path, str(tmp_path / "o2"), lambda df: seen.extend(r.sequence for r in df.collect()), prefixes='["b-"]', types='["Added"]')
    assert seen == [4]


def test_rejected_events_are_tried_again_before_they_are_parked(store):
    add(store, "a-1", "1", "2", "13", "4", "99")
    tries: list[int] = []

    def apply(rows):
        for r in rows.orderBy("sequence").collect():
            tries.append(r.sequence)
            if r.payload == "13" or r.payload == "99" and tries.count(5) < 3:
                raise ValueError(f"not {r.payload}")

    projector = Projector(store, "p", apply, retries=2, retry_ms=1)
    assert projector.run() == 5
    assert [(r.sequence, r.attempts, r.error) for r in projector.parked().collect()] == [(3, 3, "not 13")]
    assert tries.count(3) >= 3 and tries.count(5) >= 3
    with pytest.raises(EventRejected) as e:
        Projector(store, "halting", apply, retry_ms=1).run()
    assert e.value.sequence == 3 and Projector(store, "halting", apply).checkpoint() == 2
    with pytest.raises(ValueError):
        Projector(store, "q", apply, retries=1, parking=False)


def test_filtered_projections_pass_over_what_does_not_match(store):
    add(store, "a-1", "1", "2")
    add(store, "b-1", "3")
    add(store, "a-1", "4")
    seen: list[int] = []
    projector = Projector(store, "b", lambda df: seen.extend(r.sequence for r in df.collect()), where=EventFilter(("b-",)))
    assert projector.run() == 4 and seen == [3] and projector.checkpoint() == 4
    assert store.metrics.counts["store.events_appended"] == 4 and store.metrics.counts["projector.events_applied"] == 1


def test_following_drains_when_it_is_stopped(store):
    import threading

    add(store, "a-1", "1")
    seen, stop, pulses = [], threading.Event(), []

    def caught_up(at):
        pulses.append(at)
        if at == 1:
            add(store, "a-1", "2")  # wakes the idle sleep
        else:
            add(store, "a-1", "3")
            stop.set()  # the closing read finds it

    projector = Projector(store, "f", lambda df: seen.extend(r.sequence for r in df.collect()), caught_up=caught_up, idle_ms=60_000)
    assert projector.follow(stop) == 3 and seen == [1, 2, 3] and pulses[:2] == [1, 2]


def total(name="total", fail_at=None):
    def step(value, e):
        changed = value + e["payload"].cast("long")
        return changed if fail_at is None else F.when(e["payload"] == fail_at, F.raise_error("no").cast("long")).otherwise(changed)

    return View(name, F.col("stream_id"), "long", F.lit(0).cast("long"), step, ("payload",))


def test_inline_views_commit_with_the_events_or_not_at_all(store):
    view = total(fail_at="13")
    rows = lambda: sorted(tuple(r) for r in store.table(view.table, view.schema).collect())
    one = lambda *payloads: events(store.spark, [("a-1", "Added", p, []) for p in payloads])
    store.append("a-1", one("1", "2"), inline=(view,))
    store.append("b-1", one("5"), inline=(view,))
    store.append("a-1", one("4"), inline=(view,))
    assert rows() == [("a-1", 4, 7), ("b-1", 3, 5)]
    with pytest.raises(Exception, match="no"):
        store.append("a-1", one("13"), inline=(view,))
    assert store.log().count() == 4 and rows() == [("a-1", 4, 7), ("b-1", 3, 5)]
    later = FoldedProjection(store, total("later"))
    assert Projector(store, "later", later.apply).run() == 4
    later.apply(store.log())  # again
    assert sorted(tuple(r) for r in later.rows().collect()) == rows()


def test_compaction_keeps_the_log(store):
    for k in range(3):
        add(store, f"s-{k % 2}", str(k), str(k + 10))
    store.truncate("s-1", 2)
    before, old = rows(store.log()), store.manifest()
    new = store.compact()
    assert len(new.events) == 1 and rows(store.log()) == before == rows(store.log(old))
    add(store, "s-1", "x", kind="exact", expected=2)
    assert store.log().count() == len(before) + 1


def test_batches_grow_while_a_projection_is_behind(store):
    add(store, "a-1", *map(str, range(30)))
    sizes: list[int] = []
    assert Projector(store, "p", lambda df: sizes.append(df.count()), batch=2, largest=8).run() == 30
    assert sizes == [2, 8, 8, 8, 4]


def test_commit_signals_are_not_lost(store):
    seen = store.committed.last
    add(store, "a-1", "1")
    assert store.committed.wait(seen, 0) > seen
    seen = store.committed.last
    add(store, "a-1")  # nothing to append: silent
    assert store.committed.wait(seen, 0) == seen


def test_the_stream_source(store, spark, tmp_path):
    spark.dataSource.register(LogSource)
    add(store, "a-1", "1", "2")
    got: list[int] = []
    source = spark.readStream.format("lorekeep").option("path", store.path.removeprefix("file://")).load()

    def go():
        source.writeStream.foreachBatch(lambda df, _: got.extend(r.sequence for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    go()
    add(store, "b-1", "3")
    go()
    assert sorted(got) == [1, 2, 3]


def test_rejected_events_are_parked_as_tables_not_as_lists_on_the_driver(store, monkeypatch):
    add(store, "a-1", *map(str, range(12)))
    applied: list[int] = []
    poison = F.when(F.col("payload").cast("long") % 3 == 0, F.concat(F.lit("no "), F.col("payload")))
    parking = Projector(store, "p", lambda df: applied.extend(r.sequence for r in df.collect()), poison, retries=1, batch=100, retry_ms=1)

    def refused(*_):
        raise AssertionError("a list of positions in the plan")

    monkeypatch.setattr(type(F.col("sequence")), "isin", refused)
    assert parking.run() == 12
    assert [(r.sequence, r.stream_id, r.error, r.attempts) for r in parking.parked().collect()] == [(k + 1, "a-1", f"no {k}", 2) for k in (0, 3, 6, 9)]
    assert sorted(applied) == [k + 1 for k in range(12) if k % 3]
    assert store.metrics.counts["projector.events_parked"] == 4 and store.metrics.counts["projector.events_applied"] == 8


def test_batches_grow_though_events_are_parked_and_pass_over_cut_ones(store):
    add(store, "a-1", *map(str, range(30)))
    add(store, "b-1", "30", "31")
    store.truncate("a-1", 25)
    sizes: list[int] = []
    poison = F.when(F.col("payload").cast("long") % 2 == 0, F.lit("even"))
    parking = Projector(store, "p", lambda df: sizes.append(df.count()), poison, retries=0, batch=2, largest=4)
    assert parking.run() == 32 and sizes == [2, 2]
    assert [r.sequence for r in parking.parked().collect()] == [25, 27, 29, 31]


def test_events_that_raise_and_events_that_are_poison_are_parked_together(store):
    add(store, "a-1", "1", "2", "13", "4", "x")

    def apply(rows):
        if rows.where("payload = '13'").count():
            raise ValueError("not 13")

    parking = Projector(store, "p", apply, F.when(F.col("payload") == "x", F.lit("text")), retries=1, retry_ms=1)
    assert parking.run() == 5
    assert [(r.sequence, r.error, r.attempts) for r in parking.parked().collect()] == [(3, "not 13", 2), (5, "text", 2)]
