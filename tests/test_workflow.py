"""Repositories, boundaries, sagas, the mediator and the scenarios."""

from __future__ import annotations

from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from lorekeep import mediator
from lorekeep.errors import EventRejected
from lorekeep.operators import boundaries, commands
from lorekeep.operators.commands import Rejection
from lorekeep.operators.folds import SnapshotPolicy
from lorekeep.operators.predicates import Query, QueryItem
from lorekeep.operators.views import View
from lorekeep.plans.workflow_queries import account
from lorekeep.repository import Repository, complete
from lorekeep.sources.store import EventStore
from lorekeep.streaming.projector import Projector
from lorekeep.streaming.saga import Saga
from lorekeep.testing import ProjectionScenario
from lorekeep.vocabulary import Vocabulary

ASKED = "ord long, stream_id string, name string, payload string, idempotency_key string"


@pytest.fixture
def store(spark, tmp_path):
    return EventStore(spark, f"file://{tmp_path}/store")


def outcomes(done):
    return [(r.ord, r.outcome, r.expected_version, r.committed_version, r.state) for r in done.orderBy("ord").collect()]


def test_commands_are_decided_in_order_and_committed_at_once(store, spark):
    bank = Repository(store, account())
    asked = spark.createDataFrame([(1, "a", "click", "10", "k1"), (2, "a", "purchase", "30", None), (3, "a", "purchase", "4", None), (4, "b", "view", None, None), (5, "a", "click", "10", "k1"), (6, "b", "click", "1", "k1")], ASKED)
    assert outcomes(bank.execute(asked)) == [(1, "committed", 0, 1, "10"), (2, "rejected", 1, None, "10"), (3, "committed", 1, 2, "6"), (4, "noop", 0, None, "0"), (5, "already_committed", 2, 1, "6"), (6, "committed", 0, 1, "1")]
    again = spark.createDataFrame([(1, "a", "click", "10", "k1"), (2, "a", "click", "5", "k2")], ASKED)
    assert outcomes(bank.execute(again)) == [(1, "already_committed", 2, 1, "6"), (2, "committed", 2, 3, "11")]
    assert sorted((r.stream_id, r.version, r.state) for r in bank.load().collect()) == [("a", 3, "11"), ("b", 1, "1")]
    assert sorted((r.stream_id, r.state) for r in bank.load(at_version=1).collect()) == [("a", "10"), ("b", "1")]
    assert store.log().where("stream_id = 'a'").orderBy("version").select("metadata.idempotency_key").collect()[0][0] == "k1"
    assert store.metrics.counts["commands.committed"] == 4 and store.metrics.counts["commands.already_committed"] == 2


def test_a_conflict_reloads_and_decides_anew(store, spark):
    bank, other = Repository(store, account()), Repository(store, account())
    ask = lambda amount: spark.createDataFrame([(1, "a", "click", amount, None)], ASKED)
    append, faster = store.append_batch, []

    def raced(*args, **more):
        if not faster:
            faster.append(1)
            other.execute(ask("100"))
        return append(*args, **more)

    store.append_batch = raced
    assert outcomes(bank.execute(ask("1"))) == [(1, "committed", 1, 2, "101")]
    assert store.metrics.counts["commands.retries"] == 1


def test_snapshots_are_offered_when_due_and_spare_the_past(store, spark):
    bank = Repository(store, account(), snapshots=SnapshotPolicy(3))
    ask = lambda *amounts: spark.createDataFrame([(k, "a", "click", x, None) for k, x in enumerate(amounts)], ASKED)
    bank.execute(ask("1", "2"))
    assert bank.snapshot_rows().count() == 0
    bank.execute(ask("3", "4"))
    assert [tuple(r) for r in bank.snapshot_rows().collect()] == [("a", 4, "10")]
    seen = []
    counting = account()
    counted = commands.Decider(counting.init, lambda s, e: (seen.append(e), counting.apply(s, e))[1], counting.decide)
    log = store.log().select("stream_id", "version", "event_type", "payload", "metadata")
    done = commands.executed(log, ask("5"), counted, bank.snapshot_rows())
    assert outcomes(done) == [(0, "committed", 4, 5, "15")]
    assert outcomes(bank.execute(ask("5"))) == [(0, "committed", 4, 5, "15")]


def test_transfers_over_two_streams(store, spark):
    bank = Repository(store, account())
    bank.execute(spark.createDataFrame([(k, s, "click", "100", None) for k, s in enumerate("ab")], ASKED))
    asked = spark.createDataFrame([(1, ["a", "b"], "a", "b", 80), (2, ["b", "c"], "b", "c", 150), (3, ["a", "c"], "a", "c", 90)], "ord long, streams array<string>, source string, target string, amount long")

    def decide(states, rows):
        event = lambda stream, kind: F.struct(F.col(stream).alias("stream_id"), F.lit(kind).alias("event_type"), F.col("amount").cast("string").alias("payload"))
        return F.when(F.coalesce(F.element_at(states, F.col("source")).cast("long"), F.lit(0)) >= F.col("amount"), F.array(event("source", "purchase"), event("target", "click")))

    done = {r.ord: r.outcome for r in bank.execute_boundary(asked, decide).collect()}
    assert done == {1: "committed", 2: "committed", 3: "rejected"}
    assert {r.stream_id: r.state for r in bank.load().collect()} == {"a": "20", "b": "30", "c": "150"}


def test_a_decision_over_a_query_is_made_anew_when_its_events_change(store, spark):
    bank, query = Repository(store, account()), Query((QueryItem(("Enrolled",), ("course:1",)),))
    new = lambda n: complete(spark.createDataFrame([(1, f"e-{n}", "Enrolled", ["course:1"])], "ord long, stream_id string, event_type string, tags array<string>"))
    taken = []

    def decide(n):
        taken.append(n)
        if len(taken) == 1:
            store.append_if(new("fast"), spark.createDataFrame([("e-fast", "any", 0)], "stream_id string, expected_kind string, expected_version long"), Query(), 0)
        return new(n) if n < 2 else None

    assert bank.execute_query(query, lambda events: events.count(), decide) == 2 and taken == [0, 1]
    assert bank.execute_query(query, lambda events: events.count(), decide) is None
    with pytest.raises(Exception, match="outside the query"):
        boundaries.checked(store.log(), Query((QueryItem(("Other",)),))).collect()


def test_a_saga_stops_at_its_first_failure(store, spark):
    bank = Repository(store, account())
    bank.execute(spark.createDataFrame([(1, "a", "click", "50", None), (2, "a", "click", "7", None), (3, "b", "click", "9", None)], ASKED))
    fee = F.struct(F.lit("purchase").alias("command"), F.lit("a").alias("target"), F.col("payload").alias("payload"))
    saga = Saga("fee", bank, F.when((F.col("event_type") == "click") & (F.col("sequence") <= 3), F.array(fee)), mediator.saga_dispatcher(mediator.serving(bank)))
    runner = Projector(store, "fee", saga.apply, retry_ms=1)
    with pytest.raises(EventRejected) as e:
        runner.run()
    assert e.value.sequence == 3 and runner.checkpoint() == 2  # 50 and 7 of 57 are gone, 9 are not there
    bank.execute(spark.createDataFrame([(1, "a", "click", "9", None)], ASKED))
    assert runner.run() == store.manifest().last_sequence
    assert {r.stream_id: r.state for r in bank.load().collect()} == {"a": "0", "b": "9"}


def test_mediator(store, spark):
    class Ask(str):
        pass

    log = []
    m = mediator.Mediator().handle(Ask, lambda r: 1 / len(r)).handle_stream(Ask, lambda r: iter(r))
    m.behave(lambda r, inner: (log.append("in"), inner(r), log.append("out"))[1]).before(lambda r: log.append("before")).after(lambda r, out: log.append(out))
    m.on_error_do(lambda r, e: log.append(type(e).__name__)).on_error(lambda r, e: -1, ZeroDivisionError)
    assert m.send(Ask("ab")) == 0.5 and log == ["in", "before", 0.5, "out"] and list(m.stream(Ask("ab"))) == ["a", "b"]
    assert m.send(Ask("")) == -1 and log[-1] == "ZeroDivisionError"
    with pytest.raises(mediator.NoHandler):
        m.send("no")
    with pytest.raises(ValueError):
        m.handle(Ask, len)
    got = []

    def bad(n):
        raise KeyError(n)

    m.on(Ask, got.append).on(Ask, bad).on(Ask, got.append)
    for how, n in ((mediator.SEQUENTIAL, 1), (mediator.SEQUENTIAL_ALL, 2), (mediator.CONCURRENT, 2)):
        got.clear()
        with pytest.raises(KeyError):
            m.publish(Ask("x"), how)
        assert len(got) == n
    bank = Repository(store, account(), stamp=mediator.stamped(correlation_id="c-1"))
    served = mediator.serving(bank)
    served.send(mediator.Execute(spark.createDataFrame([(1, "a", "click", "5", None)], ASKED)))
    assert served.send(mediator.Load()).first().state == "5" and served.send(mediator.LoadAt(0)).count() == 0
    assert store.log().first().metadata.correlation_id == "c-1"


def test_projection_scenario(spark):
    def step(value, e):
        return F.when(e["event_type"] != "Closed", value + e["amount"])

    view = View("open", F.col("stream_id"), "long", F.lit(0).cast("long"), step, ("event_type", "amount"))
    s = ProjectionScenario(spark, "sequence long, stream_id string, event_type string, amount long", view)
    s.when((1, "a", "Put", 5), (2, "b", "Put", 1)).then(("a", 1, 5), ("b", 2, 1))
    s.when((1, "a", "Put", 5), (3, "a", "Put", 2)).then(("a", 3, 7), ("b", 2, 1))
    s.when((4, "b", "Closed", 0)).then(("a", 3, 7))


def test_deciders_from_dataclasses(store, spark):
    words = Vocabulary()

    @words.event(tags=lambda e: [f"kind:{e.kind}"])
    @dataclass
    class PutIn:
        amount: int
        kind: str = "cash"

    @words.command("put")
    @dataclass
    class Put:
        amount: int

    @dataclass
    class Box:
        total: int = 0

        def on_put_in(self, event):
            self.total += event.amount

        def put(self, command):
            return Rejection("full") if self.total + command.amount > 10 else [PutIn(command.amount)]

    box = Repository(store, words.decider(Box))
    asked = spark.createDataFrame([(k, "box-1", "put", f'{{"amount": {n}, "old": 1}}', None) for k, n in enumerate([4, 7, 6])], ASKED)
    assert [(r.outcome, r.reason, r.state) for r in box.execute(asked).orderBy("ord").collect()] == [
        ("committed", None, '{"total": 4}'),
        ("rejected", "full", '{"total": 4}'),
        ("committed", None, '{"total": 10}'),
    ]
    assert {(r.event_type, tuple(r.tags)) for r in store.log().collect()} == {("PutIn", ("kind:cash",))}
    assert words.decoded("PutIn", words.encoded(PutIn(3))["payload"]) == PutIn(3)
    with pytest.raises(LookupError):
        words.decoded("Unknown", None)
    with pytest.raises(ValueError):
        words.event("put")(Box)
