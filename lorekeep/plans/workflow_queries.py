"""Registered queries over commands, boundaries and folded views, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import boundaries, commands, folds, reads, views
from lorekeep.operators.commands import Decider, Rejection
from lorekeep.operators.predicates import EventFilter
from lorekeep.plans.log_queries import OUTCOMES, amounts, fold_sql, query, raw
from lorekeep.schema import tag
from lorekeep.sources import logs


def account() -> Decider:
    """click deposits; purchase withdraws if covered and is rejected if not; the rest does nothing."""

    def apply(balance: int, e: dict) -> int:
        amount = int(e["payload"] or 0)
        if e["event_type"] == "click":
            return balance + amount
        return balance - amount if e["event_type"] == "purchase" and balance >= amount else balance

    def decide(balance: int, c: dict):
        if c["name"] not in ("click", "purchase"):
            return []
        if c["name"] == "purchase" and balance < int(c["payload"] or 0):
            return Rejection("not covered")
        return [{"event_type": c["name"], "payload": c["payload"]}]

    return Decider(lambda: 0, apply, decide)


@query(
    OUTCOMES.replace("\nSELECT l.stream_id, l.version, ", "\nSELECT l.stream_id, l.version AS ord, ").replace(
        "r.state\nFROM",
        "CAST(r.state AS VARCHAR) AS state,\n  CASE WHEN event_type = 'purchase' AND coalesce(p.state, 0) < amount THEN 'not covered' END AS reason\nFROM",
    ) + "\nWHERE l.version > 10 OR l.user_id % 2 = 1"
)
def execute_commands(spark, d):
    """Half of the users have a log of ten events already; all other rows are commands, decided in order on top of it."""
    rows = logs.user_log(spark, d).withColumn("payload", F.col("amount").cast("string"))
    past = (F.col("version") <= 10) & (F.col("user_id") % 2 == 0)
    none = F.struct(F.lit(None).cast("string").alias("idempotency_key"))
    log = rows.where(past).select("stream_id", "version", "event_type", "payload", none.alias("metadata"))
    asked = rows.where(~past).select(F.col("version").alias("ord"), "stream_id", F.col("event_type").alias("name"), "payload")
    return commands.executed(log, asked, account()).select("stream_id", "ord", "outcome", "state", "reason")


@query(""", b AS (SELECT stream_id, CAST(sum(CASE WHEN event_type = 'click' THEN amount ELSE 0 END) AS BIGINT) AS balance FROM user_log GROUP BY stream_id),
asks AS (SELECT DISTINCT user_id AS ord, 'user-' || user_id AS source, 'user-' || (user_id * 7 + 1) % 100 AS target, 1000 * (user_id % 50) AS amount FROM events),
p AS (SELECT ord, source AS s FROM asks UNION SELECT ord, target FROM asks),
f AS (SELECT s, min(ord) AS ord FROM p GROUP BY s),
n AS (SELECT ord, count(*) AS n FROM p GROUP BY ord), a AS (SELECT ord, count(*) AS n FROM f GROUP BY ord)
SELECT asks.ord, CASE WHEN coalesce(balance, 0) < amount THEN 'rejected' WHEN source = target THEN 'noop' ELSE 'committed' END AS outcome,
  CASE WHEN coalesce(balance, 0) < amount OR source = target THEN 0 ELSE 2 END AS n_events
FROM asks JOIN n USING (ord) JOIN a USING (ord) LEFT JOIN b ON b.stream_id = asks.source WHERE n.n = a.n""")
def batch_boundary(spark, d):
    """Transfers between two accounts each: those that come first on both are decided over the two accounts' folds."""
    log = logs.flat_log(spark, d)
    states = log.groupBy("stream_id").agg(F.sum(F.when(F.col("event_type") == "click", F.col("amount")).otherwise(0)).alias("state"))
    name = lambda n: F.concat(F.lit("user-"), n.cast("string"))
    asks = log.select("user_id").distinct().select(
        F.col("user_id").alias("ord"),
        name(F.col("user_id")).alias("source"),
        name((F.col("user_id") * 7 + 1) % 100).alias("target"),
        (1000 * (F.col("user_id") % 50)).alias("amount"),
    )
    asks = boundaries.first_in_line(boundaries.lined_up(asks.withColumn("streams", F.array("source", "target"))))

    def decide(states, command):
        event = lambda stream, kind: F.struct(F.col(stream).alias("stream_id"), F.lit(kind).alias("event_type"), F.col("amount").cast("string").alias("payload"))
        both = F.array(event("source", "Withdrawn"), event("target", "Deposited"))
        covered = F.coalesce(F.element_at(states, F.col("source")), F.lit(0)) >= F.col("amount")
        return F.when(covered, F.when(F.col("source") == F.col("target"), F.slice(both, 1, 0)).otherwise(both))

    return boundaries.decided(asks, states, decide).select(
        "ord",
        "outcome",
        F.when(F.col("outcome") == "committed", F.size("events")).otherwise(0).alias("n_events"),
    )


@query(""", top AS (SELECT max(sequence) AS n FROM user_log),
d AS (SELECT DISTINCT user_id AS decision_id, 'k:' || user_id % 10 AS tag, (user_id * 5303) % n AS after FROM user_log, top),
q AS (SELECT DISTINCT tag, after FROM d),
e AS (SELECT unnest(tags) AS tag, sequence, event_type, amount FROM user_log WHERE event_type IN ('click', 'signup')),
m AS (SELECT q.tag, q.after, max(sequence) AS read, max(CASE WHEN event_type = 'signup' THEN sequence ELSE 0 END) AS opened FROM q JOIN e ON e.tag = q.tag AND e.sequence <= q.after GROUP BY 1, 2),
s AS (SELECT m.tag, m.after, m.read, CAST(coalesce(sum(CASE WHEN e.event_type = 'click' AND e.sequence > m.opened THEN amount END), 0) AS BIGINT) AS total FROM m JOIN e ON e.tag = m.tag AND e.sequence <= m.after GROUP BY 1, 2, 3)
SELECT decision_id, coalesce(read, 0) AS read, coalesce(total, 0) AS total FROM d LEFT JOIN s USING (tag, after)""")
def boundary_folds(spark, d):
    """Every decision's fold over a tag's events up to its own position: clicks since the last signup."""
    log = logs.flat_log(spark, d)
    top = log.agg(F.max("sequence")).first()[0] or 1
    asked = log.select("user_id").distinct().select(
        F.col("user_id").alias("decision_id"),
        ((F.col("user_id") * 5303) % top).alias("after"),
        F.array(F.lit("click"), F.lit("signup")).alias("types"),
        tag("k", F.col("user_id") % 10).alias("tag"),
    )
    step = lambda total, e: 0 if e[1] == "signup" else total + e[2]
    return boundaries.queried(asked, log, ["sequence", "event_type", "amount"], lambda: 0, step, "total long", lambda total: (total,))


@query(""", l AS (SELECT stream_id, event_type, amount, sequence, max(CASE WHEN event_type = 'error' THEN sequence END) OVER (PARTITION BY stream_id) AS closed FROM user_log)
SELECT stream_id AS view_id, max(sequence) AS version, CAST(sum(CASE WHEN event_type = 'click' THEN amount WHEN event_type = 'purchase' THEN -amount ELSE 0 END) AS BIGINT) AS value FROM l WHERE sequence > coalesce(closed, 0) GROUP BY stream_id""")
def folded_view(spark, d):
    """A ledger as a folded view, removed on closing, applied in two batches."""
    log = logs.flat_log(spark, d)

    def step(value, e):
        changed = F.when(e["event_type"] == "click", value + e["amount"]).when(
            e["event_type"] == "purchase",
            value - e["amount"],
        ).otherwise(value)
        return F.when(e["event_type"] != "error", changed)

    view = views.View("ledger", F.col("stream_id"), "long", F.lit(0).cast("long"), step, ("event_type", "amount"))
    half = log.agg(F.expr("max(sequence) div 2")).first()[0] or 0
    first = view.applied(log.where(F.col("sequence") <= half), spark.createDataFrame([], view.schema))
    return view.applied(log.where(F.col("sequence") > half), first)


@query("""SELECT 'deposits_only' AS view_name, stream_id AS view_id, max(sequence) AS version, CAST(sum(amount) AS BIGINT) AS value FROM user_log WHERE event_type = 'click' GROUP BY 2
UNION ALL SELECT 'minimum', stream_id, max(sequence), CAST(count(*) AS BIGINT) FROM user_log WHERE amount >= 5000 GROUP BY 2""")
def threshold_views(spark, d):
    own = F.col("stream_id")
    only = {
        "deposits_only": (F.when(F.col("event_type") == "click", own), F.col("amount")),
        "minimum": (F.when(F.col("amount") >= 5000, own), F.lit(1)),
    }
    return views.fanned_out(logs.flat_log(spark, d), only)


@query("SELECT stream_id, CAST(sum(amount) AS BIGINT) AS state, max(version) AS version FROM user_log GROUP BY stream_id")
def snapshot_delta_streamed(spark, d):
    """snapshot_delta_fold for streams of any length."""
    log = logs.user_log(spark, d)
    newest = views.newest(folds.history(log, F.col("amount")).where("version % 10 = 0"), ["stream_id"], "version", ["state"])
    return folds.streamed_on(
        log,
        newest,
        ["amount"],
        lambda state: state or 0,
        lambda total, e: total + e[1],
        "state long, version long",
        lambda acc: acc,
    )


@query(
    "SELECT sequence, CAST(amount AS VARCHAR) AS cents FROM user_log WHERE sequence % 4 < 3 AND (starts_with(stream_id, 'user-1') OR starts_with(stream_id, 'user-2')) AND sequence > 100 AND sequence <= (SELECT max(sequence) FROM (SELECT sequence FROM user_log WHERE sequence > 100 AND sequence % 4 < 3 ORDER BY sequence LIMIT 4096)) ORDER BY sequence LIMIT 64"
)
def polled_versioned_source(spark, d):
    """A poll through filter and ladder: the payload is today's, the positions are the log's."""
    rows, _ = reads.polled(raw(spark, d).where("schema_version <= 3"), 100, 64, EventFilter(("user-1", "user-2")), amounts())
    return rows.select("sequence", F.get_json_object("payload", "$.cents").alias("cents"))


@query(
    fold_sql(
        "CASE WHEN event_type = 'click' THEN greatest({b}, amount) WHEN event_type = 'signup' THEN 0 ELSE {b} END"
    ) + "\nSELECT stream_id, max_by(state, n) AS best FROM r GROUP BY stream_id"
)
def fold_streamed_reset(spark, d):
    step = lambda best, e: 0 if e[1] == "signup" else max(best, e[2]) if e[1] == "click" else best
    return folds.streamed(
        logs.user_log(spark, d),
        "stream_id",
        "version",
        ["event_type", "amount"],
        lambda: 0,
        step,
        "best long",
        lambda best: (best,),
    )


@query("""SELECT stream_id AS view_id, 'by_user' AS view_name, max(sequence) AS version, CAST(sum(amount) AS BIGINT) AS value FROM user_log GROUP BY 1 HAVING bool_or(event_type = 'purchase')
UNION ALL SELECT CAST(k AS VARCHAR), 'by_k', max(sequence), CAST(count(*) AS BIGINT) FROM user_log WHERE k IS NOT NULL GROUP BY 1 HAVING bool_or(event_type = 'purchase')""")
def fetched_views(spark, d):
    """The rows of two views that purchases touch."""
    log = logs.flat_log(spark, d)
    keys = {"by_user": F.col("stream_id"), "by_k": F.col("k")}
    every = views.fanned_out(log, {"by_user": (keys["by_user"], F.col("amount")), "by_k": (keys["by_k"], F.lit(1))})
    return views.fetched(every, views.touched(log.where("event_type = 'purchase'"), keys))
