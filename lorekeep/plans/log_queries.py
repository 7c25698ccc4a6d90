"""Registered queries over the log, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import metadata, shred, upcast
from lorekeep.operators import commands, folds, guards, reads, views
from lorekeep.operators.predicates import EventFilter, Query, QueryItem
from lorekeep.schema import aggregate_key, stream_id, tag
from lorekeep.sources import logs

QUERIES, SQL = {}, {}

#: The logs in SQL, as lorekeep.sources.logs derives them.
LOG = """WITH user_log AS (
  SELECT event_id + 1 AS sequence, 'user-' || user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version,
         event_type, CAST(round(value * 100) AS BIGINT) AS amount, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id, ts,
         ['user:' || user_id, 'k:' || CAST(json_extract(props, '$.k') AS BIGINT)] AS tags
  FROM events
), lifecycle AS (
  SELECT DISTINCT 'user-' || user_id AS stream_id, user_id % 17 = 0 AS closed, 1 + user_id % 5 AS first_kept, user_id, user_id % 97 AS head FROM events
)"""
COLUMNS = ["sequence", "stream_id", "event_type", "amount", "k"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") else f"{LOG}\n{sql}"
        return f

    return add


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = logs.table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        stream_id("user", F.col("user_id")).alias("stream_id"),
        (F.col("user_id") % 17 == 0).alias("closed"),
        (1 + F.col("user_id") % 5).alias("first_kept"),
        "user_id",
        (F.col("user_id") % 97).alias("head"),
    )


# Reads


@query("SELECT sequence, stream_id, version, event_type, amount, k FROM user_log")
def log_events(spark, d):
    return logs.user_log(spark, d).select("sequence", "stream_id", "version", "event_type", "amount", "k")


@query(
    "SELECT stream_id, version, event_type, amount FROM (SELECT 'conv-' || conv_id AS stream_id, turn + 1 AS version, role AS event_type, CAST(length(text) AS BIGINT) AS amount FROM conversations)"
)
def conversation_events(spark, d):
    return logs.conversation_log(spark, d).drop("conv_id")


@query("""WITH x AS (
  SELECT o_orderkey, 'Placed' AS event_type, 0 AS rank, 0 AS line, 0 AS part, 0 AS supplier, NULL AS shipped, 0.0 AS quantity, o_totalprice AS price FROM orders
  UNION ALL SELECT l_orderkey, 'LineAdded', 1, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice FROM lineitem)
SELECT 'order-' || o_orderkey AS stream_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY rank, line, part, supplier, shipped, quantity, price) AS version, event_type, CAST(round(price * 100) AS BIGINT) AS amount FROM x""")
def order_events(spark, d):
    return logs.order_log(spark, d).drop("tags")


@query("SELECT stream_id, version, event_type, amount FROM user_log WHERE stream_id = 'user-7' AND version > 3 ORDER BY version")
def stream_read(spark, d):
    return reads.stream(logs.user_log(spark, d), "user-7", 3).select("stream_id", "version", "event_type", "amount")


@query("SELECT sequence, stream_id, event_type, amount, k FROM user_log WHERE sequence > 400 ORDER BY sequence")
def global_read_after(spark, d):
    return reads.after(logs.flat_log(spark, d), 400).select(*COLUMNS)


@query("SELECT sequence, stream_id, event_type, amount, k FROM user_log WHERE sequence > 300 ORDER BY sequence LIMIT 128")
def poll_batch(spark, d):
    return reads.after(logs.flat_log(spark, d), 300, limit=128).select(*COLUMNS)


FILTER = EventFilter(("user-1", "user-2"), ("click", "purchase"))
MATCHES = "(starts_with(stream_id, 'user-1') OR starts_with(stream_id, 'user-2')) AND event_type IN ('click', 'purchase')"
BOUND = "(SELECT max(sequence) FROM (SELECT sequence FROM user_log WHERE sequence > 100 ORDER BY sequence LIMIT 4096))"


@query(
    f"SELECT sequence, stream_id, event_type, amount, k FROM user_log WHERE sequence > 100 AND sequence <= {BOUND} AND {MATCHES} ORDER BY sequence LIMIT 128"
)
def filtered_read_prefix_type(spark, d):
    return reads.filtered(logs.flat_log(spark, d), FILTER, 100, 128).select(*COLUMNS)


@query(f""", m AS (SELECT sequence FROM user_log WHERE sequence > 100 AND sequence <= {BOUND} AND {MATCHES} ORDER BY sequence LIMIT 128)
SELECT count(*) AS n_events, max(sequence) AS upper, CASE WHEN count(*) >= 128 THEN max(sequence) ELSE {BOUND} END AS scanned FROM m""")
def filtered_scan_bound(spark, d):
    return reads.filtered_progress(logs.flat_log(spark, d), FILTER, 100, 128)


@query(
    "SELECT sequence, stream_id, event_type, amount, k FROM user_log WHERE sequence > 50 AND event_type IN ('purchase', 'signup') AND list_contains(tags, 'k:3') ORDER BY sequence"
)
def query_read_types_tags(spark, d):
    return reads.selected(logs.flat_log(spark, d), Query((QueryItem(("purchase", "signup"), ("k:3",)),)), 50).select(*COLUMNS)


@query(
    "SELECT sequence, stream_id, event_type, amount, k FROM user_log WHERE (event_type = 'click' AND list_contains(tags, 'k:1')) OR (list_contains(tags, 'user:5')) ORDER BY sequence"
)
def query_read_or_items(spark, d):
    either = Query((QueryItem(("click",), ("k:1",)),)) | Query((QueryItem((), ("user:5",)),))
    return reads.selected(logs.flat_log(spark, d), either).select(*COLUMNS)


@query("SELECT sequence, stream_id, event_type, amount, k FROM user_log WHERE false")
def query_read_no_items(spark, d):
    return reads.selected(logs.flat_log(spark, d), Query()).select(*COLUMNS)


@query("SELECT unnest(tags) AS tag, sequence FROM user_log")
def tag_index_explode(spark, d):
    return reads.tag_index(logs.flat_log(spark, d))


@query(
    "SELECT sequence, stream_id, CASE WHEN starts_with(stream_id, 'user-') AND length(stream_id) > 5 THEN substring(stream_id, 6) END AS aggregate_id, 'kind:' || event_type AS tag FROM user_log"
)
def names_and_tags(spark, d):
    return logs.flat_log(spark, d).select(
        "sequence",
        "stream_id",
        aggregate_key("user", F.col("stream_id")).alias("aggregate_id"),
        tag("kind", F.col("event_type")).alias("tag"),
    )


# Guards


@query("SELECT stream_id, greatest(max(version), max(user_id % 97)) AS head FROM user_log GROUP BY stream_id")
def stream_heads(spark, d):
    return folds.heads(logs.user_log(spark, d), lifecycle(spark, d))


@query(""", old AS (SELECT stream_id, count(*) AS head FROM user_log WHERE (sequence - 1) % 10 <> 0 GROUP BY stream_id),
new AS (SELECT *, sequence AS ord FROM user_log WHERE (sequence - 1) % 10 = 0)
SELECT new.ord, new.stream_id, coalesce(head, 0) + row_number() OVER (PARTITION BY new.stream_id ORDER BY ord) AS version,
       (SELECT max(sequence) FROM user_log WHERE (sequence - 1) % 10 <> 0) + row_number() OVER (ORDER BY ord) AS sequence
FROM new LEFT JOIN old USING (stream_id)""")
def append_positions(spark, d):
    from lorekeep.operators.positions import appended

    log = logs.flat_log(spark, d)
    old, new = log.where(
        (F.col("sequence") - 1) % 10 != 0
    ), log.where((F.col("sequence") - 1) % 10 == 0).withColumn("ord", F.col("sequence"))
    heads = old.groupBy("stream_id").agg(F.count(F.lit(1)).alias("head"))
    last = old.agg(F.max("sequence")).first()[0] or 0
    return appended(new.select("ord", "stream_id"), heads, last, "ord").select("ord", "stream_id", "version", "sequence")


@query(""", c AS (SELECT stream_id, user_id, max(version) AS head FROM user_log GROUP BY stream_id, user_id)
SELECT c.stream_id, ['any', 'exact', 'empty'][user_id % 3 + 1] AS expected_kind, head - user_id % 2 AS expected_version, head,
  CASE WHEN user_id % 17 = 0 THEN 'closed' WHEN user_id % 3 = 0 THEN 'accepted' WHEN user_id % 3 = 2 THEN CASE WHEN head = 0 THEN 'accepted' ELSE 'conflict' END
       WHEN user_id % 2 = 0 THEN 'accepted' ELSE 'conflict' END AS outcome FROM c""")
def expected_version_check(spark, d):
    log = logs.user_log(spark, d)
    heads = folds.heads(log)
    user = F.substring("stream_id", 6, 20).cast("long")
    asked = heads.select(
        "stream_id",
        F.element_at(F.array(F.lit("any"), F.lit("exact"), F.lit("empty")), (user % 3 + 1).cast("int")).alias("expected_kind"),
        (F.col("head") - user % 2).alias("expected_version"),
    )
    return guards.expectations(asked, heads, lifecycle(spark, d).where("closed"))


@query("SELECT (sequence - 1) // 50 AS batch_id, stream_id, count(*) AS n FROM user_log GROUP BY 1, 2 HAVING count(*) > 1")
def batch_duplicate_stream(spark, d):
    return guards.repeated_streams(logs.flat_log(spark, d).select(F.expr("(sequence - 1) div 50").alias("batch_id"), "stream_id"))


@query(
    "SELECT stream_id, user_id % 4 AS after, first_kept, CASE WHEN user_id % 4 + 1 < first_kept THEN 'truncated' ELSE 'ok' END AS verdict FROM lifecycle"
)
def truncated_read_check(spark, d):
    after = (F.col("user_id") % 4).alias("after")
    return lifecycle(spark, d).select(
        "stream_id",
        after,
        "first_kept",
        guards.read_verdict(F.col("user_id") % 4, F.col("first_kept")).alias("verdict"),
    )


@query(""", c AS (SELECT stream_id, user_id, max(version) AS head FROM user_log GROUP BY ALL)
SELECT stream_id, head, user_id * 3 % 120 AS cut, CASE WHEN user_id * 3 % 120 > head + 1 THEN 'error' WHEN user_id * 3 % 120 <= 1 + user_id % 5 THEN 'noop' ELSE 'cut' END AS plan FROM c""")
def truncate_plan(spark, d):
    heads = folds.heads(logs.user_log(spark, d)).join(lifecycle(spark, d).select("stream_id", "user_id", "first_kept"), "stream_id")
    cut = F.col("user_id") * 3 % 120
    return heads.select("stream_id", "head", cut.alias("cut"), guards.cut_plan(cut, F.col("head"), F.col("first_kept")).alias("plan"))


@query("SELECT stream_id, version, amount FROM user_log JOIN lifecycle USING (stream_id) WHERE version >= first_kept")
def truncated_log(spark, d):
    return guards.kept(logs.user_log(spark, d), lifecycle(spark, d)).select("stream_id", "version", "amount")


@query("SELECT sequence, stream_id, amount FROM user_log WHERE user_id % 17 <> 0")
def closed_stream_filter(spark, d):
    closed = lifecycle(spark, d).where("closed").select("stream_id")
    return logs.flat_log(spark, d).join(closed, "stream_id", "left_anti").select("sequence", "stream_id", "amount")


@query(
    "SELECT stream_id, version, reached FROM (SELECT stream_id, version, coalesce(lag(version) OVER (PARTITION BY stream_id ORDER BY version), 0) AS reached FROM user_log WHERE sequence % 10 <> 3) WHERE version <> reached + 1"
)
def continuity_violations(spark, d):
    return guards.gaps(logs.user_log(spark, d).where("sequence % 10 <> 3"))


@query(""", b AS (SELECT (sequence - 1) // 100 AS batch_id, (sequence * 37) % 101 AS ord, sequence, (sequence - 1) // 100 * 100 AS checkpoint, (sequence - 1) // 100 * 100 + 90 AS scanned FROM user_log),
c AS (SELECT *, coalesce(lag(sequence) OVER (PARTITION BY batch_id ORDER BY ord), checkpoint) AS before FROM b)
SELECT batch_id, CAST(sum(CASE WHEN sequence <= before THEN 1 ELSE 0 END) AS BIGINT) AS unordered, max(sequence) AS upper, max(scanned) < greatest(max(sequence), max(checkpoint)) AS scan_behind FROM c GROUP BY batch_id""")
def batch_validation(spark, d):
    base = F.expr("(sequence - 1) div 100")
    batches = logs.flat_log(spark, d).select(
        base.alias("batch_id"),
        ((F.col("sequence") * 37) % 101).alias("ord"),
        "sequence",
        (base * 100).alias("checkpoint"),
        (base * 100 + 90).alias("scanned"),
    )
    return guards.delivery_faults(batches)


@query(""", l AS (SELECT DISTINCT user_id, TIMESTAMP '2024-01-01 00:00:00' AS now, TIMESTAMP '2024-01-01 00:00:00' - INTERVAL (user_id) SECOND AS renewed, TIMESTAMP '2024-01-01 00:00:00' - INTERVAL (user_id * 3) SECOND AS acquired FROM events)
SELECT 'p-' || user_id AS name, user_id * 1000 < 15000 AND user_id * 3000 < 60000 AS held FROM l""")
def lease_held(spark, d):
    users, now = logs.table(spark, d, "events").select("user_id").distinct(), F.lit("2024-01-01 00:00:00").cast("timestamp")
    ago = lambda n: F.timestamp_add("SECOND", -(F.col("user_id") * n), now)
    return users.select(
        F.concat(F.lit("p-"), F.col("user_id").cast("string")).alias("name"),
        guards.lease_held(ago(1), ago(3), now, F.lit(5000), F.lit(3), F.lit(12)).alias("held"),
    )


# Folds

ACCOUNT = ["event_type", "amount"]


def account(balance, e):
    """click deposits; purchase withdraws if covered; the rest changes nothing."""
    return F.when(e["event_type"] == "click", balance + e["amount"]).when(
        e["event_type"] == "purchase",
        commands.withdraw(balance, e["amount"]),
    ).otherwise(balance)


def fold_sql(step: str, where: str = "true", more: str = "") -> str:
    """A recursive fold; ``{b}`` in step is the state so far."""
    first, then = step.replace("{b}", "CAST(0 AS BIGINT)"), step.replace("{b}", "r.state")
    return (
        LOG.replace("WITH user_log", "WITH RECURSIVE user_log")
        + f""", l AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY version) AS n FROM user_log WHERE {where}),
r AS (
  SELECT l.stream_id, l.n, l.version, {first} AS state FROM l WHERE n = 1
  UNION ALL
  SELECT l.stream_id, l.n, l.version, {then} FROM r JOIN l ON l.stream_id = r.stream_id AND l.n = r.n + 1
){more}"""
    )


STEP = "CASE WHEN event_type = 'click' THEN {b} + amount WHEN event_type = 'purchase' AND {b} >= amount THEN {b} - amount ELSE {b} END"
LAST = "\nSELECT stream_id, max_by(state, n) AS balance, max(version) AS version FROM r GROUP BY stream_id"


@query(fold_sql(STEP) + LAST)
def fold_balance(spark, d):
    start = F.struct(F.lit(0).cast("long").alias("balance"), F.lit(0).cast("long").alias("version"))
    out = folds.folded(
        logs.user_log(spark, d),
        "stream_id",
        "version",
        ACCOUNT,
        start,
        lambda s, e: F.struct(account(s["balance"], e).alias("balance"), e["version"].alias("version")),
    )
    return out.select("stream_id", "state.*")


@query(fold_sql(STEP) + LAST)
def fold_balance_streamed(spark, d):
    def step(s, e):
        version, kind, amount = e
        balance = s[0] + amount if kind == "click" else s[0] - amount if kind == "purchase" and s[0] >= amount else s[0]
        return balance, version

    return folds.streamed(
        logs.user_log(spark, d),
        "stream_id",
        "version",
        ACCOUNT,
        lambda: (0, 0),
        step,
        "balance long, version long",
        lambda s: s,
    )


@query(
    fold_sql(
        "CASE WHEN event_type = 'signup' THEN 0 WHEN event_type = 'click' THEN {b} + amount WHEN event_type = 'purchase' THEN {b} - amount ELSE {b} END"
    ) + "\nSELECT stream_id, max_by(state, n) AS balance FROM r GROUP BY stream_id"
)
def fold_reset_on_open(spark, d):
    """Opening resets the balance, so the fold is a sum after the last opening: an aggregate of two passes over
    each stream's rows in one sort.
    """
    log = logs.user_log(spark, d)
    opened = log.where("event_type = 'signup'").groupBy("stream_id").agg(F.max("version").alias("opened"))
    change = F.when(F.col("event_type") == "click", F.col("amount")).when(F.col("event_type") == "purchase", -F.col("amount")).otherwise(0)
    return log.join(opened, "stream_id", "left").groupBy("stream_id").agg(
        F.sum(F.when(F.col("version") > F.coalesce("opened", F.lit(0)), change).otherwise(0)).alias("balance")
    )


@query(fold_sql(STEP, "version <= 5") + LAST)
def load_at_version(spark, d):
    start = F.struct(F.lit(0).cast("long").alias("balance"), F.lit(0).cast("long").alias("version"))
    out = folds.folded(
        logs.user_log(spark, d).where("version <= 5"),
        "stream_id",
        "version",
        ACCOUNT,
        start,
        lambda s, e: F.struct(account(s["balance"], e).alias("balance"), e["version"].alias("version")),
    )
    return out.select("stream_id", "state.*")


@query(""", j AS (SELECT stream_id, version, amount, ts + to_minutes(CAST((sequence * 7919) % 1000 AS BIGINT)) AS tm FROM user_log),
b AS (SELECT make_timestamp((epoch_us(min(tm)) + epoch_us(max(tm))) // 2) AS bound FROM j),
f AS (SELECT *, max(CASE WHEN tm > bound THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY version) AS late FROM j, b)
SELECT stream_id, CAST(sum(amount) AS BIGINT) AS total, max(version) AS version FROM f WHERE late = 0 GROUP BY stream_id""")
def load_until_ts(spark, d):
    jittered = logs.user_log(spark, d).withColumn(
        "at",
        F.col("ts") + F.make_dt_interval(mins=((F.col("sequence") * 7919) % 1000).cast("int")),
    )
    low, high = jittered.agg(F.min("at"), F.max("at")).first()
    bound = F.lit(low + (high - low) / 2)
    return folds.until(jittered, bound, "at").groupBy("stream_id").agg(F.sum("amount").alias("total"), F.max("version").alias("version"))


@query(
    "SELECT stream_id, version, CAST(sum(CASE WHEN event_type = 'click' THEN amount ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY version) AS BIGINT) AS state FROM user_log"
)
def state_history(spark, d):
    return folds.history(logs.user_log(spark, d), F.when(F.col("event_type") == "click", F.col("amount")).otherwise(0))


@query(
    "SELECT l.stream_id, CAST(sum(amount) FILTER (event_type = 'signup') AS BIGINT) AS state FROM lifecycle l LEFT JOIN user_log u USING (stream_id) GROUP BY 1"
)
def optional_state(spark, d):
    """No event of the type: no state at all, rather than an initial one."""
    own = logs.flat_log(spark, d).where("event_type = 'signup'")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    own = folds.folded(own, "stream_id", "sequence", ["amount"], none, folds.optional(zero, lambda s, e: s + e["amount"]))
    return lifecycle(spark, d).select("stream_id").join(own, "stream_id", "left")


SNAPSHOTS = "snaps AS (SELECT stream_id, version, sum(amount) OVER (PARTITION BY stream_id ORDER BY version) AS state FROM user_log)"


def snapshots(spark, d) -> DataFrame:
    return folds.history(logs.user_log(spark, d), F.col("amount")).where("version % 10 = 0")


@query(
    f", {SNAPSHOTS} SELECT stream_id, version, CAST(state AS BIGINT) AS state FROM snaps WHERE version % 10 = 0 QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY version DESC) = 1"
)
def snapshot_newest_wins(spark, d):
    return views.newest(snapshots(spark, d), ["stream_id"], "version", ["state"])


@query("SELECT stream_id, CAST(sum(amount) AS BIGINT) AS state, max(version) AS version FROM user_log GROUP BY stream_id")
def snapshot_delta_fold(spark, d):
    newest = views.newest(snapshots(spark, d), ["stream_id"], "version", ["state"])
    return folds.seeded(
        logs.user_log(spark, d),
        newest,
        ["amount"],
        lambda seed: F.coalesce(seed, F.lit(0).cast("long")),
        lambda s, e: s + e["amount"],
    )


@query(
    "SELECT stream_id, max(version) AS committed, max(version) // 40 * 40 AS base FROM user_log GROUP BY stream_id HAVING max(version) - max(version) // 40 * 40 >= 25"
)
def snapshots_due(spark, d):
    base = F.expr("head div 40 * 40")
    return folds.heads(logs.user_log(spark, d)).where(folds.SnapshotPolicy(25).is_due(F.col("head"), base)).select(
        "stream_id",
        F.col("head").alias("committed"),
        base.alias("base"),
    )


@query("SELECT CAST(sum(amount) AS BIGINT) AS total, count(*) AS n, max(sequence) AS as_of FROM user_log")
def running_total(spark, d):
    return logs.flat_log(spark, d).agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n"), F.max("sequence").alias("as_of"))


@query("""WITH o AS (
  SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS placed FROM orders), l AS (
  SELECT l_orderkey, count(*) AS n_lines, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS lines FROM lineitem GROUP BY 1)
SELECT 'order-' || o_orderkey AS stream_id, placed, coalesce(n_lines, 0) AS n_lines, coalesce(lines, 0) AS lines FROM o LEFT JOIN l ON l_orderkey = o_orderkey""")
def order_state(spark, d):
    """Commutative folds of order streams: aggregates, combined before the shuffle; no version is needed."""
    log = logs.order_log(spark, d)
    placed = F.col("event_type") == "Placed"
    return log.groupBy("stream_id").agg(
        F.sum(F.when(placed, F.col("amount"))).alias("placed"),
        F.count(F.when(~placed, 1)).alias("n_lines"),
        F.sum(F.when(placed, 0).otherwise(F.col("amount"))).alias("lines"),
    )


# Views


@query(
    "SELECT 'k-' || k AS view_id, max(sequence) AS version, CAST(sum(amount) AS BIGINT) AS total, arg_max(event_type, sequence) AS latest FROM user_log WHERE k IS NOT NULL GROUP BY k"
)
def view_by_key(spark, d):
    return logs.flat_log(spark, d).where("k is not null").groupBy(stream_id("k", F.col("k")).alias("view_id")).agg(
        F.max("sequence").alias("version"),
        F.sum("amount").alias("total"),
        F.max_by("event_type", "sequence").alias("latest"),
    )


@query(""", stored AS (SELECT stream_id AS view_id, max(sequence) AS version, CAST(sum(amount) AS BIGINT) AS value FROM user_log WHERE sequence % 3 = 0 GROUP BY 1),
late AS (SELECT stream_id AS view_id, max(sequence) AS version, CAST(sum(amount) AS BIGINT) AS value FROM user_log WHERE sequence % 3 = 1 GROUP BY 1),
a AS (SELECT * FROM stored UNION ALL SELECT * FROM late)
SELECT view_id, max(version) AS version, max_by(value, version) AS value FROM a GROUP BY view_id""")
def view_newest_wins(spark, d):
    log = logs.flat_log(spark, d)
    of = lambda r: log.where(f"sequence % 3 = {r}").groupBy(F.col("stream_id").alias("view_id")).agg(F.max("sequence").alias("version"), F.sum("amount").alias("value"))
    return views.upserted(of(0), of(1), ["view_id"], "version", ["value"])


@query("SELECT stream_id AS view_id, max(sequence) AS version, CAST(sum(amount) AS BIGINT) AS value FROM user_log GROUP BY 1")
def view_replay_idempotent(spark, d):
    """A view at half the log meets the whole log again: what it has seen is skipped, so the result is as if applied once."""
    log = logs.flat_log(spark, d)
    of = lambda x: x.groupBy("view_id").agg(F.max("sequence").alias("version"), F.sum("amount").alias("value"))
    half = log.agg(F.expr("max(sequence) div 2")).first()[0] or 0
    stored = of(log.where(F.col("sequence") <= half).withColumn("view_id", F.col("stream_id")))
    delta = of(views.unapplied(log, stored, F.col("stream_id")))
    return stored.unionByName(delta).groupBy("view_id").agg(F.max("version").alias("version"), F.sum("value").alias("value"))


def view_keys() -> dict[str, Column]:
    return {"by_user": F.col("stream_id"), "by_k": F.col("k"), "buyers": F.when(F.col("event_type") == "purchase", F.col("stream_id"))}


@query(""", c AS (SELECT *, (sequence - 1) // 100 AS batch FROM user_log)
SELECT DISTINCT batch, 'by_user' AS view_name, stream_id AS view_id FROM c
UNION SELECT batch, 'by_k', CAST(k AS VARCHAR) FROM c WHERE k IS NOT NULL
UNION SELECT batch, 'buyers', stream_id FROM c WHERE event_type = 'purchase'""")
def inline_touched_rows(spark, d):
    """The rows that each commit of 100 events touches."""
    return views.touched(logs.flat_log(spark, d).withColumn("batch", F.expr("(sequence - 1) div 100")), view_keys(), "batch")


@query("""SELECT 'by_user' AS view_name, stream_id AS view_id, max(sequence) AS version, CAST(sum(amount) AS BIGINT) AS value FROM user_log GROUP BY 2
UNION ALL SELECT 'by_k', CAST(k AS VARCHAR), max(sequence), CAST(count(*) AS BIGINT) FROM user_log WHERE k IS NOT NULL GROUP BY 2
UNION ALL SELECT 'buyers', stream_id, max(sequence), CAST(sum(amount) AS BIGINT) FROM user_log WHERE event_type = 'purchase' GROUP BY 2""")
def fanout_views(spark, d):
    keys = view_keys()
    return views.fanned_out(
        logs.flat_log(spark, d),
        {"by_user": (keys["by_user"], F.col("amount")), "by_k": (keys["by_k"], F.lit(1)), "buyers": (keys["buyers"], F.col("amount"))},
    )


@query(""", l AS (SELECT stream_id, event_type, amount, sequence, max(CASE WHEN event_type = 'error' THEN sequence END) OVER (PARTITION BY stream_id) AS closed FROM user_log)
SELECT stream_id, CAST(sum(CASE WHEN event_type = 'click' THEN amount WHEN event_type = 'purchase' THEN -amount ELSE 0 END) AS BIGINT) AS balance, max(sequence) AS version FROM l WHERE sequence > coalesce(closed, 0) GROUP BY stream_id""")
def ledger_with_removal(spark, d):
    """A ledger whose row goes when its account closes (error), and starts anew with the next event."""
    log = logs.flat_log(spark, d)
    closed = log.where("event_type = 'error'").groupBy("stream_id").agg(F.max("sequence").alias("closed"))
    change = F.when(F.col("event_type") == "click", F.col("amount")).when(F.col("event_type") == "purchase", -F.col("amount")).otherwise(0)
    return log.join(closed, "stream_id", "left").where(F.col("sequence") > F.coalesce("closed", F.lit(0))).groupBy("stream_id").agg(
        F.sum(change).alias("balance"),
        F.max("sequence").alias("version"),
    )


@query(""", t AS (SELECT sequence AS delivery, stream_id, version FROM user_log UNION ALL SELECT sequence + 7, stream_id, version FROM user_log WHERE sequence % 4 = 0),
a AS (SELECT *, coalesce(max(version) OVER (PARTITION BY stream_id ORDER BY delivery, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS applied FROM t)
SELECT delivery, stream_id, version FROM a WHERE version > applied""")
def skip_redelivered(spark, d):
    log = logs.user_log(spark, d)
    sent = log.select(F.struct(F.col("sequence").alias("at"), "version").alias("delivery"), "stream_id", "version").unionByName(
        log.where("sequence % 4 = 0").select(
            F.struct((F.col("sequence") + 7).alias("at"), "version").alias("delivery"),
            "stream_id",
            "version",
        )
    )
    return guards.fresh_deliveries(sent).select(F.col("delivery.at").alias("delivery"), "stream_id", "version")


# Commands


OUTCOMES = fold_sql(STEP, more="""
SELECT l.stream_id, l.version, CASE WHEN event_type = 'click' THEN 'committed' WHEN event_type = 'purchase' THEN CASE WHEN coalesce(p.state, 0) >= amount THEN 'committed' ELSE 'rejected' END ELSE 'noop' END AS outcome, r.state
FROM l JOIN r ON r.stream_id = l.stream_id AND r.n = l.n LEFT JOIN r p ON p.stream_id = l.stream_id AND p.n = l.n - 1""")


@query(OUTCOMES)
def decide_commands(spark, d):
    def decide(balance, c):
        fits = (c["event_type"] == "purchase") & (balance >= c["amount"])
        outcome = F.when(
            (c["event_type"] == "click") | fits,
            commands.COMMITTED,
        ).when(c["event_type"] == "purchase", commands.REJECTED).otherwise(commands.NOOP)
        return F.struct(account(balance, c).alias("state"), outcome.alias("outcome"))

    return commands.decided(logs.user_log(spark, d), "stream_id", "version", ACCOUNT, F.lit(0).cast("long"), decide)


@query(OUTCOMES)
def decide_commands_streamed(spark, d):
    """The same for streams of any length: one state in memory, an outcome a command."""

    def step(balance, c):
        _, kind, amount = c
        if kind == "click":
            return balance + amount, (commands.COMMITTED, balance + amount)
        if kind == "purchase":
            after = balance - amount if balance >= amount else balance
            return after, (commands.COMMITTED if balance >= amount else commands.REJECTED, after)
        return balance, (commands.NOOP, balance)

    return folds.scanned(logs.user_log(spark, d), "stream_id", "version", ACCOUNT, lambda: 0, step, "outcome string, state long")


@query(""", c AS (SELECT sequence AS ord, stream_id, CASE WHEN sequence % 3 <> 0 THEN 'key-' || (sequence // 200) END AS idempotency_key FROM user_log)
SELECT ord, stream_id, idempotency_key, CASE WHEN idempotency_key IS NULL THEN ord ELSE min(ord) OVER (PARTITION BY stream_id, idempotency_key) END AS committed_at,
  CASE WHEN idempotency_key IS NULL OR ord = min(ord) OVER (PARTITION BY stream_id, idempotency_key) THEN 'committed' ELSE 'already_committed' END AS outcome FROM c""")
def idempotent_commands(spark, d):
    key = F.when(F.col("sequence") % 3 != 0, F.concat(F.lit("key-"), F.expr("sequence div 200").cast("string")))
    return commands.first_by_key(
        logs.flat_log(spark, d).select(F.col("sequence").alias("ord"), "stream_id", key.alias("idempotency_key")),
        "ord",
    )


@query(""", done AS (SELECT DISTINCT stream_id, 'key-' || (sequence // 200) AS idempotency_key FROM user_log WHERE sequence <= 300),
c AS (SELECT sequence AS ord, stream_id, 'key-' || (sequence // 200) AS idempotency_key FROM user_log)
SELECT ord, c.stream_id, c.idempotency_key FROM c ANTI JOIN done USING (stream_id, idempotency_key)""")
def redelivered_commands(spark, d):
    keyed = logs.flat_log(spark, d).select(
        F.col("sequence").alias("ord"),
        "stream_id",
        F.concat(F.lit("key-"), F.expr("sequence div 200").cast("string")).alias("idempotency_key"),
        "sequence",
    )
    return commands.unseen(keyed.drop("sequence"), keyed.where("sequence <= 300")).select("ord", "stream_id", "idempotency_key")


@query(""", c AS (SELECT DISTINCT user_id AS condition_id, (user_id * 5303) % (SELECT max(sequence) FROM user_log) AS after, user_id FROM events)
SELECT condition_id, after, (SELECT max(sequence) FROM user_log u WHERE sequence > c.after AND ((u.event_type = 'purchase' AND list_contains(u.tags, 'user:' || c.user_id)) OR (u.event_type IN ('signup', 'error') AND list_contains(u.tags, 'k:' || c.user_id % 10)) OR (c.user_id % 50 = 3 AND u.event_type = 'view'))) AS conflict FROM c""")
def boundary_conflicts(spark, d):
    item = lambda types, tags: F.struct(types.alias("types"), tags.alias("tags"))
    none = F.array().cast("array<string>")
    items = F.array(
        item(F.array(F.lit("purchase")), F.array(tag("user", F.col("user_id")))),
        item(F.array(F.lit("signup"), F.lit("error")), F.array(tag("k", F.col("user_id") % 10))),
    )
    items = F.when(F.col("user_id") % 50 == 3, F.concat(items, F.array(item(F.array(F.lit("view")), none)))).otherwise(items)
    users, log = logs.table(spark, d, "events").select("user_id").distinct(), logs.flat_log(spark, d)
    after = (F.col("user_id") * 5303) % (log.agg(F.max("sequence")).first()[0] or 1)
    return commands.conflicts(users.select(F.col("user_id").alias("condition_id"), after.alias("after"), items.alias("items")), log)


@query(""", seats AS (SELECT k, 20 + k % 7 AS seats, count(DISTINCT user_id) AS taken FROM user_log WHERE event_type = 'signup' GROUP BY k),
courses AS (SELECT user_id, count(DISTINCT k) AS own FROM user_log WHERE event_type = 'signup' GROUP BY user_id),
mine AS (SELECT DISTINCT user_id, k FROM user_log WHERE event_type = 'signup'),
asks AS (SELECT DISTINCT user_id, (user_id * 7) % 14 AS k FROM events)
SELECT a.user_id, a.k, CASE WHEN s.k IS NULL THEN 'no course' WHEN m.k IS NOT NULL THEN 'already enrolled' WHEN taken >= seats THEN 'full' WHEN coalesce(own, 0) >= 2 THEN 'too many courses' ELSE 'enrolled' END AS outcome
FROM asks a LEFT JOIN seats s ON s.k = a.k LEFT JOIN mine m ON m.user_id = a.user_id AND m.k = a.k LEFT JOIN courses c ON c.user_id = a.user_id""")
def boundary_enrollment(spark, d):
    """Decisions over the events of two tags, the course's and the student's; each is folded once for all decisions that need it."""
    own = logs.flat_log(spark, d).where("event_type = 'signup'").select("user_id", "k")
    seats = own.where("k is not null").groupBy("k").agg(
        F.count_distinct("user_id").alias("taken")
    ).withColumn("seats", 20 + F.col("k") % 7).withColumn("course", F.lit(True))
    courses = own.groupBy("user_id").agg(F.count_distinct("k").alias("own"))
    asks = logs.table(spark, d, "events").select("user_id").distinct().withColumn("k", (F.col("user_id") * 7) % 14)
    every = asks.join(seats, "k", "left").join(
        own.distinct().withColumn("mine", F.lit(True)),
        ["user_id", "k"],
        "left",
    ).join(courses, "user_id", "left")
    outcome = F.when(F.col("course").isNull(), "no course").when(F.col("mine"), "already enrolled").when(F.col("taken") >= F.col("seats"), "full").when(
        F.coalesce("own", F.lit(0)) >= 2,
        "too many courses",
    ).otherwise("enrolled")
    return every.select("user_id", "k", outcome.alias("outcome"))


@query(""", l AS (SELECT *, (user_id * 7919) % (SELECT max(sequence) FROM user_log) AS after FROM user_log),
b AS (SELECT user_id, CAST(sum(CASE WHEN sequence > after THEN 0 WHEN event_type = 'click' THEN amount WHEN event_type = 'purchase' THEN -amount ELSE 0 END) AS BIGINT) AS balance,
  coalesce(max(CASE WHEN sequence <= after THEN sequence END), 0) AS seen, max(CASE WHEN sequence > after AND event_type = 'purchase' THEN sequence END) AS conflict FROM l GROUP BY user_id)
SELECT user_id, balance, seen, conflict, CASE WHEN balance < 5000 THEN 'rejected' WHEN conflict IS NOT NULL THEN 'conflict' ELSE 'committed' END AS outcome FROM b""")
def loan_validation_narrowed(spark, d):
    """Every user's loan is decided at a position of its own. Deposits and withdrawals decide; only later
    withdrawals invalidate the decision.
    """
    log = logs.flat_log(spark, d)
    after = (F.col("user_id") * 7919) % (log.agg(F.max("sequence")).first()[0] or 1)
    read = F.col("sequence") <= after
    change = F.when(~read, 0).when(F.col("event_type") == "click", F.col("amount")).when(
        F.col("event_type") == "purchase",
        -F.col("amount"),
    ).otherwise(0)
    later = F.when(~read & (F.col("event_type") == "purchase"), F.col("sequence"))
    seen = F.coalesce(F.max(F.when(read, F.col("sequence"))), F.lit(0).cast("long"))
    own = log.groupBy("user_id").agg(F.sum(change).alias("balance"), seen.alias("seen"), F.max(later).alias("conflict"))
    return own.withColumn(
        "outcome",
        F.when(F.col("balance") < 5000, "rejected").when(F.col("conflict").isNotNull(), "conflict").otherwise("committed"),
    )


@query("""SELECT 'wire-fee:' || sequence || ':0' AS idempotency_key, sequence, CAST(0 AS BIGINT) AS index, 'withdraw' AS command, stream_id AS target, amount // 10 AS amount FROM user_log WHERE event_type = 'click' AND amount >= 10
UNION ALL SELECT 'wire-fee:' || sequence || ':1', sequence, 1, 'notify', 'user-' || k, 0 FROM user_log WHERE event_type = 'click' AND amount >= 5000""")
def saga_commands(spark, d):
    one = lambda c, t, a: F.struct(F.lit(c).alias("command"), t.alias("target"), a.cast("long").alias("amount"))
    fee, note = one("withdraw", F.col("stream_id"), F.expr("amount div 10")), one("notify", stream_id("user", F.col("k")), F.lit(0))
    react = F.when(
        (F.col("event_type") == "click") & (F.col("amount") >= 5000),
        F.array(fee, note),
    ).when((F.col("event_type") == "click") & (F.col("amount") >= 10), F.array(fee))
    return commands.reactions(logs.flat_log(spark, d), "wire-fee", react)


@query("""SELECT sequence, coalesce(CASE WHEN sequence % 2 = 0 THEN 'i-' || sequence END, 'e-' || sequence) AS causation_id, coalesce(CASE WHEN sequence % 3 = 0 THEN 'c-' || user_id END, CASE WHEN sequence % 5 = 0 THEN 'd-' || k END) AS correlation_id,
  CASE WHEN sequence % 7 = 0 THEN 'key-' || sequence END AS idempotency_key FROM user_log""")
def metadata_overlay(spark, d):
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    when = lambda n, v: F.when(F.col("sequence") % n == 0, v)
    given = metadata.with_key(
        metadata.of_ids(when(2, text("i-", "sequence")), when(3, text("c-", "user_id"))),
        when(7, text("key-", "sequence")),
    )
    own = metadata.with_key(metadata.of_ids(text("e-", "sequence"), when(5, text("d-", "k"))), F.lit("never taken"))
    rows = logs.flat_log(spark, d).select("sequence", given.alias("given"), own.alias("own"))
    return rows.select(
        "sequence",
        metadata.overlay(F.col("given"), F.col("own")).alias("m"),
    ).select("sequence", "m.causation_id", "m.correlation_id", "m.idempotency_key")


# Upcasting, parking, shredding


def raw(spark, d) -> DataFrame:
    """Amounts in three schema versions: cents, decimal text, JSON with cents; and versions that no ladder knows."""
    version = (F.col("sequence") % 4 + 1).cast("int")
    text = (F.col("amount").cast("decimal(20,2)") / 100).cast("decimal(20,2)").cast("string")
    payload = F.when(version == 1, F.col("amount").cast("string")).when(version == 2, text).otherwise(
        F.to_json(F.struct(F.col("user_id").alias("account"), F.col("amount").alias("cents")))
    )
    return logs.flat_log(spark, d).select(
        "sequence",
        "stream_id",
        F.lit("Amount").alias("event_type"),
        version.alias("schema_version"),
        payload.alias("payload"),
    )


def amounts() -> upcast.BuiltLadder:
    decimal = lambda p: (p.cast("decimal(20,2)") / 100).cast("decimal(20,2)").cast("string")
    to_json = lambda p: F.to_json(F.struct(F.round(p.cast("decimal(20,2)") * 100).cast("long").alias("cents")))
    return upcast.Ladder().rung("Amount", 1, decimal).rung("Amount", 2, to_json).build()


@query("SELECT sequence, CASE WHEN sequence % 4 < 3 THEN amount END AS cents FROM user_log")
def upcast_ladder(spark, d):
    """Every row at its newest version; those that no rung reaches have no amount."""
    rows, ladder = raw(spark, d), amounts()
    known = ladder.known(F.col("event_type"), F.col("schema_version"))
    payload = F.when(known, ladder.column(F.col("event_type"), F.col("schema_version"), F.col("payload")))
    return rows.select("sequence", F.get_json_object(payload, "$.cents").cast("long").alias("cents"))


@query(
    "SELECT sequence, event_type, CASE WHEN event_type = 'click' THEN 'deposited:' || amount WHEN event_type = 'purchase' THEN 'withdrawn:' || amount END AS payload FROM user_log WHERE event_type IN ('click', 'purchase')"
)
def upcast_chain(spark, d):
    chain = upcast.Chain().register("click", lambda p: F.lit("old")).register(
        "purchase",
        lambda p: F.concat(F.lit("withdrawn:"), p),
    ).register("click", lambda p: F.concat(F.lit("deposited:"), p))
    rows = logs.flat_log(spark, d).where("event_type in ('click', 'purchase')")
    return rows.select("sequence", "event_type", chain.column(F.col("event_type"), F.col("amount").cast("string")).alias("payload"))


@query(
    "SELECT sequence, stream_id, 'unknown version ' || (sequence % 4 + 1) AS error, CAST(4 AS BIGINT) AS attempts FROM user_log WHERE sequence % 4 = 3"
)
def park_poison(spark, d):
    """Rows that can't be upcast go to the parked table once their retries are spent; the others pass."""
    rows = raw(spark, d)
    bad = rows.where(~amounts().known(F.col("event_type"), F.col("schema_version")))
    return bad.select(
        "sequence",
        "stream_id",
        F.concat(F.lit("unknown version "), F.col("schema_version").cast("string")).alias("error"),
        F.lit(4).cast("long").alias("attempts"),
    )


@query(""", p AS (SELECT 'sub-' || sequence % 3 AS subscription, sequence, CAST(1 + sequence % 5 AS BIGINT) AS attempts FROM user_log WHERE event_type = 'error'
UNION ALL SELECT 'sub-' || sequence % 3, sequence, 9 FROM user_log WHERE event_type = 'error' AND sequence % 2 = 0)
SELECT subscription, sequence, max(attempts) AS attempts FROM p WHERE subscription = 'sub-1' GROUP BY 1, 2 ORDER BY sequence""")
def parked_list(spark, d):
    bad = logs.flat_log(spark, d).where("event_type = 'error'")
    sub = F.concat(F.lit("sub-"), (F.col("sequence") % 3).cast("string")).alias("subscription")
    first = bad.select(sub, "sequence", (1 + F.col("sequence") % 5).alias("attempts"), F.lit(1).alias("round"))
    again = bad.where("sequence % 2 = 0").select(sub, "sequence", F.lit(9).cast("long").alias("attempts"), F.lit(2).alias("round"))
    return views.newest(
        first.unionByName(again),
        ["subscription", "sequence"],
        "round",
        ["attempts"],
    ).where("subscription = 'sub-1'").select("subscription", "sequence", "attempts").orderBy("sequence")


@query(
    "SELECT sequence, CASE WHEN user_id % 5 = 0 THEN 'shredded' ELSE 'plain' END AS state, CASE WHEN user_id % 5 <> 0 THEN 'name-' || user_id END AS value, coalesce(CASE WHEN user_id % 5 <> 0 THEN 'name-' || user_id END, 'gone') AS shown FROM user_log"
)
def key_left_join_shred(spark, d):
    """Names sealed by their users' keys and read after a fifth of the users were erased."""
    log = logs.flat_log(spark, d).select("sequence", "user_id", stream_id("user", F.col("user_id")).alias("subject"))
    users = log.select("user_id", "subject").distinct()
    keys = users.select("subject", F.substring(F.sha2("subject", 256), 1, 32).cast("binary").alias("key"))
    named = log.select("sequence", shred.plain(F.col("subject"), F.concat(F.lit("name-"), F.col("user_id").cast("string"))).alias("name"))
    left = shred.erased(keys, users.where("user_id % 5 = 0").select("subject"))
    read = shred.opened(shred.sealed(named, keys, "name"), left, "name")
    return read.select(
        "sequence",
        F.col("name.state").alias("state"),
        shred.get(F.col("name")).alias("value"),
        F.coalesce(shred.get(F.col("name")), F.lit("gone")).alias("shown"),
    )
