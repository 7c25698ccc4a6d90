"""A durable event log in Parquet.

Layout of a store's folder::

    commits/00000000000000000007.json     the manifest of commit 7, written once
    events/<commit>-*.parquet             the commit's events, sorted by sequence
    tables/<name>/<commit>-*.parquet      versions of the side tables

A commit is what its manifest says: it is written under a temporary name and
renamed without overwriting, so of two writers that prepared the same number
one fails and prepares anew from what the other wrote. Readers pin a manifest
and see its files only, hence never a later sequence before an earlier one.
Files are reached through Hadoop's file system, so any store that Spark reads
will do. Inline views are folded from an append's events and committed with
them, under one manifest: both are there or neither.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.errors import Conflict, DuplicateStream, QueryConflict, StreamClosed, Truncated, UnaskedStream, Unavailable
from lorekeep.metrics import Metrics
from lorekeep.operators import guards
from lorekeep.operators.predicates import Query
from lorekeep.operators.views import View
from lorekeep.operators.positions import appended
from lorekeep.schema import LOG, NEW_EVENT, columns

LIFECYCLE = columns("stream_id string, closed boolean, first_kept long, head long")
RETRIES = 3
#: So many names of streams go into a scan's filter.
FEW_STREAMS = 256


@dataclass
class Manifest:
    commit: int = 0
    last_sequence: int = 0
    events: list[str] = field(default_factory=list)
    tables: dict[str, str] = field(default_factory=dict)


class CommitSignal:
    """Tells waiters in this process that events were committed. Signals coalesce and are never lost: a waiter
    says which commit it has seen.
    """

    def __init__(self) -> None:
        self._changed, self.last = threading.Condition(), 0

    def notify(self, commit: int) -> None:
        with self._changed:
            self.last = max(self.last, commit)
            self._changed.notify_all()

    def wait(self, seen: int, seconds: float) -> int:
        """The last commit, at once if it is past ``seen``, else when one comes or the time is over."""
        with self._changed:
            self._changed.wait_for(lambda: self.last > seen, seconds)
            return self.last


class EventStore:
    def __init__(self, spark: SparkSession, path: str, retries: int = RETRIES) -> None:
        self.spark, self.path, self.retries = spark, path.rstrip("/"), retries
        self.metrics, self.committed = Metrics(), CommitSignal()
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for d in ("commits", "events", "tables"):
            self._fs.mkdirs(self._path(f"{self.path}/{d}"))

    # Manifests

    def head_commit(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/commits"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def manifest(self, commit: int | None = None) -> Manifest:
        n = self.head_commit() if commit is None else commit
        if not n:
            return Manifest()
        stream = self._fs.open(self._path(f"{self.path}/commits/{n:020d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def _commit(self, new: Manifest) -> bool:
        """Whether this writer's manifest is the one with its number."""
        temporary = self._path(f"{self.path}/commits/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        target = self._path(f"{self.path}/commits/{new.commit:020d}.json")
        if self._fs.exists(target):
            self._fs.delete(temporary, False)
            return False
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:  # FileContext's rename doesn't overwrite
            context.rename(
                temporary,
                target,
                self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0),
            )
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            self._fs.delete(temporary, False)
            return False
        return True

    def transact(self, prepare) -> Manifest:
        """prepare(manifest) -> the next manifest, or None for nothing to do; again from the newest manifest when
        another writer was faster.
        """
        for _ in range(self.retries + 1):
            now = self.manifest()
            new = prepare(now)
            if new is None:
                return now
            new.commit = now.commit + 1
            if self._commit(new):
                if new.last_sequence > now.last_sequence:
                    self.metrics.add("store.events_appended", new.last_sequence - now.last_sequence)
                    self.committed.notify(new.commit)
                return new
            self.metrics.add("store.commit_races")
        raise Unavailable(f"another writer was faster {self.retries + 1} times")

    # Reads

    def log(self, at: Manifest | None = None) -> DataFrame:
        """All events that are kept."""
        m = at or self.manifest()
        if not m.events:
            return self.spark.createDataFrame([], LOG)
        events = self.spark.read.schema(LOG).parquet(*[f"{self.path}/{e}" for e in m.events])
        cuts = self.lifecycle(m).where("first_kept > 1")
        return guards.kept(events, cuts) if "lifecycle" in m.tables else events

    def table(self, name: str, schema: T.StructType, at: Manifest | None = None) -> DataFrame:
        m = at or self.manifest()
        return self.spark.read.schema(schema).parquet(
            f"{self.path}/{m.tables[name]}"
        ) if name in m.tables else self.spark.createDataFrame([], schema)

    def lifecycle(self, at: Manifest | None = None) -> DataFrame:
        return self.table("lifecycle", LIFECYCLE, at)

    def stream(self, stream_id: str, after: int = 0) -> DataFrame:
        m = self.manifest()
        life = self.lifecycle(m).where(F.col("stream_id") == stream_id).first()
        if life and after + 1 < life.first_kept:
            raise Truncated(stream_id, life.first_kept)
        return self.log(m).where((F.col("stream_id") == stream_id) & (F.col("version") > after)).orderBy("version")

    def heads(self, streams: DataFrame, at: Manifest) -> DataFrame:
        """Heads of the named streams only: a semi-join before the aggregate. The names of a few streams also
        reach the scan, which passes over row groups without them.
        """
        named = streams.select("stream_id").distinct()
        few = [r[0] for r in named.limit(FEW_STREAMS + 1).collect()]
        log = self.log(at).select("stream_id", "version")
        log = log.where(F.col("stream_id").isin(few)) if len(few) <= FEW_STREAMS else log
        own = log.join(named, "stream_id", "left_semi").groupBy("stream_id").agg(F.max("version").alias("last"))
        recorded = self.lifecycle(at).select("stream_id", "head", "closed")
        every = named.join(own, "stream_id", "left").join(recorded, "stream_id", "left")
        return every.select(
            "stream_id",
            F.greatest(F.coalesce("last", F.lit(0)), F.coalesce("head", F.lit(0))).cast("long").alias("head"),
            F.coalesce("closed", F.lit(False)).alias("closed"),
        )

    # Appends

    def append(
        self,
        stream_id: str,
        events: DataFrame,
        kind: str = guards.ANY,
        expected: int = 0,
        inline: tuple[View, ...] = (),
    ) -> Manifest:
        """events: the columns of NEW_EVENT but stream_id, and ord, their order. An empty append still checks."""
        ask = self.spark.createDataFrame([(stream_id, kind, expected)], "stream_id string, expected_kind string, expected_version long")
        return self.append_batch(events.withColumn("stream_id", F.lit(stream_id)), ask, inline=inline)

    def append_batch(
        self,
        events: DataFrame,
        asks: DataFrame,
        query: Query | None = None,
        after: int = 0,
        inline: tuple[View, ...] = (),
    ) -> Manifest:
        """All streams or none. asks: stream_id, expected_kind, expected_version, a row for each stream of the
        events. With a query: refused if an event past ``after`` matches it. The rows of inline views that the
        events touch are folded and committed with them; if that fails nothing is appended.
        """
        twice = asks.groupBy("stream_id").count().where("count > 1").first()
        if twice:
            raise DuplicateStream(twice.stream_id)
        rows = events.select("ord", *[f.name for f in NEW_EVENT.fields])
        unasked = rows.select("stream_id").distinct().join(asks.select("stream_id"), "stream_id", "left_anti").limit(1).collect()
        if unasked:
            raise UnaskedStream(unasked[0].stream_id)

        def prepare(m: Manifest) -> Manifest | None:
            heads = self.heads(asks, m)
            self._check(asks, heads)
            if query is not None:
                hit = self.log(m).where((F.col("sequence") > after) & query.column()).agg(F.max("sequence")).first()[0]
                if hit is not None:
                    raise QueryConflict(hit)
            placed = appended(rows, heads.select("stream_id", "head"), m.last_sequence, "ord")
            name = f"events/{m.commit + 1:020d}-{uuid.uuid4().hex}"
            target = f"{self.path}/{name}"
            placed.select(*[F.col(f.name).cast(f.dataType) for f in LOG.fields]).sortWithinPartitions("sequence").write.parquet(target)
            written = self.spark.read.schema(LOG).parquet(target)
            last = written.agg(F.max("sequence")).first()[0]
            if last is None:
                return None
            tables = dict(m.tables) | {
                view.table: self._write(
                    view.table,
                    view.schema,
                    view.applied(written, self.table(view.table, view.schema, m)),
                    m,
                ) for view in inline
            }
            return Manifest(0, last, [*m.events, name], tables)

        return self.transact(prepare)

    def _check(self, asks: DataFrame, heads: DataFrame) -> None:
        fits = guards.version_matches(F.col("expected_kind"), F.col("expected_version"), F.col("head"))
        bad = asks.join(heads, "stream_id").withColumn("fits", fits).where("closed or not fits").orderBy("stream_id").limit(1).collect()
        if bad and bad[0].closed:
            raise StreamClosed(bad[0].stream_id)
        if bad:
            self.metrics.add("store.conflicts")
            raise Conflict(bad[0].stream_id, bad[0].head)

    def append_if(self, events: DataFrame, asks: DataFrame, query: Query, after: int) -> Manifest:
        return self.append_batch(events, asks, query, after)

    # Lifecycle and side tables

    def put(self, name: str, schema: T.StructType, change) -> Manifest:
        """Replaces a side table by change(table, manifest)."""

        def prepare(m: Manifest) -> Manifest:
            return Manifest(
                0,
                m.last_sequence,
                list(m.events),
                {**m.tables, name: self._write(name, schema, change(self.table(name, schema, m), m), m)},
            )

        return self.transact(prepare)

    def _write(self, name: str, schema: T.StructType, rows: DataFrame, m: Manifest) -> str:
        target = f"tables/{name}/{m.commit + 1:020d}-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).write.parquet(f"{self.path}/{target}")
        return target

    def compact(self) -> Manifest:
        """The log's events in one folder instead of one for each commit, without versions that were cut;
        positions stay. Older manifests keep naming the old folders.
        """

        def prepare(m: Manifest) -> Manifest | None:
            if len(m.events) < 2:
                return None
            name = f"events/{m.commit + 1:020d}-{uuid.uuid4().hex}"
            self.log(m).repartitionByRange("sequence").sortWithinPartitions("sequence").write.parquet(f"{self.path}/{name}")
            return Manifest(0, m.last_sequence, [name], dict(m.tables))

        return self.transact(prepare)

    def _live(self, stream_id: str, closed: Column, first_kept: Column):
        one = self.spark.createDataFrame([(stream_id,)], "stream_id string")

        def change(old: DataFrame, m: Manifest) -> DataFrame:
            named = F.col("stream_id") == stream_id
            mine = self.heads(one, m).drop("closed").join(old.where(named).select("stream_id", "closed", "first_kept"), "stream_id", "left")
            mine = mine.select(
                "stream_id",
                F.coalesce("closed", F.lit(False)).alias("was"),
                F.coalesce("first_kept", F.lit(1)).alias("kept_from"),
                "head",
            )
            new = mine.select(
                "stream_id",
                (F.col("was") | closed).alias("closed"),
                F.greatest("kept_from", first_kept).alias("first_kept"),
                "head",
            )
            return old.where(~named).unionByName(new)

        return change

    def close(self, stream_id: str) -> Manifest:
        """No more appends; what was written stays readable. Closing again, or an unknown name, is fine."""
        return self.put("lifecycle", LIFECYCLE, self._live(stream_id, F.lit(True), F.lit(1)))

    def truncate(self, stream_id: str, before: int) -> Manifest:
        """Drops versions below ``before``; the head is kept. Never past head + 1, never backwards."""
        m = self.manifest()
        head = self.heads(self.spark.createDataFrame([(stream_id,)], "stream_id string"), m).first().head
        if before > head + 1:
            raise ValueError(f"{stream_id}: cut {before} is past {head + 1}")
        return self.put("lifecycle", LIFECYCLE, self._live(stream_id, F.lit(False), F.lit(before)))

    def upsert(self, name: str, schema: T.StructType, rows: DataFrame, keys: list[str], by: str) -> Manifest:
        """Newest-wins upsert into a side table: snapshots by version, views by sequence."""
        from lorekeep.operators.views import upserted

        values = [f.name for f in schema.fields if f.name not in (*keys, by)]
        return self.put(name, schema, lambda old, _: upserted(old, rows, keys, by, values))
