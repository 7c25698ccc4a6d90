"""A store's log as a Structured Streaming source whose offsets are sequences.

spark.dataSource.register(LogSource); then
spark.readStream.format("lorekeep").option("path", store).load(). What is read
is what the newest manifest names: files of writers that lost the race or died
are never seen, nor are versions that were cut. Offsets are bounds, not counts,
so permanent gaps are passed over, and a batch without a matching event still
moves on. A batch is all events up to the log's head, read file by file on the
executors.

Options: path; after: where a new query begins; prefixes, types: JSON lists of
literal stream prefixes and of event types, any of each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lorekeep.schema import LOG


class EventFile(InputPartition):
    def __init__(self, file: str, after: int, upto: int, cuts: str | None) -> None:
        self.file, self.after, self.upto, self.cuts = file, after, upto, cuts


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (any that Arrow knows: local, HDFS, S3, GCS), and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files(store: fs.FileSystem, folder: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File)


def newest(path: str) -> dict:
    store, root = opened(path)
    names = [f for f in files(store, f"{root}/commits") if f.endswith(".json") and f.rsplit("/", 1)[1][0].isdigit()]
    if not names:
        return {"last_sequence": 0, "events": [], "tables": {}}
    with store.open_input_stream(max(names)) as f:
        return json.loads(f.readall())


class LogReader(DataSourceStreamReader):
    def __init__(self, path: str, after: int, prefixes: list[str], types: list[str]) -> None:
        self.path, self.after, self.prefixes, self.types = path.rstrip("/"), after, prefixes, types

    def initialOffset(self) -> dict:  # noqa: N802
        return {"sequence": self.after}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"sequence": max(self.after, newest(self.path)["last_sequence"])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        (store, root), manifest = opened(self.path), newest(self.path)
        cuts = manifest["tables"].get("lifecycle")
        out: list[InputPartition] = []
        for folder in manifest["events"]:
            for file in files(store, f"{root}/{folder}"):
                if not file.endswith(".parquet"):
                    continue
                meta = pq.read_metadata(file, filesystem=store)
                stats = [meta.row_group(g).column(0).statistics for g in range(meta.num_row_groups)]
                if any(s is None or (s.max > start["sequence"] and s.min <= end["sequence"]) for s in stats):
                    out.append(EventFile(file, start["sequence"], end["sequence"], f"{root}/{cuts}" if cuts else None))
        return out

    def read(self, partition: EventFile) -> Iterator[pa.RecordBatch]:
        store = opened(self.path)[0]
        where = (pc.field("sequence") > partition.after) & (pc.field("sequence") <= partition.upto)
        if self.types:
            where &= pc.field("event_type").isin(self.types)
        if self.prefixes:
            named = pc.starts_with(pc.field("stream_id"), self.prefixes[0])
            for prefix in self.prefixes[1:]:
                named |= pc.starts_with(pc.field("stream_id"), prefix)
            where &= named
        rows = pq.read_table(partition.file, filesystem=store, filters=where).select([f.name for f in LOG.fields])
        if partition.cuts and rows.num_rows:
            rows = rows.filter(self._kept(rows, store, partition.cuts))
        yield from rows.to_batches()

    def _kept(self, rows: pa.Table, store: fs.FileSystem, folder: str) -> pa.Array:
        """Only the cuts of this file's streams are loaded."""
        named = pc.field("stream_id").isin(rows["stream_id"].unique()) & (pc.field("first_kept") > 1)
        cuts = pa.concat_tables(
            [
                pq.read_table(
                    f,
                    filesystem=store,
                    filters=named,
                ).select(["stream_id", "first_kept"]) for f in files(store, folder) if f.endswith(".parquet")
            ]
        )
        first = dict(zip(cuts["stream_id"].to_pylist(), cuts["first_kept"].to_pylist(), strict=True))
        return pa.array(
            [v >= first.get(s, 1) for s, v in zip(rows["stream_id"].to_pylist(), rows["version"].to_pylist(), strict=True)],
            pa.bool_(),
        )


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lorekeep"

    def schema(self) -> StructType:
        return LOG

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        listed = lambda key: json.loads(self.options.get(key, "[]"))
        return LogReader(self.options["path"], int(self.options.get("after", "0")), listed("prefixes"), listed("types"))
