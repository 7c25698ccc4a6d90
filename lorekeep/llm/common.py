"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters handled at once inside a Python worker; bounds its working memory.
SLICE_CHARS = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: that of spark.checkpoint.dir. Only in local mode, where one machine
    is all there is, a folder of its own is set where none is named.
    """
    out = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not out:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        out = "/tmp/lorekeep-checkpoints"
        spark.sparkContext.setCheckpointDir(out)
    return out


def settled(df: DataFrame, keep: str = "stage") -> DataFrame:
    """Writes the rows to the shared folder and reads them back: cuts the lineage, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{keep}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.settled_at = path
    return out


def dropped(*rows: DataFrame) -> None:
    """Deletes what ``settled`` wrote for these, once all that was made of them is settled itself."""
    for df in rows:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def remainder(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts Arrow batches into runs of rows whose texts have about ``chars`` characters (one row at least); null texts are empty."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        while at < n:
            texts, total, end = [], 0, at
            while end < n and (end == at or total < chars):
                x = column[end].as_py() or ""
                texts.append(x)
                total += len(x)
                end += 1
            yield batch.slice(at, end - at), texts
            at = end


def project(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns of any name can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


#: Tables that meet in one task of the first level, as a share of all: bounds what a task gathers.
SALTS = 128


def summed_tables(parts: DataFrame, dtype: str = "<i8") -> DataFrame:
    """parts: part, salt, counts (binary). Sums the tables of each part in two levels, so that no task gathers all of them."""
    import numpy as np

    def summed(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype) for x in group["counts"])
        return pa.table(
            [group["part"][:1], group["salt"][:1], pa.array([total.astype(dtype).tobytes()], pa.binary())],
            names=["part", "salt", "counts"],
        )

    schema = f"part {dict(parts.dtypes)['part']}, salt int, counts binary"
    first = parts.select(
        "part",
        (F.abs("salt") % SALTS).cast("int").alias("salt"),
        "counts",
    ).groupBy("part", "salt").applyInArrow(summed, schema)
    return first.withColumn("salt", F.lit(0)).groupBy("part").applyInArrow(summed, schema).select("part", "counts")


#: The column of row numbers that ``numbered`` adds, where the caller has none of that name.
ROW = "__row"


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer name if df has such a column (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, row: str = ROW) -> DataFrame:
    """docs and a number for each row, settled in the shared folder: the numbers are the same in every job,
    however its scan deals the files to tasks.
    """
    return settled(docs.withColumn(row, F.monotonically_increasing_id()), "rows")


def bitmap(slots: DataFrame, bits: int) -> bytes:
    """slots: one column of numbers below 2 ** bits. A bitmap of fixed size in which those are set, merged in two levels."""
    import numpy as np

    name = slots.columns[0]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        some = False
        for b in batches:
            seen[b.column(0).to_numpy()] = True
            some |= b.num_rows > 0
        if some:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() % SALTS], pa.int32()), pa.array([np.packbits(seen).tobytes()], pa.binary())],
                ["salt", "bits"],
            )

    def merged(group: pa.Table) -> pa.Table:
        total = np.zeros((1 << bits) // 8, np.uint8)
        for x in group["bits"]:
            total |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table([group["salt"][:1], pa.array([total.tobytes()], pa.binary())], names=["salt", "bits"])

    first = slots.select(F.col(name).cast("long")).mapInArrow(
        marked,
        "salt int, bits binary",
    ).groupBy("salt").applyInArrow(merged, "salt int, bits binary")
    found = first.withColumn("salt", F.lit(0)).groupBy("salt").applyInArrow(merged, "salt int, bits binary").collect()
    return found[0][1] if found else bytes((1 << bits) // 8)


def narrowed(docs: DataFrame, keep: Callable[[list[str]], list[bool]], chars: int = SLICE_CHARS) -> DataFrame:
    """The rows of docs for which keep(texts) says so, with all their columns: a narrow map, without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, chars=chars):
            yield rows.filter(pa.array(keep(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
