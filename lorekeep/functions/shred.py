"""Sensitive fields: sealed by a subject's key, opened while the key exists, shredded once it is erased.

A field is struct<state, subject, value, algorithm>: state is ``plain``,
``sealed`` (value is base64 of nonce, ciphertext and tag) or ``shredded``. Keys
are a table (subject, key), key null once erased. The subject authenticates the
ciphertext, so one subject's value can't pass for another's.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALGORITHM = "AES-256-GCM"


def plain(subject: Column, value: Column) -> Column:
    return F.struct(
        F.lit("plain").alias("state"),
        subject.alias("subject"),
        value.alias("value"),
        F.lit(None).cast("string").alias("algorithm"),
    )


def created_keys(keys: DataFrame, subjects: DataFrame) -> DataFrame:
    """keys with a new random key for each subject that has no row; existing and erased rows stay."""
    new = subjects.select("subject").where("subject is not null").distinct().join(keys, "subject", "left_anti")

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([secrets.token_bytes(32) for _ in range(b.num_rows)], pa.binary())],
                ["subject", "key"],
            )

    return keys.select("subject", "key").unionByName(new.mapInArrow(drawn, "subject string, key binary"))


def erased(keys: DataFrame, subjects: DataFrame) -> DataFrame:
    """keys with the subjects' keys gone; the rows stay as tombstones, also for subjects that had none."""
    gone = subjects.select("subject").distinct().withColumn("gone", F.lit(True))
    return keys.join(gone, "subject", "full").select("subject", F.when(F.col("gone"), F.lit(None)).otherwise(F.col("key")).alias("key"))


def sealed(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Plain fields are encrypted; sealed and shredded ones pass; a subject without a key, or erased, is an error."""
    joined = rows.withColumn("subject_", F.col(f"{column}.subject")).join(
        keys.select(F.col("subject").alias("subject_"), "key"),
        "subject_",
        "left",
    )
    f = F.col(column)
    key = F.when(F.col("key").isNull(), F.raise_error(F.concat(F.lit("no key for "), f["subject"])).cast("binary")).otherwise(F.col("key"))
    value = F.base64(F.aes_encrypt(f["value"].cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), f["subject"].cast("binary")))
    new = F.when(
        f["state"] == "plain",
        F.struct(F.lit("sealed").alias("state"), f["subject"].alias("subject"), value.alias("value"), F.lit(ALGORITHM).alias("algorithm")),
    ).otherwise(f)
    return joined.withColumn(column, new).drop("subject_", "key")


def opened(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Sealed fields are decrypted; without a key they are shredded. A wrong algorithm or a forged value is an error, not an erasure."""
    joined = rows.withColumn("subject_", F.col(f"{column}.subject")).join(
        keys.select(F.col("subject").alias("subject_"), "key"),
        "subject_",
        "left",
    )
    f = F.col(column)
    text = F.aes_decrypt(F.unbase64(f["value"]), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), f["subject"].cast("binary")).cast("string")
    known = F.when(
        f["algorithm"] != ALGORITHM,
        F.raise_error(F.concat(F.lit("unknown algorithm "), f["algorithm"])).cast("string"),
    ).otherwise(text)
    gone = F.struct(
        F.lit("shredded").alias("state"),
        f["subject"].alias("subject"),
        F.lit(None).cast("string").alias("value"),
        F.lit(None).cast("string").alias("algorithm"),
    )
    back = plain(f["subject"], known)
    return joined.withColumn(
        column,
        F.when(f["state"] != "sealed", f).when(F.col("key").isNull(), gone).otherwise(back),
    ).drop("subject_", "key")


def is_shredded(field: Column) -> Column:
    return field["state"] == "shredded"


def get(field: Column) -> Column:
    """The value, null if it isn't plain."""
    return F.when(field["state"] == "plain", field["value"])
