"""Logs derived from the sample tables. Every derivation is narrow but for the version's window, which is partitioned by stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.schema import stream_id, tag


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(value: str) -> F.Column:
    return F.round(F.col(value) * 100).cast("long")


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log with a stream for each user: sequence, stream_id, version, event_type, amount (cents), k, user_id, ts, tags."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") + 1).alias("sequence"),
        stream_id("user", F.col("user_id")).alias("stream_id"),
        F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("version"),
        "event_type",
        cents("value").alias("amount"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "user_id",
        "ts",
    ).withColumn("tags", F.array(tag("user", F.col("user_id")), tag("k", F.col("k"))))


def flat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_log without versions: no shuffle, for reads by position, type and tag."""
    e = table(spark, sf_dir, "events")
    out = e.select(
        (F.col("event_id") + 1).alias("sequence"),
        stream_id("user", F.col("user_id")).alias("stream_id"),
        "event_type",
        cents("value").alias("amount"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "user_id",
        "ts",
    )
    return out.withColumn("tags", F.array(tag("user", F.col("user_id")), tag("k", F.col("k"))))


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a log: turn + 1 is the version, the role the event's type."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        stream_id("conv", F.col("conv_id")).alias("stream_id"),
        (F.col("turn") + 1).alias("version"),
        F.col("role").alias("event_type"),
        F.char_length("text").cast("long").alias("amount"),
        "conv_id",
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and their lines as a log with a stream for each order: Placed first, then a LineAdded for each line."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.lit("Placed").alias("event_type"),
        F.lit(0).alias("rank"),
        F.lit(0).alias("line"),
        F.lit(0).cast("long").alias("part"),
        F.lit(0).cast("long").alias("supplier"),
        F.lit(None).cast("timestamp_ntz").alias("shipped"),
        F.lit(0.0).alias("quantity"),
        F.col("o_totalprice").alias("price"),
        F.array(tag("customer", F.col("o_custkey"))).alias("tags"),
    )
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.lit("LineAdded").alias("event_type"),
        F.lit(1).alias("rank"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_shipdate").alias("shipped"),
        F.col("l_quantity").cast("double").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.array(tag("part", F.col("l_partkey")), tag("supplier", F.col("l_suppkey"))).alias("tags"),
    )
    order = W.partitionBy("o_orderkey").orderBy("rank", "line", "part", "supplier", "shipped", "quantity", "price")
    return o.unionByName(li).select(
        stream_id("order", F.col("o_orderkey")).alias("stream_id"),
        F.row_number().over(order).cast("long").alias("version"),
        "event_type",
        cents("price").alias("amount"),
        "tags",
    )
