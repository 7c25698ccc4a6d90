"""Connected components as DataFrame rounds; neither edges nor labels come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b, salt. Per node of an edge: node, label, the smallest node of its component.

    Each round takes the neighbours' smallest label, then the label's own label;
    hence labels travel twice as far each round. A node b with very many
    neighbours has edges of several salts: its label goes out once for each salt,
    and its neighbours meet the one of theirs. Joins by label are merge joins,
    whose large partitions Spark splits.
    """
    there = edges.select("a", "b", "salt")
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("salt"))
    both = common.settled(there.unionAll(back).groupBy("a", "b").agg(F.max("salt").alias("salt")), "edges")
    first = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
    copies = both.groupBy(F.col("b").alias("a")).agg((F.max("salt") + 1).alias("copies"))
    labels = common.settled(first.join(copies, "a").select(F.col("a").alias("node"), "label", "copies"), "labels")
    while True:
        sent = labels.select(F.col("node").alias("b"), "label", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
        near = both.join(sent, ["b", "salt"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node",
            "copies",
            F.col("label").alias("old"),
            F.least("label", "near").alias("label"),
        )
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = common.settled(
            lower.join(far.hint("merge"), "label").select("node", "copies", "old", F.least("label", "far").alias("label")),
            "labels",
        )
        common.dropped(labels)
        labels = new
        if not new.where("old <> label").limit(1).count():
            common.dropped(both)
            return labels.select("node", "label")
