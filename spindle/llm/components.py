"""Connected components of a graph given as a table of edges, by hooking and pointer jumping.

Every step is joins on tables in the shared folder and aggregates that combine before they shuffle; Spark can split
the partitions of a node that many others point at. Nothing about nodes or edges comes to the driver but whether a
step changed a label. The number of steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v), in any direction, repeated or not. Returns (node, label), label being a node of its component
    that all others there have too; the smallest one. Nodes without edges are not in it."""
    edges = edges.filter("u <> v")
    both = written(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        found = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("best"))
        none = F.lit(None).cast(labels.schema["label"].dataType)
        told = found.select(F.explode(F.array(F.struct(F.col("node").alias("node"), F.col("best").alias("best"), F.col("label").alias("old")), F.struct(F.col("label").alias("node"), F.col("best").alias("best"), none.alias("old")))).alias("x"))
        hooked = written(told.groupBy(F.col("x.node").alias("node")).agg(F.min("x.best").alias("label"), F.max("x.old").alias("old")), "hooked")
        above = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        before, labels = labels, written(hooked.join(above, "label").select("node", F.col("root").alias("label"), (F.col("root") != F.col("old")).alias("moved")), "labels")
        dropped(before, hooked)
        if not labels.filter("moved").limit(1).count():
            dropped(both)
            return labels.drop("moved")
