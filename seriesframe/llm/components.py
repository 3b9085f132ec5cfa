"""Connected components of an undirected graph by contraction.

Each round, every node joins its neighbour with the least label if that is
less than its own; labels are hashes of the ids, so chains shrink by a factor
and stars at once. The number of rounds grows with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.common import shared


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``comp`` (one of its ids) for each end of ``edges`` (a, b); self loops are allowed."""
    label = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("v"))
    links = shared(edges.select("a", "b").where("a <> b").distinct(), "links")
    out = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("comp", F.col("id"))
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        best = both.groupBy("a").agg(F.min(label(F.col("b"))).alias("m")).select("a", F.col("m.v").alias("b"), (F.col("m") < label(F.col("a"))).alias("less"))
        parent = shared(best.select(F.col("a").alias("node"), F.when(F.col("less"), F.col("b")).otherwise(F.col("a")).alias("parent")), "parents")
        out = shared(out.join(parent, F.col("comp") == F.col("node"), "left").select("id", F.coalesce("parent", "comp").alias("comp")), "components")
        near = links.join(parent, F.col("a") == F.col("node")).select(F.col("parent").alias("a"), "b")
        far = near.join(parent, F.col("b") == F.col("node")).select("a", F.col("parent").alias("b")).where("a <> b")
        links = shared(far.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return out
