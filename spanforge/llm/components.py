"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """(u, v) with u > v. A large star ties each node's greater neighbours to the least node around, a small star the lesser ones."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumn("part", F.pmod("u", F.lit(8191)))
    tied = both.withColumn("part", F.pmod("u", F.lit(8191))).join(least, ["u", "part"])
    if large:
        out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, least): the least node of each linked node's component; links: (a, b), numbers."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
        edges = cut(_stars(_stars(edges, True), False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("least"))
