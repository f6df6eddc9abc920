"""Connected components of an edge table, without gathering links anywhere.

Alternating large and small stars: every vertex points its larger neighbours to
the least vertex that it knows, then the same for its smaller ones, until
nothing moves.  A star is an aggregate (least neighbour, combined before the
shuffle) and a join back, which adaptive execution may split; no vertex's
neighbours are collected.  Edges of equal ends, and repeated ones, change
nothing; nulls are left out; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Scratch, materialise


def components(edges: DataFrame) -> DataFrame:
    """id, label from edges (a, b) of integers: label is the least id reachable; ids without edges are absent."""
    with Scratch(edges.sparkSession) as keep:
        e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        seen = None
        while True:
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
            large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            large = keep(large, "star")
            low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
            small = large.join(low, F.col("u") == F.col("k")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).union(low.select("k", "m"))
            e = keep(small.where("u <> v").distinct(), "star")
            now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == seen:
                return materialise(e.select(F.col("u").alias("id"), F.col("v").alias("label")).union(e.select(F.col("v"), F.col("v")).distinct()), "labels")
            seen = now
