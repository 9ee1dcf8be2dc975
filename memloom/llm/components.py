"""Connected components of an edge table, by alternating large and small stars.

Every round is written to the shared folder, in place of the one before; a few numbers a round reach the driver. A hub is
summed by partial aggregation, and its edges are joined by a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.textio import delete_stored, join_sums, stored


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node but the roots, stored. ``edges``: a, b (bigint)."""
    directed = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = stored(directed, "edges")
    while True:
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = stored(join_sums(both.where("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        delete_stored(current)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        current = stored(join_sums(large, least, ["a"]).select(ends).select("e.*").where("a <> b").distinct(), "edges")
        delete_stored(large)
        # Done when each node has one edge and that leads to a root.
        one = current.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not one and not current.join(current.select(F.col("a").alias("inner")), F.col("b") == F.col("inner"), "left_semi").limit(1).count():
            out = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out.stored_at = current.stored_at
            return out
