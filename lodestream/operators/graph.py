"""Connected components of an edge relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.sources.scratch import materialise


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable, for every id in the undirected edges (a, b): (id, component).

    Alternates large-star and small-star contraction, O(log^2 n) rounds, until
    every component is a star; each round is a written table, so lost executors
    cost one round at most.
    """

    def done(arcs: DataFrame) -> bool:
        """Whether the arcs are stars: no id has two centres or is centre and leaf."""
        ends = arcs.select(F.col("u").alias("id"), F.lit(0).alias("in"), F.lit(1).alias("out")).unionByName(arcs.select(F.col("v").alias("id"), F.lit(1).alias("in"), F.lit(0).alias("out")))
        return ends.groupBy("id").agg(F.sum("in").alias("n_in"), F.max("out").alias("out")).filter("n_in + out > 1 and n_in > 0").isEmpty()

    arcs = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "arcs")
    while not done(arcs):
        both = arcs.select("u", "v").unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("u"), "v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        down = small.select(F.col("m").alias("u"), "v").unionByName(small.filter("m <> u").select(F.col("m").alias("u"), F.col("u").alias("v")))
        arcs = materialise(down.distinct(), "arcs")
    leaves = arcs.select(F.col("v").alias("id"), F.col("u").alias("component"))
    return leaves.unionByName(arcs.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
