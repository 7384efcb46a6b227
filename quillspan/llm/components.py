"""Connected components of an edge table, by least label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.scratch import release, save


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of long ids to (node, root), where root is the least id that the node reaches.

    Each round takes the least label among a node and its neighbours, then the label of that label; it ends when
    no label changes, so the result is exact for any shape. Groups are pre-aggregated before they are shuffled, and a
    node with very many neighbours is a skewed join key that adaptive execution splits. Empty edges give no rows;
    an edge from a node to itself gives that node its own root. Labels are written to the shared folder each round,
    and those of the round before are deleted; ``release`` deletes the result.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = save(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "cc-edges")
    labels = save(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root"), F.lit(0).cast("long").alias("was")), "cc-labels")
    while True:
        old = labels.select("node", "root")
        near = both.join(old.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("m"))
        one = old.join(near, "node").select("node", F.least("root", "m").alias("r"), F.col("root").alias("was"))
        hop = old.select(F.col("node").alias("r"), F.col("root").alias("rr"))
        new = save(one.join(hop, "r", "left").select("node", F.least("r", F.coalesce("rr", "r")).alias("root"), "was"), "cc-labels")
        release(labels)
        labels = new
        if new.where("root <> was").isEmpty():
            release(both)
            return new
