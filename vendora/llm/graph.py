"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.llm.registry import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); the component is its
    smallest node.  Labels go to the smallest among the neighbours and then to
    their label's label until none changes, so chains shorten by half each round.
    Each round is written to the checkpoint folder."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
    both = cut(both)
    label = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("c")))
    while True:
        near = (both.join(label.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v")
                .groupBy("u").agg(F.min("cv").alias("m")))
        step = label.join(near, "u").select("u", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        step = cut(step)
        up = step.select(F.col("u").alias("top"), F.col("c").alias("top_c"))
        new = cut(step.join(up, F.col("c") == F.col("top"), "left").select("u", "old", F.coalesce("top_c", "c").alias("c")))
        moved = new.filter("c <> old").limit(1).count()
        label = new.select("u", "c")
        if not moved:
            return label.select(F.col("u").alias("node"), F.col("c").alias("component"))
