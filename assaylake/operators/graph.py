"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.sources.scratch import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of each node of a link; component is the smallest node that links reach.

    In each round every node points to its smallest neighbour, if that is smaller; pointers are doubled until they reach the roots of their trees; links then join
    roots, and those inside one tree go. A tree has two nodes at least, so a round halves the nodes that are left, and a doubling halves the paths. Each step is cut by a
    checkpoint. Links with a null end are ignored; a node with very many links is pre-aggregated before the shuffle.
    """
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    ends = cut(ends)
    label = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    left = ends.where("a < b")
    while left.limit(1).count():
        root = cut(left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")))
        while True:
            above = root.select(F.col("node").alias("root"), F.col("root").alias("next"))
            further = cut(root.join(above, "root").select("node", "root", "next"))
            settled = further.where("root <> next").limit(1).count() == 0
            root = further.select("node", F.col("next").alias("root"))
            if settled:
                break
        label = cut(label.join(root.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        for end in ("a", "b"):
            left = left.join(root.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("root", end)
        left = cut(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return label
