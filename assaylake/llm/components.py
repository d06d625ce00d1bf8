"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.shared import cut


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _is_star_forest(edges: DataFrame) -> bool:
    """True if each node hangs on one node, and no node hangs on a node that hangs itself. One job: of each node, how often it hangs and whether others hang on it."""
    ends = edges.select(F.col("u").alias("w"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("v").alias("w"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("w").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or hangs = 1 and holds = 1").limit(1).count() == 0


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """One row (node, component) for each node of a link; component is the smallest node reachable.

    Links are undirected; repeated links, self-links and links with a null end are allowed and the last two
    ignored. An empty table gives an empty result. Each round is two groupings and two joins on evenly dealt
    keys; a node with very many links is pre-aggregated before the shuffle and its join is split by AQE. The
    lineage is cut by a checkpoint in each round, so lost executors cost one round at most.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    for _ in range(max_rounds):
        if _is_star_forest(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _smallest_neighbour(both).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        low = _smallest_neighbour(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
