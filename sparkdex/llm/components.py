"""Connected components by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, free_shuffles, stored


def stars(edges: DataFrame) -> bool:
    """Whether every node has one edge at most, to a node without any: the edges then name each node's root."""
    return not (
        edges.groupBy("u").count().where("count > 1").select("u").unionByName(edges.select("u").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")).limit(1).count()
    )


def components(links: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, str]:
    """(node, root): every linked node that isn't the smallest of its component, and that smallest; and its path.

    Links with a null end are left out. Large and small stars alternate until only stars are left: O(log^2 n) rounds.
    A node's minimum is aggregated before the shuffle and joined back, so that no node's neighbours meet in a task.
    """
    spark = links.sparkSession
    whole = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    own = whole.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges, path = stored(own, "edges")
    rounds = 0
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = large.unionByName(both.where("v < u").join(least, "u").select("u", F.col("m").alias("v"))).distinct()
        large, large_path = stored(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        following, next_path = stored(small.distinct(), "edges")
        drop(spark, path, large_path)
        edges, path, rounds = following, next_path, rounds + 1
        if rounds % 4 == 0:
            free_shuffles(spark)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")), path
