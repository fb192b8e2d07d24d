"""Connected components of a link table that never leaves the executors."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.shared import saved


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` (the least node reachable) of every node of ``a, b`` links.

    Alternates two contractions until nothing changes: each node sends its larger
    neighbours to the least one it knows, then its smaller ones. A star stays a star, so
    hubs cost their degree once, and the rounds grow with the logarithm of the longest
    path. A hub's neighbours are never gathered: the least one is an aggregate that is
    joined back. Each round is written to the shared folder, which cuts the lineage.
    """
    edges = saved(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), name
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Every larger neighbour of u now points to the least of u's neighbourhood.
        larger = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(
            F.col("w").alias("u"), F.col("m").alias("v")
        )
        larger = larger.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        larger = saved(larger.where("u != v"), name)
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = saved(smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")
        ).first()
        # A forest of stars: every node has one parent, and a round changes nothing.
        if now == state or now[0] == 0:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    ).distinct()
