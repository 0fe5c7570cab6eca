"""Connected components by alternating large-star and small-star steps.

Each step replaces a node's links by links to its smallest neighbour, with a
join and a grouped minimum; the links shrink to one star per component in
about log(n) rounds.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicledger.llm.common import stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``label`` (the smallest node of its component) for every
    node that has an edge to another node."""
    star = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    star = stored(star, "links")
    seen = None
    while True:
        # large star: all larger neighbours of u move to u's smallest neighbour
        both = star.union(star.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        # small star: u and its smaller neighbours move to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = stored(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        sums = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen:
            return star.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                star.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        seen = tuple(sums)
