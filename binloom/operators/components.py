"""Connected components by alternating large and small stars.

Each round connects every node's larger neighbours to its least one, then its smaller
ones; what is left in the end is a star around the least node of each component. A node's
neighbours are only ever reduced by min() and joined, never gathered, so a hub may have
any number of them. Rounds are written to the shared folder: the lineage stays short, and
lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.session import discard, written


def components(edges: DataFrame, owner: str = "query") -> DataFrame:
    """(node, component) for each node of edges (a, b): the least node that can be reached.

    Ids may have any type that can be ordered. Loops and repeated edges do no harm; rows
    with a null end are left out.
    """
    stars = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, before = written(stars, owner), None
    while True:
        both = stars.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(stars.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(least, F.col("x") == F.col("k")).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k")).select("u", "v", "m")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        last, stars = stars, written(small.distinct(), owner)
        discard(last)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
