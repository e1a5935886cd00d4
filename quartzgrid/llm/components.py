"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (long columns ``a`` and ``b``); the label is the least node.

    Each step sends every node's neighbours to the least of them, with one aggregation and one join; links shrink
    to stars in a number of steps that grows with the logarithm of the longest path. Neighbour lists are never
    gathered: a hot node is pre-aggregated, and its side of the join can be split. Links of a node to itself and
    nulls are left out; repeated links count once.
    """
    links = durable(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # large star: neighbours above a node go to its least neighbour
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = durable(large)
        # small star: a node and its lesser neighbours go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        small = durable(small)
        same = small.count() == links.count() and small.exceptAll(links).limit(1).count() == 0
        links = small
        if same:
            break
    return links.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node").unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
