"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .skew import join_one


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) of every node that has a link to another; links: a, b (whole numbers).

    Large and small stars in turn: each node's larger neighbours are linked to the smallest of its neighbours, then its smaller ones, until
    each component is a star; the number of rounds grows with the logarithm of the longest chain. Links are written each round, and only
    their number and a checksum come to the driver; a node with very many links is split among tasks. Nulls link nothing; repeated links and
    links of a node with itself do no harm; no links give no rows. An error is raised if the links change for `rounds` rounds."""
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    links = written(links.distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = written(join_one(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_one(large, low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links = written(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == seen:
            stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"components have not settled in {rounds} rounds")
