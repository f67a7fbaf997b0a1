"""Joins in which few keys may have a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of all rows on, so that there are at most 1 / SHARE heavy keys, and from so many rows on.
SHARE, LEAST, SALTS = 1 / 1000, 10_000, 64


def heavy_keys(rows: DataFrame, key: str, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The keys with a large share of the rows, of which there are at most 1 / share. Counted by a sum that is combined before its shuffle."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = rows.count()
    return counts.where(F.col("n") >= max(least, int(total * share))).select(key)


def join_one(many: DataFrame, one: DataFrame, key: str, how: str = "inner", share: float = SHARE, least: int = LEAST, salts: int = SALTS) -> DataFrame:
    """many joined (inner or left) with one, which has a row for each key. Rows of heavy keys are dealt to `salts` tasks each, to each of
    which the key's row of `one` is copied: at most salts / share more rows. A null key matches nothing. Neither side may have a column
    named salt."""
    heavy = F.broadcast(heavy_keys(many, key, share, least).withColumn("heavy", F.lit(True)))
    spread = F.when(F.col("heavy"), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    left = many.join(heavy, key, "left").withColumn("salt", spread).drop("heavy")
    copies = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(heavy, key, "left").withColumn("salt", F.explode(copies)).drop("heavy")
    return left.join(right, [key, "salt"], how).drop("salt")
