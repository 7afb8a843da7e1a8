"""Upserts as views: the row of a key that arrived last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the highest ``order``; rows without key are left out.

    The last order of each key is found first (partially aggregated, so a key
    that arrives endlessly is no hot group), and only those rows are kept.
    """
    last = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias(order))
    return df.join(last, [key, order], "left_semi")


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group of keys in an order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
