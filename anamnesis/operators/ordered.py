"""Ranks and running sums within groups, spread over range chunks so that no group is one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.session import cut


def chunked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows range-partitioned by group and order, with ``chunk`` (the partition); written out, so that borders stay."""
    return cut(df.repartitionByRange(F.col(group), *[F.col(c) for c in order]).withColumn("chunk", F.spark_partition_id()))


def running_sums(df: DataFrame, group: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """Add running sums (inclusive): ``values`` maps new columns to summed columns.

    Sums run within a chunk; the totals of the chunks before come from one row
    per group and chunk.  Ties of the order get their sums in any order, so the
    order should be total.  A null group is a group like any other.
    """
    rows = chunked(df, group, order)
    inside = Window.partitionBy(group, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(group, "chunk").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in values.items()])
    totals = totals.select(F.col(group).alias("_g"), F.col("chunk").alias("_c"), *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in values])
    summed = rows.select("*", *[F.sum(v).over(inside).alias(f"_i_{k}") for k, v in values.items()])
    summed = summed.join(totals, F.col(group).eqNullSafe(F.col("_g")) & (F.col("chunk") == F.col("_c"))).drop("_g", "_c")
    for k in values:
        summed = summed.withColumn(k, F.coalesce(F.col(f"_i_{k}"), F.lit(0)) + F.col(f"_b_{k}"))
    return summed.drop("chunk", *[f"_{x}_{k}" for k in values for x in "bi"])


def ranked(df: DataFrame, group: str, order: list[str], name: str = "rank") -> DataFrame:
    """Add the place of each row within its group, from 1."""
    return running_sums(df.withColumn("_one", F.lit(1).cast("bigint")), group, order, {name: "_one"}).drop("_one")
