"""Pointer doubling on chains: list ranking and roots in logarithmic rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.session import cut, discard


def resolve(state: DataFrame, weights: list[str]) -> DataFrame:
    """Double the pointers of ``state`` until all that can be done are done.

    ``state``: node, ptr, done, and for each weight w the columns w and acc_w.
    Open: acc is the weight strictly between ptr and node.  Done: ptr is the end
    of the chain, acc the weight of everything from that end (inclusive) to node
    (exclusive).  Nodes on a circle, or hanging on one, stay open: a round that
    finishes no node proves that only those are left, since a node at distance
    2^k from its end has an ancestor finished in each earlier round.
    """
    state = cut(state)
    left = state.where("NOT done").count()
    while left:
        at = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("done").alias("done2"), *[F.col(w).alias(f"w2_{w}") for w in weights], *[F.col(f"acc_{w}").alias(f"a2_{w}") for w in weights])
        moved = state.where("NOT done").join(at, "ptr").select(
            "node", F.col("ptr2").alias("ptr"), F.col("done2").alias("done"), *weights,
            *[(F.col(f"acc_{w}") + F.col(f"w2_{w}") + F.col(f"a2_{w}")).alias(f"acc_{w}") for w in weights],
        )
        last, state = state, cut(state.where("done").unionByName(moved))
        discard(last)
        now = state.where("NOT done").count()
        if now == left:
            break
        left = now
    return state


def chain_state(links: DataFrame, nodes: DataFrame, weights: list[str]) -> DataFrame:
    """First state of :func:`resolve` from links (node, prev) and nodes (node and its weights)."""
    return nodes.join(links, "node", "left").select(
        "node", F.coalesce("prev", "node").alias("ptr"), F.col("prev").isNull().alias("done"),
        *[F.col(w).cast("bigint").alias(w) for w in weights], *[F.lit(0).cast("bigint").alias(f"acc_{w}") for w in weights],
    )


def chain_roots(links: DataFrame, nodes: DataFrame, weights: list[str]) -> DataFrame:
    """Root of each node of chains ``node -> prev`` and the weights ahead of it.

    ``links``: node, prev (at most one prev per node); ``nodes``: node and
    weights.  Returns node, root and before_w of each weight; nodes on circles
    are left out.  A chain of n nodes takes log2(n) rounds; nodes without any
    link take part in none.
    """
    member = links.select("node").union(links.select("prev")).distinct()
    alone = nodes.join(member, "node", "left_anti").select("node", F.col("node").alias("root"), *[F.lit(0).cast("bigint").alias(f"before_{w}") for w in weights])
    state = resolve(chain_state(links, nodes.join(member, "node", "left_semi"), weights), weights)
    return alone.unionByName(state.where("done").select("node", F.col("ptr").alias("root"), *[F.col(f"acc_{w}").alias(f"before_{w}") for w in weights]))


def neighbours(df: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item, prev, next) of the items in order within their groups.

    Items are range-partitioned by (group, item) and looked at within partitions;
    only the border items of each partition meet in a window over a group, so a
    group that holds a third of all rows is spread like the rest.
    """
    ranged = cut(df.select(group, item).repartitionByRange(F.col(group), F.col(item)).withColumn("chunk", F.spark_partition_id()))
    inside, chain = Window.partitionBy(group, "chunk").orderBy(item), Window.partitionBy(group).orderBy("chunk")
    edges = ranged.groupBy(group, "chunk").agg(F.min(item).alias("lo"), F.max(item).alias("hi"))
    edges = edges.select(F.col(group).alias("_g"), F.col("chunk").alias("_c"), F.lag("hi").over(chain).alias("before"), F.lead("lo").over(chain).alias("after"))
    return (
        ranged.withColumn("p", F.lag(item).over(inside)).withColumn("n", F.lead(item).over(inside))
        .join(edges, F.col(group).eqNullSafe(F.col("_g")) & (F.col("chunk") == F.col("_c")))
        .select(group, item, F.coalesce("p", "before").alias("prev"), F.coalesce("n", "after").alias("next"))
    )
