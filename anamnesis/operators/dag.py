"""The summary graph: expansion, description, leaf texts and condensing by levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.functions.text import short
from anamnesis.operators.ordered import ranked
from anamnesis.session import cut


def expand(roots: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """root, node, level: what each root reaches over edges (above, below) within max_depth steps, each node once at its nearest level."""
    known = fresh = cut(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("level")).distinct())
    for level in range(1, max_depth + 1):
        nxt = fresh.join(edges, F.col("node") == F.col("above")).select("root", F.col("below").alias("node")).distinct()
        fresh = cut(nxt.join(known, ["root", "node"], "left_anti").withColumn("level", F.lit(level)))
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
    return known


def condense(summaries: DataFrame, fan_out: int = 4) -> DataFrame:
    """One level of condensing: (conversation_id, depth, summary_id, made, descendants, content) to their parents.

    Neighbouring summaries of a conversation and depth are joined in groups of
    ``fan_out``; incomplete groups wait.  Texts are cut by depth.
    """
    r = ranked(summaries.withColumn("lane", F.struct("conversation_id", "depth")), "lane", ["made", "summary_id"])
    g = r.withColumn("g", F.expr(f"(rank - 1) DIV {fan_out}")).groupBy("conversation_id", "depth", "g").agg(
        F.count(F.lit(1)).alias("n"), F.sum("descendants").alias("descendants"), F.min("made").alias("made"),
        F.array_sort(F.collect_list(F.struct("rank", "summary_id", "content"))).alias("parts"),
    ).where(F.col("n") == fan_out)
    text = F.array_join(F.transform("parts", lambda p: F.coalesce(p["content"], F.lit(""))), "\n")
    cap = F.greatest(F.lit(500), 1000 - 200 * (F.col("depth") + 1))
    ids = F.array_join(F.transform("parts", lambda p: p["summary_id"]), ",")
    return g.select(
        "conversation_id", (F.col("depth") + 1).alias("depth"), F.concat(F.lit("sum_"), F.substring(F.sha2(ids, 256), 1, 16)).alias("summary_id"), "made", "descendants",
        F.substring(text, F.lit(1), cap).alias("content"), F.transform("parts", lambda p: p["summary_id"]).alias("sources"),
    )


def cascade(leaves: DataFrame, fan_out: int = 4, max_levels: int = 40) -> DataFrame:
    """Condense level by level until no level has a full group; all levels, the first included."""
    level = cut(leaves.withColumn("sources", F.array().cast("array<string>")))
    out = level
    for _ in range(max_levels):
        level = cut(condense(level.drop("sources"), fan_out))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def leaf_text(messages: DataFrame, group: str, order: str) -> DataFrame:
    """Extractive text of each group: a head with counts, and the first five messages at 100 characters.

    Only the five first rows of a group are carried, picked by a bounded aggregate.
    """
    first = ranked(messages, group, [order]).where("rank <= 5").groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.coalesce("role", F.lit("?")), F.lit(": "), short(F.coalesce("content", F.lit("")), 100)).alias("line")))).alias("l"))
    head = messages.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("u"))
    text = F.concat(F.lit("["), F.col("n").cast("string"), F.lit(" messages, "), F.col("u").cast("string"), F.lit(" user]\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return head.join(first, group).select(group, text.alias("text"))
