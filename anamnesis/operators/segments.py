"""Turns, tasks and episodes of conversations, over all conversations at once.

All of them are running sums of boundary flags in a total order of each
conversation, taken in range chunks: a hot conversation is spread like the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.functions.text import counts_of, let, terms_short
from anamnesis.operators.chains import neighbours
from anamnesis.operators.ordered import ranked, running_sums
from anamnesis.session import cut

HOUR = 3_600_000_000


def is_user(role: Column) -> Column:
    return F.coalesce(F.lower(F.trim(role)).isin("user", "human", "用户"), F.lit(False))


def user_turns(messages: DataFrame) -> DataFrame:
    """message_id, conversation_id, us, turn_no: a turn begins with every user message; what comes before the first is turn 0."""
    m = messages.select("message_id", "conversation_id", "us", "ingest_no", is_user(F.col("role")).cast("bigint").alias("begins"))
    return running_sums(m, "conversation_id", ["us", "ingest_no"], {"turn_no": "begins"}).select("message_id", "conversation_id", "us", "turn_no")


def turns_of_tasks(messages: DataFrame, gap_us: int = 2 * HOUR) -> tuple[DataFrame, DataFrame]:
    """The messages with their turn_no, and the turns (conversation_id, turn_no, first_us, n) with their task_no."""
    own = user_turns(messages)
    turns = own.groupBy("conversation_id", "turn_no").agg(F.min("us").alias("first_us"), F.count(F.lit(1)).alias("n"))
    near = neighbours(turns.select("conversation_id", F.struct("turn_no", "first_us", "n").alias("at")), "conversation_id", "at")
    flagged = near.select("conversation_id", "at.turn_no", "at.first_us", "at.n", F.when(F.col("at.first_us") - F.col("prev.first_us") > gap_us, 1).otherwise(0).alias("split"))
    return own, running_sums(flagged, "conversation_id", ["turn_no"], {"task_no": "split"})


def task_sessions(messages: DataFrame, gap_us: int = 2 * HOUR) -> DataFrame:
    """Tasks: turns whose first messages lie no further apart than the gap."""
    tasks = turns_of_tasks(messages, gap_us)[1]
    return tasks.groupBy("conversation_id", "task_no").agg(F.count(F.lit(1)).alias("turns"), F.sum("n").alias("messages"), F.min("first_us").alias("begin_us"))


def task_texts(messages: DataFrame, gap_us: int = 2 * HOUR) -> DataFrame:
    """conversation_id, task_no, begin_us, owner, goal, steps, result: the first 100 characters of a task's first and last
    message, and of its first five messages 80 each; owner is that of the first message."""
    own, tasks = turns_of_tasks(messages, gap_us)
    rows = own.select("message_id", "conversation_id", "turn_no").join(tasks.select("conversation_id", "turn_no", "task_no"), ["conversation_id", "turn_no"]).join(messages.select("message_id", "us", "ingest_no", "owner", F.coalesce("content", F.lit("")).alias("content")), "message_id")
    placed = ranked(rows.withColumn("lane", F.struct("conversation_id", "task_no")), "lane", ["us", "ingest_no"], "k")
    step = F.when(F.col("k") <= 5, F.struct("k", F.substring("content", 1, 80).alias("s")))
    out = placed.groupBy("conversation_id", "task_no").agg(
        F.min("us").alias("begin_us"), F.max(F.when(F.col("k") == 1, F.coalesce("owner", F.lit("default")))).alias("owner"), F.max(F.when(F.col("k") == 1, F.substring("content", 1, 100))).alias("goal"),
        F.array_sort(F.collect_list(step)).alias("s"), F.max_by(F.substring("content", 1, 100), "k").alias("result"),
    )
    return out.select("conversation_id", "task_no", "begin_us", "owner", "goal", F.transform("s", lambda x: x["s"]).alias("steps"), "result")


def far_apart(a: Column, b: Column) -> Column:
    """Whether the cosine of two maps of term counts is below a quarter, in whole numbers; true if one is empty."""
    dot = F.aggregate(F.map_entries(a), F.lit(0).cast("bigint"), lambda s, e: s + e["value"] * F.coalesce(F.element_at(b, e["key"]), F.lit(0)))
    norm = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("bigint"), lambda s, v: s + v * v)
    return (F.size(a) == 0) | (F.size(b) == 0) | let(dot, lambda d: d * d * 16 < norm(a) * norm(b))


def episodes(messages: DataFrame, gap_us: int = HOUR, least_chars: int = 20) -> DataFrame:
    """message_id, episode_no: a new episode begins at a system message, after a gap, or where the topic changes.

    Without terms on one side the cosine is 0, which is a change of topic.  The
    token cap of an episode is applied by :func:`capped_episodes`.
    """
    m = messages.select("conversation_id", F.struct("us", "ingest_no", "message_id", "role", "content").alias("at"))
    near = neighbours(m, "conversation_id", "at")
    # Texts travel, their terms are counted where two of them have met.
    terms = lambda c: counts_of(terms_short(F.coalesce(c, F.lit(""))))
    far = let(F.struct(terms(F.col("at.content")).alias("a"), terms(F.col("prev.content")).alias("b")), lambda x: far_apart(x["a"], x["b"]))
    topic = F.when((F.length("at.content") > least_chars) & (F.length("prev.content") > least_chars), far)
    cut_ = F.col("prev").isNotNull() & (F.coalesce(F.lower("at.role") == "system", F.lit(False)) | (F.col("at.us") - F.col("prev.us") > gap_us) | F.coalesce(topic, F.lit(False)))
    # Written, as a range shuffle looks at its rows twice and comparing texts is the work here.
    flagged = cut(near.select("conversation_id", "at.us", "at.ingest_no", "at.message_id", F.when(cut_, 1).otherwise(0).alias("begins")))
    return running_sums(flagged, "conversation_id", ["us", "ingest_no"], {"episode_no": "begins"}).select("conversation_id", "message_id", "us", "ingest_no", "episode_no")


def capped_episodes(rows: DataFrame, cap: int, first_counts: bool = True) -> DataFrame:
    """Split episodes whose tokens pass a cap; ``rows``: conversation_id, episode_no, us, ingest_no, message_id, tokens.

    An episode is folded in order by a counter that starts again at every cut,
    as the message at which it is cut doesn't count.  Only episodes with more
    tokens than the cap are folded, as pairs of place and tokens, and the fold
    gives the places of the cuts.  Without ``first_counts`` the message that begins
    an episode doesn't count either.
    """
    key = ["conversation_id", "episode_no"]
    place = F.struct("us", "ingest_no")
    large = rows.groupBy(*key).agg(F.sum("tokens").alias("t")).where(F.col("t") > cap).select(*key)
    items = rows.join(large, key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), F.col("tokens").cast("bigint").alias("tokens")))).alias("items"))
    begin = F.lit(0) if first_counts else -F.element_at("items", 1)["tokens"]
    start = F.struct(begin.cast("bigint").alias("sum"), F.array().cast("array<struct<us:bigint,ingest_no:bigint>>").alias("cuts"))
    step = lambda a, x: F.when(a["sum"] + x["tokens"] > cap, F.struct(F.lit(0).cast("bigint").alias("sum"), F.array_append(a["cuts"], F.struct(x["at"]["us"].cast("bigint").alias("us"), x["at"]["ingest_no"].cast("bigint").alias("ingest_no"))).alias("cuts"))).otherwise(F.struct((a["sum"] + x["tokens"]).alias("sum"), a["cuts"].alias("cuts")))
    cuts = items.select(*key, F.aggregate("items", start, step)["cuts"].alias("cuts"))
    own = F.struct(F.col("us").cast("bigint").alias("us"), F.col("ingest_no").cast("bigint").alias("ingest_no"))
    part = F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c <= own)))
    return rows.join(cuts, key, "left").select(*key, "message_id", part.alias("part"))


def merged_episodes(parts: DataFrame, least: int) -> DataFrame:
    """message_id, conversation_id, merged_no of parts (conversation_id, episode_no, part, message_id, tokens): one of
    fewer tokens than the least belongs to what is before it; the first of a conversation has nothing before it."""
    sizes = parts.groupBy("conversation_id", "episode_no", "part").agg(F.sum("tokens").alias("size"))
    begins = ((F.col("size") >= least) & ~((F.col("episode_no") == 0) & (F.col("part") == 0))).cast("bigint")
    numbers = running_sums(sizes.withColumn("begins", begins), "conversation_id", ["episode_no", "part"], {"merged_no": "begins"})
    return parts.join(numbers.select("conversation_id", "episode_no", "part", "merged_no"), ["conversation_id", "episode_no", "part"]).select("message_id", "conversation_id", "merged_no")
