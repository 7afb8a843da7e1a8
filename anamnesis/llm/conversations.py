"""Rebuilding ordered conversations from message rows.

The parent of a message is the message of its conversation with the seq before
it.  Parents are resolved by pointer jumping, after a contraction that keeps the
jumps few: 64 consecutive seqs form a block whose bitmap (``bit_or``, partially
aggregated) shows repetitions and gaps, and only block heads carry pointers.  A
head whose parent block doesn't reach up to it is an orphan; a conversation is
whole when every block's root is its first block.  The jumps also carry the
number of visible messages ahead, which is the place of each message on its
root-to-leaf path.

Scale: no window or group spans a conversation; blocks hold at most 64 messages
once repetitions are out, and a conversation of a third of all rows is spread
over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.operators.chains import chain_roots, chain_state, neighbours, resolve
from anamnesis.session import cut

#: Spellings of the four speakers, lower case, without blanks, hyphens and underscores.
SPEAKERS = {
    "user": ["user", "human", "usr", "customer", "client", "person", "用户", "使用者", "人类", "用戶", "usuario", "utilisateur", "benutzer", "nutzer", "ユーザー", "пользователь"],
    "assistant": ["assistant", "ai", "model", "bot", "chatbot", "gpt", "llm", "agent", "助手", "助理", "人工智能", "机器人", "asistente", "assistent", "assistante", "アシスタント", "ассистент"],
    "system": ["system", "sys", "developer", "系统", "系統", "sistema", "système", "систем", "система", "システム"],
    "tool": ["tool", "toolresult", "toolcall", "toolresponse", "tooloutput", "tooluse", "function", "functioncall", "functionresult", "工具", "函数", "herramienta", "outil", "werkzeug", "función", "funktion", "ツール"],
}
#: Fixed value: white space, zero-width space and byte order mark.
INVISIBLE = "\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x85\\u00a0\\u1680\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def speaker(role: Column) -> Column:
    """user, assistant, system or tool; null for anything else."""
    plain = F.lower(F.regexp_replace(role, f"[{INVISIBLE}_:-]+", ""))
    out = F.lit(None).cast("string")
    for name, spellings in SPEAKERS.items():
        out = F.when(plain.isin(spellings), F.lit(name)).otherwise(out)
    return out


def visible(content: Column) -> Column:
    """Whether a text shows anything; null shows nothing."""
    return F.coalesce(content.rlike(f"[^{INVISIBLE}]"), F.lit(False))


def last_delivery(messages: DataFrame) -> DataFrame:
    """One narrow row per message_id, of its highest ingest_no."""
    row = F.struct("ingest_no", F.col("conversation_id").alias("conv"), F.col("seq").cast("bigint").alias("seq"), speaker(F.col("role")).alias("speaker"), visible(F.col("content")).alias("shown"))
    return messages.where("message_id IS NOT NULL").groupBy("message_id").agg(F.max(row).alias("m")).select("message_id", "m.conv", "m.seq", "m.speaker", "m.shown")


def reply_paths(messages: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """node, root, depth, status of rows that name their parent row.

    status is ``ok``, ``orphan`` (its chain ends at a parent that doesn't exist)
    or ``circle`` (its chain never ends; root null, depth -1).  A null parent
    starts a conversation.  Null ids are left out, of repeated ids the smallest
    parent counts.
    """
    rows = cut(messages.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("node")).agg(F.min(parent_col).alias("prev")))
    known = rows.select(F.col("node").alias("prev"), F.lit(True).alias("known"))
    rows = rows.join(known, "prev", "left")
    links = rows.where("known").select("node", "prev")
    lost = rows.where("prev IS NOT NULL AND known IS NULL").select(F.col("node").alias("root"), F.lit(True).alias("lost"))
    state = resolve(chain_state(links, rows.select("node", F.lit(1).alias("one")), ["one"]), ["one"])
    return state.select("node", F.when(F.col("done"), F.col("ptr")).alias("root"), F.when(F.col("done"), F.col("acc_one")).otherwise(F.lit(-1)).alias("depth"), "done").join(lost, "root", "left").select(
        "node", "root", "depth", F.when(~F.col("done"), "circle").when(F.col("lost"), "orphan").otherwise("ok").alias("status")
    )


def rebuild_conversations(messages: DataFrame) -> DataFrame:
    """conversation_id, turn_no, message_id of every visible message of every kept conversation.

    Defined cases: rows without message_id are no messages; of repeated
    deliveries the highest ingest_no counts; null conversation_id is no
    conversation; null, repeated, missing or negative seqs, roles that mean no
    speaker, conversations without a visible user message and user messages
    without an answer break their conversation; null content is invisible; no
    messages, no rows; further columns are ignored.
    """
    rows = cut(last_delivery(messages).where("conv IS NOT NULL").withColumn("block", F.expr("CAST(floor(coalesce(seq, -1) / 64) AS BIGINT)")))
    blocks = rows.groupBy("conv", "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("bit_or(shiftleft(1L, CAST(pmod(seq, 64) AS INT)))").alias("bits"),
        F.min("seq").alias("lo"),
        F.max("seq").alias("hi"),
        F.count_if("shown").alias("shown"),
        F.count_if(F.col("speaker").isNull() | F.col("seq").isNull()).alias("odd"),
        F.count_if((F.col("speaker") == "user") & F.col("shown")).alias("users"),
    )
    blocks = cut(blocks.withColumn("node", F.struct("conv", "block")))
    heads = blocks.where("block > 0").select("node", "lo", F.struct("conv", (F.col("block") - 1).alias("block")).alias("prev"))
    links = cut(heads.join(blocks.select(F.col("node").alias("prev"), "hi"), "prev").where("hi = lo - 1").select("node", "prev"))
    chains = chain_roots(links, blocks.select("node", "shown"), ["shown"])
    blocks = blocks.join(chains, "node").withColumn(
        "whole",
        F.expr("odd = 0 AND block >= 0 AND n = bit_count(bits) AND n = hi - lo + 1 AND root.block = 0 AND (block > 0 OR lo <= 1)"),
    )
    blocks = cut(blocks.select("conv", "block", "whole", "users", F.col("before_shown").alias("ahead")))
    kept = blocks.groupBy("conv").agg(F.bool_and("whole").alias("whole"), F.sum("users").alias("users")).where("whole AND users > 0").select("conv")
    kept_rows = rows.where("shown").join(kept, "conv", "left_semi").select("conv", "block", "seq", "message_id", "speaker")

    inside = Window.partitionBy("conv", "block").orderBy("seq")
    placed = cut(kept_rows.withColumn("at", F.row_number().over(inside)))
    talk = placed.where("speaker IN ('user', 'assistant')").withColumn("reply", F.lead("speaker").over(inside))
    talk = talk.groupBy("conv", "block").agg(
        F.count_if((F.col("speaker") == "user") & (F.col("reply") == "user")).alias("unanswered"),
        F.min_by("speaker", "seq").alias("first"),
        F.max_by("speaker", "seq").alias("last"),
    )
    ends = neighbours(talk.select("conv", F.struct("block", "first", "last", "unanswered").alias("e")), "conv", "e")
    broken = ends.where("e.unanswered > 0 OR (e.last = 'user' AND coalesce(next.first, 'user') = 'user')").select("conv").distinct()
    ahead = blocks.join(broken, "conv", "left_anti").select("conv", "block", "ahead")
    return placed.join(ahead, ["conv", "block"]).select(
        F.col("conv").alias("conversation_id"), (F.col("ahead") + F.col("at")).cast("bigint").alias("turn_no"), "message_id"
    )
