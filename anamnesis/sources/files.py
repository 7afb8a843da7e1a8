"""Readers and writers of exchange formats: JSON, CSV, session lines, raw text; imports with known hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns every imported message has, with their types.
MESSAGE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])
CONVERSATION = T.StructType([T.StructField("conversationId", T.StringType()), T.StructField("messages", T.ArrayType(MESSAGE))])
LINE = T.StructType([T.StructField("type", T.StringType()), T.StructField("message", MESSAGE), T.StructField("_corrupt_record", T.StringType())])


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """The columns of a schema, cast; missing ones are null or take a default."""
    have, defaults = set(df.columns), defaults or {}
    pick = lambda f: F.col(f"`{f.name}`") if f.name in have else F.lit(defaults.get(f.name))
    return df.select(*[pick(f).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON files: a conversation, or a list of them."""
    df = spark.read.schema(CONVERSATION).option("multiLine", True).json(path)
    return df.select("conversationId", F.posexplode("messages").alias("position", "m")).select("conversationId", "position", "m.*")


def read_conversation_maps(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON lines that map ids of conversations to their messages; broken lines give nothing."""
    held = F.from_json("value", T.MapType(T.StringType(), T.ArrayType(MESSAGE)))
    pairs = spark.read.text(path).select(F.explode(held).alias("conversationId", "messages"))
    return pairs.select("conversationId", F.posexplode("messages").alias("position", "m")).select("conversationId", "position", "m.*")


def read_table(spark: SparkSession, path: str, mapping: dict[str, str], defaults: dict | None = None) -> DataFrame:
    """CSV rows with renamed columns and defaults for missing values."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for old, new in mapping.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    df = conform(df, MESSAGE, defaults)
    return df.select(*[F.coalesce(F.col(c), F.lit(v)).alias(c) if (v := (defaults or {}).get(c)) is not None else F.col(c) for c in df.columns])


def read_session_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of session files: kind (message, other or broken) and the message, if one."""
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", LINE, {"mode": "PERMISSIVE"}).alias("j"))
    broken = F.col("j._corrupt_record").isNotNull() | F.col("j").isNull()
    kind = F.when(broken, "broken").when((F.col("j.type") == "message") & F.col("j.message").isNotNull(), "message").otherwise("other")
    return parsed.select(kind.alias("kind"), "j.message.*", "value")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as text with their size."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.length("value").alias("n_chars"), "value")


def write_session_lines(messages: DataFrame, path: str) -> None:
    """One JSON line a message, in the form :func:`read_session_lines` reads."""
    m = F.struct(*[F.col(c).alias(n) for n, c in (("id", "message_id"), ("seq", "seq"), ("role", "role"), ("content", "content"))])
    messages.select(F.to_json(F.struct(F.lit("message").alias("type"), m.alias("message"))).alias("value")).write.mode("overwrite").text(path)


def write_conversations(messages: DataFrame, path: str, shape: str = "single") -> None:
    """Conversations as JSON, at most 1,000 messages an object, so that a hot conversation is many objects.

    Shapes: single (an object a line), list (a list of objects a line) and map (an object a line, from id to messages).
    """
    m = F.struct(F.col("message_id").alias("id"), "seq", "role", "content")
    g = messages.groupBy(F.col("conversation_id").alias("conversationId"), F.expr("ingest_no DIV 1000").alias("part")).agg(F.collect_list(m).alias("messages"))
    one = F.struct("conversationId", "messages")
    text = {"single": F.to_json(one), "list": F.to_json(F.array(one)), "map": F.to_json(F.map_from_arrays(F.array("conversationId"), F.array("messages")))}[shape]
    g.select(text.alias("value")).write.mode("overwrite").text(path)


def read_conversation_lines(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON lines, each a conversation or a list of them."""
    line = F.trim("value")
    many = F.when(line.startswith("["), F.from_json("value", T.ArrayType(CONVERSATION))).otherwise(F.array(F.from_json("value", CONVERSATION)))
    one = spark.read.text(path).select(F.explode(many).alias("c"))
    return one.select("c.conversationId", F.posexplode("c.messages").alias("position", "m")).select("conversationId", "position", "m.*")


def import_new(messages: DataFrame, seen: DataFrame, text: str = "content") -> DataFrame:
    """Rows whose content hash isn't among ``seen`` (content_hash), once each; the smallest row order wins."""
    hashed = messages.where(F.col(text).isNotNull()).withColumn("content_hash", F.substring(F.sha2(text, 256), 1, 16))
    return hashed.join(seen, "content_hash", "left_anti").dropDuplicates(["content_hash"])
