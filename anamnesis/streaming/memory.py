"""Structured Streaming: ingest, gap sessions, turn counters and resumable imports.

Each function takes and gives streaming frames, or runs one available-now pass
into a table of the checkpoint folder; state is bounded by watermarks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from anamnesis.session import ensure_checkpoint_dir, ship_package


def folder(spark: SparkSession, what: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a parquet table, and give the table."""
    spark = stream.sparkSession
    out = folder(spark, "stream")
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", folder(spark, "progress")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table (a file or a folder) as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 100)
    if _is_folder(spark, path):
        return reader.option("pathGlobFilter", "*.parquet").parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def gap_sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Sessions by gaps; a session is given once the watermark has passed its end."""
    return events.withWatermark(time, late).groupBy(F.col(key), F.session_window(F.col(time), gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("begin_at"), F.max(time).alias("end_at"))


def windowed(events: DataFrame, key: str, time: str, size: str, slide: str, late: str) -> DataFrame:
    """Counts by sliding windows, late rows left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, size, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def turn_counters(messages: DataFrame, every: int = 12) -> DataFrame:
    """conversation_id, turns, due: a running count of user messages and whether the count calls for attention."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        turns = before + sum(int(f["is_user"].sum()) for f in frames)
        state.update((turns,))
        yield pd.DataFrame({"conversation_id": [key[0]], "turns": [turns], "due": [turns // every > before // every]})

    ship_package(messages.sparkSession)
    return messages.groupBy("conversation_id").applyInPandasWithState(count, "conversation_id string, turns long, due boolean", "turns long", "update", GroupStateTimeout.NoTimeout)


def ingest(messages: DataFrame, sink) -> None:
    """Micro-batches through a function of (frame, batch number): score, store, look for contradictions."""
    q = messages.writeStream.foreachBatch(sink).option("checkpointLocation", folder(messages.sparkSession, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()


def first_seen(rows: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once; keys are forgotten when the watermark passes them."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_to_end(spark: SparkSession, build, source: DataFrame, time: str) -> DataFrame:
    """Run a windowed stream to its end and give its table: the windows that are still open are closed by an end mark.

    ``build`` makes the stream of the source (a watermark and windows in append
    mode).  A first pass takes all that is there; then a row at the end of time
    (all else null) comes in through a second source and pushes the watermark past
    every window.  Rows that are later than the watermark are left out, as in a
    stream that runs on.
    """
    marks, out, progress = folder(spark, "marks"), folder(spark, "stream"), folder(spark, "progress")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(marks)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    stream = build(source.unionByName(spark.readStream.schema(source.schema).parquet(marks)))

    def once() -> None:
        stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(out).awaitTermination()

    once()
    end = spark.range(1).select(*[(F.lit("2200-01-01 00:00:00") if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in source.schema.fields])
    end.coalesce(1).write.mode("append").parquet(marks)
    once()
    return spark.read.schema(stream.schema).parquet(out)
