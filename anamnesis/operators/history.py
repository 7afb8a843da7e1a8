"""History of changing attributes: presence bitmaps over the snapshots of each entity.

Every distinct time of an entity is one snapshot with an ordinal.  For each
state of the entity (a hash of its attribute values) the snapshots that show it
are set bits, kept as 64-bit words; a run of consecutive bits is a period in
which the state was valid, and a cleared bit between two runs is a gap or
another state.  A run begins where a bit is set and the bit before it (the top
bit of the word before, or of the chunk before) is not.

Scale: snapshots are range-partitioned by (entity, time) and an entity that
spans several partitions is handled in chunks, one per partition, so no entity
is gathered into one task.  Bitmaps are built with ``bit_or`` (partial
aggregation before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.operators.chains import chain_roots
from anamnesis.session import cut, micros


def state_hash(columns: list[Column]) -> Column:
    """Exact identity of a tuple of values: null differs from every text, lengths keep borders."""
    parts = [F.when(c.isNull(), F.lit("~")).otherwise(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def number_snapshots(df: DataFrame, entity: str, time: str) -> DataFrame:
    """Add ``chunk`` (the range partition) and ``ordinal`` (0, 1, ... within entity and chunk, by time).

    The frame must hold one row per entity and time.  The result is checkpointed,
    so that chunk borders can't move when a task is run again.
    """
    ranged = df.repartitionByRange(F.col(entity), F.col(time)).withColumn("chunk", F.spark_partition_id())
    ranged = cut(ranged)
    inside = Window.partitionBy(entity, "chunk").orderBy(time)
    return ranged.withColumn("ordinal", F.row_number().over(inside) - 1)


def run_starts(snapshots: DataFrame, entity: str, state: str) -> DataFrame:
    """(entity, chunk, ordinal) of every snapshot that begins a run of one state.

    ``snapshots`` has entity, chunk, ordinal and state, as made by
    :func:`number_snapshots`.
    """
    bits = (
        snapshots.groupBy(entity, "chunk", state, F.expr("CAST(ordinal DIV 64 AS INT)").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(ordinal % 64 AS INT)))").alias("bits"))
    )
    by_state = Window.partitionBy(entity, "chunk", state).orderBy("word")
    prev_word, prev_bits = F.lag("word").over(by_state), F.lag("bits").over(by_state)
    carry = F.when((F.col("word") == prev_word + 1) & (F.shiftrightunsigned(prev_bits, 63) == 1), F.lit(1)).otherwise(F.lit(0))
    bits = bits.withColumn("carry", carry.cast("bigint"))
    # The first snapshot of a chunk continues a run if the last of the chunk before shows the same state.
    edges = snapshots.groupBy(entity, "chunk").agg(F.min_by(state, "ordinal").alias("first_state"), F.max_by(state, "ordinal").alias("last_state"))
    chain = Window.partitionBy(entity).orderBy("chunk")
    edges = edges.withColumn("before", F.lag("last_state").over(chain)).where(F.col("before") == F.col("first_state"))
    bits = bits.join(
        edges.select(F.col(entity), F.col("chunk"), F.col("before").alias(state), F.lit(0).alias("word"), F.lit(1).cast("bigint").alias("edge")),
        [entity, "chunk", state, "word"],
        "left",
    )
    starts = F.expr("bits & ~(shiftleft(bits, 1) | carry | coalesce(edge, 0L))")
    return (
        bits.select(entity, "chunk", "word", starts.alias("starts"))
        .where("starts <> 0")
        .select(entity, "chunk", F.explode(F.expr("filter(transform(sequence(0, 63), i -> IF(shiftrightunsigned(starts, i) & 1L = 1L, word * 64 + i, -1)), o -> o >= 0)")).alias("ordinal"))
    )


def note_history(notes: DataFrame) -> DataFrame:
    """Every version of every line of notes with its period of validity.

    Returns root_note_id, version_no, note_id, valid_from_us, valid_to_us.

    Defined cases: rows without note_id or without any time say nothing and are
    left out; repeated rows and rows of one time count once; null attribute
    values equal each other; an empty table gives no rows; further columns are
    ignored.  Of several valid successors the one that begins first counts, of
    several predecessors the one that begins first keeps the line; ties go to
    the smaller id.
    """
    stable = [F.col("category"), F.col("content"), (F.col("confidence") + F.lit(0.0)).alias("confidence"), F.col("owner")]
    rows = notes.where("note_id IS NOT NULL").select(
        "note_id",
        micros(notes, "created_at").alias("created"),
        micros(notes, "updated_at").alias("updated"),
        F.col("superseded_by").alias("next_id"),
        state_hash(stable).alias("state"),
    )
    rows = rows.withColumn("t", F.coalesce("updated", "created")).where("t IS NOT NULL")

    begun = rows.groupBy("note_id").agg(F.min("created").alias("c"), F.min("updated").alias("u"))
    begun = begun.select("note_id", F.coalesce("c", "u").alias("begin"))
    named = rows.where("next_id IS NOT NULL").groupBy("note_id", "next_id").agg(F.min("t").alias("set_at"))
    named = (
        named.join(begun, "note_id")
        .join(begun.select(F.col("note_id").alias("next_id"), F.col("begin").alias("next_begin")), "next_id", "left")
        .withColumn("kind", F.expr("CASE WHEN next_begin IS NULL THEN 1 WHEN next_begin > begin THEN 0 ELSE 2 END"))
        .where("kind < 2")
        .groupBy("note_id")
        .agg(F.min(F.struct("kind", F.coalesce("next_begin", F.lit(0)).alias("next_begin"), "next_id")).alias("pick"), F.min(F.when(F.col("kind") == 1, F.col("set_at"))).alias("set_at"))
    )
    ends = cut(
        begun.join(named, "note_id", "left").select(
            "note_id",
            "begin",
            F.expr("CASE WHEN pick.kind = 0 THEN pick.next_begin WHEN pick.kind = 1 THEN set_at END").alias("end"),
            F.expr("CASE WHEN pick.kind = 0 THEN pick.next_id END").alias("next_id"),
        )
    )

    snapshots = number_snapshots(rows.groupBy("note_id", "t").agg(F.min("state").alias("state")), "note_id", "t")
    snapshots = cut(snapshots)
    starts = run_starts(snapshots, "note_id", "state")
    starts = starts.join(snapshots.select("note_id", "chunk", "ordinal", "t"), ["note_id", "chunk", "ordinal"])
    heads = snapshots.groupBy("note_id").agg(F.min("t").alias("first_t"))
    versions = cut(
        starts.join(ends.join(heads, "note_id"), "note_id")
        .where("end IS NULL OR t = first_t OR t < end")
        .select("note_id", "chunk", F.when(F.col("t") == F.col("first_t"), F.col("begin")).otherwise(F.col("t")).alias("valid_from_us"), F.coalesce("end", F.lit(-1)).alias("end"))
    )
    # Number within the note: rank in the chunk plus the versions of the chunks before.
    inside = Window.partitionBy("note_id", "chunk").orderBy("valid_from_us")
    per_chunk = versions.groupBy("note_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("valid_from_us").alias("chunk_from"))
    chain = Window.partitionBy("note_id").orderBy("chunk")
    per_chunk = per_chunk.select(
        "note_id", "chunk",
        F.coalesce(F.sum("n").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
        F.lead("chunk_from").over(chain).alias("next_chunk_from"),
    )
    versions = versions.withColumn("rank", F.row_number().over(inside)).withColumn("next_from", F.lead("valid_from_us").over(inside))

    sizes = ends.join(versions.groupBy(F.col("note_id").alias("vid")).agg(F.count(F.lit(1)).alias("weight")), F.col("note_id") == F.col("vid"), "left").select(F.col("note_id").alias("node"), F.coalesce("weight", F.lit(0)).cast("bigint").alias("weight"))
    links = ends.where("next_id IS NOT NULL").groupBy(F.col("next_id").alias("node")).agg(F.min_by("note_id", F.struct("begin", "note_id")).alias("prev"))
    lines = chain_roots(links, sizes, ["weight"])
    return (
        versions.join(per_chunk, ["note_id", "chunk"])
        .join(lines, F.col("note_id") == F.col("node"))
        .select(
            F.col("root").alias("root_note_id"),
            (F.col("before_weight") + F.col("ahead") + F.col("rank")).cast("bigint").alias("version_no"),
            "note_id",
            F.col("valid_from_us").cast("bigint").alias("valid_from_us"),
            F.coalesce("next_from", "next_chunk_from", "end").cast("bigint").alias("valid_to_us"),
        )
    )
