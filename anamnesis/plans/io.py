"""Queries of readers, writers and streams; each goes out to files and back, or runs a stream once."""

from __future__ import annotations

from pyspark.sql import functions as F

from anamnesis.functions import scoring as S
from anamnesis.functions import text as T
from anamnesis.operators import search as R
from anamnesis.operators.ordered import ranked
from anamnesis.plans.domain import T16_CTE, contradictions
from anamnesis.plans.relational import M, N, TOK, notes, tok
from anamnesis.plans.scalar import CLASS, SIGNALS, TERMS_PAIRS
from anamnesis.providers import Extractive, summarise
from anamnesis.sources import files, stores
from anamnesis.streaming import memory as stream
from anamnesis.session import micros, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_ROWS = "FROM messages WHERE message_id IS NOT NULL AND conversation_id IS NOT NULL AND content IS NOT NULL"


def rows(spark, d):
    return table(spark, d, "messages").where("message_id IS NOT NULL AND conversation_id IS NOT NULL AND content IS NOT NULL")


@query(f"SELECT conversation_id, message_id, role, length(content)::BIGINT AS chars {_ROWS}")
def s3_json_import(spark, d):
    """Conversations as objects, lists and maps, written and read again."""
    m = rows(spark, d).withColumn("shape", F.conv(F.substring(F.md5("conversation_id"), 1, 2), 16, 10).cast("int") % 3)
    out = None
    for i, (shape, read) in enumerate((("single", files.read_conversation_lines), ("list", files.read_conversation_lines), ("map", files.read_conversation_maps))):
        path = stream.folder(spark, f"json-{shape}")
        files.write_conversations(m.where(F.col("shape") == i), path, shape)
        part = read(spark, path).select(F.col("conversationId").alias("conversation_id"), F.col("id").alias("message_id"), "role", F.length("content").cast("bigint").alias("chars"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT coalesce(role, 'user') AS role, count(*)::BIGINT AS n {_ROWS} GROUP BY 1")
def s4_csv_import(spark, d):
    path = stream.folder(spark, "csv")
    rows(spark, d).select(F.col("message_id").alias("msg"), F.col("role").alias("speaker")).write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", "␀").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    df = spark.read.option("header", True).option("escape", '"').option("nullValue", "␀").option("emptyValue", "").csv(path).withColumnsRenamed({"msg": "id", "speaker": "role"})
    return files.conform(df, files.MESSAGE).groupBy(F.coalesce("role", F.lit("user")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'message' AS kind, count(*)::BIGINT AS n, sum(length(content))::BIGINT AS chars {_ROWS}")
def s6_session_lines(spark, d):
    path = stream.folder(spark, "lines")
    files.write_session_lines(rows(spark, d), path)
    return files.read_session_lines(spark, path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query(f"SELECT count(*)::BIGINT AS messages, count(DISTINCT message_id)::BIGINT AS ids, count(DISTINCT conversation_id)::BIGINT AS conversations, sum(length(content))::BIGINT AS chars, 0::BIGINT AS broken {_ROWS}")
def s7_foreign_store(spark, d):
    """Messages written into SQLite files, scanned (the sum of the counts) and read again."""
    path = stream.folder(spark, "stores")
    stores.write_stores(rows(spark, d), path)
    seen = stores.scan_stores(spark, path).agg(F.sum("messages").alias("messages"), F.count_if(F.col("error") | F.col("messages").isNull()).alias("broken"))
    m = stores.read_stores(spark, path).agg(F.countDistinct("message_id").alias("ids"), F.countDistinct("conversation_id").alias("conversations"), F.sum(F.length("content")).alias("chars"))
    return seen.join(m).select("messages", "ids", "conversations", "chars", "broken")


@query("SELECT count(*)::BIGINT AS n, sum(length(content))::BIGINT AS chars FROM notes WHERE content IS NOT NULL")
def s10_raw_text(spark, d):
    """Whole files as text; files hold at most 10,000 lines."""
    path = stream.folder(spark, "raw")
    table(spark, d, "notes").where("content IS NOT NULL").select(F.to_json(F.struct("content")).alias("value")).write.option("maxRecordsPerFile", 10_000).text(path)
    text = files.read_raw(spark, path).select(F.explode(F.split("value", "\n")).alias("v")).where("v <> ''").select(F.get_json_object("v", "$.content").alias("t"))
    return text.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("chars"))


@query("SELECT role, count(*)::BIGINT AS n FROM messages WHERE content IS NOT NULL AND length(content) > 0 GROUP BY 1")
def x12_ingest_batches(spark, d):
    """Ingest in micro-batches into a table, then count it."""
    out = stream.folder(spark, "ingested")
    schema = table(spark, d, "messages").select("message_id", "role", "content").schema

    def sink(df, batch):
        df.where("length(content) > 0").select("message_id", "role", "content").write.mode("append").parquet(f"{out}/batch={batch}")

    stream.ingest(stream.table_stream(spark, d, "messages"), sink)
    return spark.read.schema(schema).parquet(f"{out}/*").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {M}, t AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ingest_no DESC) k, count(*) OVER (PARTITION BY conversation_id) n, {SIGNALS} sc FROM m WHERE conversation_id IS NOT NULL AND content IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sc DESC, ingest_no) j FROM t WHERE k > 10), x AS (SELECT conversation_id, message_id, j <= greatest(0, trunc(n * 0.7::DOUBLE) - least(10, n)) keep, ingest_no FROM o),
l AS (SELECT DISTINCT conversation_id, 0 part, '' id FROM t UNION ALL SELECT conversation_id, 2, count(*) FILTER (WHERE NOT keep) || ' messages left out' FROM x GROUP BY 1 HAVING count(*) FILTER (WHERE NOT keep) > 0 UNION ALL SELECT conversation_id, 3, message_id FROM x WHERE keep UNION ALL SELECT conversation_id, 4, message_id FROM t WHERE k <= 10),
z AS (SELECT l.*, coalesce(m.ingest_no, 0) o FROM l LEFT JOIN m ON m.message_id = l.id AND part >= 3)
SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY part, o) AS line, CASE part WHEN 0 THEN 'session' WHEN 2 THEN 'summary' ELSE 'message' END AS type, id FROM z""")
def x13_session_output(spark, d):
    """Compressed sessions as JSON lines: head, summary of what was left out, kept old messages, the ten recent ones; written and read again."""
    from anamnesis.plans.relational import msgs

    m = msgs(spark, d).where("conversation_id IS NOT NULL AND content IS NOT NULL").select("conversation_id", "message_id", "ingest_no", (-F.col("ingest_no")).alias("back"), (-S.signal_bonus(F.col("content"))).alias("minus"))
    r = ranked(m, "conversation_id", ["back"], "k")
    old = ranked(r.where("k > 10"), "conversation_id", ["minus", "ingest_no"], "j").join(r.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")), "conversation_id")
    old = old.withColumn("keep", F.col("j") <= F.greatest(F.lit(0), F.floor(F.col("n") * 0.7) - F.least(F.lit(10), F.col("n"))))
    line = lambda df, part, id_, order: df.select("conversation_id", F.lit(part).alias("part"), id_.alias("id"), order.alias("o"))
    none = F.lit(0).cast("bigint")
    lost = old.where("NOT keep").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))
    lines = line(m.select("conversation_id").distinct(), 0, F.lit(""), none).unionByName(line(lost, 2, F.concat(F.col("n").cast("string"), F.lit(" messages left out")), none))
    lines = lines.unionByName(line(old.where("keep"), 3, F.col("message_id"), F.col("ingest_no"))).unionByName(line(r.where("k <= 10"), 4, F.col("message_id"), F.col("ingest_no")))
    placed = ranked(lines, "conversation_id", ["part", "o"], "line")
    kind = F.when(F.col("part") == 0, "session").when(F.col("part") == 2, "summary").otherwise("message")
    path = stream.folder(spark, "out")
    placed.repartitionByRange("conversation_id", "line").sortWithinPartitions("conversation_id", "line").select(F.to_json(F.struct("conversation_id", "line", kind.alias("type"), "id")).alias("value")).write.text(path)
    return spark.read.text(path).select(F.from_json("value", "conversation_id string, line bigint, type string, id string").alias("j")).select("j.*")


# Streams


@query("SELECT conversation_id, count(*) FILTER (WHERE role = 'user')::BIGINT AS turns FROM messages WHERE conversation_id IS NOT NULL GROUP BY 1")
def st3_turn_counters(spark, d):
    m = stream.table_stream(spark, d, "messages").where("conversation_id IS NOT NULL").select("conversation_id", F.coalesce(F.col("role") == "user", F.lit(False)).alias("is_user"))
    out = stream.folder(spark, "turns")

    def sink(df, batch):
        df.write.mode("append").parquet(f"{out}/batch={batch}")

    q = stream.turn_counters(m).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", stream.folder(spark, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("conversation_id string, turns long, due boolean").parquet(f"{out}/*").groupBy("conversation_id").agg(F.max("turns").alias("turns"))


LATE = "2 days"


@query("WITH x AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 1 HOUR, true) s FROM events), y AS (SELECT user_id, ts, sum(s::INT) OVER (PARTITION BY user_id ORDER BY ts) k FROM x) SELECT user_id, count(*)::BIGINT AS n, epoch_us(min(ts)) AS begin_us FROM y GROUP BY user_id, k")
def st2_gap_sessions(spark, d):
    """Sessions of a stream of events: each leaves the state once the watermark has passed its end; rows more than two days late are left out."""
    ev = stream.table_stream(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    build = lambda s: stream.gap_sessions(s.where("at IS NOT NULL"), "user_id", "at", "1 hour", LATE).select("user_id", "n", F.unix_micros("begin_at").alias("begin_us"))
    return stream.run_to_end(spark, build, ev, "at").where("user_id IS NOT NULL")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS from_us, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def st4_tumbling(spark, d):
    """Counts by windows of six hours, with the same watermark."""
    ev = stream.table_stream(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("at"))
    build = lambda s: stream.windowed(s, "event_type", "at", "6 hours", "6 hours", LATE).select("event_type", F.unix_micros("w.start").alias("from_us"), "n")
    return stream.run_to_end(spark, build, ev, "at").where("event_type IS NOT NULL")


@query("SELECT DISTINCT substring(sha256(content), 1, 16) AS content_hash FROM notes WHERE content IS NOT NULL AND coalesce(updated_at, created_at) IS NOT NULL")
def st6_resumable_import(spark, d):
    """Contents seen once over the whole stream; progress is the stream's own.

    The state forgets a content two days behind the watermark; what comes again
    later is told by an anti-join with what was written.
    """
    n = stream.table_stream(spark, d, "notes").where("content IS NOT NULL")
    n = n.select(T.short_id(F.col("content"), 16).alias("content_hash"), F.coalesce("updated_at", "created_at").cast("timestamp").alias("at")).where("at IS NOT NULL")
    out = stream.folder(spark, "imported")

    def sink(df, batch):
        fresh = df.select("content_hash").distinct()
        if batch:
            fresh = fresh.join(spark.read.schema("content_hash string").parquet(f"{out}/*"), "content_hash", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream.ingest(stream.first_seen(n, "content_hash", "at", LATE), sink)
    return spark.read.schema("content_hash string").parquet(f"{out}/*")


@query("SELECT user_id, count(*)::BIGINT AS touches, round(14.0 * list_aggregate(list_transform(range(1, count(*) + 1), lambda k: 1 + 0.5 / sqrt(k)), 'product'), 3) AS stability, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1")
def st7_touch_log(spark, d):
    """Touches come as a stream and are appended to a log; stability and last touch are folded from it on demand."""
    ev = stream.table_stream(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    log = stream.run_once(ev).groupBy("user_id").agg(F.count(F.lit(1)).alias("touches"), F.max("us").alias("last_us"))
    stability = F.aggregate(F.sequence(F.lit(1), F.col("touches").cast("int")), F.lit(14.0), lambda s, k: S.reinforced(s, k - 1))
    return log.select("user_id", "touches", F.round(stability, 3).alias("stability"), "last_us")


@query(f"SELECT ingest_no, ({CLASS}) AS class, ({SIGNALS})::BIGINT AS bonus, ({CLASS}) IN ('decision', 'config', 'code', 'error') AS exempt, {TOK} AS tokens FROM messages WHERE length(content) > 0")
def st1_scored_ingest(spark, d):
    """Messages scored and classed batch by batch as they come, into a table."""
    out, schema = stream.folder(spark, "scored"), "ingest_no bigint, class string, bonus bigint, exempt boolean, tokens bigint"

    def sink(df, batch):
        c = F.col("content")
        df.where("length(content) > 0").select("ingest_no", S.message_class(c).alias("class"), S.signal_bonus(c).alias("bonus"), S.exempt(S.message_class(c)).alias("exempt"), tok().alias("tokens")).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream.ingest(stream.table_stream(spark, d, "messages"), sink)
    return spark.read.schema(schema).parquet(f"{out}/*")


L5 = f"""WITH {N}, m AS (SELECT ingest_no::VARCHAR message_id, conversation_id, ingest_no, content FROM messages WHERE length(content) > 0), {T16_CTE},
u AS (SELECT conversation_id, least(sum({TOK}) / 3000.0::DOUBLE, 1.0::DOUBLE) v FROM m WHERE conversation_id IS NOT NULL GROUP BY 1)
SELECT m.ingest_no, row_number() OVER (PARTITION BY m.conversation_id ORDER BY m.ingest_no) AS ordinal, ({CLASS}) AS class, m.message_id IN (SELECT message_id FROM x) AS contradicts, u.v >= 0.75 AS trigger FROM m JOIN u USING (conversation_id)"""


@query(L5)
def l5_on_new_message(spark, d):
    """What every new message sets off: its class, its place in the context, whether it denies an open note, whether its conversation is to be compressed.

    Batches are scored, checked against the notes and appended; places and usage
    are read off the table.
    """
    out, schema = stream.folder(spark, "arrived"), "ingest_no bigint, conversation_id string, class string, tokens bigint, contradicts boolean"
    open_notes = notes(spark, d)

    def sink(df, batch):
        m = df.where("length(content) > 0").select(F.col("ingest_no").cast("string").alias("message_id"), "conversation_id", "ingest_no", "content")
        hit = contradictions(open_notes, m).select("message_id").distinct().withColumn("contradicts", F.lit(True))
        m.join(hit, "message_id", "left").select("ingest_no", "conversation_id", S.message_class(F.col("content")).alias("class"), tok().alias("tokens"), F.coalesce("contradicts", F.lit(False)).alias("contradicts")).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream.ingest(stream.table_stream(spark, d, "messages"), sink)
    m = spark.read.schema(schema).parquet(f"{out}/*").where("conversation_id IS NOT NULL")
    usage = m.groupBy("conversation_id").agg((F.least(F.sum("tokens") / 3000.0, F.lit(1.0)) >= 0.75).alias("trigger"))
    return ranked(m, "conversation_id", ["ingest_no"], "ordinal").join(usage, "conversation_id").select("ingest_no", "ordinal", "class", "contradicts", "trigger")


@query(f"""WITH q AS (SELECT ingest_no, 'embed' AS type, content, role FROM messages UNION ALL SELECT ingest_no, 'task_detect', content, role FROM messages WHERE role = 'user' UNION ALL SELECT ingest_no, 'other', content, role FROM messages WHERE role IS NULL),
e AS (SELECT ingest_no, count(*) k FROM (SELECT ingest_no, e % 64 dim, sum(CASE WHEN (e // 64) % 2 = 0 THEN 1 ELSE -1 END) v FROM (SELECT ingest_no, ('0x' || substring(md5(unnest({TERMS_PAIRS})), 1, 3))::INT e FROM messages WHERE content IS NOT NULL) GROUP BY 1, 2 HAVING v <> 0) GROUP BY 1)
SELECT q.ingest_no, q.type, CASE WHEN q.type = 'other' THEN 'unknown' WHEN coalesce(content, '') = '' THEN 'failed' ELSE 'done' END AS status, CASE WHEN coalesce(content, '') <> '' AND q.type = 'embed' THEN coalesce(k, 0) WHEN coalesce(content, '') <> '' AND q.type = 'task_detect' THEN 1 END::BIGINT AS result FROM q LEFT JOIN e USING (ingest_no)""")
def st4_task_queue(spark, d):
    """A queue of tasks (embed, task_detect and what nobody knows) as a stream, worked off batch by batch, each with its outcome.

    The result of embed is the number of dimensions in use; tasks without a text
    fail, tasks of another type are unknown, and neither stops the queue.
    """
    m = stream.table_stream(spark, d, "messages")
    kinds = F.filter(F.array(F.lit("embed"), F.when(F.col("role") == "user", F.lit("task_detect")), F.when(F.col("role").isNull(), F.lit("other"))), lambda x: x.isNotNull())
    tasks = m.select("ingest_no", "content", F.explode(kinds).alias("type"))
    out, schema = stream.folder(spark, "tasks"), "ingest_no bigint, type string, status string, result bigint"

    def sink(df, batch):
        empty = F.coalesce(F.length("content"), F.lit(0)) == 0
        used = R.projections(df.where("type = 'embed'"), ["ingest_no"], "content").groupBy("ingest_no").agg(F.count(F.lit(1)).alias("k")).withColumn("type", F.lit("embed"))
        status = F.when(F.col("type") == "other", "unknown").when(empty, "failed").otherwise("done")
        result = F.when(~empty & (F.col("type") == "embed"), F.coalesce("k", F.lit(0))).when(~empty & (F.col("type") == "task_detect"), F.lit(1).cast("bigint"))
        df.join(used, ["ingest_no", "type"], "left").select("ingest_no", "type", status.alias("status"), result.alias("result")).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream.ingest(tasks, sink)
    return spark.read.schema(schema).parquet(f"{out}/*")


@query()
def st5_provider_summaries(spark, d):
    """Summaries by a provider, made by a timed run over what is new; the stand-in is the extractive one."""
    out, schema = stream.folder(spark, "summaries"), "id bigint, summary string"

    def sink(df, batch):
        summarise(df, Extractive(80)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    n = stream.table_stream(spark, d, "notes").where("content IS NOT NULL").select(F.col("ingest_no").alias("id"), F.col("content").alias("text"))
    stream.ingest(n, sink)
    return spark.read.schema(schema).parquet(f"{out}/*")


@query("SELECT m.ingest_no, epoch_us(max(e.ts)) AS event_us FROM (SELECT ingest_no, created_at FROM notes WHERE created_at IS NOT NULL) m LEFT JOIN events e ON e.ts <= m.created_at AND e.ts > m.created_at - INTERVAL 1 DAY GROUP BY 1")
def st8_as_of(spark, d):
    """The last event within a day before each note: an as-of join by day buckets."""
    n = table(spark, d, "notes").where("created_at IS NOT NULL")
    n = n.select("ingest_no", micros(n, "created_at").alias("us"))
    ev = table(spark, d, "events")
    day = 86_400_000_000
    ev = ev.select(micros(ev, "ts").alias("e")).withColumn("day", F.expr(f"e DIV {day}"))
    probe = n.select("ingest_no", "us", F.explode(F.array(F.expr(f"us DIV {day}"), F.expr(f"us DIV {day} - 1"))).alias("day"))
    hit = probe.join(ev, "day").where(f"e <= us AND e > us - {day}").groupBy("ingest_no").agg(F.max("e").alias("event_us"))
    return n.select("ingest_no").join(hit, "ingest_no", "left")


