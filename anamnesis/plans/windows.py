"""Queries of ordered operators: tails, prefix budgets, gaps, turns, tasks, chunks, runs, segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from anamnesis.operators.chains import neighbours
from anamnesis.operators.ordered import ranked, running_sums
from anamnesis.operators.segments import episodes, task_sessions, user_turns
from anamnesis.plans.relational import M, N, SU, TOK, msgs, notes, sums, tok
from anamnesis.plans.scalar import TERMS_SHORT
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


def timed(spark, d):
    """Latest messages with a total order in their conversation: time, then arrival."""
    m = msgs(spark, d).where("conversation_id IS NOT NULL AND created_at IS NOT NULL")
    return m.withColumn("us", micros(m, "created_at"))


MT = M + ", t AS (SELECT *, epoch_us(created_at) us FROM m WHERE conversation_id IS NOT NULL AND created_at IS NOT NULL)"


@query(f"WITH {MT} SELECT conversation_id, message_id, row_number() OVER w AS place FROM t WINDOW w AS (PARTITION BY conversation_id ORDER BY us DESC, ingest_no DESC) QUALIFY row_number() OVER w <= 32")
def w1_fresh_tail(spark, d):
    """The last 32 messages; every task cuts its groups to 32 rows before the shuffle."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("us"), F.desc("ingest_no"))
    return timed(spark, d).withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 32").select("conversation_id", "message_id", "place")


@query(f"WITH {N}, r AS (SELECT note_id, conversation_id, sum(coalesce(length(content), 0) // 4 + 10) OVER (PARTITION BY conversation_id ORDER BY coalesce(category, ''), ingest_no) used FROM n WHERE superseded_by IS NULL AND conversation_id IS NOT NULL) SELECT note_id, used::BIGINT AS used FROM r WHERE used <= 500")
def w2_prefix_budget(spark, d):
    n = notes(spark, d).where("superseded_by IS NULL AND conversation_id IS NOT NULL")
    n = n.select("note_id", "conversation_id", F.coalesce("category", F.lit("")).alias("category"), "ingest_no", (F.floor(F.coalesce(F.length("content"), F.lit(0)) / 4) + 10).alias("cost"))
    return running_sums(n, "conversation_id", ["category", "ingest_no"], {"used": "cost"}).where("used <= 500").select("note_id", "used")


@query(f"WITH {MT}, r AS (SELECT message_id, sum({TOK}) OVER (PARTITION BY conversation_id ORDER BY us DESC, ingest_no DESC) used FROM t) SELECT message_id, used::BIGINT AS used FROM r WHERE used <= 800")
def w3_newest_first(spark, d):
    m = timed(spark, d).select("message_id", "conversation_id", (-F.col("us")).alias("back"), (-F.col("ingest_no")).alias("no"), tok().alias("cost"))
    return running_sums(m, "conversation_id", ["back", "no"], {"used": "cost"}).where("used <= 800").select("message_id", "used")


@query(f"WITH {MT} SELECT message_id, us - lag(us) OVER (PARTITION BY conversation_id ORDER BY us, ingest_no) AS gap_us FROM t")
def w4_gaps(spark, d):
    m = timed(spark, d).select("conversation_id", F.struct("us", "ingest_no", "message_id").alias("at"))
    return neighbours(m, "conversation_id", "at").select("at.message_id", (F.col("at.us") - F.col("prev.us")).alias("gap_us"))


USER = "lower(trim(role, ' ')) IN ('user', 'human', '用户')"


@query(f"WITH {MT} SELECT message_id, sum(coalesce({USER}, false)::INT) OVER (PARTITION BY conversation_id ORDER BY us, ingest_no)::BIGINT AS turn_no FROM t")
def w5_user_turns(spark, d):
    return user_turns(timed(spark, d)).select("message_id", "turn_no")


T19_SQL = f"""WITH {MT}, a AS (SELECT *, sum(coalesce({USER}, false)::INT) OVER (PARTITION BY conversation_id ORDER BY us, ingest_no) turn_no FROM t),
b AS (SELECT conversation_id, turn_no, min(us) first_us, count(*) n FROM a GROUP BY 1, 2),
c AS (SELECT *, coalesce(first_us - lag(first_us) OVER (PARTITION BY conversation_id ORDER BY turn_no) > 7200000000, false) split FROM b),
e AS (SELECT *, sum(split::INT) OVER (PARTITION BY conversation_id ORDER BY turn_no) task_no FROM c)
SELECT conversation_id, task_no::BIGINT AS task_no, count(*)::BIGINT AS turns, sum(n)::BIGINT AS messages, min(first_us) AS begin_us FROM e GROUP BY 1, 2"""


QUERIES["t19_tasks"] = lambda spark, d: task_sessions(timed(spark, d))
SQL["t19_tasks"] = T19_SQL


QUERIES["w6_task_sessions"] = lambda spark, d: task_sessions(timed(spark, d), gap_us=3_600_000_000)
SQL["w6_task_sessions"] = T19_SQL.replace("7200000000", "3600000000")


@query("SELECT max(ingest_no) AS ingest_no, content FROM messages WHERE content IS NOT NULL AND length(content) >= 10 GROUP BY md5(substring(content, 1, 300)), content")
def w7_keep_last(spark, d):
    """The last of equal contents; groups are counted by partial aggregation."""
    m = table(spark, d, "messages").where("content IS NOT NULL AND length(content) >= 10")
    return m.groupBy(F.md5(F.substring("content", 1, 300)).alias("k"), "content").agg(F.max("ingest_no").alias("ingest_no")).select("ingest_no", "content")


@query("""WITH x AS (SELECT ingest_no, conversation_id, regexp_extract(content, '\\[MEMORY REMINDER\\][^\\n]*') b, content FROM messages WHERE content LIKE '%[MEMORY REMINDER]%'),
l AS (SELECT conversation_id, max(ingest_no) k FROM x GROUP BY 1)
SELECT ingest_no, CASE WHEN ingest_no = k THEN content ELSE regexp_replace(content, '\\[MEMORY REMINDER\\][^\\n]*', '[folded]', 'g') END AS content FROM x LEFT JOIN l ON l.conversation_id IS NOT DISTINCT FROM x.conversation_id""")
def w8_fold_boilerplate(spark, d):
    """Scaffolding is kept in its last message of a conversation and folded before."""
    pattern = "\\[MEMORY REMINDER\\][^\\n]*"
    x = table(spark, d, "messages").where(F.col("content").contains("[MEMORY REMINDER]")).select("ingest_no", "conversation_id", "content")
    last = x.groupBy(F.col("conversation_id").alias("c")).agg(F.max("ingest_no").alias("k"))
    return x.join(last, F.col("conversation_id").eqNullSafe(F.col("c")), "left").select("ingest_no", F.when(F.col("ingest_no") == F.col("k"), F.col("content")).otherwise(F.regexp_replace("content", pattern, "[folded]")).alias("content"))


T9_SQL = f"""WITH {SU}, u AS (SELECT conversation_id, depth, summary_id, min(created_at) made, max(coalesce(descendant_count, 0)) dc FROM s WHERE depth IS NOT NULL AND conversation_id IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, (row_number() OVER (PARTITION BY conversation_id, depth ORDER BY made, summary_id) - 1) // 4 g FROM u)
SELECT conversation_id, depth + 1 AS depth, g::BIGINT AS group_no, sum(dc)::BIGINT AS descendants, min(summary_id) AS first_id FROM r GROUP BY conversation_id, depth, g HAVING count(*) = 4"""


@query(T9_SQL)
def w9_fan_out_chunks(spark, d):
    """Groups of four neighbouring summaries of a depth; incomplete groups wait."""
    u = sums(spark, d).where("depth IS NOT NULL AND conversation_id IS NOT NULL").groupBy("conversation_id", "depth", "summary_id").agg(F.min("created_at").alias("at"), F.max(F.coalesce("descendant_count", F.lit(0))).alias("dc"))
    r = ranked(u.withColumn("lane", F.struct("conversation_id", "depth")), "lane", ["at", "summary_id"])
    g = r.groupBy("conversation_id", "depth", F.expr("(rank - 1) DIV 4").alias("group_no")).agg(F.sum("dc").alias("descendants"), F.min("summary_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return g.where("n = 4").select("conversation_id", (F.col("depth") + 1).alias("depth"), "group_no", "descendants", "first_id")


@query("WITH r AS (SELECT entity_id, row_number() OVER (ORDER BY mention_count DESC, entity_id) k FROM entities) SELECT entity_id, round(1.0::DOUBLE / k, 6) AS score FROM r")
def w10_rank_scores(spark, d):
    e = table(spark, d, "entities").select("entity_id", (-F.col("mention_count")).alias("minus"), F.lit(0).alias("all"))
    return ranked(e, "all", ["minus", "entity_id"]).select("entity_id", F.round(1.0 / F.col("rank"), 6).alias("score"))


@query(f"WITH {MT}, a AS (SELECT conversation_id, role, us, ingest_no, coalesce(role IS DISTINCT FROM lag(role) OVER (PARTITION BY conversation_id ORDER BY us, ingest_no), true) c FROM t), b AS (SELECT conversation_id, sum(c::INT) OVER (PARTITION BY conversation_id ORDER BY us, ingest_no) g FROM a), e AS (SELECT conversation_id, g, count(*) n FROM b GROUP BY 1, 2) SELECT conversation_id, max(n)::BIGINT AS longest_run FROM e GROUP BY 1")
def w11_longest_run(spark, d):
    m = timed(spark, d).select("conversation_id", F.struct("us", "ingest_no", "role").alias("at"))
    n = neighbours(m, "conversation_id", "at").select("conversation_id", "at.us", "at.ingest_no", F.when(F.col("prev").isNull() | ~F.col("prev.role").eqNullSafe(F.col("at.role")), 1).otherwise(0).alias("change"))
    g = running_sums(n, "conversation_id", ["us", "ingest_no"], {"run": "change"})
    return g.groupBy("conversation_id", "run").agg(F.count(F.lit(1)).alias("n")).groupBy("conversation_id").agg(F.max("n").alias("longest_run"))


@query(f"WITH {MT}, r AS (SELECT message_id, row_number() OVER (PARTITION BY conversation_id ORDER BY us, ingest_no) k, count(*) OVER (PARTITION BY conversation_id) n FROM t) SELECT message_id, k <= ceil(n * 0.1) AS head FROM r")
def w13_head_share(spark, d):
    m = timed(spark, d).select("message_id", "conversation_id", "us", "ingest_no")
    n = m.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))
    return ranked(m, "conversation_id", ["us", "ingest_no"]).join(n, "conversation_id").select("message_id", (F.col("rank") <= F.ceil(F.col("n") * 0.1)).alias("head"))


@query("""WITH r AS (SELECT event_id, user_id, value, lag(value) OVER w pv, epoch_us(ts) us, lag(epoch_us(ts)) OVER w pu FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN pv IS NULL OR us <= pu OR value <= pv THEN 999.0 ELSE round((1000 - value) / ((value - pv) / ((us - pu) / 6e7)), 4) END AS minutes_left FROM r""")
def w14_growth(spark, d):
    """Minutes until a limit of 1000 at the growth between two samples; 999 without growth."""
    ev = table(spark, d, "events")
    items = ev.select("user_id", F.struct(micros(ev, "ts").alias("us"), "event_id", "value").alias("at"))
    rate = (F.col("at.value") - F.col("prev.value")) / ((F.col("at.us") - F.col("prev.us")) / 6e7)
    still = F.col("prev").isNull() | (F.col("at.us") <= F.col("prev.us")) | (F.col("at.value") <= F.col("prev.value"))
    return neighbours(items, "user_id", "at").select("at.event_id", F.when(still, F.lit(999.0)).otherwise(F.round((1000 - F.col("at.value")) / rate, 4)).alias("minutes_left"))


@query("WITH r AS (SELECT ingest_no, row_number() OVER (PARTITION BY coalesce(role, '') ORDER BY ingest_no) k FROM messages) SELECT ingest_no FROM r WHERE k % 10 = 0")
def w15_every_tenth(spark, d):
    m = table(spark, d, "messages").select(F.coalesce("role", F.lit("")).alias("role"), "ingest_no")
    return ranked(m, "role", ["ingest_no"]).where("rank % 10 = 0").select("ingest_no")


@query(f"""WITH {MT}, p AS (SELECT *, lag(us) OVER w pu, lag(content) OVER w pc, row_number() OVER w k FROM t WINDOW w AS (PARTITION BY conversation_id ORDER BY us, ingest_no)),
x AS (SELECT conversation_id, message_id, us, ingest_no, k, content, pc, coalesce(lower(role) = 'system', false) OR us - pu > 3600000000 AS hard,
  list_aggregate({TERMS_SHORT}, 'histogram') ha, list_aggregate({TERMS_SHORT.replace('content', 'pc')}, 'histogram') hb FROM p),
c AS (SELECT *, list_sum(list_transform(map_keys(ha), lambda w: ha[w] * coalesce(hb[w], 0)))::DOUBLE dot, list_sum(list_transform(map_values(ha), lambda v: v * v))::DOUBLE na, list_sum(list_transform(map_values(hb), lambda v: v * v))::DOUBLE nb FROM x),
b AS (SELECT conversation_id, message_id, us, ingest_no, k > 1 AND (hard OR (length(content) > 20 AND length(pc) > 20 AND coalesce(dot * dot * 16 < na * nb, true))) cut FROM c)
SELECT message_id, sum(coalesce(cut, false)::INT) OVER (PARTITION BY conversation_id ORDER BY us, ingest_no)::BIGINT AS episode_no FROM b""")
def t4_episodes(spark, d):
    return episodes(timed(spark, d)).select("message_id", "episode_no")


@query("SELECT user_id, count(*)::BIGINT AS sessions FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 12 HOUR s, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL f FROM events) WHERE s OR f GROUP BY 1")
def w16_event_sessions(spark, d):
    ev = table(spark, d, "events")
    return ev.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "12 hours")).agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


