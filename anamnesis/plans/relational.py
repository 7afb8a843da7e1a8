"""Queries of scans, upserts, filters, joins, aggregates, set operations and sorted cuts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from anamnesis.functions import scoring as S
from anamnesis.functions import text as T
from anamnesis.operators.latest import latest
from anamnesis.plans.scalar import CLASS, HOURS, NOW, TOKENS
from anamnesis.session import micros, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under the function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


M = "m AS (SELECT * FROM messages WHERE message_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY ingest_no DESC) = 1)"
N = "n AS (SELECT * FROM notes WHERE note_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY ingest_no DESC) = 1)"
SU = "s AS (SELECT DISTINCT * FROM summaries)"
SM = "sm AS (SELECT DISTINCT * FROM summary_messages)"
SP = "sp AS (SELECT DISTINCT * FROM summary_parents)"
CO = "c AS (SELECT conversation_id, min(lower(trim(namespace, ' '))) namespace, min(created_at) created_at FROM conversations WHERE conversation_id IS NOT NULL GROUP BY 1)"


def msgs(spark, d):
    return latest(table(spark, d, "messages"), "message_id", "ingest_no")


def notes(spark, d):
    return latest(table(spark, d, "notes"), "note_id", "ingest_no")


def sums(spark, d):
    return table(spark, d, "summaries").distinct()


def leaves(spark, d):
    return table(spark, d, "summary_messages").distinct()


def parents(spark, d):
    return table(spark, d, "summary_parents").distinct()


def convs(spark, d):
    """One row a conversation; namespaces in one spelling."""
    df = table(spark, d, "conversations").where("conversation_id IS NOT NULL")
    return df.groupBy("conversation_id").agg(F.min(F.lower(F.trim("namespace"))).alias("namespace"), F.min("created_at").alias("created_at"))


tok = lambda: F.coalesce(T.token_estimate(F.col("content")), F.lit(0))
TOK = f"coalesce({TOKENS}, 0)"


# Scans


@query("SELECT conversation_id, count(*)::BIGINT AS n_messages, count(*) FILTER (WHERE content IS NULL)::BIGINT AS n_rejected FROM messages WHERE conversation_id IS NOT NULL GROUP BY 1 HAVING count(content) > 0")
def s5_import_groups(spark, d):
    df = table(spark, d, "messages").where("conversation_id IS NOT NULL")
    return df.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("content").isNull()).alias("n_rejected"), F.count("content").alias("n_ok")).where("n_ok > 0").drop("n_ok")


@query("SELECT substring(sha256(content), 1, 16) AS content_hash, min(ingest_no) AS ingest_no, count(*)::BIGINT AS n FROM messages WHERE content IS NOT NULL AND substring(sha256(content), 1, 16) NOT IN (SELECT substring(sha256(content), 1, 16) FROM notes WHERE content IS NOT NULL) GROUP BY 1")
def s8_import_new_content(spark, d):
    """Rows whose content hash is not yet known (here: to the notes), once per hash."""
    h = T.short_id(F.col("content"), 16).alias("content_hash")
    seen = table(spark, d, "notes").where("content IS NOT NULL").select(h).distinct()
    new = table(spark, d, "messages").where("content IS NOT NULL").select(h, "ingest_no")
    return new.groupBy("content_hash").agg(F.min("ingest_no").alias("ingest_no"), F.count(F.lit(1)).alias("n")).join(seen, "content_hash", "left_anti")


@query("SELECT conversation_id, (sum(coalesce(length(content), 0)) // 3)::BIGINT AS tokens FROM messages GROUP BY 1 HAVING sum(coalesce(length(content), 0)) // 3 >= 500")
def s9_large_sessions(spark, d):
    return table(spark, d, "messages").groupBy("conversation_id").agg(F.floor(F.sum(F.coalesce(F.length("content"), F.lit(0))) / 3).cast("bigint").alias("tokens")).where("tokens >= 500")


@query("SELECT note_id, ingest_no FROM notes ORDER BY ingest_no DESC LIMIT 20 OFFSET 40")
def s11_page(spark, d):
    return table(spark, d, "notes").orderBy(F.col("ingest_no").desc()).offset(40).limit(20).select("note_id", "ingest_no")


@query("SELECT note_id, arg_max(category, ingest_no) AS category, count(*)::BIGINT AS versions FROM notes GROUP BY 1")
def s12_latest_version(spark, d):
    return table(spark, d, "notes").groupBy("note_id").agg(F.max_by("category", "ingest_no").alias("category"), F.count(F.lit(1)).alias("versions"))


# Upserts and corrections as views


@query(f"WITH {M} SELECT message_id, ingest_no, conversation_id, seq FROM m")
def x1_upsert_messages(spark, d):
    return msgs(spark, d).select("message_id", "ingest_no", "conversation_id", "seq")


@query(f"WITH {SP}, {SM} SELECT summary_id, parent_summary_id AS target, 'summary' AS kind FROM sp UNION ALL SELECT summary_id, message_id, 'message' FROM sm")
def x2_summary_edges(spark, d):
    a = parents(spark, d).select("summary_id", F.col("parent_summary_id").alias("target"), F.lit("summary").alias("kind"))
    return a.unionByName(leaves(spark, d).select("summary_id", F.col("message_id").alias("target"), F.lit("message").alias("kind")))


@query("SELECT entity_name, coalesce(entity_type, 'unknown') AS entity_type, epoch_us(min(first_seen_at)) AS first_us, epoch_us(max(last_seen_at)) AS last_us, sum(mention_count)::BIGINT AS mentions FROM entities GROUP BY 1, 2")
def x3_upsert_entities(spark, d):
    df = table(spark, d, "entities")
    df = df.withColumn("f", micros(df, "first_seen_at")).withColumn("l", micros(df, "last_seen_at"))
    return df.groupBy("entity_name", F.coalesce("entity_type", F.lit("unknown")).alias("entity_type")).agg(F.min("f").alias("first_us"), F.max("l").alias("last_us"), F.sum("mention_count").alias("mentions"))


@query(f"WITH {M}, {SM} SELECT message_id FROM m WHERE message_id NOT IN (SELECT message_id FROM sm)")
def x5_context_removed(spark, d):
    return msgs(spark, d).join(leaves(spark, d), "message_id", "left_anti").select("message_id")


@query("SELECT vec_id % 400 AS chunk_id, arg_max(label, vec_id) AS label FROM embeddings GROUP BY 1")
def x7_replace_embeddings(spark, d):
    return table(spark, d, "embeddings").groupBy((F.col("vec_id") % 400).alias("chunk_id")).agg(F.max_by("label", "vec_id").alias("label"))


@query("SELECT ingest_no, conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY ingest_no) AS ordinal FROM messages WHERE conversation_id IS NOT NULL")
def x10_ordinals(spark, d):
    """The next ordinal of a conversation as a rank of arrival: ranked in range chunks, so hot conversations are spread."""
    from anamnesis.operators.ordered import ranked

    return ranked(table(spark, d, "messages").where("conversation_id IS NOT NULL").select("ingest_no", "conversation_id"), "conversation_id", ["ingest_no"], "ordinal")


@query("SELECT 'pub_' || substring(sha256(content), 1, 16) AS public_id, 'public' AS owner, min(ingest_no) AS ingest_no FROM notes WHERE content IS NOT NULL GROUP BY 1")
def x11_public_memories(spark, d):
    df = table(spark, d, "notes").where("content IS NOT NULL")
    return df.groupBy(T.short_id(F.col("content"), 16, "pub_").alias("public_id")).agg(F.min("ingest_no").alias("ingest_no")).withColumn("owner", F.lit("public"))


@query("SELECT conversation_id, coalesce(max(seq), 0) + 1 AS next_seq FROM messages WHERE conversation_id IS NOT NULL GROUP BY 1")
def x14_next_seq(spark, d):
    return table(spark, d, "messages").where("conversation_id IS NOT NULL").groupBy("conversation_id").agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


# Filters


@query(f"WITH {N} SELECT note_id, owner FROM n WHERE owner IN ('agent_ops', 'public')")
def flt1_owner_filter(spark, d):
    return notes(spark, d).where(F.col("owner").isin("agent_ops", "public")).select("note_id", "owner")


@query(f"WITH {CO} SELECT conversation_id, namespace FROM c WHERE namespace = 'default' OR namespace IS NULL")
def flt2_namespace_filter(spark, d):
    return convs(spark, d).where("namespace = 'default' OR namespace IS NULL").select("conversation_id", "namespace")


@query(f"WITH {M} SELECT message_id FROM m WHERE content IS NOT NULL AND ({CLASS}) IN ('decision', 'config', 'code', 'error')")
def flt3_exempt_ids(spark, d):
    return msgs(spark, d).where("content IS NOT NULL").where(S.exempt(S.message_class(F.col("content")))).select("message_id")


@query(f"WITH {N} SELECT note_id, category FROM n WHERE category IN ('decision', 'constraint') AND superseded_by IS NULL")
def flt5_active_notes(spark, d):
    return notes(spark, d).where("category IN ('decision', 'constraint') AND superseded_by IS NULL").select("note_id", "category")


@query("SELECT entity_id, entity_name FROM entities WHERE entity_name ILIKE '%an%'")
def flt7_like(spark, d):
    return table(spark, d, "entities").where(F.col("entity_name").ilike("%an%")).select("entity_id", "entity_name")


@query("WITH x AS (SELECT doc_id, n_chars::DOUBLE / max(n_chars) OVER () AS score FROM documents WHERE n_chars > 0) SELECT doc_id, round(score, 6) AS score FROM x WHERE score >= 0.2")
def flt8_min_score(spark, d):
    docs = table(spark, d, "documents").where("n_chars > 0").select("doc_id", "n_chars")
    top = docs.agg(F.max("n_chars").alias("top"))
    return docs.join(F.broadcast(top)).withColumn("score", F.col("n_chars") / F.col("top")).where("score >= 0.2").select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT note_id, ingest_no FROM notes WHERE content IS NOT NULL AND NOT regexp_matches(lower(content), '你好|hello|hi|嗨|谢谢|thank|thanks|闲聊|chitchat|small talk|测试|test|再见|bye|天气|今天多少度')")
def flt9_skill_gate(spark, d):
    from anamnesis.functions.lexicons import SKIP_WORDS

    return table(spark, d, "notes").where("content IS NOT NULL").where(~F.lower("content").rlike("|".join(SKIP_WORDS))).select("note_id", "ingest_no")


@query("SELECT conversation_id, coalesce(min(ingest_no) FILTER (WHERE lower(content) LIKE '%budget%'), max(ingest_no)) AS ingest_no FROM messages WHERE conversation_id IS NOT NULL GROUP BY 1")
def flt10_pick_task(spark, d):
    """The first row that names the goal, else the last."""
    hit = F.lower("content").contains("budget")
    return table(spark, d, "messages").where("conversation_id IS NOT NULL").groupBy("conversation_id").agg(F.coalesce(F.min(F.when(hit, F.col("ingest_no"))), F.max("ingest_no")).alias("ingest_no"))


# Joins


@query(f"WITH {M}, {SM} SELECT sm.summary_id, m.message_id, m.seq FROM sm JOIN m USING (message_id)")
def j4_leaf_messages(spark, d):
    return leaves(spark, d).join(msgs(spark, d), "message_id").select("summary_id", "message_id", "seq")


@query(f"WITH {SU}, {SP} SELECT DISTINCT sp.summary_id, s.summary_id AS source_id, s.kind FROM sp JOIN s ON s.summary_id = sp.parent_summary_id")
def j5_condensed_sources(spark, d):
    s = sums(spark, d).select(F.col("summary_id").alias("source_id"), "kind")
    return parents(spark, d).join(s, F.col("parent_summary_id") == F.col("source_id")).select("summary_id", "source_id", "kind").distinct()


@query("SELECT DISTINCT e.entity_id, m.conversation_id FROM (SELECT *, regexp_extract(entity_name, '[A-Za-z0-9_-]+') w FROM entities) e JOIN (SELECT conversation_id, content, unnest(list_distinct(regexp_extract_all(content, '[A-Za-z0-9_-]+'))) w FROM messages WHERE content IS NOT NULL) m ON e.conversation_id = m.conversation_id AND e.w = m.w AND e.w <> '' AND contains(m.content, e.entity_name)")
def j6_entity_mentions(spark, d):
    """Entities that messages of their conversation name: joined on the first word of the name, then compared whole."""
    word = "[A-Za-z0-9_-]+"
    e = table(spark, d, "entities").select("entity_id", "conversation_id", "entity_name", F.regexp_extract("entity_name", word, 0).alias("w")).where("w <> ''")
    m = table(spark, d, "messages").where("content IS NOT NULL").select("conversation_id", "content", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(word), F.lit(0)))).alias("w"))
    return m.join(e, ["conversation_id", "w"]).where(F.col("content").contains(F.col("entity_name"))).select("entity_id", "conversation_id").distinct()


@query(f"WITH {M}, {SU} SELECT message_id AS id FROM m WHERE conversation_id IN (SELECT conversation_id FROM conversations) UNION SELECT summary_id FROM s WHERE conversation_id IN (SELECT conversation_id FROM conversations)")
def j7_semi_join(spark, d):
    c = table(spark, d, "conversations").select("conversation_id")
    return msgs(spark, d).join(c, "conversation_id", "left_semi").select(F.col("message_id").alias("id")).union(sums(spark, d).join(c, "conversation_id", "left_semi").select("summary_id")).distinct()


@query(f"WITH {N} SELECT note_id FROM n WHERE superseded_by IN (SELECT note_id FROM notes UNION SELECT message_id FROM messages)")
def j8_semi_join_union(spark, d):
    ids = table(spark, d, "notes").select(F.col("note_id").alias("superseded_by")).union(table(spark, d, "messages").select("message_id"))
    return notes(spark, d).join(ids, "superseded_by", "left_semi").select("note_id")


@query(f"WITH {M}, {SM} SELECT count(*)::BIGINT AS n, count(DISTINCT conversation_id)::BIGINT AS conversations FROM m WHERE message_id NOT IN (SELECT message_id FROM sm) AND (content IS NULL OR ({CLASS}) NOT IN ('decision', 'config', 'code', 'error'))")
def j9_anti_joins(spark, d):
    rest = msgs(spark, d).join(leaves(spark, d), "message_id", "left_anti").where(F.col("content").isNull() | ~S.exempt(S.message_class(F.col("content"))))
    return rest.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conversation_id").alias("conversations"))


@query(f"""WITH {SU}, {SM}, {SP}, {M}, i AS (SELECT summary_id item, parent_summary_id id, 'summary' t FROM sp UNION ALL SELECT summary_id, message_id, 'message' FROM sm)
SELECT i.item, i.id, i.t AS item_type, coalesce(m.content, s.content) AS content FROM i LEFT JOIN m ON i.t = 'message' AND m.message_id = i.id LEFT JOIN (SELECT summary_id, min(content) content FROM s GROUP BY 1) s ON i.t = 'summary' AND s.summary_id = i.id""")
def j12_context_items(spark, d):
    """Items that name a message or a summary, joined with the right one of the two."""
    m = msgs(spark, d).select(F.col("message_id").alias("id"), "content")
    s = sums(spark, d).groupBy(F.col("summary_id").alias("id")).agg(F.min("content").alias("content"))
    own = leaves(spark, d).select(F.col("summary_id").alias("item"), F.col("message_id").alias("id")).join(m, "id", "left").withColumn("item_type", F.lit("message"))
    below = parents(spark, d).select(F.col("summary_id").alias("item"), F.col("parent_summary_id").alias("id")).join(s, "id", "left").withColumn("item_type", F.lit("summary"))
    return own.unionByName(below)


# Aggregates


@query(f"WITH {SU} SELECT memory_tier, count(*)::BIGINT AS n, sum(coalesce(token_count, 0))::BIGINT AS tokens FROM s GROUP BY 1")
def a1_tiers(spark, d):
    return sums(spark, d).groupBy("memory_tier").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"))


@query(f"WITH {M}, {N}, {SU} SELECT (SELECT count(*) FROM m)::BIGINT AS messages, (SELECT count(*) FROM n)::BIGINT AS notes, (SELECT count(*) FROM s)::BIGINT AS summaries, (SELECT count(DISTINCT entity_id) FROM entities)::BIGINT AS entities")
def a2_status(spark, d):
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(msgs(spark, d), "messages").join(count(notes(spark, d), "notes")).join(count(sums(spark, d), "summaries")).join(table(spark, d, "entities").agg(F.countDistinct("entity_id").alias("entities")))


@query(f"WITH {M} SELECT conversation_id, count(*)::BIGINT AS n, sum(coalesce(token_count, 0))::BIGINT AS tokens FROM m GROUP BY 1")
def a3_conversation_stats(spark, d):
    return msgs(spark, d).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"))


@query(f"WITH {M} SELECT conversation_id, count(*) FILTER (WHERE lower(trim(role, ' ')) IN ('user', 'human', '用户'))::BIGINT AS turns FROM m GROUP BY 1")
def a4_turns(spark, d):
    return msgs(spark, d).groupBy("conversation_id").agg(F.count_if(F.lower(F.trim("role")).isin("user", "human", "用户")).alias("turns"))


@query(f"WITH {M} SELECT conversation_id, round(least(sum({TOK}) / 4000.0::DOUBLE, 1.0::DOUBLE), 6) AS usage FROM m GROUP BY 1")
def a5_usage(spark, d):
    return msgs(spark, d).groupBy("conversation_id").agg(F.round(F.least(F.sum(tok()) / 4000.0, F.lit(1.0)), 6).alias("usage"))


@query(f"WITH {M}, {SU}, a AS (SELECT conversation_id, sum({TOK})::BIGINT tokens FROM m GROUP BY 1), b AS (SELECT conversation_id, count(*)::BIGINT n FROM s GROUP BY 1) SELECT a.conversation_id, tokens, coalesce(n, 0) AS summaries, tokens >= 3000 AS needs FROM a LEFT JOIN b USING (conversation_id)")
def a7_monitor(spark, d):
    a = msgs(spark, d).groupBy("conversation_id").agg(F.sum(tok()).alias("tokens"))
    b = sums(spark, d).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))
    return a.join(b, "conversation_id", "left").select("conversation_id", "tokens", F.coalesce("n", F.lit(0)).alias("summaries"), (F.col("tokens") >= 3000).alias("needs"))


@query(f"WITH {M}, {N} SELECT 'messages' AS what, count(*) FILTER (WHERE owner IN ('agent_main', 'public'))::BIGINT AS visible, count(*)::BIGINT AS total FROM m UNION ALL SELECT 'notes', count(*) FILTER (WHERE owner IN ('agent_main', 'public'))::BIGINT, count(*)::BIGINT FROM n")
def a8_viewer_stats(spark, d):
    one = lambda df, name: df.agg(F.lit(name).alias("what"), F.count_if(F.col("owner").isin("agent_main", "public")).alias("visible"), F.count(F.lit(1)).alias("total"))
    return one(msgs(spark, d), "messages").unionByName(one(notes(spark, d), "notes"))


@query("SELECT entity_name, sum(mention_count)::BIGINT AS n FROM entities GROUP BY 1 ORDER BY n DESC, entity_name LIMIT 10")
def a11_top_entities(spark, d):
    return table(spark, d, "entities").groupBy("entity_name").agg(F.sum("mention_count").alias("n")).orderBy(F.desc("n"), "entity_name").limit(10)


@query(f"WITH {M}, {SM} SELECT summary_id, count(*) FILTER (WHERE role = 'user')::BIGINT AS users, count(*) FILTER (WHERE role = 'assistant')::BIGINT AS assistants, count(*) FILTER (WHERE role = 'tool')::BIGINT AS tools FROM sm JOIN m USING (message_id) GROUP BY 1")
def a12_role_counts(spark, d):
    j = leaves(spark, d).join(msgs(spark, d), "message_id")
    return j.groupBy("summary_id").agg(*[F.count_if(F.col("role") == r).alias(f"{r}s") for r in ("user", "assistant", "tool")])


@query(f"WITH {SU}, {SP}, u AS (SELECT summary_id, max(descendant_count) dc, min(earliest_at) e, max(latest_at) l FROM s GROUP BY 1) SELECT sp.summary_id, sum(dc)::BIGINT AS descendants, epoch_us(min(e)) AS earliest_us, epoch_us(max(l)) AS latest_us FROM sp JOIN u ON u.summary_id = sp.parent_summary_id GROUP BY 1")
def a13_fan_out(spark, d):
    s = sums(spark, d)
    s = s.withColumn("e", micros(s, "earliest_at")).withColumn("l", micros(s, "latest_at")).groupBy(F.col("summary_id").alias("parent_summary_id")).agg(F.max("descendant_count").alias("dc"), F.min("e").alias("e"), F.max("l").alias("l"))
    return parents(spark, d).join(s, "parent_summary_id").groupBy("summary_id").agg(F.sum("dc").alias("descendants"), F.min("e").alias("earliest_us"), F.max("l").alias("latest_us"))


@query("SELECT event_type, user_id % 3 AS strategy, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def a14_run_log(spark, d):
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 3).alias("strategy")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, round(avg(value), 4) AS mean, count(*)::BIGINT AS n FROM events GROUP BY 1")
def a17_cost_report(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS qty, count(*)::BIGINT AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a18_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))


# Set operations


@query("SELECT message_id AS id FROM messages WHERE message_id IS NOT NULL UNION SELECT summary_id FROM summaries")
def u1_union_ids(spark, d):
    return table(spark, d, "messages").where("message_id IS NOT NULL").select(F.col("message_id").alias("id")).union(table(spark, d, "summaries").select("summary_id")).distinct()


@query("SELECT 0 AS channel, message_id AS id FROM messages WHERE contains(content, 'budget') UNION ALL SELECT 1, note_id FROM notes WHERE contains(content, 'budget')")
def u2_channels(spark, d):
    a = table(spark, d, "messages").where(F.col("content").contains("budget")).select(F.lit(0).alias("channel"), F.col("message_id").alias("id"))
    return a.unionByName(table(spark, d, "notes").where(F.col("content").contains("budget")).select(F.lit(1).alias("channel"), F.col("note_id").alias("id")))


@query("SELECT DISTINCT summary_id, message_id FROM summary_messages")
def u4_distinct_edges(spark, d):
    return leaves(spark, d)


@query("SELECT conversation_id FROM messages INTERSECT SELECT conversation_id FROM notes")
def u5_intersect(spark, d):
    return table(spark, d, "messages").select("conversation_id").intersect(table(spark, d, "notes").select("conversation_id"))


@query("SELECT conversation_id FROM conversations EXCEPT SELECT conversation_id FROM messages")
def u6_except(spark, d):
    return table(spark, d, "conversations").select("conversation_id").subtract(table(spark, d, "messages").select("conversation_id"))


# Sorted cuts


@query("SELECT entity_id, mention_count FROM entities ORDER BY mention_count DESC, entity_id LIMIT 15")
def o3_top_k(spark, d):
    return table(spark, d, "entities").orderBy(F.desc("mention_count"), "entity_id").limit(15).select("entity_id", "mention_count")


@query(f"WITH {SU}, r AS (SELECT summary_id, memory_tier, row_number() OVER (PARTITION BY memory_tier ORDER BY created_at DESC, summary_id) k FROM (SELECT summary_id, memory_tier, max(created_at) created_at FROM s GROUP BY 1, 2)) SELECT summary_id, memory_tier, k AS place FROM r WHERE k <= CASE memory_tier WHEN 'working' THEN 20 WHEN 'episodic' THEN 10 ELSE 5 END")
def o4_tier_top(spark, d):
    """Newest 20, 10 and 5 of the tiers; the ranks of each tier are cut early in every task."""
    s = sums(spark, d).groupBy("summary_id", "memory_tier").agg(F.max("created_at").alias("created_at"))
    w = Window.partitionBy("memory_tier").orderBy(F.desc("created_at"), "summary_id")
    return s.withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 20").where("place <= CASE memory_tier WHEN 'working' THEN 20 WHEN 'episodic' THEN 10 ELSE 5 END").select("summary_id", "memory_tier", "place")


@query(f"WITH {N} SELECT note_id, CASE category WHEN 'decision' THEN 0 WHEN 'constraint' THEN 1 WHEN 'preference' THEN 2 ELSE 3 END AS priority FROM n WHERE superseded_by IS NULL ORDER BY priority, confidence DESC NULLS LAST, note_id LIMIT 50")
def o8_priority(spark, d):
    p = F.when(F.col("category") == "decision", 0).when(F.col("category") == "constraint", 1).when(F.col("category") == "preference", 2).otherwise(3)
    return notes(spark, d).where("superseded_by IS NULL").withColumn("priority", p).orderBy("priority", F.col("confidence").desc_nulls_last(), "note_id").limit(50).select("note_id", "priority")
