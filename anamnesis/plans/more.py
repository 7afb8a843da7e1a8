"""Queries of the remaining scalar functions, recurrences and policies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from anamnesis.functions import scoring as S
from anamnesis.functions import text as T
from anamnesis.functions.content import flatten_blocks, json_text
from anamnesis.operators.chains import neighbours
from anamnesis.operators.ordered import ranked
from anamnesis.plans.relational import M, N, SU, TOK, msgs, notes, sums, tok
from anamnesis.plans.scalar import BLANK, CLASS, HOURS, NOW, SIGNALS, TERMS_SHORT
from anamnesis.plans.windows import MT, timed
from anamnesis.providers import Extractive, summarise
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


PAIRS = MT + """, p AS (SELECT message_id, content, lag(content) OVER (PARTITION BY conversation_id ORDER BY us, ingest_no) pc FROM t)"""


def with_previous(spark, d, item):
    m = timed(spark, d)
    rows = m.select("conversation_id", F.struct("us", "ingest_no", "message_id", item.alias("x")).alias("at"))
    return neighbours(rows, "conversation_id", "at").select("at.message_id", F.col("at.x").alias("a"), F.col("prev.x").alias("b"))


@query(f"""WITH {PAIRS}, x AS (SELECT message_id, list_aggregate({TERMS_SHORT}, 'histogram') ha, list_aggregate({TERMS_SHORT.replace('content', 'pc')}, 'histogram') hb FROM p WHERE content IS NOT NULL AND pc IS NOT NULL),
c AS (SELECT message_id, coalesce(list_sum(list_transform(map_keys(ha), lambda w: ha[w] * coalesce(hb[w], 0))), 0)::DOUBLE dot, coalesce(list_sum(list_transform(map_values(ha), lambda v: v * v)), 0)::DOUBLE na, coalesce(list_sum(list_transform(map_values(hb), lambda v: v * v)), 0)::DOUBLE nb FROM x)
SELECT message_id, CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE round(dot / (sqrt(na) * sqrt(nb)), 6) END AS cosine FROM c""")
def f9_term_cosine(spark, d):
    """Cosine of the term counts of neighbouring messages."""
    counts = F.map_entries(T.counts_of(T.terms_short(F.coalesce("content", F.lit("")))))
    p = with_previous(spark, d, F.when(F.col("content").isNotNull(), counts)).where("a IS NOT NULL AND b IS NOT NULL")
    a, b = F.map_from_entries("a"), F.map_from_entries("b")
    dot = F.aggregate(F.col("a"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at(b, e["key"]), F.lit(0)))
    norm = lambda c: F.sqrt(F.aggregate(F.map_values(c), F.lit(0.0), lambda s, v: s + v * v))
    return p.select("message_id", F.when((F.size("a") == 0) | (F.size("b") == 0), F.lit(0.0)).otherwise(F.round(dot / (norm(a) * norm(b)), 6)).alias("cosine"))


@query(f"WITH {PAIRS}, x AS (SELECT message_id, list_distinct({BLANK}) a, list_distinct({BLANK.replace('content', 'pc')}) b FROM p WHERE content IS NOT NULL AND pc IS NOT NULL) SELECT message_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 6) END AS jaccard FROM x")
def f10_word_jaccard(spark, d):
    p = with_previous(spark, d, F.array_distinct(T.blank_words(F.col("content")))).where("a IS NOT NULL AND b IS NOT NULL")
    return p.select("message_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(f"WITH {PAIRS}, x AS (SELECT message_id, list_distinct(string_split(substring(content, 1, 200), '')) a, list_distinct(string_split(substring(pc, 1, 200), '')) b FROM p WHERE length(content) > 0 AND length(pc) > 0) SELECT message_id, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 6) AS jaccard FROM x")
def f11_character_jaccard(spark, d):
    p = with_previous(spark, d, T.characters(F.col("content"))).where("size(a) > 0 AND size(b) > 0")
    return p.select("message_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("WITH q AS (SELECT embedding e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 5) AS cosine FROM embeddings, q")
def f12_vector_cosine(spark, d):
    df = table(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in df.orderBy("vec_id").select("embedding").first()[0]])
    return df.select("vec_id", F.round(T.cosine(F.col("embedding"), q), 5).alias("cosine"))


@query("SELECT ingest_no, CASE WHEN metadata LIKE '{%' AND json_valid(metadata) THEN json_extract_string(metadata, '$.source') END AS source FROM messages")
def f24_metadata_text(spark, d):
    """A text of the JSON metadata; broken JSON gives null."""
    m = F.col("metadata")
    return table(spark, d, "messages").select("ingest_no", F.when(m.startswith("{") & F.try_parse_json(m).isNotNull(), F.get_json_object(m, "$.source")).alias("source"))


@query()
def f24_flatten_blocks(spark, d):
    """Typed content blocks to text by their type."""
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("toolCall").alias("type"), F.lit(None).cast("string").alias("text"), F.col("role").alias("name")))
    return table(spark, d, "messages").select("ingest_no", flatten_blocks(blocks).alias("text"))


@query()
def f25_json_text(spark, d):
    """All texts inside JSON contents, whatever their depth."""
    m = table(spark, d, "messages").where(T.looks_json(F.col("content")))
    return json_text(m, "ingest_no", "content")


@query(f"WITH {M}, x AS (SELECT message_id, conversation_id, ({CLASS}) c, greatest(10.0 + {SIGNALS}, 1.0) b, {HOURS} h, ingest_no FROM m WHERE content IS NOT NULL AND created_at IS NOT NULL AND conversation_id IS NOT NULL), r AS (SELECT message_id, row_number() OVER (PARTITION BY conversation_id ORDER BY round(b * pow(0.5, h / 2000), 6), ingest_no) k FROM x) SELECT message_id FROM r WHERE k <= 100")
def o5_weakest_hundred(spark, d):
    """The hundred messages of a conversation with the least left."""
    m = msgs(spark, d).where("content IS NOT NULL AND created_at IS NOT NULL AND conversation_id IS NOT NULL")
    left = F.round(F.greatest(10.0 + S.signal_bonus(F.col("content")), F.lit(1.0)) * F.pow(F.lit(0.5), S.hours_between(F.lit(NOW), micros(m, "created_at")) / 2000), 6)
    w = Window.partitionBy("conversation_id").orderBy("left", "ingest_no")
    return m.select("message_id", "conversation_id", "ingest_no", left.alias("left")).withColumn("k", F.row_number().over(w)).where("k <= 100").select("message_id")


@query(f"WITH {SU}, {N}, x AS (SELECT 'summary' kind, summary_id id, memory_tier tier, max(created_at) made FROM s GROUP BY 2, 3 UNION ALL SELECT 'note', note_id, 'semantic', max(created_at) FROM n GROUP BY 2), r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY made DESC NULLS LAST, id) k FROM x) SELECT kind, id, tier FROM r WHERE k <= CASE tier WHEN 'working' THEN 20 WHEN 'episodic' THEN 10 ELSE 5 END")
def l1_context_by_tier(spark, d):
    s = sums(spark, d).groupBy("summary_id", "memory_tier").agg(F.max("created_at").alias("made")).select(F.lit("summary").alias("kind"), F.col("summary_id").alias("id"), F.col("memory_tier").alias("tier"), "made")
    x = s.unionByName(notes(spark, d).select(F.lit("note").alias("kind"), F.col("note_id").alias("id"), F.lit("semantic").alias("tier"), F.col("created_at").alias("made")))
    w = Window.partitionBy("tier").orderBy(F.desc_nulls_last("made"), "id")
    return x.withColumn("k", F.row_number().over(w)).where("k <= 20").where("k <= CASE tier WHEN 'working' THEN 20 WHEN 'episodic' THEN 10 ELSE 5 END").select("kind", "id", "tier")


@query(f"WITH {M}, u AS (SELECT conversation_id, least(sum({TOK}) / 3000.0::DOUBLE, 1.0::DOUBLE) x FROM m GROUP BY 1) SELECT conversation_id, CASE WHEN x >= 0.9 THEN 'heavy' WHEN x >= 0.75 THEN 'medium' WHEN x >= 0.5 THEN 'light' ELSE 'none' END AS preview FROM u")
def l7_preview(spark, d):
    u = msgs(spark, d).groupBy("conversation_id").agg(F.least(F.sum(tok()) / 3000.0, F.lit(1.0)).alias("x"))
    return u.select("conversation_id", F.when(F.col("x") >= 0.9, "heavy").when(F.col("x") >= 0.75, "medium").when(F.col("x") >= 0.5, "light").otherwise("none").alias("preview"))


@query(f"WITH {M}, u AS (SELECT conversation_id, least(sum({TOK}) / 3000.0::DOUBLE, 1.0::DOUBLE) x, count(*) FILTER (WHERE role = 'user') n FROM m GROUP BY 1) SELECT conversation_id, n > 0 AND (n % 12 = 0 OR x > 0.85) OR x >= 0.8 AS due FROM u")
def l9_after_turn(spark, d):
    u = msgs(spark, d).groupBy("conversation_id").agg(F.least(F.sum(tok()) / 3000.0, F.lit(1.0)).alias("x"), F.count_if(F.col("role") == "user").alias("n"))
    return u.select("conversation_id", ((F.col("n") > 0) & ((F.col("n") % 12 == 0) | (F.col("x") > 0.85)) | (F.col("x") >= 0.8)).alias("due"))


