"""Queries of search, fusion, similarity and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from anamnesis.functions import scoring as S
from anamnesis.functions import text as T
from anamnesis.operators import search as R
from anamnesis.operators import similarity as X
from anamnesis.operators.segments import is_user
from anamnesis.operators.stored import stored
from anamnesis.plans.relational import CO, M, SU, convs, msgs, sums
from anamnesis.plans.scalar import CLASS, DECAY, NOW, SIGNALS, TERMS_FULL, TERMS_PAIRS
from anamnesis.session import cut, discard, micros, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def bm25_cte(source: str, doc: str, terms: list[str], x: str = "") -> str:
    """CTEs up to r{x} (doc, score, and place from 1) of the documents that hold every term."""
    inn = ", ".join(f"'{t}'" for t in terms)
    return f"""t{x} AS (SELECT {doc} doc, {TERMS_PAIRS} ts FROM {source} WHERE content IS NOT NULL), c{x} AS (SELECT count(*) docs, avg(len(ts)) mean_len FROM t{x} WHERE len(ts) > 0),
p{x} AS (SELECT doc, len(ts) dl, unnest(ts) term FROM t{x}), f{x} AS (SELECT doc, dl, term, count(*) tf FROM p{x} WHERE term IN ({inn}) GROUP BY 1, 2, 3), g{x} AS (SELECT term, count(*) df FROM f{x} GROUP BY 1),
b{x} AS (SELECT doc, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean_len))), 6) score FROM f{x} JOIN g{x} USING (term), c{x} GROUP BY doc HAVING count(*) = {len(terms)}),
r{x} AS (SELECT doc, score, row_number() OVER (ORDER BY score DESC, doc) place FROM b{x})"""


ONE = "u AS (SELECT summary_id, min(content) content, min(epoch_us(created_at)) us FROM s GROUP BY 1)"


def one_text(df):
    return df.groupBy("summary_id").agg(F.min("content").alias("content"))


def message_index(spark, d):
    """The written postings and size of all messages (last deliveries)."""
    return R.written_index(spark, "messages", [f"{d}/messages.parquet"], lambda: msgs(spark, d).where("content IS NOT NULL"), "message_id", "content")


def summary_index(spark, d):
    return R.written_index(spark, "summaries", [f"{d}/summaries.parquet"], lambda: one_text(sums(spark, d)).where("content IS NOT NULL"), "summary_id", "content")


def placed(index, query: str, limit: int):
    """id, score and place (from 1) of the best documents that hold all terms of a query."""
    hits = R.bm25(*index, R.query_terms(query)).select(F.col("doc").alias("id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    return hits.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


@query(f"WITH {M}, {bm25_cte('m', 'message_id', ['budget', 'tokens'])} SELECT doc AS id, score FROM r WHERE place <= 20")
def r1_search_messages(spark, d):
    """Messages that hold all words, best first, off the written index."""
    return placed(message_index(spark, d), "Budget, tokens?", 20).select("id", "score")


@query(f"WITH {SU}, {ONE}, {bm25_cte('u', 'summary_id', ['budget'])} SELECT doc AS id, score FROM r WHERE place <= 20")
def r2_search_summaries(spark, d):
    return placed(summary_index(spark, d), "budget", 20).select("id", "score")


@query("""WITH x AS (SELECT ingest_no, list_filter(regexp_split_to_array(content, '[ \t\n\r\f\v]+'), lambda w: w <> '') ws FROM notes), y AS (SELECT *, list_position(list_transform(ws, lambda w: regexp_matches(w, '(?i)(budget)')), true) pos FROM x), z AS (SELECT *, greatest(pos - 4, 1) s FROM y WHERE pos > 0)
SELECT ingest_no, CASE WHEN s > 1 THEN '...' ELSE '' END || array_to_string(list_transform(ws[s:s + 9], lambda w: regexp_replace(w, '(?i)(budget)', '>>>\\1<<<', 'g')), ' ') || CASE WHEN s + 10 <= len(ws) THEN '...' ELSE '' END AS snippet FROM z""")
def r3_snippets(spark, d):
    """Ten words around the first hit."""
    n = table(spark, d, "notes")
    return n.select("ingest_no", R.snippet_tokens(F.col("content"), ["budget"]).alias("snippet")).where("snippet IS NOT NULL")


GREP_COSINE = """coalesce(list_sum(list_transform(list_distinct(q), lambda w: len(list_filter(q, lambda v: v = w)) * len(list_filter(ts, lambda v: v = w))))::DOUBLE
  / nullif(sqrt(list_sum(list_transform(list_distinct(q), lambda w: len(list_filter(q, lambda v: v = w)) ** 2))) * sqrt(list_sum(list_transform(list_distinct(ts), lambda w: len(list_filter(ts, lambda v: v = w)) ** 2))), 0), 0)"""


def grep_sql() -> str:
    full = TERMS_FULL
    return f"""WITH {M}, {SU}, {ONE}, {bm25_cte('m', 'message_id', ['budget'], '1')}, {bm25_cte('u', 'summary_id', ['budget'], '2')}, {IDF.replace('t AS (', 'ti AS (', 1).replace('FROM t)', 'FROM ti)').replace('unnest(ts) term FROM t)', 'unnest(ts) term FROM ti)')},
x AS (SELECT ingest_no, avg(idf) * 10 s FROM (SELECT ingest_no, unnest(ts) term FROM ti) JOIN idf USING (term) GROUP BY 1),
h AS (SELECT 'message' AS type, 0 AS o, r1.doc AS id, r1.place, round(coalesce(x.s, 0), 2) tfidf, m.content FROM r1 JOIN m ON m.message_id = r1.doc LEFT JOIN x USING (ingest_no) WHERE r1.place <= 10
  UNION ALL SELECT 'summary', 1, r2.doc, r2.place, 0, u.content FROM r2 JOIN u ON u.summary_id = r2.doc WHERE r2.place <= 10),
k AS (SELECT type, o, id, place, tfidf, ['budget'] q, {full} ts FROM h),
v AS (SELECT type, o, id, place, round(CASE WHEN o = 0 THEN 0.4::DOUBLE * (tfidf::DOUBLE / 100.0::DOUBLE) + 0.3::DOUBLE * (1.0::DOUBLE / place) ELSE 0.7::DOUBLE * (1.0::DOUBLE / place) END + 0.3::DOUBLE * {GREP_COSINE}, 3) relevance FROM k)
SELECT type, id, relevance FROM v ORDER BY relevance DESC, o, place LIMIT 10"""


def text_cosine(query: str, text):
    """Cosine of the full terms of a query and of a text, 0 without terms."""
    asked = T.counts_of(T.terms_full(F.lit(query)))
    norm = lambda c: F.sqrt(F.aggregate(F.map_values(c), F.lit(0).cast("bigint"), lambda s, v: s + v * v))
    return T.let(F.struct(asked.alias("q"), T.counts_of(T.terms_full(text)).alias("t")), lambda x: F.when((F.size(x["q"]) == 0) | (F.size(x["t"]) == 0), F.lit(0.0)).otherwise(
        F.aggregate(F.map_entries(x["q"]), F.lit(0).cast("bigint"), lambda s, e: s + e["value"] * F.coalesce(F.element_at(x["t"], e["key"]), F.lit(0))) / (norm(x["q"]) * norm(x["t"]))))


def grep(spark, d, words: str, limit: int = 10):
    """Messages and summaries: the first ``limit`` hits of each by place, blended with stored term weight and cosine, sorted again."""
    m = placed(message_index(spark, d), words, 2 * limit).where(F.col("place") <= limit)
    m = m.join(msgs(spark, d).select(F.col("message_id").alias("id"), "ingest_no", "content"), "id").join(stored_scores(spark, d).select("ingest_no", "tfidf"), "ingest_no", "left")
    u = placed(summary_index(spark, d), words, 2 * limit).where(F.col("place") <= limit).join(one_text(sums(spark, d)).withColumnRenamed("summary_id", "id"), "id")
    near = lambda: 0.3 * text_cosine(words, F.col("content"))
    a = m.select(F.lit("message").alias("type"), "id", "place", F.round(0.4 * (F.coalesce("tfidf", F.lit(0.0)) / 100.0) + 0.3 * (1.0 / F.col("place")) + near(), 3).alias("relevance"))
    b = u.select(F.lit("summary").alias("type"), "id", "place", F.round(0.7 * (1.0 / F.col("place")) + near(), 3).alias("relevance"))
    return a.unionByName(b).orderBy(F.desc("relevance"), "type", "place").limit(limit)


@query(f"WITH {M}, {CO} SELECT m.message_id, c.namespace FROM m JOIN c USING (conversation_id) WHERE list_contains({TERMS_PAIRS}, 'budget')")
def j1_messages_of_term(spark, d):
    """Postings of a term joined with messages and conversations."""
    hits = R.of_terms(message_index(spark, d)[0], ["budget"]).select(F.col("doc").alias("message_id"))
    return hits.join(msgs(spark, d).select("message_id", "conversation_id"), "message_id").join(convs(spark, d), "conversation_id").select("message_id", "namespace")


@query(f"WITH {SU}, {CO} SELECT DISTINCT s.summary_id, c.namespace FROM s JOIN (SELECT summary_id FROM (SELECT summary_id, min(content) content FROM s GROUP BY 1) WHERE list_contains({TERMS_PAIRS}, 'budget')) USING (summary_id) JOIN c USING (conversation_id)")
def j2_summaries_of_term(spark, d):
    hits = R.of_terms(summary_index(spark, d)[0], ["budget"]).select(F.col("doc").alias("summary_id"))
    return hits.join(sums(spark, d).select("summary_id", "conversation_id"), "summary_id").join(convs(spark, d), "conversation_id").select("summary_id", "namespace").distinct()


def first_vector(spark, d):
    return list(table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0])


VEC = "WITH q AS (SELECT embedding e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) score FROM embeddings, q)"


@query(f"{VEC} SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10")
def r5_vector_top(spark, d):
    return R.vector_top(table(spark, d, "embeddings"), "vec_id", "embedding", first_vector(spark, d), 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"{VEC} SELECT vec_id, score FROM s JOIN embeddings USING (vec_id) WHERE label = (SELECT min(label) FROM embeddings) ORDER BY score DESC, vec_id LIMIT 10")
def r5_vector_filtered(spark, d):
    """The nearest among the vectors of one type (their label)."""
    v = table(spark, d, "embeddings")
    return R.vector_top(v.join(F.broadcast(v.agg(F.min("label").alias("label"))), "label"), "vec_id", "embedding", first_vector(spark, d), 10).select("vec_id", F.round("score", 6).alias("score"))


PROJ = lambda source, doc, kind: f"""SELECT '{kind}' AS type, {doc} id, dim, sum(v) v FROM (SELECT {doc}, e % 64 dim, CASE WHEN (e // 64) % 2 = 0 THEN 1 ELSE -1 END v FROM (SELECT {doc}, ('0x' || substring(md5(unnest({TERMS_PAIRS})), 1, 3))::INT e FROM {source} WHERE content IS NOT NULL)) GROUP BY ALL HAVING sum(v) <> 0"""


def projection_table(spark, d):
    """Written projections of all messages and summaries."""
    def build():
        m = msgs(spark, d).select(F.lit("message").alias("type"), F.col("message_id").alias("id"), "content")
        return R.projections(m.unionByName(one_text(sums(spark, d)).select(F.lit("summary").alias("type"), F.col("summary_id").alias("id"), "content")), ["type", "id"], "content")

    return stored(spark, "projections", [f"{d}/messages.parquet", f"{d}/summaries.parquet"], build)


QUERY_VECTOR = "z AS (SELECT e % 64 dim, sum(CASE WHEN (e // 64) % 2 = 0 THEN 1 ELSE -1 END) w FROM (SELECT ('0x' || substring(md5(unnest(['budget', 'tokens'])), 1, 3))::INT e) GROUP BY 1)"
RRF = f"""{bm25_cte('m', 'message_id', ['budget', 'tokens'], '1')}, {bm25_cte('u', 'summary_id', ['budget', 'tokens'], '2')},
vec AS ({PROJ('m', 'message_id', 'message')} UNION ALL {PROJ('u', 'summary_id', 'summary')}), {QUERY_VECTOR},
near AS (SELECT type, id, round(coalesce(sum(v * w), 0) / (sqrt(sum(v * v)) * (SELECT sqrt(sum(w * w)) FROM z)), 6) sc FROM vec LEFT JOIN z USING (dim) GROUP BY 1, 2),
nr AS (SELECT type, id, row_number() OVER (ORDER BY sc DESC, type, id) - 1 place FROM near QUALIFY place < 50),
ch AS (SELECT 0 channel, 'message' AS type, doc id, place - 1 place FROM r1 WHERE place <= 50
  UNION ALL SELECT 0, 'summary', doc, place - 1 + least(50, (SELECT count(*) FROM r1)) FROM r2 WHERE place <= 50 UNION ALL SELECT 1, type, id, place FROM nr),
f AS (SELECT type, id, sum(1.0::DOUBLE / (60 + place + 1)) score, min(channel) first_channel FROM ch GROUP BY 1, 2)"""
WORDS = "budget tokens"


def channels(spark, d, words: str = WORDS):
    """channel (0: words, messages before summaries; 1: vectors), type, id, place from 0 of the first 50 of each search."""
    a = placed(message_index(spark, d), words, 50)
    b = placed(summary_index(spark, d), words, 50)
    n = a.agg(F.count(F.lit(1)).alias("n"))
    v = R.projection_top(projection_table(spark, d), ["type", "id"], words, 50)
    return (
        a.select(F.lit(0).alias("channel"), F.lit("message").alias("type"), "id", (F.col("place") - 1).alias("place"))
        .unionByName(b.join(n).select(F.lit(0).alias("channel"), F.lit("summary").alias("type"), "id", (F.col("place") - 1 + F.col("n")).alias("place")))
        .unionByName(v.select(F.lit(1).alias("channel"), "type", "id", (F.row_number().over(Window.orderBy(F.desc("score"), "type", "id")) - 1).alias("place")))
    )


@query(f"WITH {M}, {SU}, {ONE}, {RRF} SELECT type, id, round(score, 8) AS score, first_channel FROM f")
def r6_fusion(spark, d):
    """Reciprocal ranks of word search (messages, then summaries) and of vector search."""
    return R.reciprocal_ranks(channels(spark, d), key=["type", "id"]).select("type", "id", F.round("score", 8).alias("score"), "first_channel")


def fused_texts(spark, d, words: str = WORDS):
    """Fused hits with content and age in days; hits of the vector search alone have neither."""
    fused = cut(R.reciprocal_ranks(channels(spark, d, words), key=["type", "id"]))
    m = msgs(spark, d)
    m = m.select(F.lit("message").alias("type"), F.col("message_id").alias("id"), "content", micros(m, "created_at").alias("us"))
    s = sums(spark, d)
    s = s.select("summary_id", "content", micros(s, "created_at").alias("us")).groupBy("summary_id").agg(F.min("content").alias("content"), F.min("us").alias("us"))
    texts = m.unionByName(s.select(F.lit("summary").alias("type"), F.col("summary_id").alias("id"), "content", "us"))
    words_first = F.col("first_channel") == 0
    return cut(fused.join(texts, ["type", "id"], "left").select(
        F.concat_ws(":", "type", "id").alias("id"), "score", F.when(words_first, F.col("content")).otherwise("").alias("content"), F.when(words_first, (F.lit(NOW) - F.col("us")) / 8.64e10).alias("days"),
    ))


@query()
def r7_diversify(spark, d):
    """The first twelve of the fused hits by score against likeness to what is chosen."""
    return R.diversify(fused_texts(spark, d).select(F.lit(WORDS).alias("query"), "id", "score", "content"), k=12)


def hybrid(hits, k: int = 6, least: float = 0.45):
    """id, place, share of fused hits (id, score, content, days): diversity, fading by age, share of the best, the first k in the order of diversity."""
    chosen = R.diversify(hits.select(F.lit("").alias("query"), "id", "score", "content"), k=2 * k)
    faded = cut(chosen.join(hits.select("id", "score", "days"), "id").withColumn("score", F.col("score") * S.recall_decay(F.col("days"))))
    best = faded.agg(F.max("score").alias("best"))
    return faded.join(F.broadcast(best)).where(f"score / best >= {least}").orderBy("place").limit(k).select("id", "place", F.round(F.col("score") / F.col("best"), 6).alias("share"))


@query()
def r8_hybrid(spark, d):
    """Word and vector search, fusion, diversity, fading by age, share of the best, the first six."""
    return hybrid(fused_texts(spark, d))


@query(f"SELECT type, id, dim::INT AS dim, v::BIGINT AS value FROM ({PROJ('notes', 'ingest_no', 'note')})")
def r9_hashed_embedding(spark, d):
    """The stand-in for a remote embedder: a hashed projection of the terms, near for texts with common terms."""
    return R.projections(table(spark, d, "notes").select(F.lit("note").alias("type"), F.col("ingest_no").alias("id"), "content"), ["type", "id"], "content")


# Term statistics

IDF = f"t AS (SELECT ingest_no, {TERMS_FULL} ts, content, created_at FROM messages WHERE content IS NOT NULL), n AS (SELECT count(*) n FROM t), df AS (SELECT term, count(*) df FROM (SELECT DISTINCT ingest_no, unnest(ts) term FROM t) GROUP BY 1), idf AS (SELECT term, df, ln((n + 1) / (df + 1)) + 1 AS idf FROM df, n)"


def idf_of(spark, d):
    t = table(spark, d, "messages").where("content IS NOT NULL").select("ingest_no", T.terms_full(F.col("content")).alias("ts"))
    n = t.agg(F.count(F.lit(1)).alias("n"))
    df = t.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return t, df.join(F.broadcast(n)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


#: Most frequent terms whose weights go to every task.
HOT_TERMS = 100_000


def mean_weight(tokens, idf):
    """ingest_no, mean: the mean weight of the tokens (ingest_no, term) of each text.

    The weights of the most frequent terms are broadcast, so that hot terms meet
    their weight where they stand; only terms beyond them are shuffled.
    """
    hot = idf.orderBy(F.desc("df"), "term").limit(HOT_TERMS).select("term", "idf")
    met = tokens.join(F.broadcast(hot), "term", "left")
    sums = met.groupBy("ingest_no").agg(F.sum("idf").alias("s"), F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("idf").isNull(), F.col("term"))).alias("rare"))
    if idf.count() <= HOT_TERMS:
        return sums.select("ingest_no", (F.col("s") / F.col("n")).alias("mean"))
    sums = cut(sums)
    rest = sums.select("ingest_no", F.explode("rare").alias("term")).join(idf.select("term", "idf"), "term").groupBy("ingest_no").agg(F.sum("idf").alias("r"))
    return sums.join(rest, "ingest_no", "left").select("ingest_no", ((F.coalesce("s", F.lit(0.0)) + F.coalesce("r", F.lit(0.0))) / F.col("n")).alias("mean"))


@query(f"WITH {IDF} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM idf")
def a9_document_frequency(spark, d):
    return idf_of(spark, d)[1].select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {IDF}, w AS (SELECT ingest_no, unnest(ts) term FROM t), x AS (SELECT ingest_no, avg(idf) * 10 s FROM w JOIN idf USING (term) GROUP BY 1) SELECT ingest_no, round(coalesce(s, 0), 2) AS tfidf, ({SIGNALS})::BIGINT AS bonus, {CLASS} AS class, round(greatest(0.0, round(coalesce(s, 0), 2) + {SIGNALS} + {DECAY}), 2) AS final FROM t LEFT JOIN x USING (ingest_no)")
def t1_score_and_tag(spark, d):
    """Term weight, bonus, class and final score of every message."""
    t, idf = idf_of(spark, d)
    s = mean_weight(t.select("ingest_no", F.explode("ts").alias("term")), cut(idf)).select("ingest_no", (F.col("mean") * 10).alias("s"))
    m = table(spark, d, "messages").where("content IS NOT NULL")
    m = m.select("ingest_no", "content", S.hours_between(F.lit(NOW), micros(m, "created_at")).alias("hours")).join(s, "ingest_no", "left")
    c, tfidf = F.col("content"), F.round(F.coalesce("s", F.lit(0.0)), 2)
    return m.select("ingest_no", tfidf.alias("tfidf"), S.signal_bonus(c).alias("bonus"), S.message_class(c).alias("class"), F.round(F.greatest(F.lit(0.0), tfidf + S.signal_bonus(c) + S.age_decay(F.col("hours"))), 2).alias("final"))


def stored_scores(spark, d):
    """The scores of all messages, written once."""
    return stored(spark, "scores", [f"{d}/messages.parquet"], lambda: t1_score_and_tag(spark, d))


@query(grep_sql())
def r4_grep(spark, d):
    return grep(spark, d, "budget").select("type", "id", "relevance")


@query(f"WITH {M} SELECT conversation_id, sum(coalesce(token_count, 0))::BIGINT AS tokens, count(*) FILTER (WHERE content IS NOT NULL AND ({CLASS}) IN ('decision', 'config', 'code', 'error'))::BIGINT AS exempt, count(*)::BIGINT AS n FROM m WHERE conversation_id IS NOT NULL GROUP BY 1")
def flagship_usage(spark, d):
    """Tokens, exempt messages and size of every conversation."""
    m = msgs(spark, d).where("conversation_id IS NOT NULL")
    return m.groupBy("conversation_id").agg(F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"), F.count_if(F.col("content").isNotNull() & S.exempt(S.message_class(F.col("content")))).alias("exempt"), F.count(F.lit(1)).alias("n"))


# Similarity

NOTE_TEXTS = f"x AS (SELECT content, min(note_id) id FROM notes WHERE content IS NOT NULL GROUP BY 1), t AS (SELECT id || '|' || md5(content) id, {TERMS_PAIRS} ts FROM x), v AS (SELECT id, term, count(*) tf FROM (SELECT id, unnest(ts) term FROM t) GROUP BY 1, 2)"


def note_texts(spark, d):
    x = table(spark, d, "notes").where("content IS NOT NULL").groupBy("content").agg(F.min("note_id").alias("id"))
    return x.select(F.concat("id", F.lit("|"), F.md5("content")).alias("id"), T.terms_pairs(F.col("content")).alias("terms"), "content")


@query(f"WITH {NOTE_TEXTS}, n AS (SELECT id, sum(tf * tf) norm FROM v GROUP BY 1), p AS (SELECT a.id id_a, b.id id_b, sum(a.tf * b.tf) dot FROM v a JOIN v b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2) SELECT id_a, id_b, dot::BIGINT AS dot FROM p JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE dot::HUGEINT * dot * 10000 > a.norm::HUGEINT * b.norm * 6724")
def j10_cosine_pairs(spark, d):
    return X.cosine_pairs(note_texts(spark, d).select("id", "terms"), 82, 100)


@query(f"WITH {NOTE_TEXTS}, n AS (SELECT id, count(*) k FROM v GROUP BY 1), p AS (SELECT a.id id_a, b.id id_b, count(*) shared FROM v a JOIN v b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2) SELECT id_a, id_b, shared::INT AS shared, (a.k + b.k - shared)::INT AS united FROM p JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE shared * 5 > (a.k + b.k - shared) * 4")
def u3_jaccard_pairs(spark, d):
    return X.jaccard_pairs(note_texts(spark, d).select("id", "terms"), 4, 5, strict=True)


@query()
def t2_deduplicate(spark, d):
    """Messages (last deliveries, by conversation) and notes that a greedy pass removes: above 0.82, the lower score goes.

    Exempt messages and those of fewer than 3 terms stay; ties go to the earlier message.
    """
    return duplicate_messages(spark, d).unionByName(duplicate_notes(spark, d))


def duplicate_messages(spark, d):
    """Messages that a greedy pass over each conversation removes, by final score, time and arrival."""
    m = msgs(spark, d).where("content IS NOT NULL")
    m = m.select("conversation_id", "message_id", "ingest_no", "content", F.coalesce(micros(m, "created_at"), F.lit(2**63 - 1)).alias("us"))
    scored = m.join(stored_scores(spark, d).select("ingest_no", "class", "final"), "ingest_no")
    # Texts in the order of the numbers: 16 digits each, the sign turned over.
    digits = lambda c: F.lpad(F.hex(F.col(c).cast("bigint").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    items = scored.select(F.coalesce("conversation_id", F.lit("")).alias("grp"), F.col("message_id").alias("id"), T.terms_pairs(F.col("content")).alias("terms"), F.col("final").alias("score"), F.concat(digits("us"), digits("ingest_no")).alias("place"), S.exempt(F.col("class")).alias("exempt"))
    return X.alike_removed(items, 82, 100, 3)


def duplicate_notes(spark, d):
    """Notes that a greedy pass over all of them removes, by signals and id."""
    texts = cut(note_texts(spark, d))
    gone = X.removed_among(texts.select(F.lit("").alias("grp"), "id", "terms", F.col("id").alias("place"), "content"), 82, 100, S.signal_bonus(F.col("content")).cast("double"))
    discard(texts)
    return gone.select("id")


@query("SELECT ingest_no, row_number() OVER (PARTITION BY lower(trim(content, ' ')) ORDER BY ingest_no) = 1 AS kept FROM notes WHERE content IS NOT NULL")
def t3_exact_fallback(spark, d):
    """Equal texts after trimming and lower case: the first is kept (found by an aggregate, so hot texts are no hot task)."""
    n = table(spark, d, "notes").where("content IS NOT NULL").select("ingest_no", F.sha2(F.lower(F.trim("content")), 256).alias("k"))
    first = n.groupBy("k").agg(F.min("ingest_no").alias("ingest_no")).select("ingest_no", F.lit(True).alias("kept"))
    return n.join(first, "ingest_no", "left").select("ingest_no", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3")
def t3_embedding_neighbours(spark, d):
    """Vectors near a stated query set (ids divisible by 100), in blocks of the queries against all rows."""
    return R.near_queries(table(spark, d, "embeddings"), "vec_id", "embedding", "vec_id % 100 = 0", 0.3)


@query()
def t3_embedding_removed(spark, d):
    """Vectors that a greedy pass removes as they are nearer than 0.85 to an earlier one that stays."""
    v = table(spark, d, "embeddings")
    pairs = cut(X.near_vectors(v, "vec_id", "embedding", 0.85).select("id_a", "id_b"))
    groups = cut(X.components(pairs))
    items = groups.select(F.col("root").alias("grp"), "id", F.lit(1.0).alias("score"), F.col("id").alias("place"))
    return X.greedy_removal(pairs.join(groups.toDF("id_a", "grp"), "id_a").select("grp", "id_a", "id_b"), items).select(F.col("id").alias("vec_id"))


@query(f"WITH {M}, x AS (SELECT message_id, regexp_extract_all(content, '[a-z]+') w FROM m WHERE lower(role) = 'tool' AND content IS NOT NULL), v AS (SELECT DISTINCT message_id, unnest(w) t FROM x), n AS (SELECT message_id, count(*) k FROM v GROUP BY 1), p AS (SELECT a.message_id id_a, b.message_id id_b, count(*) shared FROM v a JOIN v b ON a.t = b.t AND a.message_id < b.message_id GROUP BY 1, 2) SELECT id_a, id_b FROM p JOIN n a ON a.message_id = id_a JOIN n b ON b.message_id = id_b WHERE shared * 5 > (a.k + b.k - shared) * 4")
def t6_tool_repeats(spark, d):
    """Tool messages that nearly repeat each other, by word sets above 0.8."""
    m = msgs(spark, d).where("lower(role) = 'tool' AND content IS NOT NULL")
    return X.jaccard_pairs(m.select(F.col("message_id").alias("id"), F.regexp_extract_all("content", F.lit("[a-z]+"), F.lit(0)).alias("terms")), 4, 5, strict=True).select("id_a", "id_b")




@query()
def t6_role_repeats(spark, d):
    """Messages of every role but user and assistant (under any of their names), each with the number of its repeats:
    the first of those whose words between white space are alike above 0.8 stays.

    ``t6_tool_repeats`` gives only pairs of one role, as its SQL does.  Without a role it is 'unknown'.
    """
    role = F.coalesce(F.lower(F.trim("role")), F.lit("unknown"))
    m = msgs(spark, d).where(~is_user(F.col("role")) & ~role.isin("assistant", "ai", "model", "bot", "助手"))
    items = m.select(role.alias("grp"), F.col("message_id").alias("id"), F.coalesce(T.blank_words(F.col("content")), F.array().cast("array<string>")).alias("terms"), F.col("ingest_no").alias("place"))
    return X.first_and_repeats(items, 4, 5).select("id", F.col("grp").alias("role"), "repeat_count")
