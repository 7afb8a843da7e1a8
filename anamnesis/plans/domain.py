"""Queries of the graph, notes, entities, skills, assembly and legacy pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from anamnesis.functions import lexicons as L
from anamnesis.functions import scoring as S
from anamnesis.functions import text as T
from anamnesis.operators import dag
from anamnesis.operators.ordered import ranked, running_sums
from anamnesis.plans.relational import M, N, SM, SP, SU, TOK, leaves, msgs, notes, parents, sums, tok
from anamnesis.plans.scalar import CLASS, HOURS, NOW, SIGNALS, q
from anamnesis.plans.windows import MT, T19_SQL, timed
from anamnesis.session import cut, micros, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Graph

EXPAND = f"""WITH RECURSIVE {SU}, {SP}, {SM}, {M}, e AS (
  SELECT summary_id root, summary_id node, 0 lev FROM (SELECT DISTINCT summary_id FROM s WHERE depth >= 2)
  UNION SELECT root, parent_summary_id, lev + 1 FROM e JOIN sp ON sp.summary_id = e.node WHERE lev < 3),
k AS (SELECT root, node, min(lev) lev FROM e GROUP BY 1, 2)"""


def expanded(spark, d):
    roots = sums(spark, d).where("depth >= 2").select(F.col("summary_id").alias("node"))
    edges = parents(spark, d).select(F.col("summary_id").alias("above"), F.col("parent_summary_id").alias("below"))
    return cut(dag.expand(roots, edges, 3))


@query(f"{EXPAND} SELECT root, node, lev AS level FROM k")
def g1_expand(spark, d):
    return expanded(spark, d).select("root", "node", "level")


@query(f"{EXPAND}, o AS (SELECT DISTINCT root, message_id FROM k JOIN sm ON sm.summary_id = k.node) SELECT o.root, o.message_id, m.seq FROM o JOIN m USING (message_id)")
def g1_expand_messages(spark, d):
    own = expanded(spark, d).join(leaves(spark, d), F.col("node") == F.col("summary_id")).select("root", "message_id").distinct()
    return own.join(msgs(spark, d), "message_id").select("root", "message_id", "seq")


WORD = "[A-Za-z0-9_-]+"


def named_messages(m, names):
    """message_id, name of the messages that hold a name, beginning with a whole word: equi-joined on the name's first word."""
    keyed = names.select("name", F.regexp_extract("name", WORD, 0).alias("word")).where("word <> ''").distinct()
    words = m.where("content IS NOT NULL").select("message_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(WORD), F.lit(0)))).alias("word"))
    met = words.join(keyed, "word").select("message_id", "name")
    return met.join(m.select("message_id", "content"), "message_id").where(F.col("content").contains(F.col("name"))).select("message_id", "name").distinct()


@query(f"{EXPAND}, o AS (SELECT DISTINCT root, message_id FROM k JOIN sm ON sm.summary_id = k.node), en AS (SELECT DISTINCT entity_name FROM entities WHERE entity_type = 'project'), h AS (SELECT message_id, content, unnest(list_distinct(regexp_extract_all(content, '{WORD}'))) w FROM m WHERE content IS NOT NULL) SELECT DISTINCT o.root, o.message_id, en.entity_name AS name FROM o JOIN h USING (message_id) JOIN en ON regexp_extract(en.entity_name, '{WORD}') = h.w AND contains(h.content, en.entity_name)")
def g2_expand_by_entity(spark, d):
    """Summaries expanded down to the messages that name a known project."""
    own = expanded(spark, d).join(leaves(spark, d), F.col("node") == F.col("summary_id")).select("root", "message_id").distinct()
    names = table(spark, d, "entities").where("entity_type = 'project' AND entity_name IS NOT NULL").select(F.col("entity_name").alias("name"))
    below = own.select("message_id").distinct()
    hits = named_messages(msgs(spark, d).join(below, "message_id", "left_semi"), names)
    return own.join(hits, "message_id").select("root", "message_id", "name")


@query(f"WITH {SP}, {SM} SELECT coalesce(a.summary_id, b.summary_id) AS summary_id, coalesce(a.n, 0)::BIGINT AS summaries, coalesce(b.n, 0)::BIGINT AS messages FROM (SELECT summary_id, count(*) n FROM sp GROUP BY 1) a FULL JOIN (SELECT summary_id, count(*) n FROM sm GROUP BY 1) b USING (summary_id)")
def g3_describe(spark, d):
    a = parents(spark, d).groupBy("summary_id").agg(F.count(F.lit(1)).alias("a"))
    b = leaves(spark, d).groupBy("summary_id").agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "summary_id", "full").select("summary_id", F.coalesce("a", F.lit(0)).alias("summaries"), F.coalesce("b", F.lit(0)).alias("messages"))


@query(f"WITH {SU} SELECT conversation_id, count(DISTINCT summary_id)::BIGINT AS summaries, max(depth) AS deepest FROM s GROUP BY 1")
def g4_describe_conversation(spark, d):
    return sums(spark, d).groupBy("conversation_id").agg(F.countDistinct("summary_id").alias("summaries"), F.max("depth").alias("deepest"))


def leaf_rows(spark, d):
    return sums(spark, d).where("depth = 0 AND conversation_id IS NOT NULL").groupBy("conversation_id", "summary_id").agg(
        F.min("created_at").alias("made"), F.max(F.coalesce("descendant_count", F.lit(0))).alias("descendants"), F.min("content").alias("content")
    ).withColumn("depth", F.lit(0)).select("conversation_id", "depth", "summary_id", "made", "descendants", "content")


T9 = f"""WITH {SU}, u AS (SELECT conversation_id, summary_id, min(created_at) made, max(coalesce(descendant_count, 0)) dc, coalesce(min(content), '') c FROM s WHERE depth = 0 AND conversation_id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY made, summary_id) rk FROM u)
SELECT conversation_id, 'sum_' || substring(sha256(string_agg(summary_id, ',' ORDER BY rk)), 1, 16) AS summary_id, sum(dc)::BIGINT AS descendants, substring(string_agg(c, chr(10) ORDER BY rk), 1, 800) AS content FROM r GROUP BY conversation_id, (rk - 1) // 4 HAVING count(*) = 4"""


@query(T9)
def t9_condense(spark, d):
    return dag.condense(leaf_rows(spark, d)).select("conversation_id", "summary_id", "descendants", "content")


@query(f"WITH {SM}, {M}, r AS (SELECT sm.summary_id, m.role, m.content, row_number() OVER (PARTITION BY sm.summary_id ORDER BY m.ingest_no) k FROM sm JOIN m USING (message_id)) SELECT summary_id, '[' || count(*) || ' messages, ' || count(*) FILTER (WHERE role = 'user') || ' user]' || chr(10) || string_agg(coalesce(role, '?') || ': ' || CASE WHEN length(content) > 100 THEN substring(content, 1, 100) || '...' ELSE coalesce(content, '') END, chr(10) ORDER BY k) FILTER (WHERE k <= 5) AS text FROM r GROUP BY 1")
def t8_leaf_text(spark, d):
    rows = leaves(spark, d).join(msgs(spark, d), "message_id").select("summary_id", "ingest_no", "role", "content")
    return dag.leaf_text(rows, "summary_id", "ingest_no")


@query(f"WITH {MT}, u AS (SELECT conversation_id, sum({TOK}) tk FROM t GROUP BY 1) SELECT conversation_id, CASE WHEN least(tk / 3000.0::DOUBLE, 1.0::DOUBLE) < 0.6 THEN 'none' WHEN least(tk / 3000.0::DOUBLE, 1.0::DOUBLE) < 0.75 THEN 'light' ELSE 'aggressive' END AS strategy, tk::BIGINT AS tokens FROM u")
def t12_compress_decision(spark, d):
    u = timed(spark, d).groupBy("conversation_id").agg(F.sum(tok()).alias("tokens"))
    return u.select("conversation_id", S.strategy_three(F.least(F.col("tokens") / 3000.0, F.lit(1.0))).alias("strategy"), "tokens")


# Entities, intents, notes

_FILE = r"(?:/[\w./-]+\.\w{1,6}|\.\.?/[\w./-]+)"
_PASCAL = r"[A-Z][a-zA-Z0-9]{2,20}"
T13 = f"""WITH f AS (SELECT conversation_id, unnest(regexp_extract_all(content, {q(_FILE)})) AS e FROM messages WHERE content IS NOT NULL),
p AS (SELECT conversation_id, unnest(regexp_extract_all(content, {q(_PASCAL)})) AS e FROM messages WHERE content IS NOT NULL),
k AS (SELECT conversation_id, content, strpos(content, w) p FROM messages, (SELECT unnest([{', '.join(q(w) for w in L.DECISION_WORDS)}]) w) WHERE content IS NOT NULL AND contains(content, w)),
s AS (SELECT conversation_id, regexp_extract(regexp_replace(substring(content, greatest(p - 10, 1), least(p - 1, 10)), '[ \\t\\n\\r\\f\\v]+$', ''), '[^ \\t\\n\\r\\f\\v]+$') e FROM k),
a AS (SELECT conversation_id, e, 0 t FROM f WHERE length(e) > 3 UNION ALL SELECT conversation_id, e, 1 FROM p UNION ALL SELECT conversation_id, e, 2 FROM s WHERE length(e) > 1)
SELECT conversation_id, e AS name, CASE max(t) WHEN 0 THEN 'file' WHEN 1 THEN 'concept' ELSE 'decision' END AS type, count(*)::BIGINT AS n FROM a GROUP BY 1, 2"""


@query(T13)
def t13_rule_entities(spark, d):
    """Paths, capitalised words and words before a decision, by conversation; the later kind of a name wins."""
    m = table(spark, d, "messages").where("content IS NOT NULL")
    f = m.select("conversation_id", F.explode(F.regexp_extract_all("content", F.lit(_FILE), F.lit(0))).alias("name"), F.lit(0).alias("t")).where(F.length("name") > 3)
    p = m.select("conversation_id", F.explode(F.regexp_extract_all("content", F.lit(_PASCAL), F.lit(0))).alias("name"), F.lit(1).alias("t"))
    places = F.filter(F.array(*[F.locate(w, F.col("content")) for w in L.DECISION_WORDS]), lambda x: x > 0)
    before = lambda x: F.substring(F.col("content"), F.greatest(x - 10, F.lit(1)), F.least(x - 1, F.lit(10)))
    word = lambda x: F.regexp_extract(F.regexp_replace(before(x), "[ \\t\\n\\r\\f\\u000b]+$", ""), "[^ \\t\\n\\r\\f\\u000b]+$", 0)
    s = m.select("conversation_id", F.explode(F.transform(places, word)).alias("name"), F.lit(2).alias("t")).where(F.length("name") > 1)
    g = f.unionByName(p).unionByName(s).groupBy("conversation_id", "name").agg(F.max("t").alias("t"), F.count(F.lit(1)).alias("n"))
    return g.select("conversation_id", "name", F.when(F.col("t") == 0, "file").when(F.col("t") == 1, "concept").otherwise("decision").alias("type"), "n")


NEG = " OR ".join(f"regexp_matches(c.content, '(?i)(?:{p.replace(chr(39), chr(39) * 2)})[^\\n]{{0,20}}' || regexp_escape(w.k))" for p in L.NEGATIONS)
ANY_NEG = "|".join(L.NEGATIONS)
T16_CTE = f"""w AS (SELECT DISTINCT note_id, conversation_id, unnest(regexp_extract_all(content, {q(L.CLAIM_WORDS)})) k FROM n WHERE superseded_by IS NULL),
c AS (SELECT message_id, conversation_id, ingest_no, content FROM m WHERE length(content) >= 10 AND regexp_matches(content, {q('(?i)' + ANY_NEG)})),
x AS (SELECT DISTINCT w.note_id, c.message_id, c.ingest_no FROM w JOIN c USING (conversation_id) WHERE {NEG})"""
T16 = f"WITH {N}, {M}, {T16_CTE} SELECT note_id, message_id, 0.9::DOUBLE AS score FROM x"


@query(T16)
def t16_contradictions(spark, d):
    """Messages that deny a claim of an open note of their conversation: a denial, at most 20 characters, a word of the note."""
    return contradictions(notes(spark, d), msgs(spark, d)).select("note_id", "message_id", F.lit(0.9).alias("score"))


def contradictions(n, m):
    """note_id, message_id, ingest_no of notes (note_id, conversation_id, content, superseded_by) and messages.

    A word of a note is looked up by its first two or three letters among the
    places up to 20 characters behind each denial, in an equi-join on conversation
    and letters; only what meets there is compared whole.
    """
    n = n.where("superseded_by IS NULL")
    words = F.regexp_extract_all("content", F.lit(L.CLAIM_WORDS), F.lit(0))
    w = n.select("note_id", "conversation_id", F.explode(F.array_distinct(F.transform(words, F.lower))).alias("k"))
    w = w.select("note_id", "conversation_id", "k", F.substring("k", 1, 3).alias("key"))
    m = m.where("length(content) >= 10").where(F.col("content").rlike("(?i)" + ANY_NEG))
    m = cut(m.select("message_id", "conversation_id", "ingest_no", F.lower("content").alias("low")))
    hits = F.concat(*[T.match_starts(F.col("low"), p) for p in L.NEGATIONS])
    ends = m.select("message_id", "conversation_id", "low", F.explode(F.array_distinct(F.transform(hits, lambda h: h["start"] + F.length(h["hit"])))).alias("at"))
    after = ends.withColumn("near", F.substring("low", F.col("at"), F.lit(23)))
    gap = F.least(F.when(F.locate("\n", F.col("near")) > 0, F.locate("\n", F.col("near")) - 1).otherwise(20), F.lit(20))
    keys = after.select("message_id", "conversation_id", "at", F.explode(F.transform(F.sequence(F.lit(0), gap), lambda o: F.struct(o.alias("o"), F.substring(F.col("near"), o + 1, F.lit(3)).alias("k3")))).alias("p"))
    keys = keys.select("message_id", "conversation_id", (F.col("at") + F.col("p.o")).alias("at"), F.explode(F.array_distinct(F.array("p.k3", F.substring("p.k3", 1, 2)))).alias("key"))
    met = keys.join(w, ["conversation_id", "key"]).select("note_id", "message_id", "k", "at").distinct()
    return met.join(m, "message_id").where(F.substring("low", F.col("at"), F.length("k")) == F.col("k")).select("note_id", "message_id", "ingest_no").distinct()


@query(f"WITH {N}, {M}, {T16_CTE}, f AS (SELECT note_id, arg_min(message_id, ingest_no) message_id FROM x GROUP BY 1) SELECT f.note_id AS old_note_id, 'note_' || substring(sha256(f.note_id || f.message_id), 1, 16) AS note_id, coalesce(n.category, 'decision') AS category, '[更新] ' || substring(m.content, 1, 200) AS content, 0.7::DOUBLE AS confidence FROM f JOIN n ON n.note_id = f.note_id JOIN m USING (message_id)")
def t17_reconcile(spark, d):
    """The first message that denies an open note becomes a note of its category; the old one is superseded by it."""
    first = contradictions(notes(spark, d), msgs(spark, d)).groupBy("note_id").agg(F.min_by("message_id", "ingest_no").alias("message_id"))
    new = first.join(notes(spark, d).select("note_id", "category"), "note_id").join(msgs(spark, d).select("message_id", "content"), "message_id")
    return new.select(F.col("note_id").alias("old_note_id"), T.short_id(F.concat("note_id", "message_id"), 16, "note_").alias("note_id"), F.coalesce("category", F.lit("decision")).alias("category"), F.concat(F.lit("[更新] "), F.substring("content", 1, 200)).alias("content"), F.lit(0.7).alias("confidence"))


@query(f"WITH {N}, k AS (SELECT DISTINCT content FROM n WHERE superseded_by IS NULL AND content IS NOT NULL) SELECT min(ingest_no) AS ingest_no, content FROM messages WHERE content IS NOT NULL AND content NOT IN (SELECT content FROM k) GROUP BY content")
def t18_save_notes(spark, d):
    """New notes, exact copies of open ones left out."""
    known = notes(spark, d).where("superseded_by IS NULL").select("content")
    return table(spark, d, "messages").where("content IS NOT NULL").groupBy("content").agg(F.min("ingest_no").alias("ingest_no")).join(known, "content", "left_anti").select("ingest_no", "content")


@query(f"WITH x AS (SELECT ingest_no, {CLASS} cls FROM messages WHERE content IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY ingest_no DESC) k, count(*) OVER (PARTITION BY cls) n FROM x) SELECT ingest_no, cls AS class FROM r WHERE k <= CASE WHEN cls = 'chitchat' THEN 3 WHEN cls IN ('decision', 'error') THEN n WHEN cls = 'config' THEN ceil(n * 0.8) WHEN cls = 'question' THEN ceil(n * 0.5) ELSE ceil(n * 0.3) END")
def t25_quotas(spark, d):
    """Newest messages of each class up to its quota."""
    x = table(spark, d, "messages").where("content IS NOT NULL").select("ingest_no", (-F.col("ingest_no")).alias("back"), S.message_class(F.col("content")).alias("class"))
    r = ranked(x, "class", ["back"]).join(x.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class")
    quota = F.when(F.col("class") == "chitchat", 3).when(F.col("class").isin("decision", "error"), F.col("n")).when(F.col("class") == "config", F.ceil(F.col("n") * 0.8)).when(F.col("class") == "question", F.ceil(F.col("n") * 0.5)).otherwise(F.ceil(F.col("n") * 0.3))
    return r.where(F.col("rank") <= quota).select("ingest_no", "class")


@query(f"WITH {MT}, r AS (SELECT message_id, conversation_id, us, ingest_no, {SIGNALS} sc, row_number() OVER (PARTITION BY conversation_id ORDER BY us DESC, ingest_no DESC) k FROM t WHERE content IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY -sc, ingest_no) j, count(*) OVER (PARTITION BY conversation_id) n FROM r WHERE k > 10) SELECT message_id FROM r WHERE k <= 10 UNION ALL SELECT message_id FROM o WHERE j <= ceil(n * 0.3)")
def t26_keep_flow(spark, d):
    """The ten newest messages of a conversation, and the best 30 % of the older ones."""
    m = timed(spark, d).where("content IS NOT NULL").select("conversation_id", "message_id", (-F.col("us")).alias("back"), (-F.col("ingest_no")).alias("no"), "ingest_no", (-S.signal_bonus(F.col("content"))).alias("minus"))
    r = cut(ranked(m, "conversation_id", ["back", "no"], "k"))
    old = r.where("k > 10")
    best = ranked(old, "conversation_id", ["minus", "ingest_no"], "j").join(old.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")), "conversation_id").where("j <= ceil(n * 0.3)")
    return r.where("k <= 10").select("message_id").unionByName(best.select("message_id"))


@query("WITH c AS (SELECT event_type, count(*) n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, event_type) k, row_number() OVER (ORDER BY n, event_type) b FROM c) SELECT event_type, (100 + CASE WHEN k <= 3 THEN 20 ELSE 0 END)::BIGINT AS weight, least(150, greatest(0, 100 + CASE WHEN k <= 3 THEN 5 ELSE 0 END - CASE WHEN b <= 3 THEN 3 ELSE 0 END))::BIGINT AS adjusted FROM r")
def t27_adaptive_weights(spark, d):
    """More weight for the three most used kinds, less for the three least used."""
    c = cut(table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
    top = c.orderBy(F.desc("n"), "event_type").limit(3).select("event_type", F.lit(1).alias("top"))
    low = c.orderBy("n", "event_type").limit(3).select("event_type", F.lit(1).alias("low"))
    j = c.join(top, "event_type", "left").join(low, "event_type", "left")
    adjusted = F.least(F.lit(150), F.greatest(F.lit(0), 100 + F.when(F.col("top") == 1, 5).otherwise(0) - F.when(F.col("low") == 1, 3).otherwise(0)))
    return j.select("event_type", (100 + F.when(F.col("top") == 1, 20).otherwise(0)).cast("bigint").alias("weight"), adjusted.cast("bigint").alias("adjusted"))


@query(f"WITH x AS (SELECT conversation_id, max(epoch_us(created_at)) FILTER (WHERE role = 'system') mark, sum({TOK}) tk, max(epoch_us(created_at)) last FROM messages WHERE conversation_id IS NOT NULL GROUP BY 1) SELECT conversation_id, CASE WHEN mark IS NOT NULL AND last - mark < 3600000000 THEN 'skip' WHEN tk / 30 < 80 THEN 'none' WHEN tk / 30 < 90 THEN 'light' WHEN tk / 30 < 95 THEN 'medium' ELSE 'defer' END AS action FROM x")
def t28_coordinate(spark, d):
    """Skip conversations that were just marked, else act by usage."""
    m = table(spark, d, "messages").where("conversation_id IS NOT NULL")
    us = micros(m, "created_at")
    x = m.groupBy("conversation_id").agg(F.max(F.when(F.col("role") == "system", us)).alias("mark"), F.sum(tok()).alias("tk"), F.max(us).alias("last"))
    use = F.col("tk") / 30
    return x.select("conversation_id", F.when(F.col("last") - F.col("mark") < 3600000000, "skip").when(use < 80, "none").when(use < 90, "light").when(use < 95, "medium").otherwise("defer").alias("action"))


@query("SELECT event_type AS action, user_id % 4 AS strategy, count(*)::BIGINT AS runs, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def t31_metrics(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("action"), (F.col("user_id") % 4).alias("strategy")).agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("value"), 2).alias("total"))


# Assembly and lifecycle


@query(f"WITH {MT}, x AS (SELECT conversation_id, count(*) FILTER (WHERE role = 'user') turns, least(sum({TOK}) / 3000.0::DOUBLE, 1.0::DOUBLE) u FROM t GROUP BY 1) SELECT conversation_id, turns % 12 = 0 OR u > 0.85 AS focus, CASE WHEN turns >= 12 THEN 'turns' WHEN u >= 0.85 THEN 'usage' WHEN u >= 0.8 THEN 'threshold' ELSE 'none' END AS reason FROM x")
def l6_focus(spark, d):
    x = timed(spark, d).groupBy("conversation_id").agg(F.count_if(F.col("role") == "user").alias("turns"), F.least(F.sum(tok()) / 3000.0, F.lit(1.0)).alias("u"))
    return x.select("conversation_id", ((F.col("turns") % 12 == 0) | (F.col("u") > 0.85)).alias("focus"), F.when(F.col("turns") >= 12, "turns").when(F.col("u") >= 0.85, "usage").when(F.col("u") >= 0.8, "threshold").otherwise("none").alias("reason"))


@query(f"WITH {M}, x AS (SELECT conversation_id, count(*) n FROM m WHERE conversation_id IS NOT NULL GROUP BY 1) SELECT conversation_id, CASE WHEN n < 10 THEN 'none' WHEN n > 50 THEN 'compress' ELSE 'watch' END AS advice FROM x")
def l10_check_context(spark, d):
    n = msgs(spark, d).where("conversation_id IS NOT NULL").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("conversation_id", F.when(F.col("n") < 10, "none").when(F.col("n") > 50, "compress").otherwise("watch").alias("advice"))


@query(f"WITH {N}, r AS (SELECT note_id, row_number() OVER (ORDER BY CASE category WHEN 'decision' THEN 0 ELSE 1 END, ingest_no DESC) k, length(content) + 1 c FROM n WHERE superseded_by IS NULL AND content IS NOT NULL), u AS (SELECT note_id, sum(c) OVER (ORDER BY k) used FROM r) SELECT note_id FROM u WHERE used <= 8000")
def l8_inject(spark, d):
    """Memories in order of priority up to 8,000 characters."""
    n = notes(spark, d).where("superseded_by IS NULL AND content IS NOT NULL").select("note_id", F.when(F.col("category") == "decision", 0).otherwise(1).alias("p"), (-F.col("ingest_no")).alias("no"), (F.length("content") + 1).alias("c"), F.lit(0).alias("all"))
    return running_sums(n, "all", ["p", "no"], {"used": "c"}).where("used <= 8000").select("note_id")


