"""Queries of pipelines that emit rows: intents, tool facts, quality checks, keep flows, leaf summaries, skills, assembly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from anamnesis.functions import lexicons as L
from anamnesis.functions import scoring as S
from anamnesis.functions import text as T
from anamnesis.functions.content import trim_blocks, whole_mean
from anamnesis.operators import dag
from anamnesis.operators import search as R
from anamnesis.operators import similarity as X
from anamnesis.operators.contained import contained
from anamnesis.operators.ordered import ranked, running_sums
from anamnesis.operators.segments import capped_episodes, episodes, is_user, merged_episodes, task_texts
from anamnesis.plans.domain import leaf_rows, t26_keep_flow
from anamnesis.plans.relational import M, N, SM, SU, TOK, leaves, msgs, notes, sums, tok
from anamnesis.plans.retrieval import IDF, duplicate_messages, stored_scores
from anamnesis.plans.scalar import SQL as SCALAR_SQL
from anamnesis.plans.scalar import CLASS, COMPLEXITY, HOURS, LIFE, NOW, SIGNALS, TERMS_PAIRS, TERMS_SHORT, q
from anamnesis.plans.windows import MT, USER, timed
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


_SPACE = "[ \\t\\n\\r\\f\\u000b]+"
SQL_SPACE = "[ \\t\\n\\r\\f\\v]+"
strip = lambda c: F.regexp_replace(c, f"^{_SPACE}|{_SPACE}$", "")


# Intents and conclusions

ENTITY_COUNT = "len(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(content, {q('(?i)' + p)})" for p in L.ENTITY_PATTERNS) + "])))"


def _marks_sql(kinds: dict, role: str) -> str:
    arms = " UNION ALL ".join(
        f"SELECT {i} kind_no, {q(k)} kind, conversation_id, message_id, us, ingest_no, content, string_split_regex(content, {q('(?i)' + p)}) s, regexp_extract_all(content, {q('(?i)' + p)}) m FROM t WHERE role = '{role}' AND content IS NOT NULL"
        for i, (k, p) in enumerate(kinds.items())
    )
    return f"""WITH {MT}, a AS ({arms}), b AS (SELECT *, unnest(range(1, len(m) + 1)) i FROM a),
c AS (SELECT *, (list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT p FROM b),
d AS (SELECT *, regexp_replace(substring(content, greatest(p - 50, 0) + 1, p + length(m[i]) + 50 - greatest(p - 50, 0)), '^{SQL_SPACE}|{SQL_SPACE}$', '', 'g') snippet FROM c)
SELECT message_id, kind, snippet, round(least(1.0::DOUBLE, 0.7::DOUBLE + 0.3::DOUBLE * ({ENTITY_COUNT} / 5.0::DOUBLE)), 4) AS confidence FROM d QUALIFY row_number() OVER (PARTITION BY message_id, kind, substring(snippet, 1, 50) ORDER BY i) = 1"""


def marked(spark, d, kinds: dict, role: str):
    """A row for each mark in messages of a role: its kind, the text around it (50 characters on both sides), a
    confidence by the entities of the message; of marks that begin alike the first of the message and kind."""
    m = timed(spark, d).where((F.col("role") == role) & F.col("content").isNotNull())
    found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(f"(?i){p}"), F.lit(0)) for p in L.ENTITY_PATTERNS])))
    hits = F.array(*[F.struct(F.lit(i).alias("kind_no"), F.lit(k).alias("kind"), T.match_starts(F.col("content"), f"(?i){p}").alias("hits")) for i, (k, p) in enumerate(kinds.items())])
    rows = m.select("conversation_id", "message_id", "us", "ingest_no", "content", F.size(found).alias("n"), F.explode(hits).alias("h")).where("size(h.hits) > 0")
    rows = rows.select("*", F.posexplode("h.hits").alias("i", "at"))
    begin = F.greatest(F.col("at.start") - 51, F.lit(0))
    snippet = strip(F.substring("content", begin + 1, F.col("at.start") - 1 + F.length("at.hit") + 50 - begin))
    rows = rows.select("conversation_id", "message_id", "us", "ingest_no", "h.kind_no", "h.kind", "i", snippet.alias("snippet"), F.round(F.least(F.lit(1.0), 0.7 + 0.3 * (F.col("n") / 5.0)), 4).alias("confidence"))
    first = rows.groupBy("message_id", "kind", F.substring("snippet", 1, 50).alias("k")).agg(F.min(F.struct("i", "conversation_id", "us", "ingest_no", "kind_no", "snippet", "confidence")).alias("f"))
    return first.select("message_id", "kind", "f.*")


@query(_marks_sql(L.INTENTS, "user"))
def t14_intents(spark, d):
    """What users want, with the text around each mark."""
    return marked(spark, d, L.INTENTS, "user").select("message_id", "kind", "snippet", "confidence")


@query(_marks_sql(L.CONCLUSIONS, "assistant"))
def t14_conclusions(spark, d):
    """What assistants conclude, with the text around each mark."""
    return marked(spark, d, L.CONCLUSIONS, "assistant").select("message_id", "kind", "snippet", "confidence")


def merged_marks(marks):
    """conversation_id, kind_no, kind, snippet, confidence, place, repeat_count of marks: of those of a conversation and
    kind whose words are alike above 0.8 the first stays and counts the others."""
    m = cut(marks.withColumn("id", F.concat_ws("|", "message_id", "kind", F.lpad(F.col("i").cast("string"), 9, "0"))).withColumn("place", F.struct("us", "ingest_no", "kind_no", "i")))
    items = m.select(F.concat_ws("\n", "conversation_id", "kind").alias("grp"), "id", T.blank_words(F.col("snippet")).alias("terms"), F.concat_ws("|", F.lpad(F.col("us").cast("string"), 20, "0"), F.lpad(F.col("ingest_no").cast("string"), 20, "0"), F.lpad(F.col("i").cast("string"), 9, "0")).alias("place"))
    return m.join(X.first_and_repeats(items, 4, 5).select("id", "repeat_count"), "id").select("conversation_id", "kind_no", "kind", "message_id", "snippet", "confidence", "place", "repeat_count")


@query()
def t14_merged(spark, d):
    """Intents and conclusions of each conversation, repeats merged and counted."""
    a = merged_marks(marked(spark, d, L.INTENTS, "user")).withColumn("side", F.lit("user"))
    return a.unionByName(merged_marks(marked(spark, d, L.CONCLUSIONS, "assistant")).withColumn("side", F.lit("assistant"))).select("conversation_id", "side", "kind", "message_id", "snippet", "confidence", "repeat_count")


def intent_lines(merged, title: str):
    """conversation_id and the lines of its five surest marks under a title."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("confidence"), "kind_no", "place")
    top = merged.withColumn("k", F.row_number().over(w)).where("k <= 5")
    line = F.concat(F.lit("  • "), "kind", F.lit(": "), F.substring("snippet", 1, 100), F.when(F.col("repeat_count") > 1, F.concat(F.lit(" (重复 "), F.col("repeat_count").cast("string"), F.lit(" 次)"))).otherwise(""))
    lines = top.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("l"))
    return lines.select("conversation_id", F.concat(F.lit(title + "\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("part"))


def intent_summaries(spark, d):
    """conversation_id, summary: intents, conclusions and the five most named entities, cut at 500 characters."""
    a = intent_lines(merged_marks(marked(spark, d, L.INTENTS, "user")), "[用户意图]")
    b = intent_lines(merged_marks(marked(spark, d, L.CONCLUSIONS, "assistant")), "[Assistant 结论]")
    m = timed(spark, d).where("content IS NOT NULL AND role IN ('user', 'assistant', 'tool', 'system')")
    found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(f"(?i){p}"), F.lit(0)) for p in L.ENTITY_PATTERNS])))
    named = m.select("conversation_id", F.explode(found).alias("name")).groupBy("conversation_id", "name").agg(F.count(F.lit(1)).alias("n"))
    top = named.withColumn("k", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("n"), "name"))).where("k <= 5")
    c = top.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("k", "name"))).alias("l")).select("conversation_id", F.concat(F.lit("[关键实体] "), F.array_join(F.transform("l", lambda x: x["name"]), ", ")).alias("part"))
    parts = a.withColumn("o", F.lit(0)).unionByName(b.withColumn("o", F.lit(1))).unionByName(c.withColumn("o", F.lit(2)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "part"))), lambda x: x["part"]), "\n")
    return parts.groupBy("conversation_id").agg(text.alias("t")).select("conversation_id", T.short(F.col("t"), 500).alias("summary"))


@query()
def t15_intent_summary(spark, d):
    return intent_summaries(spark, d)


# Tool facts

TOOL = "role IN ('tool', 'toolResult', 'tool_result', 'Tool')"
_LONE = [p if "(" in p.replace("(?:", "") else f"({p})" for p in L.FACT_PATHS]
_any = lambda ps: "|".join(ps)
FACTS = f"""WITH x AS (SELECT ingest_no, content FROM messages WHERE content IS NOT NULL AND {TOOL}),
p AS (SELECT ingest_no, list_distinct(v) u, v FROM (SELECT ingest_no, flatten([{', '.join(f"regexp_extract_all(content, {q(p)}, 1)" for p in _LONE)}]) v FROM x)),
p2 AS (SELECT ingest_no, unnest(u) f, v FROM p), p3 AS (SELECT ingest_no, 'path' AS key, f AS value, 8 importance, list_position(v, f) o FROM p2 QUALIFY row_number() OVER (PARTITION BY ingest_no ORDER BY list_position(v, f)) <= 2),
n AS (SELECT ingest_no, flatten([{', '.join(f"list_transform(regexp_extract_all(content, {q('(?i)' + p)}, 1), lambda y: struct_pack(k := '{k}', v := y))" for p, k in L.FACT_NUMBERS)}])[1:3] l FROM x),
n2 AS (SELECT ingest_no, unnest(l) e, generate_subscripts(l, 1) o FROM n),
e AS (SELECT ingest_no, flatten([{', '.join(f"regexp_extract_all(content, {q('(?i)' + p)}, 1)" for p in L.FACT_ERRORS)}]) l FROM x),
s AS (SELECT ingest_no, 'status' AS key, CASE WHEN regexp_matches(lower(content), {q(L.FACT_ERRORS[0])}) OR regexp_matches(lower(content), {q(L.FACT_ERRORS[1])}) THEN 'failure' WHEN regexp_matches(lower(content), {q(L.FACT_SUCCESS)}) THEN 'success' ELSE 'unknown' END AS value FROM x),
a AS (SELECT ingest_no, key, value, importance, 0 kind, o FROM p3 UNION ALL SELECT ingest_no, e.k, e.v, 6, 1, o FROM n2 UNION ALL SELECT ingest_no, 'error', substring(l[1], 1, 100), 9, 2, 1 FROM e WHERE len(l) > 0 UNION ALL SELECT ingest_no, key, value, 7, 3, 1 FROM s)
SELECT ingest_no, row_number() OVER w AS place, key, value, importance::INT AS importance FROM a WINDOW w AS (PARTITION BY ingest_no ORDER BY importance DESC, kind, o) QUALIFY row_number() OVER w <= 5"""


@query(FACTS)
def t22_tool_facts(spark, d):
    """Up to two paths, three labelled numbers, one error and the status of a tool result: the five most important."""
    c = F.col("content")
    m = table(spark, d, "messages").where("content IS NOT NULL").where(TOOL)
    fact = lambda key, value, importance: F.struct((-F.lit(importance)).alias("minus"), key.alias("key"), value.alias("value"))
    paths = F.slice(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in _LONE]))), 1, 2)
    as_number = lambda key: lambda v: fact(F.lit(key), v, 6)
    numbers = F.slice(F.flatten(F.array(*[F.transform(F.regexp_extract_all(c, F.lit(f"(?i){p}"), F.lit(1)), as_number(k)) for p, k in L.FACT_NUMBERS])), 1, 3)
    errors = F.slice(F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(f"(?i){p}"), F.lit(1)) for p in L.FACT_ERRORS])), 1, 1)
    low = F.lower(c)
    status = F.when(low.rlike(L.FACT_ERRORS[0]) | low.rlike(L.FACT_ERRORS[1]), "failure").when(low.rlike(L.FACT_SUCCESS), "success").otherwise("unknown")
    # In order of importance; each part is in its own order already.
    facts = F.concat(F.transform(errors, lambda v: fact(F.lit("error"), F.substring(v, 1, 100), 9)), F.transform(paths, lambda v: fact(F.lit("path"), v, 8)), F.array(fact(F.lit("status"), status, 7)), numbers)
    rows = m.select("ingest_no", F.posexplode(F.slice(facts, 1, 5)).alias("i", "f"))
    return rows.select("ingest_no", (F.col("i") + 1).cast("bigint").alias("place"), "f.key", "f.value", (-F.col("f.minus")).alias("importance"))


# Flows that keep a share

FLOW = f"""WITH {MT}, r AS (SELECT message_id, conversation_id, us, ingest_no, {{score}} sc, row_number() OVER (PARTITION BY conversation_id ORDER BY us DESC, ingest_no DESC) k, count(*) OVER (PARTITION BY conversation_id) n FROM t WHERE content IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sc DESC, us, ingest_no) j FROM r WHERE k > 10)
SELECT message_id FROM r WHERE k <= 10 UNION ALL SELECT message_id FROM o WHERE j <= greatest(0, trunc(n * {{rate}}::DOUBLE) - least(10, n))"""


def kept(m, score, rate: float, recent: int = 10):
    """message_id of what stays: the newest messages of a conversation, and of the others the best up to a share of all.

    ``m``: message_id, conversation_id, us, ingest_no and what ``score`` needs.
    """
    rows = m.select("conversation_id", "message_id", "us", "ingest_no", (-F.col("us")).alias("back"), (-F.col("ingest_no")).alias("no"), (-score).alias("minus"))
    r = cut(ranked(rows, "conversation_id", ["back", "no"], "k"))
    old = ranked(r.where(F.col("k") > recent), "conversation_id", ["minus", "us", "ingest_no"], "j")
    n = r.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))
    best = old.join(n, "conversation_id").where(F.col("j") <= F.greatest(F.lit(0), F.floor(F.col("n") * F.lit(rate)) - F.least(F.lit(recent), F.col("n"))))
    return r.where(F.col("k") <= recent).select("message_id").unionByName(best.select("message_id"))


@query(FLOW.format(score=SIGNALS, rate=0.7))
def t26_share_flow(spark, d):
    """Ten newest forced, in all 70 % kept by signals."""
    return kept(timed(spark, d).where("content IS NOT NULL"), S.signal_bonus(F.col("content")), 0.7)


@query()
def t26_dedup_flow(spark, d):
    """Near-equal messages out first, then 70 % kept by final score."""
    m = timed(spark, d).where("content IS NOT NULL").join(duplicate_messages(spark, d).select(F.col("id").alias("message_id")), "message_id", "left_anti")
    scored = m.join(stored_scores(spark, d).select("ingest_no", "final"), "ingest_no")
    return kept(scored, F.col("final"), 0.7)


TEN = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(content), {q(w)})" for w in words) + f" THEN {float(weight)}" for _, weight, words in L.TEN_CLASSES) + " ELSE 50.0 END"


@query(f"""WITH {MT}, u AS (SELECT conversation_id, sum({TOK}) tk FROM t WHERE content IS NOT NULL GROUP BY 1), g AS (SELECT conversation_id FROM u WHERE tk >= 6400 AND floor(tk * 0.27::DOUBLE) - 1600 > 0),
f AS ({FLOW.format(score=f"{TEN}::DOUBLE - least(20.0, 0.5 * ({NOW} - us) / 3.6e9)", rate=0.55)}) SELECT t.message_id FROM t WHERE content IS NOT NULL AND (conversation_id NOT IN (SELECT conversation_id FROM g) OR message_id IN (SELECT message_id FROM f))""")
def t26_benefit_flow(spark, d):
    """Only conversations in which it pays are cut to 55 %, by class weight and age."""
    m = timed(spark, d).where("content IS NOT NULL")
    pays = m.groupBy("conversation_id").agg(F.sum(tok()).alias("tk")).where((F.col("tk") >= S.BENEFIT["medium"][2]) & (S.net_benefit(F.col("tk"), "medium") > 0)).select("conversation_id")
    score = S.ten_class_weight(F.col("content")) - F.least(F.lit(20.0), 0.5 * (F.lit(NOW) - F.col("us")) / 3.6e9)
    some = kept(m.join(pays, "conversation_id", "left_semi"), score, 0.55)
    return m.join(pays, "conversation_id", "left_anti").select("message_id").unionByName(some)


# Quality of what was kept

GUARD = f"""WITH {MT}, r AS (SELECT message_id, conversation_id, us, ingest_no, {SIGNALS} sc, row_number() OVER (PARTITION BY conversation_id ORDER BY us DESC, ingest_no DESC) k FROM t WHERE content IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY -sc, ingest_no) j, count(*) OVER (PARTITION BY conversation_id) n FROM r WHERE k > 10), kp AS (SELECT message_id FROM r WHERE k <= 10 UNION ALL SELECT message_id FROM o WHERE j <= ceil(n * 0.3)),
kept AS (SELECT t.* FROM t JOIN kp USING (message_id)), txt AS (SELECT conversation_id, lower(string_agg(content, ' ')) x FROM kept GROUP BY 1),
kw AS (SELECT unnest([{', '.join(q(w.lower()) for w in L.GUARD_DECISIONS)}]) w, unnest(range({len(L.GUARD_DECISIONS)})) i), f1 AS (SELECT conversation_id, content, arg_min(w, i) w FROM t JOIN kw ON contains(lower(t.content), w) GROUP BY conversation_id, message_id, content),
d1 AS (SELECT DISTINCT conversation_id, substring(regexp_replace(s, '^{SQL_SPACE}|{SQL_SPACE}$', '', 'g'), 1, 100) dec FROM (SELECT conversation_id, w, unnest(string_split_regex(content, '[。.!?！？]')) s FROM f1) WHERE contains(lower(s), w)),
d2 AS (SELECT conversation_id, dec, len(list_filter((list_filter(string_split_regex(dec, '{SQL_SPACE}'), lambda v: v <> ''))[1:5], lambda v: length(v) > 2 AND contains(x, lower(v)))) > 0 ok FROM d1 JOIN txt USING (conversation_id)),
d3 AS (SELECT conversation_id, floor(count(*) FILTER (WHERE ok) * 100.0 / count(*))::BIGINT sc FROM d2 GROUP BY 1),
s1 AS (SELECT DISTINCT conversation_id, unnest(regexp_extract_all(content, '[A-Za-z0-9_]+=[^ \\t\\n\\r\\f\\v]+')) c FROM t UNION SELECT conversation_id, w FROM t JOIN (SELECT unnest([{', '.join(q(w) for w in L.GUARD_SETTINGS)}]) w) ON contains(lower(content), lower(w))),
s2 AS (SELECT conversation_id, floor(count(*) FILTER (WHERE contains(x, lower(c))) * 100.0 / count(*))::BIGINT sc FROM s1 JOIN txt USING (conversation_id) GROUP BY 1),
ru AS (SELECT conversation_id, coalesce(role, '') role, us, ingest_no, row_number() OVER (PARTITION BY conversation_id ORDER BY us, ingest_no) - row_number() OVER (PARTITION BY conversation_id, coalesce(role, '') ORDER BY us, ingest_no) g FROM kept),
rn AS (SELECT conversation_id, max(c) run FROM (SELECT conversation_id, role, g, count(*) c FROM ru GROUP BY 1, 2, 3) GROUP BY 1),
co AS (SELECT conversation_id, (100 - CASE WHEN count(*) FILTER (WHERE role = 'user') = 0 THEN 30 ELSE 0 END - CASE WHEN count(*) FILTER (WHERE role = 'assistant') = 0 THEN 30 ELSE 0 END - CASE WHEN max(run) > 5 THEN 20 ELSE 0 END)::BIGINT sc FROM kept JOIN rn USING (conversation_id) GROUP BY 1),
g AS (SELECT co.conversation_id, coalesce(d3.sc, 100)::BIGINT AS decisions, coalesce(s2.sc, 100)::BIGINT AS settings, co.sc AS coherence FROM co LEFT JOIN d3 USING (conversation_id) LEFT JOIN s2 USING (conversation_id))"""


def guard(spark, d):
    """conversation_id, decisions, settings, coherence: scores of the three checks of what t26_keep_flow keeps.

    Decisions: sentences with a decision word, of which one of the first five words
    of three letters or more is still there.  Settings: ``name=value`` texts and
    setting words that are still there.  Coherence: both speakers are there, no
    speaker has more than five messages in a row.
    """
    m = cut(timed(spark, d).select("conversation_id", "message_id", "us", "ingest_no", "role", "content"))
    keep = cut(m.join(t26_keep_flow(spark, d), "message_id", "left_semi"))
    low = F.lower("content")
    words = keep.select(F.col("conversation_id").alias("grp"), F.explode(T.blank_words(F.col("content"))).alias("word")).distinct()
    first = F.coalesce(*[F.when(low.contains(w.lower()), w.lower()) for w in L.GUARD_DECISIONS])
    sentences = m.select("conversation_id", first.alias("w"), F.explode(F.split("content", "[。.!?！？]", -1)).alias("s")).where(F.lower("s").contains(F.col("w")))
    decisions = cut(sentences.select("conversation_id", F.substring(strip(F.col("s")), 1, 100).alias("dec")).distinct())
    asked = decisions.select("conversation_id", "dec", F.explode_outer(F.filter(F.slice(F.filter(F.split("dec", _SPACE), lambda v: v != ""), 1, 5), lambda v: F.length(v) > 2)).alias("v"))
    asked = asked.select("conversation_id", "dec", F.lower("v").alias("needle"))
    found = contained(asked.select(F.col("conversation_id").alias("grp"), "needle"), words).select(F.col("grp").alias("conversation_id"), "needle", F.lit(1).alias("hit"))
    share = lambda hit, n: F.floor(hit * 100.0 / n)
    dec = asked.join(found, ["conversation_id", "needle"], "left").groupBy("conversation_id", "dec").agg(F.coalesce(F.max("hit"), F.lit(0)).alias("hit")).groupBy("conversation_id").agg(share(F.sum("hit"), F.count(F.lit(1))).alias("decisions"))
    pairs = m.select("conversation_id", F.explode(F.regexp_extract_all("content", F.lit("[A-Za-z0-9_]+=[^ \\t\\n\\r\\f\\u000b]+"), F.lit(0))).alias("c"))
    named = m.select("conversation_id", F.explode(F.filter(F.array(*[F.when(low.contains(w.lower()), w) for w in L.GUARD_SETTINGS]), lambda x: x.isNotNull())).alias("c"))
    settings = cut(pairs.union(named).distinct().withColumn("needle", F.lower("c")))
    held = contained(settings.select(F.col("conversation_id").alias("grp"), "needle"), words).select(F.col("grp").alias("conversation_id"), "needle", F.lit(1).alias("hit"))
    sett = settings.join(held, ["conversation_id", "needle"], "left").groupBy("conversation_id").agg(share(F.count("hit"), F.count(F.lit(1))).alias("settings"))
    order = ranked(keep.select("conversation_id", "us", "ingest_no", F.coalesce("role", F.lit("")).alias("role")), "conversation_id", ["us", "ingest_no"], "a")
    both = ranked(order.withColumn("lane", F.struct("conversation_id", "role")), "lane", ["us", "ingest_no"], "b")
    run = both.groupBy("conversation_id", "role", (F.col("a") - F.col("b")).alias("g")).agg(F.count(F.lit(1)).alias("n")).groupBy("conversation_id").agg(F.max("n").alias("run"))
    speakers = keep.groupBy("conversation_id").agg(F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants")).join(run, "conversation_id")
    coherent = 100 - F.when(F.col("users") == 0, 30).otherwise(0) - F.when(F.col("assistants") == 0, 30).otherwise(0) - F.when(F.col("run") > 5, 20).otherwise(0)
    out = speakers.select("conversation_id", coherent.cast("bigint").alias("coherence")).join(dec, "conversation_id", "left").join(sett, "conversation_id", "left")
    return out.select("conversation_id", F.coalesce("decisions", F.lit(100)).cast("bigint").alias("decisions"), F.coalesce("settings", F.lit(100)).cast("bigint").alias("settings"), "coherence")


@query(f"{GUARD} SELECT * FROM g")
def t24_guard(spark, d):
    return guard(spark, d)


@query(f"{GUARD} SELECT conversation_id, ((decisions * 40 + settings * 30 + coherence * 30) // 100)::BIGINT AS score, (decisions * 40 + settings * 30 + coherence * 30) // 100 >= 60 AND decisions >= 60 AND settings >= 70 AND coherence >= 60 AS passed FROM g")
def a15_quality(spark, d):
    """Weighted whole-number mean (40, 30, 30) of the checks; passed if it and every check are high enough."""
    score = F.expr("(decisions * 40 + settings * 30 + coherence * 30) DIV 100")
    return guard(spark, d).select("conversation_id", score.alias("score"), ((score >= 60) & (F.col("decisions") >= 60) & (F.col("settings") >= 70) & (F.col("coherence") >= 60)).alias("passed"))


# Trimming

LONG_JSON = "(trim(content, ' ') LIKE '{%' AND trim(content, ' ') LIKE '%}') OR (trim(content, ' ') LIKE '[%' AND trim(content, ' ') LIKE '%]')"
CUT_SQL = "substring(content, 1, 200) || '... [truncated ' || (length(content) - 200) || ' chars]'"
TRIM = f"""CASE WHEN role = 'user' THEN content WHEN role = 'assistant' THEN CASE WHEN length(content) > 500 AND NOT ({LONG_JSON}) THEN {CUT_SQL} ELSE content END
  WHEN length(content) >= 100 AND len(regexp_extract_all(substring(content, 1, 200), '[A-Za-z0-9+/=]')) / length(substring(content, 1, 200)) > 0.95 THEN '[base64 data, ' || length(content) || ' chars]'
  WHEN length(content) > 500 AND ({LONG_JSON}) THEN {CUT_SQL} ELSE content END"""


def trimmed(role, c):
    """First pass of trimming: user messages stay, long answers are cut, tool and system output loses binary data and long JSON.

    Answers that are lists of blocks are trimmed block by block (:func:`trim_blocks`).
    """
    cut_ = F.concat(F.substring(c, 1, 200), F.lit("... [truncated "), (F.length(c) - 200).cast("string"), F.lit(" chars]"))
    base64 = F.concat(F.lit("[base64 data, "), F.length(c).cast("string"), F.lit(" chars]"))
    answer = F.when((F.length(c) > 500) & ~T.looks_json(c), cut_).otherwise(c)
    return F.when(role == "user", c).when(role == "assistant", answer).when(T.looks_base64(c), base64).when((F.length(c) > 500) & T.looks_json(c), cut_).otherwise(c)


@query(f"SELECT ingest_no, {TRIM} AS content FROM messages WHERE content IS NOT NULL")
def t5_trim(spark, d):
    return table(spark, d, "messages").where("content IS NOT NULL").select("ingest_no", trimmed(F.col("role"), F.col("content")).alias("content"))


@query()
def t5_blocks(spark, d):
    """Answers that are lists of typed blocks: thinking becomes a summary, long texts inside are cut."""
    m = table(spark, d, "messages").where("role = 'assistant'").where(T.looks_json(F.col("content")))
    return trim_blocks(m, "ingest_no", "content")


MARK = "\\[MEMORY REMINDER\\][^\\n]*"


@query(f"""WITH {MT}, a AS (SELECT *, {TRIM} c1, row_number() OVER (PARTITION BY conversation_id, CASE WHEN {TOOL} AND length(content) >= 10 THEN md5(substring(content, 1, 300)) ELSE message_id END ORDER BY us DESC, ingest_no DESC) k FROM t WHERE content IS NOT NULL),
b AS (SELECT *, CASE WHEN {TOOL} AND length(content) >= 10 AND k > 1 THEN NULL ELSE c1 END c2 FROM a), l AS (SELECT conversation_id, arg_max(message_id, (us, ingest_no)) last FROM b WHERE contains(c2, '[MEMORY REMINDER]') GROUP BY 1),
e AS (SELECT b.*, CASE WHEN contains(c2, '[MEMORY REMINDER]') AND message_id <> last THEN regexp_replace(c2, {q(MARK)}, '[folded]', 'g') ELSE c2 END c3 FROM b LEFT JOIN l USING (conversation_id))
SELECT conversation_id, sum({TOK})::BIGINT AS original_tokens, sum({TOK.replace('content', 'c3')})::BIGINT AS trimmed_tokens, sum(greatest(0, length(content) - length(c1)))::BIGINT AS saved_bloat, sum(CASE WHEN c2 IS NULL THEN length(c1) ELSE 0 END)::BIGINT AS saved_repeats, sum(coalesce(length(c2) - length(c3), 0))::BIGINT AS saved_scaffolding FROM e GROUP BY 1""")
def t5_passes(spark, d):
    """Three passes one after the other (bloat, repeated tool results of which the last stays, scaffolding of which the last stays) and what each saves."""
    m = timed(spark, d).where("content IS NOT NULL").select("conversation_id", "message_id", "us", "ingest_no", "content", F.expr(TOOL).alias("tool"), trimmed(F.col("role"), F.col("content")).alias("c1"))
    m = cut(m.withColumn("key", F.when(F.coalesce("tool", F.lit(False)) & (F.length("content") >= 10), F.md5(F.substring("content", 1, 300)))))
    last = m.where("key IS NOT NULL").groupBy("conversation_id", "key").agg(F.max(F.struct("us", "ingest_no"))["ingest_no"].alias("keep"))
    m = m.join(last, ["conversation_id", "key"], "left").withColumn("c2", F.when(F.col("key").isNull() | (F.col("ingest_no") == F.col("keep")), F.col("c1")))
    m = cut(m)
    marks = m.where(F.col("c2").contains("[MEMORY REMINDER]")).groupBy("conversation_id").agg(F.max(F.struct("us", "ingest_no"))["ingest_no"].alias("marked"))
    fold = F.col("c2").contains("[MEMORY REMINDER]") & (F.col("ingest_no") != F.col("marked"))
    m = m.join(marks, "conversation_id", "left").withColumn("c3", F.when(fold, F.regexp_replace("c2", MARK, "[folded]")).otherwise(F.col("c2")))
    tokens = lambda c: F.sum(F.coalesce(T.token_estimate(F.col(c)), F.lit(0)))
    return m.groupBy("conversation_id").agg(
        tokens("content").alias("original_tokens"), tokens("c3").alias("trimmed_tokens"), F.sum(F.greatest(F.lit(0), F.length("content") - F.length("c1"))).alias("saved_bloat"),
        F.sum(F.when(F.col("c2").isNull(), F.length("c1")).otherwise(0)).alias("saved_repeats"), F.sum(F.coalesce(F.length("c2") - F.length("c3"), F.lit(0))).alias("saved_scaffolding"))


# Leaf summaries

RETENTION = f"CASE WHEN ({CLASS}) IN ('decision', 'config', 'code', 'error') THEN b ELSE b * pow(2.0, -(greatest({HOURS}, 0.0) / 24) / ({LIFE} * (1 + 0.5 * {COMPLEXITY}))) END"
FREE = f"""a AS (SELECT *, CASE WHEN 10.0 + {SIGNALS} <= 0 THEN 1.0::DOUBLE ELSE (10.0 + {SIGNALS})::DOUBLE END b, row_number() OVER (PARTITION BY conversation_id ORDER BY us DESC, ingest_no DESC) k FROM t),
fr AS (SELECT *, coalesce(round({RETENTION}, 6), 0) ret, {TOK} tk FROM a WHERE k > 8 AND message_id NOT IN (SELECT message_id FROM sm) AND coalesce(({CLASS}) NOT IN ('decision', 'config', 'code', 'error'), true))"""
#: Of the queries: newest messages left out, messages a run takes, tokens a leaf aims at, and of short episodes.
TAIL, WINDOW, LEAF_TOKENS, SHORT, CAP = 8, 100, 200, 50, 20_000


def free_messages(spark, d):
    """What a leaf pass may take (older than the fresh tail, not in a summary, not exempt; narrow rows with what is left of
    each), and all messages with their texts.

    Texts are looked at once, and only numbers go through the ranking.
    """
    m = cut(timed(spark, d).select("message_id", "conversation_id", "us", "ingest_no", "role", "content"))
    c = F.col("content")
    left = S.retention_by_class(10.0 + S.signal_bonus(c), F.col("class"), S.hours_between(F.lit(NOW), F.col("us")), S.complexity_text(c), F.lit(0))
    scored = m.withColumn("class", S.message_class(c)).select("message_id", "conversation_id", "us", "ingest_no", (-F.col("us")).alias("back"), (-F.col("ingest_no")).alias("no"), tok().alias("tokens"), F.coalesce(F.round(left, 6), F.lit(0.0)).alias("left"), (c.isNotNull() & S.exempt(F.col("class"))).alias("exempt"))
    old = ranked(cut(scored), "conversation_id", ["back", "no"]).where((F.col("rank") > TAIL) & ~F.col("exempt")).join(leaves(spark, d), "message_id", "left_anti")
    return old.drop("back", "no", "rank", "exempt"), m


@query(f"WITH {MT}, {SM}, {FREE} SELECT message_id, tk::BIGINT AS tokens, ret AS retention FROM fr")
def t7_leaf_candidates(spark, d):
    return free_messages(spark, d)[0].select("message_id", "tokens", F.col("left").alias("retention"))


LEAF = f"""WITH RECURSIVE {MT}, {SM}, {FREE}, w AS (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY ret, ingest_no) <= {WINDOW}),
y AS (SELECT * FROM w WHERE conversation_id IN (SELECT conversation_id FROM w GROUP BY 1 HAVING sum(tk) >= {LEAF_TOKENS})),
p AS (SELECT *, lag(us) OVER v pu, lag(content) OVER v pc, row_number() OVER v q FROM y WINDOW v AS (PARTITION BY conversation_id ORDER BY us, ingest_no)),
x AS (SELECT *, coalesce(lower(role) = 'system', false) OR us - pu > 3600000000 AS hard, list_aggregate({TERMS_SHORT}, 'histogram') ha, list_aggregate({TERMS_SHORT.replace('content', 'pc')}, 'histogram') hb FROM p),
c AS (SELECT *, list_sum(list_transform(map_keys(ha), lambda w: ha[w] * coalesce(hb[w], 0)))::DOUBLE dot, list_sum(list_transform(map_values(ha), lambda v: v * v))::DOUBLE na, list_sum(list_transform(map_values(hb), lambda v: v * v))::DOUBLE nb FROM x),
bb AS (SELECT *, q > 1 AND (hard OR (length(content) > 20 AND length(pc) > 20 AND coalesce(dot * dot * 16 < na * nb, true))) cut FROM c),
e AS (SELECT message_id, conversation_id, us, ingest_no, role, content, tk, sum(coalesce(cut, false)::INT) OVER (PARTITION BY conversation_id ORDER BY us, ingest_no) ep FROM bb),
z AS (SELECT conversation_id, ep, sum(tk) size FROM e GROUP BY 1, 2), mg AS (SELECT *, sum((size >= {SHORT} AND ep > 0)::INT) OVER (PARTITION BY conversation_id ORDER BY ep) mno FROM z),
em AS (SELECT conversation_id, mno, sum(size) tk, row_number() OVER (PARTITION BY conversation_id ORDER BY mno) rn FROM mg GROUP BY 1, 2),
rec AS (SELECT conversation_id, mno, rn, 0 g, CASE WHEN tk * 2 >= {LEAF_TOKENS} THEN 0 ELSE tk END pend, (tk * 2 >= {LEAF_TOKENS})::INT closed FROM em WHERE rn = 1
  UNION ALL SELECT em.conversation_id, em.mno, em.rn, rec.closed, CASE WHEN (rec.pend + em.tk) * 2 >= {LEAF_TOKENS} THEN 0 ELSE rec.pend + em.tk END, rec.closed + ((rec.pend + em.tk) * 2 >= {LEAF_TOKENS})::INT FROM rec JOIN em ON em.conversation_id = rec.conversation_id AND em.rn = rec.rn + 1),
fin AS (SELECT conversation_id, arg_max(closed, rn) closed, arg_max(pend, rn) pend FROM rec GROUP BY 1),
lf AS (SELECT e.*, CASE WHEN g = fin.closed AND fin.closed > 0 AND fin.pend * 10 < {LEAF_TOKENS} * 3 THEN g - 1 ELSE g END leaf FROM e JOIN mg USING (conversation_id, ep) JOIN rec USING (conversation_id, mno) JOIN fin USING (conversation_id)),
n1 AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, leaf ORDER BY us, ingest_no) k FROM lf),
sm2 AS (SELECT conversation_id, leaf, 'sum_' || substring(sha256(string_agg(message_id, ',' ORDER BY k)), 1, 16) AS summary_id, '[' || count(*) || ' messages, ' || count(*) FILTER (WHERE role = 'user') || ' user]' || chr(10) || string_agg(coalesce(role, '?') || ': ' || CASE WHEN length(content) > 100 THEN substring(content, 1, 100) || '...' ELSE coalesce(content, '') END, chr(10) ORDER BY k) FILTER (WHERE k <= 5) AS content, count(*)::BIGINT AS descendants, min(us) AS earliest_us, max(us) AS latest_us FROM n1 GROUP BY 1, 2)"""


def new_leaves(spark, d):
    """Rows of messages with the leaf summary they go into: conversation_id, message_id, us, ingest_no, role, content, grp, k.

    Of what is free, the hundred messages of a conversation with the least left,
    if they have tokens enough; in order of time they are cut into episodes, short
    ones merged, and episodes joined until half of the aim is reached.  A rest below
    three tenths goes to the leaf before it.
    """
    free, texts = free_messages(spark, d)
    weakest = free.withColumn("w", F.row_number().over(Window.partitionBy("conversation_id").orderBy("left", "ingest_no"))).where(F.col("w") <= WINDOW)
    weakest = cut(weakest.drop("w", "left"))
    enough = weakest.groupBy("conversation_id").agg(F.sum("tokens").alias("t")).where(F.col("t") >= LEAF_TOKENS).select("conversation_id")
    m = cut(weakest.join(enough, "conversation_id", "left_semi").join(texts.select("message_id", "role", "content"), "message_id"))
    discard(weakest)
    e = cut(episodes(m).join(m.select("message_id", "tokens"), "message_id"))
    parts = cut(capped_episodes(e, CAP, first_counts=False).join(e.select("message_id", "tokens"), "message_id"))
    merged = cut(merged_episodes(parts, SHORT).join(m.select("message_id", "tokens"), "message_id"))
    sizes = merged.groupBy("conversation_id", "merged_no").agg(F.sum("tokens").alias("size"))
    # At most WINDOW episodes a conversation: the fold holds no more.
    folded = sizes.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("merged_no", "size"))).alias("eps"))
    start = F.expr("named_struct('pend', 0L, 'closed', 0, 'out', CAST(array() AS ARRAY<STRUCT<merged_no: BIGINT, g: INT>>))")
    full = lambda a, x: (a["pend"] + x["size"]) * 2 >= LEAF_TOKENS
    step = lambda a, x: F.struct(F.when(full(a, x), F.lit(0).cast("bigint")).otherwise(a["pend"] + x["size"]).alias("pend"), (a["closed"] + F.when(full(a, x), 1).otherwise(0)).alias("closed"), F.array_append(a["out"], F.struct(x["merged_no"].alias("merged_no"), a["closed"].alias("g"))).alias("out"))
    done = folded.select("conversation_id", F.aggregate("eps", start, step).alias("f"))
    rest = (F.col("o.g") == F.col("f.closed")) & (F.col("f.closed") > 0) & (F.col("f.pend") * 10 < LEAF_TOKENS * 3)
    groups = done.select("conversation_id", "f", F.explode("f.out").alias("o")).select("conversation_id", "o.merged_no", F.when(rest, F.col("o.g") - 1).otherwise(F.col("o.g")).alias("g"))
    rows = merged.select("message_id", "conversation_id", "merged_no").join(groups, ["conversation_id", "merged_no"]).join(m.drop("conversation_id", "tokens"), "message_id")
    return cut(ranked(rows.withColumn("grp", F.concat_ws("|", "conversation_id", F.lpad(F.col("g").cast("string"), 4, "0"))), "grp", ["us", "ingest_no"], "k"))


def leaf_summaries(rows):
    """summary_id, conversation_id, content, descendants, earliest_us, latest_us, grp of the leaves of :func:`new_leaves`."""
    text = dag.leaf_text(rows.select("grp", "k", "role", "content"), "grp", "k")
    ids = rows.groupBy("grp").agg(F.min("conversation_id").alias("conversation_id"), F.array_sort(F.collect_list(F.struct("k", "message_id"))).alias("m"), F.count(F.lit(1)).alias("descendants"), F.min("us").alias("earliest_us"), F.max("us").alias("latest_us"))
    named = T.short_id(F.array_join(F.transform("m", lambda x: x["message_id"]), ","), 16, "sum_")
    return ids.join(text, "grp").select("grp", named.alias("summary_id"), "conversation_id", F.col("text").alias("content"), "descendants", "earliest_us", "latest_us")


@query(f"{LEAF} SELECT summary_id, conversation_id, content, descendants, earliest_us, latest_us FROM sm2")
def t7_leaf_compact(spark, d):
    """New leaf summaries of all conversations."""
    return leaf_summaries(new_leaves(spark, d)).drop("grp")


@query(f"{LEAF} SELECT sm2.summary_id, n1.message_id FROM n1 JOIN sm2 USING (conversation_id, leaf)")
def t7_leaf_edges(spark, d):
    """Which messages the new leaf summaries cover."""
    rows = new_leaves(spark, d)
    return leaf_summaries(rows).select("grp", "summary_id").join(rows.select("grp", "message_id"), "grp").select("summary_id", "message_id")


def cascade_sql(leaves_: str, levels: int = 8) -> str:
    """CTEs c0 .. of the levels that condensing gives, each from the one below; more levels than test data can fill."""
    out = f"c0 AS (SELECT conversation_id, 0 depth, summary_id, made, descendants, content, 0 n_sources FROM ({leaves_}))"
    for d in range(levels):
        out += f""", k{d} AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY made, summary_id) rk FROM c{d}),
c{d + 1} AS (SELECT conversation_id, {d + 1} depth, 'sum_' || substring(sha256(string_agg(summary_id, ',' ORDER BY rk)), 1, 16) summary_id, min(made) made, sum(descendants)::BIGINT descendants, substring(string_agg(coalesce(content, ''), chr(10) ORDER BY rk), 1, {max(500, 1000 - 200 * (d + 1))}) AS content, 4 n_sources FROM k{d} GROUP BY conversation_id, (rk - 1) // 4 HAVING count(*) = 4)"""
    return out + ", cc AS (" + " UNION ALL ".join(f"SELECT conversation_id, depth, summary_id, descendants, n_sources FROM c{d}" for d in range(levels + 1)) + ")"


OLD_LEAVES = "SELECT conversation_id, summary_id, epoch_us(min(created_at)) made, max(coalesce(descendant_count, 0))::BIGINT descendants, min(content) content FROM (SELECT DISTINCT * FROM summaries) WHERE depth = 0 AND conversation_id IS NOT NULL GROUP BY 1, 2"


@query(f"WITH {cascade_sql(OLD_LEAVES)} SELECT * FROM cc")
def t10_cascade(spark, d):
    """All levels that condensing the leaves gives; each level has a quarter of the nodes of the one below."""
    return dag.cascade(leaf_rows(spark, d)).select("conversation_id", "depth", "summary_id", "descendants", F.size("sources").alias("n_sources"))


@query(f"{LEAF}, {cascade_sql(OLD_LEAVES + ' UNION ALL SELECT conversation_id, summary_id, latest_us, descendants, content FROM sm2')} SELECT * FROM cc")
def t11_full_compact(spark, d):
    """New leaf summaries, and all levels that condensing old and new ones gives."""
    fresh = leaf_summaries(new_leaves(spark, d)).select("conversation_id", F.lit(0).alias("depth"), "summary_id", F.timestamp_micros("latest_us").cast("timestamp_ntz").alias("made"), "descendants", "content")
    return dag.cascade(leaf_rows(spark, d).unionByName(fresh)).select("conversation_id", "depth", "summary_id", "descendants", F.size("sources").alias("n_sources"))


# Segments with their cap and merge

PARTED = f"""WITH RECURSIVE {MT}, p0 AS (SELECT *, lag(us) OVER w pu, lag(content) OVER w pc, row_number() OVER w k FROM t WINDOW w AS (PARTITION BY conversation_id ORDER BY us, ingest_no)),
x0 AS (SELECT *, coalesce(lower(role) = 'system', false) OR us - pu > 3600000000 AS hard, list_aggregate({TERMS_SHORT}, 'histogram') ha, list_aggregate({TERMS_SHORT.replace('content', 'pc')}, 'histogram') hb FROM p0),
c0 AS (SELECT *, list_sum(list_transform(map_keys(ha), lambda w: ha[w] * coalesce(hb[w], 0)))::DOUBLE dot, list_sum(list_transform(map_values(ha), lambda v: v * v))::DOUBLE na, list_sum(list_transform(map_values(hb), lambda v: v * v))::DOUBLE nb FROM x0),
b0 AS (SELECT conversation_id, message_id, us, ingest_no, {TOK} tk, k > 1 AND (hard OR (length(content) > 20 AND length(pc) > 20 AND coalesce(dot * dot * 16 < na * nb, true))) cut FROM c0),
e0 AS (SELECT *, sum(coalesce(cut, false)::INT) OVER (PARTITION BY conversation_id ORDER BY us, ingest_no)::BIGINT ep FROM b0),
e1 AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, ep ORDER BY us, ingest_no) rn FROM e0),
f0 AS (SELECT conversation_id, ep, rn, message_id, tk, CASE WHEN @first > @cap THEN 0 ELSE @first END s, CASE WHEN @first > @cap THEN 1 ELSE 0 END part FROM e1 WHERE rn = 1
  UNION ALL SELECT e1.conversation_id, e1.ep, e1.rn, e1.message_id, e1.tk, CASE WHEN f0.s + e1.tk > @cap THEN 0 ELSE f0.s + e1.tk END, f0.part + (f0.s + e1.tk > @cap)::INT FROM f0 JOIN e1 ON e1.conversation_id = f0.conversation_id AND e1.ep = f0.ep AND e1.rn = f0.rn + 1)"""


@query(PARTED.replace("@first", "tk").replace("@cap", "200") + " SELECT message_id, ep AS episode_no, part FROM f0")
def t4_capped_episodes(spark, d):
    """Episodes cut again where they pass 200 tokens."""
    m = timed(spark, d)
    e = cut(episodes(m).join(m.select("message_id", tok().alias("tokens")), "message_id"))
    return capped_episodes(e, 200).select("message_id", "episode_no", "part")


@query(PARTED.replace("@first", "0").replace("@cap", str(CAP)) + """, sz AS (SELECT conversation_id, ep, part, sum(tk) size FROM f0 GROUP BY 1, 2, 3),
nm AS (SELECT conversation_id, ep, part, sum((size >= 500 AND NOT (ep = 0 AND part = 0))::INT) OVER (PARTITION BY conversation_id ORDER BY ep, part)::BIGINT mno FROM sz) SELECT message_id, mno AS merged_no FROM f0 JOIN nm USING (conversation_id, ep, part)""")
def t4_merged_episodes(spark, d):
    """The whole segmentation: episodes, cut where they pass 20,000 tokens, those of fewer than 500 merged into the one before."""
    m = timed(spark, d)
    e = cut(episodes(m).join(m.select("message_id", tok().alias("tokens")), "message_id"))
    parts = cut(capped_episodes(e, CAP, first_counts=False).join(e.select("message_id", "tokens"), "message_id"))
    return merged_episodes(parts, 500).select("message_id", "merged_no")


# Extractive summaries of what a flow leaves out

SNIPPET = SCALAR_SQL["f30_snippet"].split("SELECT ingest_no, ", 1)[1].rsplit(" AS snippet", 1)[0]


@query(f"""WITH ky AS ({FLOW.format(score=SIGNALS, rate=0.7)}), {MT}, b AS (SELECT conversation_id, message_id, ingest_no, {SIGNALS} sc, '[' || coalesce(role, 'unknown') || '] ' || {SNIPPET} part FROM t WHERE content IS NOT NULL AND message_id NOT IN (SELECT message_id FROM ky)),
r AS (SELECT *, sum(length(part)) OVER w used, row_number() OVER w k FROM b WINDOW w AS (PARTITION BY conversation_id ORDER BY -sc, ingest_no)) SELECT conversation_id, '历史摘要: ' || string_agg(part, ' | ' ORDER BY k) AS summary, count(*)::BIGINT AS messages FROM r WHERE used <= 200 GROUP BY 1""")
def t23_extract(spark, d):
    """A summary of what the share flow leaves out: the best snippets first, up to 200 characters a conversation."""
    m = timed(spark, d).where("content IS NOT NULL").join(t26_share_flow(spark, d), "message_id", "left_anti")
    part = F.concat(F.lit("["), F.coalesce("role", F.lit("unknown")), F.lit("] "), T.snippet(F.col("content")))
    b = m.select("conversation_id", "ingest_no", (-S.signal_bonus(F.col("content"))).alias("minus"), part.alias("part")).withColumn("n", F.length("part"))
    best = running_sums(b, "conversation_id", ["minus", "ingest_no"], {"used": "n"}).where("used <= 200")
    lines = F.array_sort(F.collect_list(F.struct("minus", "ingest_no", "part")))
    return best.groupBy("conversation_id").agg(F.concat(F.lit("历史摘要: "), F.array_join(F.transform(lines, lambda x: x["part"]), " | ")).alias("summary"), F.count(F.lit(1)).alias("messages"))


# Strategy with what was learned


@query(f"""WITH h AS (SELECT user_id % 3 s, value, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts DESC, event_id DESC) k FROM events QUALIFY k <= 100),
a AS (SELECT s, (list_reduce(list(struct_pack(n := 1::BIGINT, m := floor(value)::BIGINT) ORDER BY k DESC), lambda a, b: struct_pack(n := a.n + 1, m := floor((a.m * a.n + b.m) / (a.n + 1.0))::BIGINT))).m v FROM h GROUP BY 1),
u AS (SELECT conversation_id, least(sum({TOK}) / 1000.0::DOUBLE, 1.0::DOUBLE) * 100 p FROM messages WHERE conversation_id IS NOT NULL GROUP BY 1)
SELECT conversation_id, CASE WHEN p < 70 THEN 'none' WHEN p < 85 THEN CASE WHEN coalesce((SELECT v FROM a WHERE s = 0), 0) > 5 THEN 'light' ELSE 'medium' END WHEN p < 95 THEN CASE WHEN coalesce((SELECT v FROM a WHERE s = 1), 0) > 10 THEN 'medium' ELSE 'heavy' END ELSE 'heavy' END AS strategy FROM u""")
def f38_learned_strategy(spark, d):
    """Strategy by usage; light and medium only where the log says that they save enough (running means of its newest rows)."""
    w = Window.partitionBy("s").orderBy(F.desc("ts"), F.desc("event_id"))
    h = table(spark, d, "events").withColumn("s", F.col("user_id") % 3).withColumn("k", F.row_number().over(w)).where("k <= 100")
    mean = h.groupBy("s").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), F.floor("value").cast("bigint").alias("v")))).alias("l")).select("s", whole_mean(F.transform("l", lambda x: x["v"])).alias("v"))
    learned = mean.agg(F.coalesce(F.max(F.when(F.col("s") == 0, F.col("v"))), F.lit(0)).alias("light"), F.coalesce(F.max(F.when(F.col("s") == 1, F.col("v"))), F.lit(0)).alias("medium"))
    u = table(spark, d, "messages").where("conversation_id IS NOT NULL").groupBy("conversation_id").agg((F.least(F.sum(tok()) / 1000.0, F.lit(1.0)) * 100).alias("p"))
    choice = F.when(F.col("p") < 70, "none").when(F.col("p") < 85, F.when(F.col("light") > 5, "light").otherwise("medium")).when(F.col("p") < 95, F.when(F.col("medium") > 10, "medium").otherwise("heavy")).otherwise("heavy")
    return u.join(F.broadcast(learned)).select("conversation_id", choice.alias("strategy"))


# Assembly

L2_SQL = f"""WITH {N}, {SU}, {MT}, i AS (
  SELECT conversation_id, 'semantic' tier, note_id id, (coalesce(length(content), 0) // 4 + 10)::BIGINT cost, row_number() OVER (PARTITION BY conversation_id ORDER BY ingest_no DESC) o FROM n WHERE superseded_by IS NULL AND conversation_id IS NOT NULL QUALIFY o <= 5
  UNION ALL SELECT conversation_id, 'episodic', summary_id, max(coalesce(token_count, 0)), row_number() OVER (PARTITION BY conversation_id ORDER BY max(epoch_us(created_at)) DESC, summary_id) o FROM s WHERE conversation_id IS NOT NULL GROUP BY conversation_id, summary_id QUALIFY o <= 10
  UNION ALL SELECT conversation_id, 'working', message_id, {TOK.replace('content', 'tc')}, o FROM (SELECT *, {TRIM} tc, row_number() OVER (PARTITION BY conversation_id ORDER BY us DESC, ingest_no DESC) o FROM t QUALIFY o <= 20)),
r AS (SELECT *, sum(cost) OVER (PARTITION BY conversation_id, tier ORDER BY o) used FROM i)
SELECT conversation_id, tier, id, used::BIGINT AS used FROM r WHERE used <= CASE tier WHEN 'working' THEN 320 ELSE 240 END"""


def context_items(spark, d):
    """conversation_id, tier, id, cost, o: the newest 5 notes, 10 summaries and 20 trimmed messages of each conversation."""
    newest = lambda df, n, *order: df.withColumn("o", F.row_number().over(Window.partitionBy("conversation_id").orderBy(*order))).where(F.col("o") <= n)
    pick = lambda df, tier, id_: df.select("conversation_id", F.lit(tier).alias("tier"), F.col(id_).alias("id"), F.col("cost").cast("bigint").alias("cost"), "o")
    n = notes(spark, d).where("superseded_by IS NULL AND conversation_id IS NOT NULL").withColumn("cost", F.floor(F.coalesce(F.length("content"), F.lit(0)) / 4) + 10)
    s = sums(spark, d).where("conversation_id IS NOT NULL")
    s = s.withColumn("us", micros(s, "created_at")).groupBy("conversation_id", "summary_id").agg(F.max(F.coalesce("token_count", F.lit(0))).alias("cost"), F.max("us").alias("us"))
    m = newest(timed(spark, d), 20, F.desc("us"), F.desc("ingest_no"))
    m = m.withColumn("cost", F.coalesce(T.token_estimate(trimmed(F.col("role"), F.col("content"))), F.lit(0)))
    return pick(newest(n, 5, F.desc("ingest_no")), "semantic", "note_id").unionByName(pick(newest(s, 10, F.desc_nulls_last("us"), "summary_id"), "episodic", "summary_id")).unionByName(pick(m, "working", "message_id"))


def within_budget(items, budget: int):
    """Items of each tier of a conversation, in order, up to the tier's share of the budget (30, 30, 40 of 100)."""
    used = F.sum("cost").over(Window.partitionBy("conversation_id", "tier").orderBy("o").rowsBetween(Window.unboundedPreceding, 0))
    share = F.when(F.col("tier") == "working", int(budget * 0.4)).otherwise(int(budget * 0.3))
    return items.withColumn("used", used).where(F.col("used") <= share).select("conversation_id", "tier", "id", "used")


@query(L2_SQL)
def l2_assemble(spark, d):
    """Context of every conversation by tiers within 800 tokens, messages trimmed; at most 36 items a group are ranked."""
    return within_budget(context_items(spark, d), 800)


@query()
def l2_assemble_with_intents(spark, d):
    """The same, with the summary of intents in front of the messages (a quarter of its characters as tokens)."""
    intents = intent_summaries(spark, d).select("conversation_id", F.lit("working").alias("tier"), F.lit("intents").alias("id"), F.floor(F.length("summary") / 4).cast("bigint").alias("cost"), F.lit(0).alias("o"))
    return within_budget(context_items(spark, d).unionByName(intents), 800)


# Sweep and prune

PARTS = f"least(1.0, least(0.3, {TOK} / 500.0::DOUBLE * 0.3) + least(0.2, tfidf * 0.2) + CASE WHEN contains(content, '```') OR contains(content, 'def ') OR contains(content, 'function ') THEN 0.2 ELSE 0.0 END)"
SWEEP = f"""WITH {M}, {IDF.replace('t AS (', 'ti AS (', 1).replace('FROM t)', 'FROM ti)')}, sc AS (SELECT ingest_no, round(avg(idf) * 10, 2) tfidf FROM (SELECT ingest_no, unnest(ts) term FROM ti) JOIN idf USING (term) GROUP BY 1),
x AS (SELECT m.*, coalesce(tfidf, 0) tfidf, {HOURS} h FROM m LEFT JOIN sc USING (ingest_no) WHERE content IS NOT NULL AND created_at IS NOT NULL AND conversation_id IS NOT NULL),
cd AS (SELECT *, pow(0.5, h / (12 * (1 + 0.1 * {PARTS}))) ret FROM x WHERE h > 720 AND h > 168 AND ({CLASS}) NOT IN ('decision', 'config', 'code', 'error') QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY tfidf, created_at, ingest_no) <= 100)"""


def sweep_candidates(spark, d):
    """Messages that weren't touched for 30 days, are older than 7, not exempt: of a conversation the hundred of the least term weight."""
    m = msgs(spark, d).where("content IS NOT NULL AND created_at IS NOT NULL AND conversation_id IS NOT NULL")
    m = m.withColumn("us", micros(m, "created_at")).withColumn("hours", S.hours_between(F.lit(NOW), F.col("us")))
    m = m.where((F.col("hours") > 30 * 24) & (F.col("hours") > 7 * 24)).where(~S.exempt(S.message_class(F.col("content"))))
    m = m.join(stored_scores(spark, d).select("ingest_no", "tfidf"), "ingest_no", "left").withColumn("tfidf", F.coalesce("tfidf", F.lit(0.0)))
    m = m.withColumn("k", F.row_number().over(Window.partitionBy("conversation_id").orderBy("tfidf", "us", "ingest_no"))).where("k <= 100")
    complexity = S.complexity_message(tok(), F.lit(0), F.col("tfidf"), F.col("content"))
    return m.withColumn("retention", S.retention_by_hours(F.col("hours"), S.half_life_hours(complexity, F.lit(0))))


@query(f"{SWEEP} SELECT message_id, tfidf::DOUBLE AS tfidf FROM cd")
def flt4_sweep_candidates(spark, d):
    return sweep_candidates(spark, d).select("message_id", "tfidf")


@query(f"{SWEEP} SELECT conversation_id, count(*)::BIGINT AS candidates, count(*) FILTER (WHERE ret < 0.3)::BIGINT AS decayed FROM cd GROUP BY 1")
def l3_sweep(spark, d):
    """Candidates of each conversation, and how many of them have less than 0.3 left."""
    return sweep_candidates(spark, d).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("retention") < 0.3).alias("decayed"))


@query(f"{SWEEP} SELECT count(*)::BIGINT AS n, array_to_string(list(message_id ORDER BY message_id)[1:10], ',') AS first_ids FROM cd WHERE ret < 0.3")
def x6_prune_preview(spark, d):
    """How many decayed messages a prune would delete, and the first ten ids."""
    gone = sweep_candidates(spark, d).where("retention < 0.3").select("message_id")
    firsts = gone.orderBy("message_id").limit(10).agg(F.array_join(F.array_sort(F.collect_list("message_id")), ",").alias("first_ids"))
    return gone.agg(F.count(F.lit(1)).alias("n")).join(firsts)


# Tasks and skills

TASKS = f"""a AS (SELECT *, sum(coalesce({USER}, false)::INT) OVER (PARTITION BY conversation_id ORDER BY us, ingest_no) turn_no FROM t), b AS (SELECT conversation_id, turn_no, min(us) first_us FROM a GROUP BY 1, 2),
c AS (SELECT *, coalesce(first_us - lag(first_us) OVER (PARTITION BY conversation_id ORDER BY turn_no) > 7200000000, false) split FROM b), e AS (SELECT *, sum(split::INT) OVER (PARTITION BY conversation_id ORDER BY turn_no)::BIGINT task_no FROM c),
f AS (SELECT a.conversation_id, task_no, us, coalesce(owner, 'default') owner, coalesce(content, '') x, row_number() OVER (PARTITION BY a.conversation_id, task_no ORDER BY us, ingest_no) k FROM a JOIN e USING (conversation_id, turn_no)),
ta AS (SELECT conversation_id, task_no, min(us) begin_us, arg_min(owner, k) owner, substring(arg_min(x, k), 1, 100) goal, list(substring(x, 1, 80) ORDER BY k) FILTER (WHERE k <= 5) steps, substring(arg_max(x, k), 1, 100) result FROM f GROUP BY 1, 2)"""
DOCUMENT = "'# ' || substring(goal, 1, 50) || chr(10) || chr(10) || '## 目标' || chr(10) || goal || chr(10) || chr(10) || '## 步骤' || chr(10) || array_to_string(list_transform(steps, lambda s, i: i || '. ' || s), chr(10)) || chr(10) || chr(10) || '## 警告' || chr(10) || '- 此技能由规则模板自动生成，建议人工审核' || chr(10)"
SKILLS = f"""{TASKS}, sd AS (SELECT *, {DOCUMENT} doc FROM ta WHERE NOT regexp_matches(lower(goal), {q('|'.join(L.SKIP_WORDS))})),
sk AS (SELECT *, 'skill_' || substring(sha256(owner || substring(goal, 1, 50)), 1, 16) skill_id, round(least(1.0, CASE WHEN len(steps) >= 2 THEN 0.3 ELSE 0.0 END + CASE WHEN length(result) > 20 THEN 0.2 ELSE 0.0 END + CASE WHEN length(doc) > 200 THEN 0.2 ELSE 0.0 END + CASE WHEN contains(doc, '```') THEN 0.15 ELSE 0.0 END + 0.15)::DOUBLE, 4) quality FROM sd),
sl AS (SELECT * FROM sk QUALIFY row_number() OVER (PARTITION BY skill_id ORDER BY begin_us DESC, conversation_id DESC, task_no DESC) = 1)"""


@query(f"WITH {MT}, {TASKS} SELECT conversation_id, task_no, owner, goal, array_to_string(steps, chr(10)) AS steps, result FROM ta")
def t19_task_texts(spark, d):
    """Goal, steps and result of every task."""
    return task_texts(timed(spark, d)).select("conversation_id", "task_no", "owner", "goal", F.array_join("steps", "\n").alias("steps"), "result")


def skills(spark, d):
    """A skill of each task whose goal passes the gate: skill_id, name, description, owner, quality, document and its task."""
    t = task_texts(timed(spark, d)).where(~F.lower("goal").rlike("|".join(L.SKIP_WORDS)))
    steps = F.array_join(F.transform("steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    document = F.concat(F.lit("# "), F.substring("goal", 1, 50), F.lit("\n\n## 目标\n"), "goal", F.lit("\n\n## 步骤\n"), steps, F.lit("\n\n## 警告\n- 此技能由规则模板自动生成，建议人工审核\n"))
    t = t.withColumn("document", document)
    score = (
        F.when(F.size("steps") >= 2, 0.3).otherwise(0.0) + F.when(F.length("result") > 20, 0.2).otherwise(0.0) + F.when(F.length("document") > 200, 0.2).otherwise(0.0)
        + F.when(F.col("document").contains("```"), 0.15).otherwise(0.0) + F.when(F.col("document").contains("## 警告"), 0.15).otherwise(0.0)
    )
    return t.select(T.short_id(F.concat("owner", F.substring("goal", 1, 50)), 16, "skill_").alias("skill_id"), F.substring("goal", 1, 50).alias("name"), F.col("result").alias("description"), "owner", F.round(F.least(F.lit(1.0), score), 4).alias("quality"), "document", "conversation_id", "task_no", "begin_us")


@query(f"WITH {MT}, {SKILLS} SELECT conversation_id, task_no, skill_id, md5(doc) AS document_md5, quality FROM sk")
def t20_skills(spark, d):
    """Skills by rule, gate, template and score."""
    return skills(spark, d).select("conversation_id", "task_no", "skill_id", F.md5("document").alias("document_md5"), "quality")


def saved_skills(spark, d):
    """Skills as saved: the last version of each, with the number of versions."""
    last = F.max_by(F.struct("name", "description", "owner", "quality"), F.struct("begin_us", "conversation_id", "task_no"))
    return skills(spark, d).groupBy("skill_id").agg(last.alias("s"), F.count(F.lit(1)).alias("versions")).select("skill_id", "s.*", "versions")


@query(f"WITH {MT}, {SKILLS}, v AS (SELECT skill_id, count(*) versions FROM sk GROUP BY 1) SELECT skill_id, sl.owner, sl.quality, sl.result AS description, versions::BIGINT AS versions FROM sl JOIN v USING (skill_id)")
def x8_save_skills(spark, d):
    return saved_skills(spark, d).select("skill_id", "owner", "quality", "description", "versions")


@query(f"WITH {MT}, {SKILLS} SELECT DISTINCT conversation_id AS task_id, skill_id FROM sk")
def x8_task_skills(spark, d):
    return skills(spark, d).select(F.col("conversation_id").alias("task_id"), "skill_id").distinct()


SKILL_TEXT = "substring(goal, 1, 50) || ' ' || result"


@query(f"WITH {MT}, {SKILLS}, h AS (SELECT skill_id, quality, {SKILL_TEXT} content FROM sl) SELECT skill_id, quality FROM h WHERE list_contains({TERMS_PAIRS}, 'budget') ORDER BY quality DESC, skill_id LIMIT 20")
def j3_skills_of_term(spark, d):
    """Postings of the skills' texts joined with the skills, best first."""
    s = cut(saved_skills(spark, d))
    index = R.postings(s.withColumn("text", F.concat_ws(" ", "name", "description")), "skill_id", "text")
    hits = R.of_terms(index, ["budget"]).select(F.col("doc").alias("skill_id"))
    return hits.join(s, "skill_id").orderBy(F.desc("quality"), "skill_id").limit(20).select("skill_id", "quality")


@query(f"WITH {MT}, {SKILLS}, h AS (SELECT skill_id, owner, quality, {SKILL_TEXT} content FROM sl) SELECT skill_id, CASE WHEN owner = 'public' THEN 'public' ELSE 'self' END AS scope FROM h WHERE owner IN ('agent_main', 'public') AND list_contains({TERMS_PAIRS}, 'budget')")
def t21_scoped_search(spark, d):
    """Own and public skills of a term."""
    s = cut(saved_skills(spark, d).where(F.col("owner").isin("agent_main", "public")))
    index = R.postings(s.withColumn("text", F.concat_ws(" ", "name", "description")), "skill_id", "text")
    return R.of_terms(index, ["budget"]).select(F.col("doc").alias("skill_id")).join(s, "skill_id").select("skill_id", F.when(F.col("owner") == "public", "public").otherwise("self").alias("scope"))


# Corrections and publication as logs

CORRECTIONS = """b AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ingest_no) k, lag(content) OVER w pc, lag(metadata) OVER w pm FROM messages WHERE message_id IS NOT NULL WINDOW w AS (PARTITION BY message_id ORDER BY ingest_no)),
lg AS (SELECT message_id, ingest_no, 'delete' correction_type, pc old_value, NULL new_value FROM b WHERE k > 1 AND content = '' UNION ALL SELECT message_id, ingest_no, 'content', pc, content FROM b WHERE k > 1 AND content <> '' AND content IS DISTINCT FROM pc
  UNION ALL SELECT message_id, ingest_no, 'metadata', pm, metadata FROM b WHERE k > 1 AND metadata IS NOT NULL AND metadata IS DISTINCT FROM pm)"""


def correction_log(spark, d):
    """message_id, ingest_no, correction_type, old_value, new_value: every later delivery that changes something is a correction.

    The deliveries of a message are few and meet by pointer to the one before, not in a list.
    """
    m = table(spark, d, "messages").where("message_id IS NOT NULL").select("message_id", "ingest_no", "content", "metadata")
    again = m.groupBy("message_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("message_id")
    rows = m.join(again, "message_id", "left_semi").withColumn("pc", F.lag("content").over(Window.partitionBy("message_id").orderBy("ingest_no"))).withColumn("pm", F.lag("metadata").over(Window.partitionBy("message_id").orderBy("ingest_no"))).withColumn("k", F.row_number().over(Window.partitionBy("message_id").orderBy("ingest_no"))).where("k > 1")
    entry = lambda cond, kind, old, new: F.when(cond, F.struct(F.lit(kind).alias("correction_type"), old.alias("old_value"), new.alias("new_value")))
    c, p = F.col("content"), F.col("metadata")
    kinds = F.array(entry(c == "", "delete", F.col("pc"), F.lit(None).cast("string")), entry((c != "") & ~c.eqNullSafe(F.col("pc")), "content", F.col("pc"), c), entry(p.isNotNull() & ~p.eqNullSafe(F.col("pm")), "metadata", F.col("pm"), p))
    return rows.select("message_id", "ingest_no", F.explode(F.filter(kinds, lambda e: e.isNotNull())).alias("e")).select("message_id", "ingest_no", "e.*")


@query(f"WITH {CORRECTIONS} SELECT message_id, ingest_no, correction_type, md5(old_value) AS old_md5, md5(new_value) AS new_md5 FROM lg")
def x4_audit(spark, d):
    """The audit rows of all corrections, old and new value hashed."""
    return correction_log(spark, d).select("message_id", "ingest_no", "correction_type", F.md5("old_value").alias("old_md5"), F.md5("new_value").alias("new_md5"))


@query(f"WITH {CORRECTIONS}, f AS (SELECT message_id, content, metadata FROM b WHERE k = 1), lc AS (SELECT message_id, arg_max(new_value, ingest_no) v FROM lg WHERE correction_type = 'content' GROUP BY 1), lm AS (SELECT message_id, arg_max(new_value, ingest_no) v FROM lg WHERE correction_type = 'metadata' GROUP BY 1) SELECT message_id, md5(coalesce(lc.v, f.content)) AS content_md5, md5(coalesce(lm.v, f.metadata)) AS metadata_md5 FROM f LEFT JOIN lc USING (message_id) LEFT JOIN lm USING (message_id) WHERE message_id NOT IN (SELECT message_id FROM lg WHERE correction_type = 'delete')")
def x4_corrections(spark, d):
    """Current view: first deliveries with the last correction of content and of metadata, deleted ones taken out."""
    m = table(spark, d, "messages").where("message_id IS NOT NULL")
    base = m.groupBy("message_id").agg(F.min_by(F.struct("content", "metadata"), "ingest_no").alias("f"))
    log = cut(correction_log(spark, d))
    last = lambda kind: F.max_by(F.when(F.col("correction_type") == kind, F.col("new_value")), F.when(F.col("correction_type") == kind, F.col("ingest_no")))
    current = log.groupBy("message_id").agg(last("content").alias("c"), last("metadata").alias("p"), F.max(F.col("correction_type") == "delete").alias("gone"))
    out = base.join(current, "message_id", "left").where("gone IS NULL OR NOT gone")
    return out.select("message_id", F.md5(F.coalesce("c", "f.content")).alias("content_md5"), F.md5(F.coalesce("p", "f.metadata")).alias("metadata_md5"))


@query("WITH l AS (SELECT note_id, ingest_no, CASE WHEN owner = 'public' THEN 'publish' ELSE 'unpublish' END e FROM notes WHERE note_id IS NOT NULL) SELECT note_id, CASE WHEN arg_max(e, ingest_no) = 'publish' THEN 'public' ELSE 'private' END AS visibility, count(*) FILTER (WHERE e = 'publish')::BIGINT AS published FROM l GROUP BY 1")
def x9_latest_state(spark, d):
    """Visibility after a log of publications: every row of a note publishes it or takes it back; the last one holds."""
    n = table(spark, d, "notes").where("note_id IS NOT NULL").select("note_id", "ingest_no", F.when(F.col("owner") == "public", "publish").otherwise("unpublish").alias("e"))
    return n.groupBy("note_id").agg(F.when(F.max_by("e", "ingest_no") == "publish", "public").otherwise("private").alias("visibility"), F.count_if(F.col("e") == "publish").alias("published"))


# Scans with their order and limit, structure, bounded histories


@query(f"WITH {M} SELECT message_id, conversation_id, seq, role FROM m WHERE conversation_id = 'conv_00000000default' ORDER BY seq NULLS LAST, ingest_no LIMIT 200")
def s1_messages_of(spark, d):
    """The first messages of a conversation by seq."""
    return msgs(spark, d).where("conversation_id = 'conv_00000000default'").orderBy(F.asc_nulls_last("seq"), "ingest_no").limit(200).select("message_id", "conversation_id", "seq", "role")


@query(f"WITH {SU} SELECT summary_id, depth, kind, row_number() OVER (ORDER BY depth NULLS LAST, created_at, summary_id, kind, md5(content), coalesce(descendant_count, -1), coalesce(owner, '')) AS place FROM s WHERE conversation_id = (SELECT min(conversation_id) FROM s) ORDER BY place LIMIT 100")
def s2_summaries_of_depth(spark, d):
    """Summaries of a conversation by depth and time."""
    s = sums(spark, d)
    s = s.join(F.broadcast(s.agg(F.min("conversation_id").alias("conversation_id"))), "conversation_id")
    order = [F.asc_nulls_last("depth"), "created_at", "summary_id", "kind", F.md5("content"), F.coalesce("descendant_count", F.lit(-1)), F.coalesce("owner", F.lit(""))]
    return s.orderBy(*order).limit(100).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("summary_id", "depth", "kind", F.col("place").cast("bigint").alias("place"))


@query(f"WITH {SU}, {M}, u AS (SELECT conversation_id, count(*) FILTER (WHERE {USER}) turns FROM m GROUP BY 1), x AS (SELECT conversation_id, max(depth) deepest FROM s GROUP BY 1) SELECT s.conversation_id, s.depth, count(*)::BIGINT AS n, max(descendant_count) AS most, any_value(deepest) AS deepest, any_value(coalesce(turns, 0))::BIGINT AS turns FROM s LEFT JOIN u USING (conversation_id) LEFT JOIN x USING (conversation_id) WHERE s.conversation_id IS NOT NULL GROUP BY 1, 2")
def a6_structure(spark, d):
    """Summaries of each depth, the deepest level and the number of turns of a conversation."""
    s = sums(spark, d).where("conversation_id IS NOT NULL")
    turns = msgs(spark, d).groupBy("conversation_id").agg(F.count_if(is_user(F.col("role"))).alias("turns"))
    by_depth = s.groupBy("conversation_id", "depth").agg(F.count(F.lit(1)).alias("n"), F.max("descendant_count").alias("most"))
    return by_depth.join(s.groupBy("conversation_id").agg(F.max("depth").alias("deepest")), "conversation_id").join(turns, "conversation_id", "left").select("conversation_id", "depth", "n", "most", "deepest", F.coalesce("turns", F.lit(0)).alias("turns"))


HISTORY = "SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) k FROM events QUALIFY k <= 100"


@query(f"WITH h AS ({HISTORY}) SELECT event_type, (list_reduce(list(struct_pack(n := 1::BIGINT, m := floor(value)::BIGINT) ORDER BY k DESC), lambda a, b: struct_pack(n := a.n + 1, m := floor((a.m * a.n + b.m) / (a.n + 1.0))::BIGINT))).m AS mean_saved, count(*)::BIGINT AS runs FROM h GROUP BY 1")
def a16_running_mean(spark, d):
    """Running mean of saved percent by strategy in whole numbers, over the newest hundred rows of the log (its bound)."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    h = table(spark, d, "events").withColumn("k", F.row_number().over(w)).where("k <= 100")
    g = h.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), F.floor("value").cast("bigint").alias("v")))).alias("l"), F.count(F.lit(1)).alias("runs"))
    return g.select("event_type", whole_mean(F.transform("l", lambda x: x["v"])).alias("mean_saved"), "runs")


@query(f"WITH {N}, c AS (SELECT md5(content) AS key, max(epoch_us(coalesce(updated_at, created_at))) us FROM n WHERE content IS NOT NULL GROUP BY 1) SELECT key, us FROM c WHERE us > (SELECT max(us) FROM c) - 864000000000 ORDER BY us DESC, key LIMIT 100")
def t30_bounded_history(spark, d):
    """A cache keyed by the hash of its input: entries of the last ten days, the newest hundred."""
    n = notes(spark, d).where("content IS NOT NULL")
    c = n.select(F.md5("content").alias("key"), F.coalesce(micros(n, "updated_at"), micros(n, "created_at")).alias("us")).groupBy("key").agg(F.max("us").alias("us"))
    newest = c.agg(F.max("us").alias("top"))
    return c.join(F.broadcast(newest)).where("us > top - 864000000000").orderBy(F.desc("us"), "key").limit(100).select("key", "us")


@query(f"WITH x AS (SELECT conversation_id, least(sum({TOK}) / 3000.0::DOUBLE, 1.0::DOUBLE) * 100 u FROM messages WHERE conversation_id IS NOT NULL GROUP BY 1) SELECT count(*)::BIGINT AS sessions, count(*) FILTER (WHERE u < 60)::BIGINT AS safe, count(*) FILTER (WHERE u > 80)::BIGINT AS attention FROM x")
def t28_report(spark, d):
    """How many conversations are safe, and how many call for attention."""
    x = table(spark, d, "messages").where("conversation_id IS NOT NULL").groupBy("conversation_id").agg((F.least(F.sum(tok()) / 3000.0, F.lit(1.0)) * 100).alias("u"))
    return x.agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("u") < 60).alias("safe"), F.count_if(F.col("u") > 80).alias("attention"))
