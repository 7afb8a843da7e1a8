"""Queries of the scalar functions, each over all rows of its table, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from anamnesis.functions import lexicons as L
from anamnesis.functions import scoring as S
from anamnesis.functions import text as T
from anamnesis.session import micros, table

QUERIES: dict = {}
SQL: dict = {}

#: The clock of all queries: microseconds of 2026-03-01, later than every row.
NOW = 1772323200000000


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


HAN = "length(regexp_replace(content, '[^\\x{4e00}-\\x{9fff}]', '', 'g'))"
TOKENS = f"trunc((length(content) - {HAN}) / 4.0 + {HAN} / 1.5)::BIGINT"
HOURS = f"(({NOW} - epoch_us(created_at)) / 3.6e9)"


def add(name, columns, sql, source="messages", where="content IS NOT NULL", key="ingest_no"):
    """A projection of one table: key plus columns (name -> Column of the frame)."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, source).where(where)
        made = columns(df)
        return df.select(key, *[c.alias(n) for n, c in made.items()])

    QUERIES[name] = run
    SQL[name] = f"SELECT {key}, {sql} FROM {source} WHERE {where}"


C = lambda: F.col("content")
now_hours = lambda df: S.hours_between(F.lit(NOW), micros(df, "created_at"))

add("f1_token_estimate", lambda df: {"tokens": T.token_estimate(C())}, f"{TOKENS} AS tokens")
add(
    "f2_provider_tokens",
    lambda df: {p: T.provider_tokens(C(), L.PROVIDER_CJK[p]) for p in ("qwen", "claude", "openai")},
    ", ".join(f"ceil({HAN} * {L.PROVIDER_CJK[p]}::DOUBLE + (length(content) - {HAN}) / 4.0)::BIGINT AS {p}" for p in ("qwen", "claude", "openai")),
)
add("f3_length_tokens", lambda df: {"per4": T.length_tokens(C(), 4), "per3": T.length_tokens(C(), 3)}, "(length(content) // 4)::BIGINT AS per4, (length(content) // 3)::BIGINT AS per3")
_CODE = " + ".join(
    f"coalesce(list_sum(list_transform(regexp_extract_all(content, '{p}'), lambda x: length(x))), 0)"
    for p in ("```(?s:.*?)```", "`[^`]+`", "\\{(?s:.*?)\\}", "def |class |function |import |from ")
)
_LATIN = "len(regexp_extract_all(content, '[A-Za-z0-9]'))"
add(
    "f4_model_tokens",
    lambda df: {"glm": T.model_tokens(C(), 1.8), "qwen": T.model_tokens(C(), 1.5, per_code=3.2)},
    ", ".join(f"trunc({HAN} / {h}::DOUBLE + {_LATIN} / 4.0::DOUBLE + ({_CODE}) / {c}::DOUBLE + (length(content) - {HAN} - {_LATIN} - ({_CODE})) / 4.0::DOUBLE)::BIGINT AS {n}" for n, h, c in (("glm", 1.8, 3.5), ("qwen", 1.5, 3.2))),
)


def f5_dialogue_tokens(spark, sf_dir):
    df = table(spark, sf_dir, "messages")
    return df.groupBy("conversation_id").agg((F.sum(F.coalesce(T.token_estimate(C()), F.lit(0)) + 4) + 3).alias("tokens"))


QUERIES["f5_dialogue_tokens"] = f5_dialogue_tokens
SQL["f5_dialogue_tokens"] = f"SELECT conversation_id, (sum(coalesce({TOKENS}, 0) + 4) + 3)::BIGINT AS tokens FROM messages GROUP BY 1"

_PAIRS = "flatten(list_transform(regexp_extract_all(content, '[\\x{4e00}-\\x{9fff}]{2,}'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))"
_WORDS = "regexp_extract_all(lower(content), '[a-z]+')"
TERMS_FULL = f"list_concat(list_concat({_WORDS}, regexp_extract_all(content, '[0-9]+')), list_concat({_PAIRS}, regexp_extract_all(content, '[\\x{{4e00}}-\\x{{9fff}}]')))"
TERMS_PAIRS = f"list_concat({_WORDS}, {_PAIRS})"
TERMS_SHORT = "regexp_extract_all(lower(content), '[\\x{4e00}-\\x{9fff}]|[a-zA-Z]{2,}')"
BLANK = "list_filter(regexp_split_to_array(lower(content), '[ \\t\\n\\r\\f\\x0b]+'), lambda w: w <> '')"
add("f6_terms_full", lambda df: {"terms": F.array_join(T.terms_full(C()), "␟")}, f"array_to_string({TERMS_FULL}, '␟') AS terms")
add("f7_terms_pairs", lambda df: {"terms": F.array_join(T.terms_pairs(C()), "␟")}, f"array_to_string({TERMS_PAIRS}, '␟') AS terms")
add("f8_terms_short", lambda df: {"terms": F.array_join(T.terms_short(C()), "␟")}, f"array_to_string({TERMS_SHORT}, '␟') AS terms")
add("a10_term_counts", lambda df: {"n_kinds": F.size(F.array_distinct(T.terms_pairs(C()))).cast("bigint"), "most": F.coalesce(F.array_max(F.map_values(T.counts_of(T.terms_pairs(C())))), F.lit(0)).cast("bigint")},
    f"len(list_distinct({TERMS_PAIRS}))::BIGINT AS n_kinds, coalesce(list_max(map_values(list_histogram({TERMS_PAIRS}))), 0)::BIGINT AS most".replace("map_values(list_histogram(", "map_values(list_aggregate(").replace(f"{TERMS_PAIRS}))), 0)", f"{TERMS_PAIRS}, 'histogram'))), 0)"))

SIGNALS = " + ".join(f"CASE WHEN regexp_matches(lower(content), {q(p)}) THEN {w} ELSE 0 END" for w, p in L.SIGNALS)
CLASS = "CASE " + " ".join(f"WHEN regexp_matches(lower(content), {q(p)}) THEN '{c}'" for c, p in L.CLASSES) + f" WHEN regexp_matches(trim(lower(content)), {q(L.CHITCHAT)}) THEN 'chitchat' ELSE 'unknown' END"
add("f13_signal_bonus", lambda df: {"bonus": S.signal_bonus(C())}, f"({SIGNALS})::BIGINT AS bonus")
add("f14_message_class", lambda df: {"class": S.message_class(C())}, f"{CLASS} AS class")
add("f15_exempt", lambda df: {"exempt": S.exempt(S.message_class(C()))}, f"({CLASS}) IN ('decision', 'config', 'code', 'error') AS exempt")
DECAY = f"CASE WHEN {HOURS} > 0 THEN -least(15.0, 0.3 * {HOURS}) ELSE 0.0 END"
add("f16_age_decay", lambda df: {"decay": F.round(S.age_decay(now_hours(df)), 6), "final": F.round(F.greatest(F.lit(0.0), 10.0 + S.signal_bonus(C()) + S.age_decay(now_hours(df))), 6)}, f"round({DECAY}, 6) AS decay, round(greatest(0.0, 10.0 + {SIGNALS} + {DECAY}), 6) AS final", where="content IS NOT NULL AND created_at IS NOT NULL")
_C = lambda p: f"len(regexp_extract_all(content, '{p}'))"
COMPLEXITY = f"""CASE WHEN length(content) < 20 THEN 0.0 ELSE least(
  CASE WHEN len({BLANK}) < 5 THEN 0.5 ELSE len(list_distinct({BLANK})) / len({BLANK}) END
  + least(length(content) / 500.0::DOUBLE * (1 + 2 * {HAN} / length(content)), 1.0)
  + least(CASE WHEN contains(content, '```') OR contains(content, '    ') THEN 0.5 ELSE 0.0 END
    + CASE WHEN {_C('- ')} > 2 OR {_C('[*] ')} > 2 OR {_C('1[.] ')} > 2 THEN 0.3 ELSE 0.0 END
    + CASE WHEN {_C(chr(92) + 'n')} > 5 THEN 0.2 ELSE 0.0 END, 1.0), 3.0) END::DOUBLE"""
add("f17_complexity_text", lambda df: {"complexity": F.round(S.complexity_text(C()), 6)}, f"round({COMPLEXITY}, 6) AS complexity")
LIFE = "CASE " + " ".join(f"WHEN ({CLASS}) = '{c}' THEN {d}" for c, d in L.HALF_LIFE_DAYS.items()) + " END::DOUBLE"
add(
    "f18_retention_by_class",
    lambda df: {"retention": F.round(S.retention_by_class(10.0 + S.signal_bonus(C()), S.message_class(C()), now_hours(df), S.complexity_text(C()), F.col("ingest_no") % 7), 6)},
    f"round(CASE WHEN ({CLASS}) IN ('decision', 'config', 'code', 'error') THEN b ELSE b * pow(2.0, -(greatest({HOURS}, 0.0) / 24) / ({LIFE} * (1 + 0.5 * {COMPLEXITY}) * (1 + 0.5 * ln(1 + ingest_no % 7)))) END, 6) AS retention",
    where="content IS NOT NULL AND created_at IS NOT NULL",
)
SQL["f18_retention_by_class"] = SQL["f18_retention_by_class"].replace("FROM messages", f"FROM (SELECT *, CASE WHEN 10.0 + {SIGNALS} <= 0 THEN 1.0::DOUBLE ELSE (10.0 + {SIGNALS})::DOUBLE END b FROM messages) x")
add("f19_recall_decay", lambda df: {"decay": F.round(S.recall_decay(now_hours(df) / 24), 6)}, f"round(CASE WHEN created_at IS NULL THEN 0.3 ELSE 0.3 + 0.7 * pow(0.5, {HOURS} / 24 / 14) END, 6) AS decay")
CHLR = f"least(1.0, least(0.3, {TOKENS} / 500.0::DOUBLE * 0.3) + least(0.3, (ingest_no % 12) / 10.0::DOUBLE * 0.3) + 0.2 + CASE WHEN contains(content, '```') OR contains(content, 'def ') OR contains(content, 'function ') THEN 0.2 ELSE 0.0 END)"
LIFE_H = f"(12 * (1 + 0.1 * {CHLR}) * (1 + 0.1 * least(ingest_no % 14, 10)))"
_chlr = lambda: S.complexity_message(T.token_estimate(C()), F.col("ingest_no") % 12, F.lit(10.0), C())
_life = lambda: S.half_life_hours(_chlr(), F.col("ingest_no") % 14)
add("f20_complexity_message", lambda df: {"complexity": F.round(_chlr(), 6)}, f"round({CHLR}, 6) AS complexity")
add("f21_half_life_hours", lambda df: {"half_life": F.round(_life(), 6)}, f"round({LIFE_H}, 6) AS half_life")
_TIER = "CASE WHEN ingest_no % 2 = 0 THEN 'working' ELSE 'episodic' END"
add(
    "f22_lifecycle",
    lambda df: {"action": S.lifecycle(F.round(S.retention_by_hours(F.col("ingest_no") % 40, _life()), 9), F.when(F.col("ingest_no") % 2 == 0, "working").otherwise("episodic"), F.col("ingest_no") % 14)},
    f"CASE WHEN r < 0.3 THEN 'decay' WHEN t = 'working' AND r > 0.7 THEN 'promote' WHEN t = 'episodic' AND r > 0.8 AND ingest_no % 14 >= 3 THEN 'promote' ELSE 'keep' END AS action",
)
SQL["f22_lifecycle"] = SQL["f22_lifecycle"].replace("FROM messages", f"FROM (SELECT *, round(pow(0.5, (ingest_no % 40) / {LIFE_H}), 9) r, {_TIER} t FROM messages) x")
add("f23_reinforced", lambda df: {"stability": F.round(S.reinforced(F.lit(14.0), F.col("ingest_no") % 9), 6)}, "round(14.0 * (1 + 0.5 / sqrt(ingest_no % 9 + 1)), 6) AS stability")
add("f26_short_ids", lambda df: {"sha16": T.short_id(C(), 16), "sha24": T.short_id(C(), 24, "ent_"), "md8": F.substring(F.md5(F.substring(C(), 1, 300)), 1, 8)}, "substring(sha256(content), 1, 16) AS sha16, 'ent_' || substring(sha256(content), 1, 24) AS sha24, substring(md5(substring(content, 1, 300)), 1, 8) AS md8")
add("f27_short_text", lambda df: {"t100": T.short(C(), 100), "t80": T.short(C(), 80)}, "CASE WHEN length(content) > 100 THEN substring(content, 1, 100) || '...' ELSE content END AS t100, CASE WHEN length(content) > 80 THEN substring(content, 1, 80) || '...' ELSE content END AS t80")
add("f28_base64", lambda df: {"base64": T.looks_base64(C())}, "length(content) >= 100 AND len(regexp_extract_all(substring(content, 1, 200), '[A-Za-z0-9+/=]')) / length(substring(content, 1, 200)) > 0.95 AS base64")
add("f29_json", lambda df: {"json": T.looks_json(C())}, "(trim(content, ' ') LIKE '{%' AND trim(content, ' ') LIKE '%}') OR (trim(content, ' ') LIKE '[%' AND trim(content, ' ') LIKE '%]') AS json")
_FLAT = "trim(regexp_replace(content, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'), ' ')"
add("f30_snippet", lambda df: {"snippet": T.snippet(C())},
    f"CASE WHEN length({_FLAT}) <= 80 THEN {_FLAT} WHEN length(regexp_extract(substring({_FLAT}, 1, 80), '^((?s:.*)[。.！!？?])', 1)) - 1 > 40 THEN substring({_FLAT}, 1, length(regexp_extract(substring({_FLAT}, 1, 80), '^((?s:.*)[。.！!？?])', 1))) ELSE rtrim(substring({_FLAT}, 1, 80), ' ') || '...' END AS snippet")
SECONDS = f"(({NOW} - epoch_us(created_at)) / 1000000.0::DOUBLE)"
TIME_TIER = f"CASE WHEN {SECONDS} < 3600 THEN 100 WHEN {SECONDS} < 21600 THEN 80 WHEN {SECONDS} < 86400 THEN 60 WHEN {SECONDS} < 604800 THEN 40 ELSE 20 END"
_seconds = lambda df: (F.lit(NOW) - micros(df, "created_at")) / 1e6
add("f31_tiered_decay", lambda df: {"decay": S.tiered_time_decay(_seconds(df)).cast("bigint")}, f"({TIME_TIER})::BIGINT AS decay", where="created_at IS NOT NULL")
_KEYS = " + ".join(f"CASE WHEN regexp_matches(content, {q(p)}) THEN {w} ELSE 0 END" for p, w in L.IMPORTANCE)
add("f32_keyword_importance", lambda df: {"importance": S.keyword_importance(C(), _seconds(df), "预算|budget")},
    f"(CASE WHEN length(content) < 20 THEN (({_KEYS}) * ({TIME_TIER}) // 100) * 80 // 100 WHEN length(content) > 500 THEN (({_KEYS}) * ({TIME_TIER}) // 100) * 90 // 100 ELSE ({_KEYS}) * ({TIME_TIER}) // 100 END + CASE WHEN regexp_matches(content, '预算|budget') THEN 30 ELSE 0 END)::BIGINT AS importance", where="content IS NOT NULL AND created_at IS NOT NULL")
add("f33_seven_classes", lambda df: {"class": S.first_class(C(), L.SEVEN_CLASSES, "context")}, "CASE " + " ".join(f"WHEN regexp_matches(content, {q(p)}) THEN '{c}'" for c, p in L.SEVEN_CLASSES) + " ELSE 'context' END AS class")
_DECIDED = " OR ".join(f"contains(lower(content), {q(w)})" for w in L.ROLE_DECISION_WORDS)
ROLE_CLASS = f"CASE WHEN role = 'user' THEN 'user' WHEN role IN ('thinking', 'tool_result') THEN role WHEN role = 'assistant' AND ({_DECIDED}) THEN 'assistant_decision' WHEN role = 'assistant' AND regexp_matches(trim(lower(content), ' '), {q(L.CHITCHAT)}) THEN 'assistant_chitchat' ELSE 'assistant_normal' END"
add("f34_role_class", lambda df: {"class": S.role_class(F.col("role"), C()), "weight": S.role_weight(S.role_class(F.col("role"), C()))}, f"{ROLE_CLASS} AS class, CASE WHEN ({ROLE_CLASS}) IN ('user', 'assistant_decision') THEN 0.3 WHEN ({ROLE_CLASS}) IN ('thinking', 'assistant_chitchat') THEN -0.2 ELSE 0.0 END::DOUBLE AS weight")
add("f35_additive_keywords", lambda df: {"score": F.round(S.additive_keywords(C()), 6)}, "round((" + " + ".join(f"CASE WHEN contains(lower(content), {q(w)}) THEN {x} ELSE 0.0 END" for x, ws in L.KEYWORD_WEIGHTS.values() for w in ws) + ")::DOUBLE, 6) AS score")
_TEN = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(content), {q(w)})" for w in ws) + f" THEN {x}.0" for _, x, ws in L.TEN_CLASSES) + " ELSE 50.0 END"
add("f36_ten_classes", lambda df: {"importance": F.round(F.greatest(F.lit(0.0), S.ten_class_weight(C()) - F.least(F.lit(20.0), now_hours(df) * 0.5)), 6)}, f"round(greatest(0.0, {_TEN} - least(20.0, {HOURS} * 0.5))::DOUBLE, 6) AS importance", where="content IS NOT NULL AND created_at IS NOT NULL")


def f37_strategy(spark, sf_dir):
    """Usage of a context of 4,000 tokens by conversation, and the strategies it calls for."""
    used = table(spark, sf_dir, "messages").groupBy("conversation_id").agg(F.sum(F.coalesce(T.token_estimate(C()), F.lit(0))).alias("tokens"))
    usage = F.least(F.col("tokens") / 4000, F.lit(1.0))
    return used.select("conversation_id", "tokens", F.round(usage, 6).alias("usage"), S.strategy_three(usage).alias("strategy"), S.strategy_four(usage * 100).alias("strategy4"))


QUERIES["f37_strategy"] = f37_strategy
SQL["f37_strategy"] = f"""
WITH u AS (SELECT conversation_id, sum(coalesce({TOKENS}, 0))::BIGINT tokens FROM messages GROUP BY 1), v AS (SELECT *, least(tokens / 4000.0::DOUBLE, 1.0::DOUBLE) x FROM u)
SELECT conversation_id, tokens, round(x, 6) AS usage, CASE WHEN x < 0.6 THEN 'none' WHEN x < 0.75 THEN 'light' ELSE 'aggressive' END AS strategy,
  CASE WHEN x * 100 < 70 THEN 'none' WHEN x * 100 < 85 THEN 'light' WHEN x * 100 < 95 THEN 'medium' ELSE 'heavy' END AS strategy4 FROM v"""


def f39_net_benefit(spark, sf_dir):
    used = table(spark, sf_dir, "messages").groupBy("conversation_id").agg(F.sum(F.coalesce(T.token_estimate(C()), F.lit(0))).alias("tokens"))
    return used.select("conversation_id", *[S.net_benefit(F.col("tokens"), s).alias(s) for s in S.BENEFIT], *[((F.col("tokens") >= least) & (S.net_benefit(F.col("tokens"), s) > 0)).alias(f"do_{s}") for s, (_, _, least) in S.BENEFIT.items()])


QUERIES["f39_net_benefit"] = f39_net_benefit
SQL["f39_net_benefit"] = (
    f"WITH u AS (SELECT conversation_id, sum(coalesce({TOKENS}, 0))::BIGINT tokens FROM messages GROUP BY 1) SELECT conversation_id, "
    + ", ".join(f"floor(tokens * {r}::DOUBLE)::BIGINT - {c} AS {s}, tokens >= {m} AND floor(tokens * {r}::DOUBLE)::BIGINT - {c} > 0 AS do_{s}" for s, (c, r, m) in S.BENEFIT.items())
    + " FROM u"
)
add("f41_skill_quality", lambda df: {"quality": F.round(S.skill_quality(F.col("source_msg_ids"), C(), F.concat(C(), C())), 6)},
    "round(least(1.0, CASE WHEN len(source_msg_ids) >= 2 THEN 0.3 ELSE 0.0 END + CASE WHEN length(content) > 20 THEN 0.2 ELSE 0.0 END + CASE WHEN length(content || content) > 200 THEN 0.2 ELSE 0.0 END + CASE WHEN contains(content, '```') THEN 0.15 ELSE 0.0 END + CASE WHEN contains(content, '## ') THEN 0.15 ELSE 0.0 END)::DOUBLE, 6) AS quality", source="notes")


def f42_note_lines(spark, sf_dir):
    """Latest notes of each conversation as labelled lines; a line per note keeps groups unbounded."""
    from anamnesis.operators.latest import latest

    notes = latest(table(spark, sf_dir, "notes"), "note_id", "ingest_no")
    label = F.when(F.col("category") == "decision", "[decision]").when(F.col("category") == "constraint", "[constraint]").when(F.col("category") == "preference", "[preference]").otherwise("[fact]")
    return notes.where("superseded_by IS NULL AND content IS NOT NULL").select("note_id", F.concat(label, F.lit(" "), T.short(C(), 200)).alias("line"))


QUERIES["f42_note_lines"] = f42_note_lines
SQL["f42_note_lines"] = """
WITH n AS (SELECT * FROM notes QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY ingest_no DESC) = 1)
SELECT note_id, CASE category WHEN 'decision' THEN '[decision]' WHEN 'constraint' THEN '[constraint]' WHEN 'preference' THEN '[preference]' ELSE '[fact]' END || ' ' ||
  CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END AS line
FROM n WHERE superseded_by IS NULL AND content IS NOT NULL"""
