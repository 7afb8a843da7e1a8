"""Queries of the text problems (2, 3, 4, 6, 7, 8) and the SQL of those that SQL can express."""

from __future__ import annotations

import secrets

from pyspark.sql import functions as F

from anamnesis.llm.conversations import INVISIBLE, SPEAKERS, last_delivery, rebuild_conversations, reply_paths
from anamnesis.llm.neardup import near_duplicate_groups, near_duplicates
from anamnesis.llm.packing import container_report, fill_containers
from anamnesis.llm.pii import find_mentions, redact, replace_by_surrogates, texts_of
from anamnesis.llm.spam import find_spam_pages, score_pages
from anamnesis.llm.tokens import count_tokens, encode_corpus
from anamnesis.session import cut, table


def _texts(spark, sf_dir):
    return texts_of(table(spark, sf_dir, "messages"), table(spark, sf_dir, "notes"))


def p2_found(spark, sf_dir):
    return find_mentions(_texts(spark, sf_dir), table(spark, sf_dir, "entities")).select("tbl", "ingest_no", "kind", "start_pos")


def p2_redacted(spark, sf_dir):
    return redact(_texts(spark, sf_dir), table(spark, sf_dir, "entities"))


def p2_surrogates(spark, sf_dir):
    """The key is the setting spark.anamnesis.surrogate.key; without it a random one, which nobody keeps."""
    key = spark.conf.get("spark.anamnesis.surrogate.key", None) or secrets.token_hex(32)
    return replace_by_surrogates(_texts(spark, sf_dir), table(spark, sf_dir, "entities"), key)


def p3_found(spark, sf_dir):
    return rebuild_conversations(table(spark, sf_dir, "messages"))


def p3_paths(spark, sf_dir):
    """Root, depth and state of every message on the chain of those with the seq before (of equals the smallest id);
    after a gap a chain is an orphan."""
    m = cut(last_delivery(table(spark, sf_dir, "messages")).where("conv IS NOT NULL AND seq IS NOT NULL").select("message_id", "conv", "seq"))
    before = m.groupBy("conv", (F.col("seq") + 1).alias("seq")).agg(F.min("message_id").alias("before"))
    low = m.groupBy("conv").agg(F.min("seq").alias("low"))
    rows = m.join(before, ["conv", "seq"], "left").join(low, "conv")
    parent = F.when(F.col("before").isNotNull(), F.col("before")).when(F.col("seq") > F.col("low"), F.lit("missing"))
    return reply_paths(rows.select("message_id", parent.alias("parent")), "message_id", "parent")


def p4_found(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "messages"), table(spark, sf_dir, "notes"))


def p4_groups(spark, sf_dir):
    return near_duplicate_groups(table(spark, sf_dir, "messages"), table(spark, sf_dir, "notes"))


def p6_ids(spark, sf_dir):
    return encode_corpus(table(spark, sf_dir, "documents"))


def p7_containers(spark, sf_dir):
    sizes = cut(count_tokens(table(spark, sf_dir, "documents")))
    return fill_containers(sizes, table(spark, sf_dir, "token_budgets"))


def p7_report(spark, sf_dir):
    return container_report(p7_containers(spark, sf_dir))


def p8_found(spark, sf_dir):
    return find_spam_pages(table(spark, sf_dir, "documents"))


def p8_scores(spark, sf_dir):
    scores = score_pages(table(spark, sf_dir, "documents"))
    return scores.selectExpr("doc_id", "host", "label", "round(trees, 4) AS trees", "round(vote, 4) AS vote", "round(score, 4) AS score")


_ROLES = " ".join(f"WHEN r IN ({', '.join(repr(x) for x in spellings)}) THEN '{name}'" for name, spellings in SPEAKERS.items())
_BLANK = INVISIBLE.replace("\\u", "\\x{").replace("\\x{00a0", "\\x{00a0}").replace("\\x{1680", "\\x{1680}").replace("\\x{2000-\\x{200b", "\\x{2000}-\\x{200b}").replace("\\x{2028", "\\x{2028}").replace("\\x{2029", "\\x{2029}").replace("\\x{202f", "\\x{202f}").replace("\\x{205f", "\\x{205f}").replace("\\x{3000", "\\x{3000}").replace("\\x{feff", "\\x{feff}")

P3_SQL = f"""
WITH last AS (
  SELECT message_id, arg_max(struct_pack(c := conversation_id, s := seq, r := role, x := content), ingest_no) m
  FROM messages WHERE message_id IS NOT NULL GROUP BY 1),
a AS (SELECT message_id, m.c c, m.s s, lower(regexp_replace(m.r, '[{_BLANK}_:-]+', '', 'g')) r,
  coalesce(regexp_matches(m.x, '[^{_BLANK}]'), false) v FROM last WHERE m.c IS NOT NULL),
b AS (SELECT message_id, c, s, v, CASE {_ROLES} END r FROM a),
k AS (SELECT c FROM b GROUP BY c HAVING count(r) = count(*) AND count(s) = count(*) AND count(DISTINCT s) = count(*)
  AND max(s) - min(s) + 1 = count(*) AND min(s) IN (0, 1) AND count(*) FILTER (WHERE v AND r = 'user') > 0),
t AS (SELECT c, r, lead(r) OVER (PARTITION BY c ORDER BY s) n FROM b WHERE v AND r IN ('user', 'assistant') AND c IN (SELECT c FROM k)),
u AS (SELECT DISTINCT c FROM t WHERE r = 'user' AND coalesce(n, 'user') = 'user')
SELECT c AS conversation_id, row_number() OVER (PARTITION BY c ORDER BY s) AS turn_no, message_id
FROM b WHERE v AND c IN (SELECT c FROM k) AND c NOT IN (SELECT c FROM u)
"""

P3_PATHS_SQL = """
WITH RECURSIVE last AS (SELECT message_id, arg_max(struct_pack(c := conversation_id, s := seq), ingest_no) m FROM messages WHERE message_id IS NOT NULL GROUP BY 1),
m AS (SELECT message_id, m.c c, m.s s FROM last WHERE m.c IS NOT NULL AND m.s IS NOT NULL), b AS (SELECT c, s + 1 s, min(message_id) p FROM m GROUP BY 1, 2), l AS (SELECT c, min(s) low FROM m GROUP BY 1),
x AS (SELECT message_id, p, s > low late FROM m LEFT JOIN b USING (c, s) JOIN l USING (c)),
r AS (SELECT message_id node, message_id root, 0 depth, CASE WHEN late THEN 'orphan' ELSE 'ok' END status FROM x WHERE p IS NULL
  UNION ALL SELECT x.message_id, r.root, depth + 1, status FROM r JOIN x ON x.p = r.node)
SELECT node, root, depth::BIGINT AS depth, status FROM r
"""

QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted, "p2_surrogates": p2_surrogates, "p3_found": p3_found, "p3_paths": p3_paths, "p4_found": p4_found, "p4_groups": p4_groups, "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_report": p7_report, "p8_found": p8_found, "p8_scores": p8_scores}
SQL = {"p3_found": P3_SQL, "p3_paths": P3_PATHS_SQL}
