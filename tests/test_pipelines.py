"""Pipelines without SQL against plain readings, stores, block trimming and streams that run to their end."""

import json
import os
import random
import re
import sqlite3
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from anamnesis.functions.content import trim_block_list, trim_blocks
from anamnesis.operators.segments import capped_episodes
from anamnesis.plans import pipelines, retrieval
from anamnesis.providers import Extractive
from anamnesis.sources import files, stores
from anamnesis.streaming import memory as stream

MESSAGES = "message_id string, conversation_id string, seq bigint, role string, content string, token_count bigint, created_at timestamp_ntz, metadata string, owner string, ingest_no bigint"


def write(spark, path, rows):
    df = spark.createDataFrame([(f"m{n:03}", c, n, role, t, 0, None, None, "x", n) for n, (c, role, t) in enumerate(rows)], MESSAGES)
    df.withColumn("created_at", F.expr("TIMESTAMP_NTZ'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, ingest_no)")).write.mode("overwrite").parquet(f"{path}/messages.parquet")


def test_intents_are_merged_and_summarised(spark, tmp_path):
    rows = [("c", "user", "请帮我 修复 a.py 的 配置 now"), ("c", "user", "请帮我 修复 a.py 的 配置 now"), ("c", "assistant", "我们决定 用 a.py 了"), ("c", "tool", "帮我"), ("d", "user", None), ("d", "user", ""), (None, "user", "帮我")]
    write(spark, tmp_path, rows)
    got = pipelines.t14_merged(spark, str(tmp_path)).collect()
    assert {r["conversation_id"] for r in got} == {"c"}
    asked = [r for r in got if r["side"] == "user"]
    # Three marks a message, all with the same text around them: one row for the kind, said by two messages.
    assert [(r["kind"], r["repeat_count"]) for r in asked] == [("request", 2)] and asked[0]["message_id"] == "m000" and asked[0]["snippet"] == rows[0][2]
    assert [(r["kind"], r["confidence"]) for r in got if r["side"] == "assistant"] == [("decision", 0.76)]
    text = pipelines.intent_summaries(spark, str(tmp_path)).where("conversation_id = 'c'").first()["summary"]
    assert text.split("\n") == ["[用户意图]", f"  • request: {rows[0][2]} (重复 2 次)", "[Assistant 结论]", "  • decision: 我们决定 用 a.py 了", "[关键实体] a.py"]


def test_a_cap_against_a_plain_loop(spark):
    rng = random.Random(2)
    data = [("c" if i % 3 else None, i % 2, i, i, f"m{i:03}", rng.randrange(0, 40)) for i in range(200)]
    df = spark.createDataFrame(data, "conversation_id string, episode_no int, us long, ingest_no long, message_id string, tokens int")
    for first in (True, False):
        want = {}
        for key in {(r[0], r[1]) for r in data if r[0]}:
            total, part = 0, 0
            for i, r in enumerate(r for r in data if (r[0], r[1]) == key):
                if not (i == 0 and not first):
                    if total + r[5] > 100:
                        total, part = 0, part + 1
                    else:
                        total += r[5]
                want[r[4]] = part
        got = {r["message_id"]: r["part"] for r in capped_episodes(df.where("conversation_id IS NOT NULL"), 100, first).collect()}
        assert got == want


def test_blocks(spark):
    blocks = [{"type": "thinking", "thinking": "x" * 150}, {"type": "text", "text": "y" * 600}, {"type": "text", "text": json.dumps([{"type": "thinking", "thinking": "z"}])}, "loose", {"type": "other"}]
    out = trim_block_list(blocks)
    assert out[0] == {"type": "thinking_summary", "preview": "x" * 100 + "...", "original_length": 150, "_trimmed": True}
    assert out[1]["text"] == "y" * 200 + "... [truncated 400 chars]" and json.loads(out[2]["text"])[0]["preview"] == "z" and out[3:] == ["loose", {"type": "other"}]
    df = spark.createDataFrame([(1, json.dumps(blocks)), (2, "broken ["), (3, None), (4, '{"a": 1}')], "k long, t string")
    got = {r["k"]: r["content"] for r in trim_blocks(df, "k", "t").collect()}
    assert json.loads(got[1]) == out and got[2] == "broken [" and got[3] is None and json.loads(got[4]) == {"a": 1}


def test_stores(spark, tmp_path):
    rows = [("a", "c", "user", "hi"), ("b", None, None, None)] + [(f"x{i}", "d", "tool", "t" * i) for i in range(50)]
    df = spark.createDataFrame(rows, "message_id string, conversation_id string, role string, content string").coalesce(1)
    assert stores.write_stores(df, str(tmp_path), 20) == 3
    (tmp_path / "broken.db").write_bytes(b"no store at all" * 10)
    con = sqlite3.connect(tmp_path / "other.db")
    con.execute("CREATE TABLE t (x)"), con.commit(), con.close()
    seen = stores.scan_stores(spark, str(tmp_path)).collect()
    assert sum(r["messages"] or 0 for r in seen) == 52 and sum(r["error"] for r in seen) == 1 and sum(r["messages"] is None for r in seen) == 2
    assert sorted(map(tuple, stores.read_stores(spark, str(tmp_path)).drop("file").collect()), key=repr) == sorted(rows, key=repr)


def test_conversations_in_three_shapes(spark, tmp_path):
    m = spark.createDataFrame([("a", "c", 1, "user", "x", 1), ("b", "c", 2, "user", None, 2), ("e", "d", None, None, "y", 3)], "message_id string, conversation_id string, seq long, role string, content string, ingest_no long")
    for shape, read in (("single", files.read_conversation_lines), ("list", files.read_conversation_lines), ("map", files.read_conversation_maps)):
        files.write_conversations(m, str(tmp_path / shape), shape)
        (tmp_path / shape / "part-broken.txt").write_text("{broken\n")
        got = sorted((r["conversationId"], r["id"], r["content"] or "") for r in read(spark, str(tmp_path / shape)).collect() if r["id"])
        assert got == [("c", "a", "x"), ("c", "b", ""), ("d", "e", "y")]


def test_open_sessions_are_closed_at_the_end(spark, tmp_path):
    ev = spark.createDataFrame([("u", t) for t in (0, 600, 7200, 7260)] + [("v", 50), (None, 60)], "user string, s long").select("user", F.timestamp_seconds("s").alias("at"))
    ev.write.parquet(str(tmp_path / "ev"))
    source = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    got = stream.run_to_end(spark, lambda s: stream.gap_sessions(s, "user", "at", "1 hour", "10 minutes").select("user", "n"), source, "at")
    assert sorted((r["user"], r["n"]) for r in got.where("user IS NOT NULL").collect()) == [("u", 2), ("u", 2), ("v", 1)]


def test_provider_summaries_by_value():
    assert Extractive(20).generate(["One two three. Four five six seven", "short", ""]) == ["One two three.", "short", ""]


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_deduplication_against_a_plain_loop(spark):
    from anamnesis.plans.relational import msgs
    from anamnesis.session import micros

    m = msgs(spark, SMALL).where("content IS NOT NULL")
    rows = m.select("conversation_id", "message_id", "ingest_no", "content", micros(m, "created_at").alias("us")).collect()
    scores = {r["ingest_no"]: (r["class"], r["final"]) for r in retrieval.t1_score_and_tag(spark, SMALL).collect()}

    def terms(t):
        return Counter(re.findall("[a-z]+", t.lower()) + [r[i : i + 2] for r in re.findall("[一-鿿]{2,}", t) for i in range(len(r) - 1)])

    groups, gone = defaultdict(list), set()
    for r in sorted(rows, key=lambda r: (r["us"] if r["us"] is not None else 2**63 - 1, r["ingest_no"])):
        cls, final = scores[r["ingest_no"]]
        if cls not in ("decision", "config", "code", "error") and (c := terms(r["content"])).total() >= 3:
            groups[r["conversation_id"] or ""].append((r["message_id"], c, final))
    for items in groups.values():
        for i, (a, x, s) in enumerate(items):
            for b, y, t in items[i + 1 :]:
                if a in gone:
                    break
                dot = sum(n * y[k] for k, n in x.items())
                if b not in gone and dot * dot * 10000 > 6724 * sum(n * n for n in x.values()) * sum(n * n for n in y.values()):
                    gone.add(b if s >= t else a)
    got = {r["id"] for r in retrieval.t2_deduplicate(spark, SMALL).collect() if r["id"].startswith("msg_")}
    assert got == gone and gone


def test_hybrid_against_a_plain_loop(spark):
    rng = random.Random(7)
    hits = [(f"i{n:02}", rng.random(), "".join(rng.choices("abcdefgh", k=rng.randrange(0, 6))), rng.choice([None, 0.0, 3.0, 90.0])) for n in range(30)]
    left, chosen = sorted(hits, key=lambda h: (-h[1], h[0])), []
    while left and len(chosen) < 12:
        def value(h):
            like = max((len(set(h[2]) & set(c[2])) / len(set(h[2]) | set(c[2])) if h[2] and c[2] else 0.0 for c in chosen), default=0.0)
            return 0.7 * h[1] - 0.3 * like
        best = max(left, key=value)  # the first of equals
        left.remove(best), chosen.append(best)
    faded = [(h[0], h[1] * (0.3 if h[3] is None else 0.3 + 0.7 * 0.5 ** (h[3] / 14))) for h in chosen]
    top = max(v for _, v in faded)
    want = [(i, round(v / top, 6)) for i, v in faded if v / top >= 0.45][:6]
    df = spark.createDataFrame(hits, "id string, score double, content string, days double")
    assert [(r["id"], r["share"]) for r in retrieval.hybrid(df).orderBy("place").collect()] == want


def test_levels_of_a_compaction_add_up(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    rows = pipelines.t11_full_compact(spark, SMALL).collect()
    new = {r["summary_id"]: r["descendants"] for r in pipelines.t7_leaf_compact(spark, SMALL).collect()}
    assert new and new.items() <= {r["summary_id"]: r["descendants"] for r in rows if r["depth"] == 0}.items()
    assert all(r["n_sources"] == (4 if r["depth"] else 0) for r in rows)
    by = Counter((r["conversation_id"], r["depth"]) for r in rows)
    assert all(by[c, d + 1] == n // 4 for (c, d), n in by.items())
