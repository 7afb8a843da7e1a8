"""The client object on the smallest tables and on small frames."""

import os

import pytest
from pyspark.sql import functions as F

from anamnesis.api import Memory
from anamnesis.functions.content import json_text, whole_mean
from anamnesis.providers import Extractive, Fallback, Hashed, embed, summarise
from anamnesis.sources import files

DATA = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs
def test_tools_give_rows(spark):
    m = Memory(spark, DATA)
    assert m.list_sessions().count() > 0 and m.preview().count() > 0 and m.describe().count() > 0
    assert m.assemble(800).agg(F.max("used")).first()[0] <= 320
    s = table_first(spark)
    assert m.expand(s).count() > 0 and m.describe(s).count() > 0
    assert {r["what"] for r in m.status().collect()} == {"messages", "notes", "summaries"}
    n = m.prune(1772323200000000).first()["n"]
    assert m.prune(1772323200000000, dry_run=False).count() + n == m.messages().count()
    assert m.grep("budget tokens", 5).count() <= 5
    assert m.import_new(m.messages()).count() == 0
    own = Memory(spark, DATA, owner="agent_ops", namespace="default")
    assert own.messages().where("owner NOT IN ('agent_ops', 'public')").count() == 0


def table_first(spark):
    return spark.read.parquet(f"{DATA}/summary_messages.parquet").first()["summary_id"]


@needs
def test_corrections(spark):
    m = Memory(spark, DATA)
    a, b = [r["message_id"] for r in m.messages().orderBy("message_id").limit(2).collect()]
    c = spark.createDataFrame([(a, "content", "old", 1), (a, "content", "new", 2), (b, "delete", None, 1)], "target_id string, correction_type string, new_value string, created_at int")
    got = {r["message_id"]: r["content"] for r in m.correct(c).collect()}
    assert got[a] == "new" and b not in got


def test_skills(spark):
    s = spark.createDataFrame([("1", "deploy it", "x", "me", "private", 0.5), ("2", "deploy", "y", "you", "public", 0.9), ("3", "test", "z", "you", "private", 0.1)], "skill_id string, name string, description string, owner string, visibility string, quality_score double")
    m = Memory(spark, DATA, owner="me")
    assert [r["skill_id"] for r in m.skill_search(s, "deploy").collect()] == ["2", "1"]
    assert [r["skill_id"] for r in m.skill_search(s, "*", "self").collect()] == ["1"]
    e = spark.createDataFrame([("1", "public", 1), ("1", "private", 2), ("3", "public", 1)], "skill_id string, visibility string, created_at int")
    assert {r["skill_id"]: r["visibility"] for r in Memory.publish(s, e).collect()} == {"1": "private", "2": "public", "3": "public"}
    assert Memory.update_weights({"a": 1.0}, {"a": 2.0, "b": 3.0}) == {"a": 2.0}


def test_providers(spark):
    class Broken:
        def generate(self, texts):
            raise ValueError

    assert Fallback(Broken(), Extractive(20)).generate(["One two. Three four five six seven"]) == ["One two. Three four "]
    df = spark.createDataFrame([(1, "a text."), (2, None)], "id long, text string")
    assert summarise(df, Extractive()).count() == 2
    v = {r["id"]: r["vector"] for r in embed(df, Hashed(8)).collect()}
    assert len(v[1]) == 8 and v[1] == Hashed(8).embed(["a text."])[0]


def test_json_text_and_whole_mean(spark):
    df = spark.createDataFrame([(1, '{"a": ["x", {"b": "y"}], "n": 1}'), (2, "broken {"), (3, None), (4, "[" * 5000 + "]" * 5000)], "k long, t string")
    got = {r["k"]: r["text"] for r in json_text(df, "k", "t").collect()}
    assert got[1] == "x\ny" and got[2] == got[3] == ""
    one = spark.createDataFrame([([10, 20, 25],)], "v array<bigint>").select(whole_mean(F.col("v"))).first()[0]
    assert one == 18


def test_session_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type":"session"}\n{"type":"message","message":{"id":"1","role":"user","content":"hi"}}\nnot json\n')
    got = {r["kind"] for r in files.read_session_lines(spark, str(tmp_path / "a.jsonl")).collect()}
    assert got == {"other", "message", "broken"}


def test_conversation_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"conversationId":"c","messages":[{"id":"1","seq":1,"role":"user","content":"a"},{"id":"2","seq":2,"role":"assistant","content":"b"}]}]')
    assert [(r["conversationId"], r["id"]) for r in files.read_conversations(spark, str(tmp_path / "c.json")).orderBy("position").collect()] == [("c", "1"), ("c", "2")]
    (tmp_path / "c.csv").write_text('msg,text\n1,"a, b"\n2,\n')
    got = files.read_table(spark, str(tmp_path / "c.csv"), {"msg": "id", "text": "content"}, {"role": "user"}).orderBy("id").collect()
    assert [(r["id"], r["role"], r["content"]) for r in got] == [("1", "user", "a, b"), ("2", "user", None)]
