"""Written indexes, fusion, projections, vector search, substring joins and places of matches."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.api import Memory
from anamnesis.functions import text as T
from anamnesis.operators import search as R
from anamnesis.operators import similarity as X
from anamnesis.operators.contained import contained
from anamnesis.operators.stored import stored
from anamnesis.providers import Hashed


def test_query_terms_are_read_like_texts(spark):
    for q in ("Budget?", "我们决定", "budget 我们决定 x1", ""):
        df = spark.createDataFrame([(q,)], "t string")
        assert sorted(R.query_terms(q)) == sorted(df.select(T.terms_pairs(F.col("t"))).first()[0])


MESSAGES = "message_id string, conversation_id string, seq bigint, role string, content string, token_count bigint, created_at timestamp, metadata string, owner string, ingest_no bigint"


def write_messages(spark, path, rows):
    df = spark.createDataFrame([(i, "c", n, "user", t, 0, None, None, owner, n) for n, (i, t, owner) in enumerate(rows)], MESSAGES)
    df.write.mode("overwrite").parquet(f"{path}/messages.parquet")


def test_grep_reads_an_index_that_follows_its_source(spark, tmp_path):
    write_messages(spark, tmp_path, [("a", "the budget?", "x"), ("b", "我们决定采用它", "x"), ("d", None, "x"), ("e", "", "x"), ("a", "the budget, the Budget!", "x"), ("h", "budget", "y")])
    m = Memory(spark, str(tmp_path))
    assert sorted(r["doc"] for r in m.grep("budget?").collect()) == ["a", "h"] and [r["doc"] for r in m.grep("我们决定").collect()] == ["b"]
    assert [r["doc"] for r in Memory(spark, str(tmp_path), owner="y").grep("budget").collect()] == ["h"]
    assert m.grep("nothing here").count() == 0
    write_messages(spark, tmp_path, [("z", "budget", "x")])
    assert [r["doc"] for r in Memory(spark, str(tmp_path)).grep("budget").collect()] == ["z"]


def test_an_index_reads_the_folders_of_its_terms_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join("".join(random.Random(i * 9 + j).choices("abcdefg", k=4)) for j in range(8))) for i in range(300)] + [(900, "needle needle"), (901, "needle and hay")], "id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    index, size = R.written_index(spark, "test", [str(tmp_path / "docs")], lambda: docs, "id", "text")
    got = {r["doc"]: r["score"] for r in R.bm25(index, size, ["needle"]).collect()}
    n, mean = size.first()
    idf = math.log(1 + (n - 2 + 0.5) / 2.5)
    assert got[900] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 2 / mean))) and set(got) == {900, 901}
    hits = R.of_terms(index, ["needle"])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters:")[1]


def test_stored_frames_are_built_once(spark, tmp_path):
    (tmp_path / "s.txt").write_text("1")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert stored(spark, "t", [str(tmp_path / "s.txt")], build).count() == 3
    assert len(calls) == 1
    (tmp_path / "s.txt").write_text("22")
    stored(spark, "t", [str(tmp_path / "s.txt")], build)
    assert len(calls) == 2


def test_projections_are_near_for_common_words(spark):
    texts = [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon eta"), (3, "one two three four five six"), (4, None), (5, "")]
    df = spark.createDataFrame(texts, "id long, text string")
    v = R.projections(df, ["id"], "text")
    top = [r["id"] for r in R.projection_top(v, ["id"], "alpha beta gamma delta epsilon zeta", 3).collect()]
    assert top[:2] == [1, 2]
    got = {r["dim"]: r["value"] for r in v.where("id = 1").collect()}
    assert got == R.projected_query(texts[0][1])
    a, b, c = np.array(Hashed(64).embed([t or "" for _, t in texts[:3]]))
    assert a @ b / np.linalg.norm(a) / np.linalg.norm(b) > 0.6 > abs(a @ c) / np.linalg.norm(a) / np.linalg.norm(c)
    assert R.projection_top(v, ["id"], "", 3).count() == 3  # no terms: all scores are 0


def test_queries_against_all_vectors_both_ways(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((400, 8))
    m[7], m[8] = m[0] * 2, 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(500, None)], "id long, v array<double>")
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    s = u @ u.T
    want = {(i, j) for i in range(0, 400, 100) for j in range(400) if i != j and s[i, j] > 0.6}
    for most in (10, 2):
        got = {(r["id_a"], r["id_b"]) for r in R.near_queries(df, "id", "v", "id % 100 = 0", 0.6, most=most, block=2).collect()}
        assert got == want and (0, 7) in got
    assert R.near_queries(df.limit(0), "id", "v", "id % 100 = 0", 0.6).count() == 0


def test_recall_of_near_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 32))
    m = np.concatenate([base, base + 0.3 * rng.standard_normal((300, 32)), base + 0.5 * rng.standard_normal((300, 32))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(5000, [0.0] * 32), (5001, None)], "id long, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i in range(900) for j in range(i + 1, 900) if s[i, j] > 0.85}
    got = {(r["id_a"], r["id_b"]) for r in X.near_vectors(df, "id", "v", 0.85).collect()}
    assert len(want) > 300 and not got - want and len(got) >= 0.99 * len(want)


def test_contained_against_a_plain_loop(spark):
    rng = random.Random(3)
    word = lambda lo, hi: "".join(rng.choices("ab决定", k=rng.randrange(lo, hi)))
    needles, words = [(g, word(1, 6)) for g in "xy" for _ in range(40)], [(g, word(1, 9)) for g in "xyz" for _ in range(30)]
    got = {tuple(r) for r in contained(spark.createDataFrame(needles + [("x", None)], "grp string, needle string"), spark.createDataFrame(words + [("x", None)], "grp string, word string")).collect()}
    assert got == {(g, n) for g, n in needles if len(n) >= 2 and any(n in w for h, w in words if h == g)}


def test_match_starts(spark):
    df = spark.createDataFrame([("改用它，不用它",), ("",), (None,), ("nothing",), ("不用",)], "t string")
    got = [r[0] and [(x["start"], x["hit"]) for x in r[0]] for r in df.select(T.match_starts(F.col("t"), "不用|改用")).collect()]
    assert got == [[(1, "改用"), (5, "不用")], [], None, [], [(1, "不用")]]


def test_snippets(spark):
    df = spark.createDataFrame([("one two three four five six Budget. eight nine ten eleven twelve thirteen",), ("budget",), ("none",), (None,), ("a (b) c",)], "t string")
    got = [r[0] for r in df.select(R.snippet_tokens(F.col("t"), ["budget"])).collect()]
    assert got == ["...three four five six >>>Budget<<<. eight nine ten eleven twelve...", ">>>budget<<<", None, None, None]
    assert df.where("t LIKE 'a%'").select(R.snippet_tokens(F.col("t"), ["(b)"])).first()[0] == "a >>>(b)<<< c"


def test_mean_weights_with_few_hot_terms(spark, monkeypatch):
    from anamnesis.plans import retrieval

    tokens = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (2, "a"), (3, "d")], "ingest_no long, term string")
    idf = spark.createDataFrame([("a", 9, 1.0), ("b", 2, 2.0), ("c", 1, 4.0), ("d", 1, 5.0)], "term string, df long, idf double")
    want = {1: 4 / 3, 2: 2.5, 3: 5.0}
    for hot in (100, 1):
        monkeypatch.setattr(retrieval, "HOT_TERMS", hot)
        assert {r["ingest_no"]: r["mean"] for r in retrieval.mean_weight(tokens, idf).collect()} == pytest.approx(want)
