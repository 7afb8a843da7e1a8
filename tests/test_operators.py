"""Small cases of the ordered, similarity and search operators."""

import os

import pytest
from pyspark.sql import functions as F

from anamnesis.functions import scoring as S
from anamnesis.functions import text as T
from anamnesis.operators import dag
from anamnesis.operators import search as R
from anamnesis.operators import similarity as X
from anamnesis.operators.chains import chain_roots, neighbours
from anamnesis.operators.ordered import ranked, running_sums
from anamnesis.operators.segments import capped_episodes, merged_episodes

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_sums_and_ranks_of_a_hot_group(spark):
    df = spark.range(1000).select((F.col("id") % 7 == 0).cast("int").alias("g"), "id")
    got = {r["id"]: (r["rank"]) for r in ranked(df, "g", ["id"]).collect()}
    for g in (0, 1):
        own = [i for i in range(1000) if int(i % 7 == 0) == g]
        assert [got[i] for i in own] == list(range(1, len(own) + 1))
    sums = {r["id"]: r["s"] for r in running_sums(df, "g", ["id"], {"s": "id"}).collect()}
    assert sums[14] == 0 + 7 + 14


def test_null_groups_and_empty_frames(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 5)], "g string, x int")
    assert {(r["g"], r["x"], r["rank"]) for r in ranked(df, "g", ["x"]).collect()} == {(None, 1, 1), (None, 2, 2), ("a", 5, 1)}
    assert {(r["g"], r["x"], r["next"]) for r in neighbours(df, "g", "x").collect()} == {(None, 1, 2), (None, 2, None), ("a", 5, None)}
    assert ranked(df.limit(0), "g", ["x"]).count() == 0 and neighbours(df.limit(0), "g", "x").count() == 0


def test_neighbours(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 9)], "g string, x int")
    assert rows(neighbours(df, "g", "x").fillna(-1)) == [("a", 1, -1, 2), ("a", 2, 1, 3), ("a", 3, 2, -1), ("b", 9, -1, -1)]


def test_chain_roots_leave_circles_out(spark):
    links = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(20)] + [("x", "y"), ("y", "x")], "node string, prev string")
    nodes = spark.createDataFrame([(f"n{i}", i) for i in range(21)] + [("x", 1), ("y", 1), ("solo", 4)], "node string, w int")
    got = {r["node"]: (r["root"], r["before_w"]) for r in chain_roots(links, nodes, ["w"]).collect()}
    assert got == {f"n{i}": ("n0", sum(range(i))) for i in range(21)} | {"solo": ("solo", 0)}


def test_decay_values(spark):
    df = spark.createDataFrame([(0.0,), (14.0,), (28.0,), (1000.0,), (None,)], "d double")
    assert [round(r[0], 3) for r in df.select(S.recall_decay(F.col("d"))).collect()] == [1.0, 0.65, 0.475, 0.3, 0.3]


def test_fusion_values(spark):
    ch = spark.createDataFrame([(0, "a", 0), (0, "b", 1), (1, "a", 0)], "channel int, id string, place int")
    got = {r["id"]: r["score"] for r in R.reciprocal_ranks(ch).collect()}
    assert got["a"] == pytest.approx(2 / 61) and got["b"] == pytest.approx(1 / 62)


def test_twelve_leaves_make_three(spark):
    leaf = spark.createDataFrame([("c", 0, f"s{i:02}", i, 10, "t") for i in range(12)] + [("d", 0, f"q{i}", i, 10, "t") for i in range(3)], "conversation_id string, depth int, summary_id string, made int, descendants int, content string")
    got = rows(dag.condense(leaf).select("conversation_id", "depth", "descendants"))
    assert got == [("c", 1, 40)] * 3


def test_cascade_ends(spark):
    leaf = spark.createDataFrame([("c", 0, f"s{i:02}", i, 1, "t") for i in range(17)], "conversation_id string, depth int, summary_id string, made int, descendants int, content string")
    got = [r["depth"] for r in dag.cascade(leaf.withColumn("made", F.col("made").cast("bigint")).withColumn("descendants", F.col("descendants").cast("bigint"))).collect()]
    assert (got.count(0), got.count(1), got.count(2)) == (17, 4, 1)


def test_five_identical_leave_one(spark):
    items = spark.createDataFrame([("g", f"m{i}", 1.0, i) for i in range(5)], "grp string, id string, score double, place int")
    pairs = spark.createDataFrame([("g", f"m{i}", f"m{j}") for i in range(5) for j in range(i + 1, 5)], "grp string, id_a string, id_b string")
    assert [r["id"] for r in X.greedy_removal(pairs, items).orderBy("id").collect()] == ["m1", "m2", "m3", "m4"]


def test_similarity_joins_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    data = [(f"i{n:02}", [f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 9))]) for n in range(40)]
    df = spark.createDataFrame(data, "id string, terms array<string>")
    jac, cos = set(), set()
    for a, x in data:
        for b, y in data:
            if a < b:
                if 10 * len(set(x) & set(y)) >= 7 * len(set(x) | set(y)):
                    jac.add((a, b))
                dot = sum(x.count(w) * y.count(w) for w in set(x))
                if dot * dot * 10000 > 6724 * sum(x.count(w) ** 2 for w in set(x)) * sum(y.count(w) ** 2 for w in set(y)):
                    cos.add((a, b))
    assert {(r[0], r[1]) for r in X.jaccard_pairs(df, 7, 10).collect()} == jac
    assert {(r[0], r[1]) for r in X.cosine_pairs(df, 82, 100).collect()} == cos


def test_components(spark):
    pairs = spark.createDataFrame([(f"a{i:02}", f"a{i + 1:02}") for i in range(30)] + [("z1", "z2")], "id_a string, id_b string")
    got = {r["id"]: r["root"] for r in X.components(pairs).collect()}
    assert set(got.values()) == {"a00", "z1"} and len(got) == 33


def test_capped_episodes_start_again(spark):
    data = [("c", 0, i, i, f"m{i}", 60) for i in range(6)]
    df = spark.createDataFrame(data, "conversation_id string, episode_no int, us long, ingest_no long, message_id string, tokens int")
    got = {r["message_id"]: r["part"] for r in capped_episodes(df, 100).collect()}
    # The message at which a part is cut isn't counted in it.
    assert [got[f"m{i}"] for i in range(6)] == [0, 1, 1, 2, 2, 3]


def test_cosine_pairs_against_all_pairs(spark, monkeypatch):
    import random
    from collections import Counter

    monkeypatch.setattr(X, "BLOCK", 20)  # hot terms are dealt to blocks
    rng = random.Random(5)
    data = [("g" if i % 3 else "h", f"{i:03}", rng.choices("abcdefgh", [9, 7, 5, 3, 2, 1, 1, 1], k=rng.randrange(0, 14)) + rng.choices("xyz", k=i % 2)) for i in range(200)]
    data += [("g", "long1", ["x"] * 400 + ["y"] * 90), ("g", "long2", ["x"] * 300 + ["y"] * 31), ("h", "long3", ["x"] * 300 + ["y"] * 31)]
    counts = {i: (g, Counter(t)) for g, i, t in data}
    want = set()
    for a in counts:
        for b in counts:
            (g, x), (h, y) = counts[a], counts[b]
            dot = sum(n * y[k] for k, n in x.items())
            if a < b and g == h and dot * dot * 10000 > 6724 * sum(n * n for n in x.values()) * sum(n * n for n in y.values()):
                want.add((a, b, dot))
    got = X.cosine_pairs(spark.createDataFrame(data, "grp string, id string, terms array<string>"), 82, 100, ["grp"])
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 500


def test_few_chance_meetings_are_written(spark, monkeypatch):
    import random

    rng, sizes, write = random.Random(6), [], X.cut

    def cut(df):
        out = write(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(X, "cut", cut)
    names = [f"name{i}" for i in range(300)]
    frames = [[f"w{t}x{i}" for i in range(9)] for t in range(4)]
    data = [(f"{i:04}", [w for t in rng.sample(frames, 2) for w in [*t, "the", *rng.sample(names, 4)]]) for i in range(600)]
    data += [(f"c{i}", [*w[:-1], "new"]) for i, w in data[:200]]
    n = X.cosine_pairs(spark.createDataFrame(data, "id string, terms array<string>"), 82, 100).count()
    # Tables by item, and the pairs that are compared by text: nearly all others are dropped where they meet.
    assert n >= 200 and max(sizes) <= 800 + 2 * n


def test_deduplicated_messages(spark):
    same = ["a", "b", "c", "d"]
    data = [("c", "low", same, 1.0, 1, False), ("c", "high", same, 2.0, 2, False), ("c", "tie", same, 2.0, 3, False), ("c", "exempt", same, 0.0, 4, True), ("c", "s1", ["x", "y"], 1.0, 5, False), ("c", "s2", ["x", "y"], 1.0, 6, False), ("d", "other", same, 0.0, 1, False)]
    items = spark.createDataFrame(data, "grp string, id string, terms array<string>, score double, place int, exempt boolean")
    assert rows(X.alike_removed(items, 82, 100, 3)) == [("low",), ("tie",)]


def test_small_and_large_groups_are_deduplicated_alike(spark, monkeypatch):
    import random

    rng = random.Random(8)
    data = [(f"g{i % 4}", f"m{i}", rng.choices("abcdef", [9, 6, 4, 2, 1, 1], k=rng.randrange(0, 12)), float(rng.randrange(3)), f"{i:03}", i % 9 == 0) for i in range(160)]
    items = spark.createDataFrame(data, "grp string, id string, terms array<string>, score double, place string, exempt boolean")
    small = rows(X.alike_removed(items, 82, 100, 3))
    monkeypatch.setattr(X, "SMALL_GROUP", 0)
    assert small and rows(X.alike_removed(items, 82, 100, 3)) == small


def test_repeated_texts_of_a_large_group_are_not_paired(spark, monkeypatch):
    import random

    write, sizes, rng = X.cut, [], random.Random(9)

    def cut(df):
        out = write(df)
        sizes.append(out.count())
        return out

    texts = ["working on it".split(), "it is on working order".split(), "it is on working order now".split(), "sounds good to me".split()]
    data = [("g", f"m{i}", rng.sample(t := rng.choice(texts), len(t)), float(rng.randrange(4)), f"{i:04}", False) for i in range(1_200)]
    gone, of = set(), {i: (frozenset(t), s) for _, i, t, s, _, _ in data}
    alike = {(a, b) for a in map(frozenset, texts) for b in map(frozenset, texts) if len(a & b) ** 2 * 10_000 > 6_724 * len(a) * len(b)}
    for k, (_, i, *_) in enumerate(data):
        for _, j, *_ in data[k + 1 :]:
            if i in gone:
                break
            if j not in gone and (of[i][0], of[j][0]) in alike:
                gone.add(j if of[i][1] >= of[j][1] else i)
    items = spark.createDataFrame(data, "grp string, id string, terms array<string>, score double, place string, exempt boolean")
    monkeypatch.setattr(X, "cut", cut)
    assert {r["id"] for r in X.alike_removed(items, 82, 100, 3).collect()} == gone and len(alike) > 4
    # Pairs of items would be some 360,000.
    assert max(sizes) <= len(data)


def test_notes_with_the_same_words_are_not_paired(spark, monkeypatch, tmp_path):
    from anamnesis.plans import retrieval

    write, sizes = X.cut, []

    def cut(df):
        out = write(df)
        sizes.append(out.count())
        return out

    data = [(f"n{i:03}", f"heartbeat zesobox {1000 + i} ms") for i in range(300)] + [("other", "the listener fits the upper lock"), (None, None)]
    spark.createDataFrame(data, "note_id string, content string").write.parquet(f"{tmp_path}/notes.parquet")
    monkeypatch.setattr(X, "cut", cut), monkeypatch.setattr(retrieval, "cut", cut)
    gone = sorted(r["id"].split("|")[0] for r in retrieval.duplicate_notes(spark, str(tmp_path)).collect())
    assert gone == [f"n{i:03}" for i in range(1, 300)]
    assert max(sizes) <= len(data)  # pairs of notes would be 44,850


def test_flow_over_messages_leaves_notes_alone(spark, monkeypatch):
    from anamnesis.plans import pipelines, retrieval

    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    monkeypatch.setattr(retrieval, "duplicate_notes", lambda *_: pytest.fail("notes are compared"))
    assert pipelines.t26_dedup_flow(spark, SMALL).columns == ["message_id"]


def test_messages_are_deduplicated(spark):
    from anamnesis.plans import registry
    from anamnesis.plans.relational import msgs

    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    gone = registry.queries()["t2_deduplicate"](spark, SMALL)
    assert gone.join(msgs(spark, SMALL), gone["id"] == F.col("message_id"), "left_semi").count() > 0


def test_first_and_repeats_against_a_plain_loop(spark):
    import random

    rng = random.Random(3)
    data = [(g, f"{g}{i:02}", rng.choices("abcdefg", k=rng.randrange(0, 9)), i) for g in ("tool", "system") for i in range(60)]
    data += [("tool", "beat1", "heartbeat zesobox 3793 ms".split(), 98), ("tool", "beat2", "heartbeat zesobox 7635 ms".split(), 99)]
    want = {}
    for g, i, terms, _ in data:
        kept = [k for k in want if k[0] == g and set(terms) and 5 * len(k[2] & set(terms)) > 4 * len(k[2] | set(terms))]
        key = kept[0] if kept else (g, i, frozenset(terms))
        want[key] = want.get(key, 0) + 1
    got = X.first_and_repeats(spark.createDataFrame(data, "grp string, id string, terms array<string>, place int"), 4, 5)
    assert {(r["grp"], r["id"]): r["repeat_count"] for r in got.collect()} == {k[:2]: n for k, n in want.items()}


def test_short_episodes_join_the_one_before(spark):
    data = [("c", 0, 0, "a", 30), ("c", 1, 0, "b", 40), ("c", 2, 0, "d", 60), ("c", 2, 0, "e", 50), ("c", 2, 1, "f", 20), ("c", 3, 0, "g", 100), ("d", 0, 0, "h", 500), ("d", 1, 0, "i", 99)]
    df = spark.createDataFrame(data, "conversation_id string, episode_no int, part int, message_id string, tokens int")
    got = {r["message_id"]: r["merged_no"] for r in merged_episodes(df, 100).collect()}
    assert got == {"a": 0, "b": 0, "d": 1, "e": 1, "f": 1, "g": 2, "h": 0, "i": 0}


def test_a_cap_without_the_first_message(spark):
    data = [("c", 0, i, i, f"m{i}", 60) for i in range(6)]
    df = spark.createDataFrame(data, "conversation_id string, episode_no int, us long, ingest_no long, message_id string, tokens int")
    got = {r["message_id"]: r["part"] for r in capped_episodes(df, 100, first_counts=False).collect()}
    assert [got[f"m{i}"] for i in range(6)] == [0, 0, 1, 1, 2, 2]


def test_greedy_choice_prefers_difference(spark):
    c = spark.createDataFrame([("q", "a", 1.0, "xxxx"), ("q", "b", 0.9, "xxxx"), ("q", "c", 0.8, "yzuv"), ("q", "d", 0.1, None)], "query string, id string, score double, content string")
    assert [r["id"] for r in R.diversify(c, 0.5, 2).orderBy("place").collect()] == ["a", "c"]


def test_text_cases(spark):
    df = spark.createDataFrame([("",), (None,), ("天气很好 ok",)], "t string")
    got = df.select(T.token_estimate(F.col("t")), F.size(T.terms_full(F.col("t"))), T.snippet(F.col("t"))).collect()
    assert tuple(got[0]) == (0, 0, "") and got[1][0] is None and got[2][0] == 3


def test_tables_end_with_their_scope(spark):
    from anamnesis.session import cut, discard, scratch

    with scratch(spark):
        a, b = cut(spark.range(3)), cut(spark.range(4))
        folders = [p._cut_path.removeprefix("file:") for p in (a, b)]
        assert all(map(os.path.isdir, folders)) and a.count() == 3
        discard(a)
        assert not os.path.isdir(folders[0])
    assert not any(map(os.path.isdir, folders))
    kept = cut(spark.range(2))
    assert kept.count() == 2 and os.path.isdir(kept._cut_path.removeprefix("file:"))
