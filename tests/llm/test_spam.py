"""Spam pages: features of clear cases, trees on held-out data, frames."""

import random

import numpy as np

from anamnesis.llm.spam import FEATURES, PARTS, find_spam_pages, grow_trees, measure_page, put_together, score_pages, smooth_by_host, vote

PROSE = "The planner keeps the notes of one team apart from the others, because the older copy is still read by the gateway. When the list grows, it is merged before it is ranked again, so that nobody waits for it. "


def page(rng, spam):
    if spam:
        kind = rng.randrange(4)
        key = rng.choice(["quick viewer", "chat tool", "best router"])
        if kind == 0:
            return "\n".join(f"{rng.choice(['cheap', 'best', 'buy'])} {key} {rng.choice(['price', 'near me', 'online', 'sale'])}" for _ in range(40))
        if kind == 1:
            return "\n".join(f"https://shop.{rng.randrange(999)}.example.com/p{i}" for i in range(40))
        if kind == 2:
            return " | ".join(f"{rng.choice(['Acme', 'Bolt'])} {rng.choice(['lamp', 'bag', 'case'])} {rng.choice(['red', 'XL', '64GB'])} in stock" for _ in range(40))
        return ". ".join(f"get {key} now. for {key} choose {key}. why {key}? {key}" for _ in range(20))
    kind = rng.randrange(4)
    if kind == 0:
        return PROSE * rng.randrange(1, 5)
    if kind == 1:
        return "```python\ndef f(x):\n    return x\n```\n" + PROSE
    if kind == 2:
        return "\n".join(f"2025-01-0{rng.randrange(1, 9)}T10:00:00Z INFO part.{i} done id={i}" for i in range(20))
    return "name\tn\tratio\n" + "\n".join(f"row{i}\t{i * 7}\t0.{i}" for i in range(20)) + "\nSee https://docs.example.com/x for the rest of it, which is the longer part of the text."


def mixed(rng, spam):
    """A page of which about two thirds are of one kind and a third of the other: no labeller speaks."""
    own, other = page(rng, spam), page(rng, not spam)
    while len(own) < 600 or len(other) < 200:
        own, other = page(rng, spam), page(rng, not spam)
    return own + "\n" + other[: len(own) * 3 // 7]


def label(text):
    return measure_page(text)[1]


def test_weak_labels():
    rng = random.Random(1)
    assert {label(page(rng, True)) for _ in range(40)} == {1}
    assert {label(page(rng, False)) for _ in range(40)} == {0}
    assert measure_page(None) == measure_page("  \n") == ([0.0] * len(FEATURES), None)
    assert label("keyword " * 20_000) == 1
    # tables, glossaries, parameter lists and logs are none
    assert label("session,tokens,kept,owner\n" + "\n".join(f"s{i},{i * 7},0.{i},root" for i in range(20))) == 0
    assert label("\n".join(f"Word{i}: a {w} which is kept by the {w[::-1]} {n}{w}s for later." for i, (w, n) in enumerate(zip(PROSE.split(), PROSE.split()[5:])))) == 0
    assert label("\n".join(f"`limit_{i}` default {i}" for i in range(20))) == 0
    assert label("public class Store {\n    private int size;\n    public void add(String x) {\n        size = 1;\n    }\n}\n" * 3) == 0
    assert label("public registry noisy node visible public node registry noisy visible " * 12) == 1
    # neither half is enough to speak
    assert label(PROSE * 4 + "cheap viewer sale, " * 40) is None


def test_features_are_finite():
    rng = random.Random(5)
    for text in ("x", "。", "\ud800", "a," * 3, "https://a.example/b", "重复 " * 9, page(rng, True)):
        assert np.isfinite(measure_page(text)[0]).all()


def test_the_trees_decide_pages_without_label():
    rng = random.Random(8)
    known = [measure_page(page(rng, i % 3 == 0)) for i in range(900)]
    known += [m for i in range(600) if (m := put_together([page(rng, True) for _ in range(PARTS[i % 4][0])], [page(rng, False) for _ in range(PARTS[i % 4][1])], i))[1] is not None]
    x, y = np.array([m[0] for m in known]), np.array([m[1] for m in known], float)
    truth = [i % 2 == 0 for i in range(300)]
    doubtful = [measure_page(mixed(rng, t)) for t in truth]
    open_ = [i for i, m in enumerate(doubtful) if m[1] is None]
    assert len(open_) > 200
    votes = vote(grow_trees(x, y), np.array([doubtful[i][0] for i in open_]))
    right = np.mean([(v > 0.5) == truth[i] for v, i in zip(votes, open_)])
    # Without trees these pages have no label at all: half of them are right at best.
    assert right > 0.8


def test_hosts_decide_doubtful_pages_only(spark):
    rng = random.Random(9)
    rows, truth = [], {}
    for i in range(4000):
        bad_host = i % 4 == 0
        spam = rng.random() < (0.9 if bad_host else 0.03)
        sure = rng.random() < 0.9
        v = (0.97 if spam else 0.02) if sure else rng.uniform(0.3, 0.7)
        rows.append((i, f"{'bad' if bad_host else 'good'}{i % 40}", None, v))
        truth[i] = spam
    df = spark.createDataFrame(rows, "doc_id bigint, host string, label int, vote double")
    got = {r["doc_id"]: (r["vote"], r["score"]) for r in smooth_by_host(df).collect()}
    assert len(got) == 4000
    doubtful = [i for i, (v, _) in got.items() if 0.3 <= v <= 0.7]
    before = np.mean([(got[i][0] > 0.5) == truth[i] for i in doubtful])
    after = np.mean([(got[i][1] > 0.5) == truth[i] for i in doubtful])
    assert before < 0.6 and after > 0.9
    assert all(v == s for v, s in got.values() if v > 0.8 or v < 0.2)
    alike = spark.createDataFrame([(i, f"h{i % 7}", None, 0.5 if i % 50 == 0 else float(i % 10 < 3)) for i in range(700)], "doc_id bigint, host string, label int, vote double")
    assert all(abs(r["vote"] - r["score"]) < 0.05 for r in smooth_by_host(alike).collect())


def test_trees_on_held_out_rows():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.7)).astype(float)
    forest = grow_trees(x[:2000], y[:2000])
    assert ((vote(forest, x[2000:]) > 0.5) == y[2000:]).mean() > 0.97


def test_frames(spark):
    rng = random.Random(3)
    rows = [(i, page(rng, i % 4 == 0), "hot.example" if i % 3 else None) for i in range(200)] + [(900, None, "h"), (901, "", "h"), (902, " ", None), (0, page(rng, True), "hot.example"), (None, page(rng, True), None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1.0 AS vote", "'clash' AS label", "1 AS host_n")
    assert sorted(r["doc_id"] for r in find_spam_pages(df).collect()) == list(range(0, 200, 4))
    assert score_pages(df).count() == len(rows)
    assert find_spam_pages(df.limit(0)).count() == 0
    only = spark.createDataFrame([(1, PROSE, "a")], "doc_id bigint, text string, source string")
    assert find_spam_pages(only).count() == 0
