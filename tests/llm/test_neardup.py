"""Near-duplicates against all pairs, and the estimator of BagMinHash."""

import random
import re

import numpy as np

from anamnesis.llm.neardup import LATE, Signer, band_shape, near_duplicate_groups, near_duplicates, too_far, word_arrivals

MESSAGE = "message_id string, content string, ingest_no bigint, tbl string, no int"
NOTE = "note_id string, content string, ingest_no bigint, bag string"


def words(t):
    return frozenset("".join(c.lower() for c in w) for w in re.findall("[A-Za-z0-9]+", t or ""))


def brute(messages, notes):
    last = {}
    for i, t, n in messages:
        if i is not None and (i not in last or n > last[i][1]):
            last[i] = (t, n)
    items = {"messages": [(i, words(t)) for i, (t, _) in last.items()], "notes": [(i, words(t)) for i, t, _ in notes if i is not None]}
    out = set()
    for tbl, xs in items.items():
        for a, x in xs:
            for b, y in xs:
                if a < b and len(x) >= 12 and len(y) >= 12 and 10 * len(x & y) >= 7 * len(x | y):
                    out.add((tbl, a, b))
    return out


def run(spark, messages, notes, **banding):
    m = spark.createDataFrame([(*r, "clash", 0) for r in messages], MESSAGE)
    n = spark.createDataFrame([(*r, "clash") for r in notes], NOTE)
    got = [tuple(r) for r in near_duplicates(m, n, **banding).select("tbl", "id_a", "id_b").collect()]
    assert len(got) == len(set(got))
    return set(got)


def edits_and_copies():
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = rng.sample(vocabulary, rng.randrange(12, 40))
        texts.append(" ".join(base))
        for _ in range(4):
            new = base[:]
            for _ in range(rng.randrange(0, 7)):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            rng.shuffle(new)
            texts.append(", ".join(new).upper() if rng.random() < 0.3 else " ".join(new))
    messages = [(f"m{i:03}", t, i) for i, t in enumerate(texts)] + [("m000", "short now", 999), ("mnull", None, 1000), ("mempty", "", 1001), (None, texts[1], 1002), ("mlong", "x " * 50_000, 1003)]
    messages += [(f"copy{i:02}", "same words " + " ".join(vocabulary[:14]), 2000 + i) for i in range(40)]
    notes = [(f"n{i % 30:02}", t, i) for i, t in enumerate(texts)] + [("n00", None, 500), ("n01", texts[0], 501)]
    return messages, notes


def test_edits_copies_and_cases(spark):
    messages, notes = edits_and_copies()
    assert run(spark, messages, notes) == brute(messages, notes)


def test_longer_keys_several_ranges_and_split_runs(spark):
    """What large collections use: five registers a key, keys in ranges, hot keys in blocks."""
    messages, notes = edits_and_copies()
    assert run(spark, messages, notes, shape=band_shape(30_000_000, 0.7), ranges=3, run=2) == brute(messages, notes)


def test_groups(spark):
    messages, notes = edits_and_copies()
    m = spark.createDataFrame([(*r, "clash", 0) for r in messages], MESSAGE)
    n = spark.createDataFrame([(*r, "clash") for r in notes], NOTE)
    rows = near_duplicate_groups(m, n).collect()
    pairs = brute(messages, [])
    of = {r["id"]: r for r in rows if r["tbl"] == "messages"}
    assert len(of) == sum(r["tbl"] == "messages" for r in rows)
    assert all(of[a]["group_id"] == of[b]["group_id"] for _, a, b in pairs)
    parent = {i: i for i in of}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for _, a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert all(of[i]["group_id"] == find(i) for i in of)
    assert of["copy00"]["copies"] == 40 and of["copy39"]["class_id"] == "copy00"
    assert near_duplicate_groups(m.limit(0), n.limit(0)).count() == 0




def test_exactly_the_threshold(spark):
    shared = " ".join(f"s{i}" for i in range(14))
    a, b, c = shared + " a1 a2 a3", shared + " b1 b2 b3", shared + " b1 b2 b3 b4"
    assert run(spark, [("a", a, 1), ("b", b, 2), ("c", c, 3)], []) == {("messages", "a", "b"), ("messages", "b", "c")}


def test_empty(spark):
    assert run(spark, [], []) == set()


def test_weighted_estimate():
    m = 4096
    signer = Signer(m, 1)
    bags = [(["a", "b", "c", "d"], [5, 1, 2, 9]), (["a", "b", "c", "e"], [3, 1, 7, 4])]
    flat, weights = [w for b, _ in bags for w in b], np.array([x for _, ws in bags for x in ws])
    s = signer.sign(flat, weights, np.array([4, 8]))
    shared, united = 3 + 1 + 2, 5 + 1 + 7 + 9 + 4
    assert abs((s[0] == s[1]).mean() - shared / united) < 4 * (0.25 * 0.75 / m) ** 0.5 + 0.01


def test_signatures_are_the_earliest_places_of_their_words():
    """Registers take two bytes a word; bags of uneven lengths, some of which leave registers to later times."""
    rng, m = random.Random(6), 270
    signer = Signer(m, 12)
    bags = [rng.sample([f"w{i}" for i in range(900)], n) for n in [3, 700, *(rng.randrange(12, 60) for _ in range(700)), 12]]
    flat, ends = [w for b in bags for w in b], np.cumsum([len(b) for b in bags])
    got = signer.sign(flat, np.ones(len(flat), np.int64), ends)
    assert signer.table.dtype.itemsize == 2
    for bag, own in [*zip(bags, got)][:: len(bags) // 40]:
        hashes = np.array([signer.hashes[signer.index[w]] for w in bag], np.uint64)
        time = word_arrivals(hashes, np.ones(len(bag), np.int64), 8.0, m).min(axis=0)
        want = signer._places(time)
        assert (own[want < LATE] == want[want < LATE]).all() and (own[want == LATE] > LATE).all()
    assert (got > LATE).any() and (got < LATE).any()


def test_recall_of_the_bands():
    for n in (1, 10**6, 10**8, 10**11):
        bands, rows = band_shape(n, 0.7)
        assert (1 - 0.7**rows) ** bands < 0.0016
    assert band_shape(10**6, 0.7)[1] < band_shape(10**9, 0.7)[1]


def test_few_pairs_at_the_threshold_are_lost_by_the_bands():
    for n in (1, 10**6, 10**8, 10**11):
        bands, rows = band_shape(n, 0.7)
        assert (1 - 0.7**rows) ** bands < 0.0001


def test_no_pair_at_the_threshold_is_lost_by_the_parities():
    signer = Signer(8, 1)
    for n in (14, 70, 700):
        bags = []
        for k in range(40):
            both = [f"{n}s{k}x{i}" for i in range(n)]
            bags += [both + [f"{n}{side}{k}x{i}" for i in range(n * 3 // 14)] for side in "ab"]
        ones = np.ones(sum(map(len, bags)), np.int64)
        flat, ends = [w for b in bags for w in b], np.cumsum([len(b) for b in bags])
        bits = signer.parities(flat, ones, ends)
        mass = np.full(40, 2 * (n + n * 3 // 14))
        assert not too_far(bits[::2], bits[1::2], mass, 0.7).any()
        if n == 14:  # texts without common words are dropped
            assert too_far(bits[:-2:2], bits[3::2], mass[1:], 0.7).mean() > 0.95
    heavy = [(["a", "b"], [3, 20]), (["a", "b"], [4, 20])]
    flat, weights = [w for b, _ in heavy for w in b], np.array([x for _, ws in heavy for x in ws])
    bits = signer.parities(flat, weights, np.array([2, 4]))
    assert np.bitwise_count(bits[0] ^ bits[1]).sum() == 1
