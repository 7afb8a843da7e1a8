"""Note history against a plain reading of the definition."""

import datetime as dt
import random

import pytest

from anamnesis.operators.history import note_history

SCHEMA = "note_id string, category string, content string, confidence double, created_at timestamp_ntz, updated_at timestamp_ntz, superseded_by string, owner string, ingest_no bigint, root string"
T0 = dt.datetime(2025, 1, 1)


def at(n):
    return None if n is None else T0 + dt.timedelta(seconds=n)


def us(t):
    return int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def brute(rows):
    notes = {}
    for r in rows:
        t = r[5] or r[4]
        if r[0] is not None and t is not None:
            notes.setdefault(r[0], []).append((us(t), r))
    begin = {}
    for n, rs in notes.items():
        c = [us(r[4]) for _, r in rs if r[4]]
        begin[n] = min(c) if c else min(us(r[5]) for _, r in rs if r[5])
    end, nxt = {}, {}
    for n, rs in notes.items():
        named = {r[6] for _, r in rs if r[6] is not None}
        later = sorted((begin[s], s) for s in named if s in notes and begin[s] > begin[n])
        outside = [t for t, r in rs if r[6] is not None and r[6] not in notes]
        if later:
            end[n], nxt[n] = later[0]
        else:
            end[n] = min(outside) if outside else None
    versions = {}
    for n, rs in notes.items():
        states = {}
        for t, r in rs:
            states.setdefault(t, (r[1], r[2], r[3], r[7]))
        ts = sorted(states)
        vs = [begin[n]]
        for a, b in zip(ts, ts[1:]):
            if states[a] != states[b] and (end[n] is None or b < end[n]):
                vs.append(b)
        ends = vs[1:] + [end[n] if end[n] is not None else -1]
        versions[n] = list(zip(vs, ends))
    out, used = [], set(nxt.values())
    for n in notes:
        if n in used:
            continue
        k, cur = 0, n
        while cur:
            for f, e in versions[cur]:
                k += 1
                out.append((n, k, cur, f, e))
            cur = nxt.get(cur)
    return sorted(out)


def run(spark, rows):
    df = note_history(spark.createDataFrame(rows, SCHEMA))
    return sorted(tuple(r) for r in df.collect())


def test_lines_gaps_and_returns(spark):
    rows = [
        ("a", "x", "one", 1.0, at(0), at(0), None, "o", 1, "clash"),
        ("a", "x", "two", 1.0, at(0), at(10), None, "o", 2, None),
        ("a", "x", "one", 1.0, at(0), at(20), "b", "o", 3, None),
        ("a", "x", "one", 1.0, at(0), at(20), "b", "o", 4, None),
        ("a", "x", "late", 1.0, at(0), at(99), "b", "o", 5, None),
        ("b", None, None, None, at(50), None, "b", None, 6, None),
        ("b", None, None, None, None, at(60), "gone", None, 7, None),
        ("c", "x", "", 0.0, None, at(5), "a", "o", 8, None),
        ("d", "x", "", -0.0, at(5), at(6), None, "o", 9, None),
        ("d", "x", "", 0.0, at(5), at(7), None, "o", 10, None),
        (None, "x", "", 0.0, at(5), at(7), None, "o", 11, None),
        ("e", "x", "", 0.0, None, None, None, "o", 12, None),
    ]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_with_a_hot_note(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(12)]
    started = {n: rng.randrange(1000) for n in ids}
    heirs = {n: rng.choice([None, "zz", n, *[m for m in ids if started[m] > started[n]][:1]]) for n in ids}
    taken = set()
    for n in ids:  # one line per heir
        if heirs[n] in taken:
            heirs[n] = None
        taken.add(heirs[n])
    rows = []
    for i in range(400):
        n = ids[0] if i % 3 == 0 else rng.choice(ids)
        t = started[n] + rng.randrange(500)
        rows.append((n, "c", f"text {t // 40}", float(t // 90), at(started[n]), at(t), heirs[n] if rng.random() < 0.5 else None, None, i, None))
    assert run(spark, rows) == brute(rows)
