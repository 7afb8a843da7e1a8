"""Rebuilt conversations against a plain reading of the definition."""

import random

import pytest

from anamnesis.llm.conversations import INVISIBLE, SPEAKERS, rebuild_conversations, reply_paths

SCHEMA = "message_id string, conversation_id string, seq bigint, role string, content string, ingest_no bigint, block int, speaker string"
BLANK = set("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85      　​﻿") | {chr(c) for c in range(0x2000, 0x200B)}


def brute(rows):
    last = {}
    for r in rows:
        if r[0] is not None and (r[0] not in last or r[5] > last[r[0]][5]):
            last[r[0]] = r
    convs = {}
    for r in last.values():
        if r[1] is not None:
            convs.setdefault(r[1], []).append(r)
    out = []
    for c, ms in convs.items():
        roles = {"".join(ch for ch in (r[3] or "").lower() if ch not in BLANK | set("_:-")): r for r in ms}
        who = {s: k for k, v in SPEAKERS.items() for s in v}
        seqs = [r[2] for r in ms]
        if None in seqs or len(set(seqs)) < len(seqs) or max(seqs) - min(seqs) + 1 != len(seqs) or min(seqs) not in (0, 1) or any(k not in who for k in roles):
            continue
        ms.sort(key=lambda r: r[2])
        seen = [r for r in ms if any(ch not in BLANK for ch in (r[4] or ""))]
        talk = [k for r in seen if (k := who["".join(ch for ch in r[3].lower() if ch not in BLANK | set("_:-"))]) in ("user", "assistant")]
        if "user" not in talk or any(a == "user" and b != "assistant" for a, b in zip(talk, [*talk[1:], "end"])):
            continue
        out += [(c, i + 1, r[0]) for i, r in enumerate(seen)]
    return sorted(out)


def run(spark, rows):
    return sorted(tuple(r) for r in rebuild_conversations(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect())


def test_cases(spark):
    def conv(c, items, start=0):
        return [(f"{c}{i}", c, start + i, role, text, i) for i, (role, text) in enumerate(items)]

    rows = (
        conv("good", [("system", "s"), (" User", "hi"), ("AI", "yo"), ("tool", "​ "), ("human", "more"), ("助手", "done")], 1)
        + conv("unanswered", [("user", "a"), ("user", "b"), ("assistant", "c")])
        + conv("hidden", [("user", "a"), ("assistant", "　﻿")])
        + conv("nouser", [("assistant", "a")])
        + conv("odd", [("user", "a"), ("n/a", "b"), ("assistant", "c")])
        + conv("late", [("user", "a"), ("assistant", "b")], 2)
        + [("g1", "gap", 0, "user", "a", 1), ("g2", "gap", 2, "assistant", "b", 2)]
        + [("t1", "twice", 0, "user", "a", 1), ("t2", "twice", 0, "assistant", "b", 2)]
        + [("n1", "null", None, "user", "a", 1), ("n2", "null", 0, "assistant", "b", 2)]
        + [("w1", None, 0, "user", "a", 1), (None, "good", 9, "user", "a", 1)]
        + [("r1", "redone", 5, "user", "old", 1), ("r1", "redone", 0, "user", "new", 3), ("r2", "redone", 1, "toolResult", "x", 4), ("r3", "redone", 2, "bot", "y", 5), ("r3", "redone", 2, "bot", "y", 6)]
    )
    got = run(spark, rows)
    assert got == brute(rows)
    assert {r[0] for r in got} == {"good", "redone"} and INVISIBLE


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_with_a_hot_conversation(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(30):
        n = 700 if c == 0 else rng.randrange(1, 9)
        for i in range(n):
            role = ("user", "assistant")[i % 2] if rng.random() < 0.97 or c == 0 else rng.choice(["user", "tool", "?"])
            rows.append((f"m{c}_{i}", f"c{c}", i + c % 2, role, rng.choice(["text", "x"]) if c == 0 or rng.random() < 0.95 else " ", len(rows)))
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_reply_paths(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "y"), ("o", "gone"), ("p", "o"), ("s", "s")], "id string, parent string")
    got = {r["node"]: (r["root"], r["depth"], r["status"]) for r in reply_paths(df, "id", "parent").collect()}
    assert got["c"] == ("a", 2, "ok") and got["p"] == ("o", 1, "orphan")
    assert {got[k][2] for k in "xyzs"} == {"circle"}
