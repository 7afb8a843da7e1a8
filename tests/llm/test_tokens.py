"""Token ids against the public library, and the segment tree against a plain scan."""

import os
import random

import pytest

from anamnesis.llm.tokens import Encoder, count_tokens, encode_corpus, merge_piece, vocabulary_path

pytestmark = pytest.mark.skipif(not os.path.exists(vocabulary_path()), reason="no vocabulary files")


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "a", "Hello world's end, it's 2025!", "<|endoftext|> stays text", "天气 很好。再见", "a" * 3000, "ab" * 900, "é🎉👩‍🔬" * 50, "tabs\t\tand\r\n\r\n  blanks  ", "\x00\x1c\x1f\x7f​﻿", "x" * 64 + "1" * 500, "　  z"]


def test_same_ids_as_the_public_library(public):
    e = Encoder(vocabulary_path())
    for t in TEXTS:
        assert e.encode(t) == public(t)


def test_random_unicode(public):
    rng, e = random.Random(3), Encoder(vocabulary_path())
    for _ in range(300):
        t = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FF), rng.randrange(0x4E00, 0x4F00), rng.randrange(0x1F300, 0x1F600), 32])) for _ in range(rng.randrange(40)))
        assert e.encode(t) == public(t)


def test_tree_equals_scan():
    ranks = {bytes([a]): a for a in range(97, 101)} | {b"ab": 200, b"bc": 201, b"abc": 202, b"cd": 203, b"aa": 204, b"aaaa": 205, b"dd": 206}
    rng = random.Random(1)
    for _ in range(500):
        piece = bytes(rng.randrange(97, 101) for _ in range(rng.randrange(1, 24)))
        parts = [piece[i : i + 1] for i in range(len(piece))] if piece not in ranks else [piece]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert merge_piece(piece, ranks) == [ranks[p] for p in parts]


def test_frame_cases(spark):
    df = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (2, None, 1), (3, "", 1), (None, "x", 1)], "doc_id bigint, text string, ids int")
    got = sorted((str(r["doc_id"]), list(r["ids"])) for r in encode_corpus(df).collect())
    ab = Encoder(vocabulary_path()).encode("a b")
    assert got == sorted([("1", ab), ("1", ab), ("2", []), ("3", []), ("None", Encoder(vocabulary_path()).encode("x"))])
    assert encode_corpus(df.limit(0)).count() == 0
    assert sorted(r["n_tokens"] for r in count_tokens(df).collect()) == [0, 0, 1, 2, 2]
