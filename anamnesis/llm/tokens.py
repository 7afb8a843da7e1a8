"""Byte-level BPE encoding with a public vocabulary, by a segment tree over pair ranks.

A text is cut into pieces by the vocabulary's pre-tokenisation pattern.  The
symbols of a piece are the leaves' borders of a segment tree: leaf i holds the
rank of the pair (symbol i, next living symbol), inner nodes the smallest rank
below them with ties to the left, so the root names the leftmost pair of lowest
rank.  A merge changes two leaves and costs O(log n), where a plain scan costs
O(n) for every merge; texts of one endless run stay near-linear.

Scale: no shuffle at all.  Each Python worker reads the vocabulary once and
keeps what it knows about pieces (a bounded memo), since most pieces of a corpus
repeat.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from anamnesis.session import ship_package

#: Fixed value: the pre-tokenisation pattern published with the 50k byte-level vocabulary.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 1 << 18
NONE = 1 << 62


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> str:
    """Place of a vocabulary file; the folder is a parameter of the cluster, nothing is copied into the package."""
    return f"{folder}/{name}"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    parts = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1
    while size < n - 1:
        size *= 2
    tree = [NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        if (r := get(parts[i] + parts[i + 1])) is not None:
            tree[size + i] = r * n + i  # the rank decides, then the place: one number orders both
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    while (best := tree[1]) < NONE:
        i = best % n
        j = after[i]
        parts[i] += parts[j]
        parts[j] = b""
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
        for at, nxt in ((j, -1), (i, k), (before[i], i)):
            if at < 0 or at >= n - 1:
                continue
            r = get(parts[at] + parts[nxt]) if 0 <= nxt < n else None
            at_leaf = size + at
            tree[at_leaf] = NONE if r is None else r * n + at
            at_leaf >>= 1
            while at_leaf:
                a, b = tree[2 * at_leaf], tree[2 * at_leaf + 1]
                least = a if a <= b else b
                if tree[at_leaf] == least:
                    break
                tree[at_leaf] = least
                at_leaf >>= 1
    return [ranks[p] for p in parts if p]


class Encoder:
    """Encodes texts with one vocabulary; pieces that were met before are looked up."""

    def __init__(self, path: str):
        import regex

        self.ranks = read_ranks(path)
        self.find = regex.compile(PIECES).findall
        self.memo: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts give no ids.  Special tokens' strings are ordinary text."""
        if not text:
            return []
        out: list[int] = []
        memo, extend = self.memo, out.extend
        for piece in self.find(text):
            ids = memo.get(piece)
            if ids is None:
                ids = merge_piece(piece.encode("utf-8", "surrogatepass"), self.ranks)
                if len(piece) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            extend(ids)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _batches(path: str, counts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, texts = part.column(0), part.column(1)
                if counts:
                    yield pa.RecordBatch.from_arrays([ids, pa.array([len(encode(t.as_py())) for t in texts], pa.int64())], ["doc_id", "n_tokens"])
                    continue
                flat: list[int] = []
                ends = np.zeros(len(texts) + 1, np.int32)
                for i, t in enumerate(texts):
                    flat.extend(encode(t.as_py()))
                    ends[i + 1] = len(flat)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(flat, np.int32, len(flat))))
                yield pa.RecordBatch.from_arrays([ids, lists], ["doc_id", "ids"])

    return run


def encode_corpus(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row.

    Defined cases: null and empty texts give an empty list; a row per input row,
    repeated rows included; null doc_id stays null; an empty table gives no
    rows; further columns are ignored.
    """
    ship_package(documents.sparkSession)
    return documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"]).mapInArrow(_batches(path or vocabulary_path(), False), "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row, in the same units as :func:`encode_corpus`."""
    ship_package(documents.sparkSession)
    return documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"]).mapInArrow(_batches(path or vocabulary_path(), True), "doc_id bigint, n_tokens bigint")
