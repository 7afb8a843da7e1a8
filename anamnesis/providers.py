"""Extension points: text generators and embedders that run inside batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from anamnesis.operators.search import query_terms
from anamnesis.session import ship_package


class Generator(Protocol):
    """Anything that turns texts into texts; it is sent to the workers, so it must be picklable."""

    def generate(self, texts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    """Anything that turns texts into vectors of one length."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Extractive:
    """The generator without a model: the first characters up to a sentence end."""

    def __init__(self, limit: int = 200):
        self.limit = limit

    def generate(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            head = " ".join(t.split())[: self.limit]
            end = max(head.rfind(c) for c in ".。!！?？")
            out.append(head[: end + 1] if end > self.limit / 2 else head)
        return out


class Hashed:
    """The embedder without a model: each word adds 1 or -1 to the dimension its hash names, so texts with common words
    have near vectors; the same at every call."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for term in query_terms(t):
                h = int.from_bytes(hashlib.md5(term.encode()).digest()[:8], "big")
                out[i, h % self.size] += 1 if h >> 63 else -1
        return out.tolist()


class Fallback:
    """The first generator that doesn't fail."""

    def __init__(self, *generators: Generator):
        self.generators = generators

    def generate(self, texts: list[str]) -> list[str]:
        for g in self.generators:
            try:
                return g.generate(texts)
            except Exception:  # noqa: BLE001
                continue
        raise RuntimeError("no generator answered")


def summarise(df: DataFrame, generator: Generator) -> DataFrame:
    """id and summary of rows (id, text)."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "summary": generator.generate(b["text"].fillna("").tolist())})

    return df.select("id", "text").mapInPandas(run, "id long, summary string")


def embed(df: DataFrame, embedder: Embedder) -> DataFrame:
    """id and vector of rows (id, text)."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "vector": embedder.embed(b["text"].fillna("").tolist())})

    return df.select("id", "text").mapInPandas(run, "id long, vector array<double>")
