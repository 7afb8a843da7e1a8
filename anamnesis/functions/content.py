"""Content of typed blocks and of nested JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.session import ship_package


def flatten_blocks(blocks: Column) -> Column:
    """Text of blocks (type, text, name): texts as they are, calls as [name], joined by line ends; null for null."""
    one = lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "toolCall", F.concat(F.lit("["), b["name"], F.lit("]"))).otherwise(b["text"])
    return F.when(blocks.isNotNull(), F.array_join(F.filter(F.transform(blocks, one), lambda t: t.isNotNull()), "\n"))


def texts_in(value) -> Iterator[str]:
    """Texts anywhere in a JSON value, in order; a stack instead of recursion, so depth is no limit."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            yield v
        elif isinstance(v, dict):
            stack.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            stack.extend(reversed(v))


def json_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and the joined texts of JSON contents; what is no JSON gives an empty text."""

    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["t"]:
                try:
                    out.append("\n".join(texts_in(json.loads(t))) if t is not None else "")
                except (ValueError, RecursionError):
                    out.append("")
            yield pd.DataFrame({key: b["k"], "text": out})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} long, text string")


def trim_block_list(value):
    """Blocks of an answer: thinking becomes a summary of 100 characters, texts over 500 characters are cut to 200; a text
    that is a list of blocks itself is trimmed likewise.  What is no list stays."""
    if not isinstance(value, list):
        return value
    out = []
    for block in value:
        if isinstance(block, dict) and block.get("type") == "thinking":
            text = block.get("thinking") or ""
            block = {"type": "thinking_summary", "preview": text[:100] + ("..." if len(text) > 100 else ""), "original_length": len(text), "_trimmed": True}
        elif isinstance(block, dict) and block.get("type") == "text":
            text = block.get("text") or ""
            try:
                text = json.dumps(trim_block_list(json.loads(text)), ensure_ascii=False)
            except (ValueError, RecursionError):
                text = text[:200] + f"... [truncated {len(text) - 200} chars]" if len(text) > 500 else text
            block = block | {"text": text}
        out.append(block)
    return out


def trim_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and the trimmed JSON of contents that are lists of blocks; other contents stay as they are."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["t"]:
                try:
                    out.append(json.dumps(trim_block_list(json.loads(t)), ensure_ascii=False) if t is not None else None)
                except (ValueError, RecursionError):
                    out.append(t)
            yield pd.DataFrame({key: b["k"], "content": pd.Series(out, dtype=object)})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} long, content string")


def whole_mean(values: Column) -> Column:
    """The running mean of an ordered array in whole numbers, each step cut down."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("mean"))
    step = lambda a, x: F.struct((a["n"] + 1).alias("n"), F.floor((a["mean"] * a["n"] + x) / (a["n"] + 1)).cast("bigint").alias("mean"))
    return F.aggregate(values, start, step, lambda a: a["mean"])
