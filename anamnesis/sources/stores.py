"""Foreign stores: folders of SQLite files with a table of messages.

A file is opened by the task that reads it, from its bytes in memory, so files
can lie in any file system; a file is the unit of work and has to fit into a
task.  Files that are no store, or have no such table, are counted as errors or
left out.
"""

from __future__ import annotations

import hashlib
import os
import sqlite3
import uuid
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from anamnesis.session import ship_package

#: Columns read, and their SQL types when written.
COLUMNS = {"message_id": "TEXT", "conversation_id": "TEXT", "role": "TEXT", "content": "TEXT"}


def _opened(blob: bytes) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    db.deserialize(bytes(blob))
    return db


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.db").option("recursiveFileLookup", True).load(path).select("path", "content")


def scan_stores(spark: SparkSession, path: str, table: str = "messages") -> DataFrame:
    """file, messages, error of every store file: its number of messages; null where the table is missing or the file is broken."""
    ship_package(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, blob in zip(b["path"], b["content"]):
                n, error = None, False
                try:
                    db = _opened(blob)
                    if db.execute("SELECT count(*) FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone()[0]:
                        n = db.execute(f'SELECT count(*) FROM "{table}"').fetchone()[0]
                except sqlite3.Error:
                    error = True
                rows.append((PurePosixPath(name).name, n, error))
            yield pd.DataFrame(rows, columns=["file", "messages", "error"]).astype({"messages": "Int64"})

    return _files(spark, path).mapInPandas(run, "file string, messages long, error boolean")


def read_stores(spark: SparkSession, path: str, table: str = "messages") -> DataFrame:
    """The messages of all store files, with the file; columns a store lacks are null."""
    ship_package(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, blob in zip(b["path"], b["content"]):
                try:
                    db = _opened(blob)
                    have = {r[1] for r in db.execute(f'PRAGMA table_info("{table}")')}
                    if not have:
                        continue
                    rows = db.execute("SELECT " + ", ".join(c if c in have else f"NULL AS {c}" for c in COLUMNS) + f' FROM "{table}"')
                    while part := rows.fetchmany(10_000):
                        yield pd.DataFrame(part, columns=list(COLUMNS)).assign(file=PurePosixPath(name).name)
                except sqlite3.Error:
                    continue

    return _files(spark, path).mapInPandas(run, ", ".join(f"{c} string" for c in COLUMNS) + ", file string")


def write_stores(messages: DataFrame, path: str, rows_a_file: int = 20_000) -> int:
    """Write messages as store files of at most so many rows into a folder that all tasks can reach as files; the number of files."""
    spark = messages.sparkSession
    ship_package(spark)
    folder = path.removeprefix("file:")
    if "://" in folder.removeprefix("//"):
        raise ValueError("store files are written to a mounted folder only")
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), rows_a_file):
                db = sqlite3.connect(":memory:")
                db.execute("CREATE TABLE messages (" + ", ".join(f"{c} {t}" for c, t in COLUMNS.items()) + ")")
                part = b.iloc[i : i + rows_a_file]
                db.executemany(f"INSERT INTO messages VALUES ({', '.join('?' * len(COLUMNS))})", part.astype(object).where(part.notna(), None).itertuples(index=False, name=None))
                db.commit()
                blob = db.serialize()
                # Named by what it holds, and put in place whole: a task that is run again writes the same file.
                name = hashlib.sha256(blob).hexdigest()[:24]
                with open(f"{folder}/.{name}-{uuid.uuid4().hex}", "wb") as f:
                    f.write(blob)
                os.replace(f.name, f"{folder}/store-{name}.db")
                yield pd.DataFrame({"file": [f"store-{name}.db"]})

    return messages.select(*COLUMNS).mapInPandas(run, "file string").count()
