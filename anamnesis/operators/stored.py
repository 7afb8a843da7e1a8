"""Frames that are built once and read again: indexes, scores, vectors.

A stored frame lies in the checkpoint folder under a name made of what it holds
and of the state (length and time of change) of the files it came from.  A changed
source gives another name, so nothing stale is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from anamnesis.session import ensure_checkpoint_dir


def state_of(spark: SparkSession, *paths: str) -> str:
    """A short hash of the paths and of the lengths and times of all files below them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(conf).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def stored(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """The frame ``build`` gives, written at the first call and read at later ones.

    ``by``: a column with few values; the files are laid out by it, so that a
    filter on it reads only its folders.
    """
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{name}-{state_of(spark, *sources)}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        writer = build().write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.parquet(path)
