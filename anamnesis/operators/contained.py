"""Which short texts stand anywhere inside which words: a substring join by equal n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contained(needles: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct (grp, needle) of needles (grp, needle) that are part of a word (grp, word) of their group.

    A needle is looked up by its first three characters (two, if it has no more)
    among the three- and two-character pieces of the words; what meets is compared
    whole, so the result is exact, and no needle meets all words of a group.
    Needles of fewer than two characters and null ones are in nothing.
    """
    keyed = needles.where(F.length("needle") >= 2).select("grp", "needle", F.substring("needle", 1, 3).alias("key")).distinct()
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.length("word") - (n - 1)), lambda i: F.substring("word", i, F.lit(n)))
    grams = F.when(F.length("word") >= 3, F.concat(pieces(3), pieces(2))).otherwise(F.array("word"))
    held = words.where(F.length("word") >= 2).select("grp", "word").distinct().select("grp", "word", F.explode(F.array_distinct(grams)).alias("key"))
    return keyed.join(held, ["grp", "key"]).where(F.col("word").contains(F.col("needle"))).select("grp", "needle").distinct()
