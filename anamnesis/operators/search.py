"""Full-text, vector and hybrid search as DataFrames.

The inverted index is a written postings table (term, doc, tf, dl), laid out in
``BUCKETS`` folders by a hash of the term and sorted by term inside: a query
reads the folders of its terms only, and of their files only the row groups that
can hold them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.functions.text import characters, cosine, let, terms_pairs
from anamnesis.operators.stored import stored
from anamnesis.session import ship_package

K1, B = 1.2, 0.75
#: Most terms of a query, and most query vectors that are sent to all tasks.
MAX_TERMS, MAX_QUERIES = 64, 10_000
#: Folders of an index.
BUCKETS = 64
#: Dimensions of projected texts.
DIMENSIONS = 64


def query_terms(query: str) -> list[str]:
    """Terms of a query as the index has them: lower-case words and Chinese pairs."""
    low = query.lower()
    return re.findall("[a-z]+", low) + [r[i : i + 2] for r in re.findall("[一-鿿]{2,}", query) for i in range(len(r) - 1)]


def postings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """term, doc, tf, dl of a corpus."""
    terms = docs.select(F.col(doc).alias("doc"), terms_pairs(F.col(text)).alias("terms")).where(F.size("terms") > 0)
    flat = terms.select("doc", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return flat.groupBy("term", "doc", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def written_index(spark: SparkSession, name: str, sources: list[str], docs: Callable[[], DataFrame], doc: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The postings of a corpus and its size, built at the first call (:func:`stored`).

    Hot terms are spread: the rows of a bucket come from several tasks, ranged by
    (bucket, term, doc).
    """
    index = stored(spark, f"{name}-postings", sources, lambda: postings(docs(), doc, text).withColumn("bucket", bucket_of(F.col("term"))).repartitionByRange("bucket", "term", "doc").sortWithinPartitions("bucket", "term"), by="bucket")
    return index, stored(spark, f"{name}-size", sources, lambda: corpus_size(docs(), text))


def of_terms(index: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of some terms; of a written index only their folders are read."""
    wanted = sorted(set(terms))
    if len(wanted) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    hits = index.where(F.col("term").isin(wanted))
    if "bucket" in index.columns:
        spark = index.sparkSession
        rows = spark.range(1).select(*[bucket_of(F.lit(t)).alias(f"b{i}") for i, t in enumerate(wanted)]).first() if wanted else ()
        hits = hits.where(F.col("bucket").isin(sorted(set(rows))))
    return hits


def corpus_size(docs: DataFrame, text: str) -> DataFrame:
    """One row: number of documents with terms and their mean length."""
    n = F.size(terms_pairs(F.col(text)))
    return docs.select(n.alias("n")).where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean_len"))


def bm25(index: DataFrame, size: DataFrame, terms: list[str], every: bool = True) -> DataFrame:
    """doc and score of the documents that hold every (or any) query term."""
    wanted = set(terms)
    hits = of_terms(index, terms)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(size))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean_len")))
    out = scored.groupBy("doc").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("found"))
    return (out.where(F.col("found") == len(wanted)) if every else out).select("doc", "score")


def snippet_tokens(text: Column, terms: list[str], width: int = 10) -> Column:
    """A window of ``width`` words around the first that holds a term (as part of it, in any case), hits marked.

    Up to four words stand before the hit; dots where words are left out; null without a hit.
    """
    quoted = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    words = F.filter(F.split(text, "[ \\t\\n\\r\\f\\u000b]+"), lambda w: w != "")

    def window(ws: Column) -> Column:
        at = F.array_position(F.transform(ws, lambda w: w.rlike(f"(?i)({quoted})")), True)
        begin = F.greatest(at - 4, F.lit(1))
        piece = F.array_join(F.transform(F.slice(ws, begin, width), lambda w: F.regexp_replace(w, f"(?i)({quoted})", ">>>$1<<<")), " ")
        return F.when(at > 0, F.concat(F.when(begin > 1, "...").otherwise(""), piece, F.when(begin + width <= F.size(ws), "...").otherwise("")))

    return let(words, window)


def projected(terms: Column) -> Column:
    """Pairs (dimension, value) of a text's hashed projection: every term adds 1 or -1 to the dimension its hash names.

    Texts with common terms have near vectors; the entries of a dimension are to be summed.
    """
    digits = lambda t: F.conv(F.substring(F.md5(t), 1, 3), 16, 10).cast("int")
    return F.transform(terms, lambda t: let(digits(t), lambda d: F.struct((d % DIMENSIONS).alias("dim"), F.when(F.floor(d / DIMENSIONS) % 2 == 0, 1).otherwise(-1).alias("value"))))


def projections(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, dim, value (not 0) of the projections of texts."""
    flat = texts.select(*key, F.explode(projected(terms_pairs(F.col(text)))).alias("p")).select(*key, "p.dim", "p.value")
    return flat.groupBy(*key, "dim").agg(F.sum("value").alias("value")).where("value <> 0")


def projected_query(query: str) -> dict[int, int]:
    """The same projection of a query, on the driver."""
    import hashlib

    out: dict[int, int] = {}
    for t in query_terms(query):
        d = int(hashlib.md5(t.encode()).hexdigest()[:3], 16)
        out[d % DIMENSIONS] = out.get(d % DIMENSIONS, 0) + (1 if d // DIMENSIONS % 2 == 0 else -1)
    return {d: v for d, v in out.items() if v}


def projection_top(vectors: DataFrame, key: list[str], query: str, k: int) -> DataFrame:
    """The k texts whose projections (key, dim, value) are nearest to a query's by cosine, with their score.

    Only the dimensions of the query are multiplied; the norms come along from all of them.
    """
    q = projected_query(query)
    weight = F.lit(0.0)
    for d, v in q.items():
        weight = F.when(F.col("dim") == d, float(v)).otherwise(weight)
    norm = sum(v * v for v in q.values()) ** 0.5 or 1.0
    scored = vectors.groupBy(*key).agg(F.sum(weight * F.col("value")).alias("dot"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return scored.select(*key, F.round(F.col("dot") / (F.col("norm") * norm), 6).alias("score")).orderBy(F.desc("score"), *key).limit(k)


def vector_top(vectors: DataFrame, id_col: str, vec: str, query: list[float], k: int) -> DataFrame:
    """The k nearest vectors by cosine; every task keeps its best k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col), cosine(F.col(vec), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def near_queries(vectors: DataFrame, id_col: str, vec: str, chosen: str, least: float, most: int = MAX_QUERIES, block: int = 256) -> DataFrame:
    """id_a (a query), id_b, score of all vectors nearer to a query than ``least``.

    Up to ``most`` queries go to every task as one matrix, and each Arrow batch of
    vectors is multiplied with it.  More are packed into blocks of about ``block``,
    and so are the vectors; blocks meet blocks, and no pair of rows below the
    threshold is built in either way.  Null vectors take no part.
    """
    import numpy as np

    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.where(F.col(vec).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    asked = vectors.where(chosen).where(F.col(vec).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    out = "id_a long, id_b long, score double"

    def unit(m):
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def product(ia, a, ib, b) -> pd.DataFrame:
        s = unit(a) @ unit(b).T
        i, j = np.nonzero(s > least)
        keep = ia[i] != ib[j]
        return pd.DataFrame({"id_a": ia[i][keep], "id_b": ib[j][keep], "score": np.round(s[i, j][keep], 5)})

    first = asked.limit(most + 1).collect()
    if len(first) <= most:
        sent = spark.sparkContext.broadcast((np.array([r["id"] for r in first], np.int64), np.array([r["v"] for r in first], np.float64)))

        def against_all(batches):
            ia, a = sent.value
            for pdf in batches:
                if len(pdf) and len(ia):
                    yield product(ia, a, pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy()).astype(np.float64))

        return rows.mapInPandas(against_all, out)

    def multiply(batches):
        for pdf in batches:
            for q, group in zip(pdf["q"], pdf["g"]):
                yield product(np.array([x["id"] for x in q]), np.array([x["v"] for x in q], np.float64), np.array([x["id"] for x in group]), np.array([x["v"] for x in group], np.float64))

    def packed(df: DataFrame, size: int, name: str) -> DataFrame:
        n = max(1, df.count() // size)
        return df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("b")).agg(F.collect_list(F.struct("id", "v")).alias(name)).drop("b")

    return packed(asked, block, "q").crossJoin(packed(rows, 4 * block, "g")).mapInPandas(multiply, out)


def reciprocal_ranks(channels: DataFrame, k: int = 60, key: list[str] = ["id"]) -> DataFrame:  # noqa: B006
    """Fuse channels (channel, key, place from 0): the sum of 1 / (k + place + 1)."""
    return channels.groupBy(*key).agg(F.sum(1.0 / (k + F.col("place") + 1)).alias("score"), F.min("channel").alias("first_channel"))


def diversify(candidates: DataFrame, lam: float = 0.7, k: int = 10) -> DataFrame:
    """Greedy choice by score against likeness to what is chosen, per query.

    ``candidates``: query, id, score, content; at most 100 a query are looked at,
    the number that the channels return.  Returns query, id, place.
    """
    ship_package(candidates.sparkSession)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = candidates.withColumn("rn", F.row_number().over(w)).where("rn <= 100").select("query", "id", "score", characters(F.col("content")).alias("chars"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left = sorted(zip(-pdf["score"], pdf["id"], [frozenset(c if c is not None else ()) for c in pdf["chars"]]), key=lambda x: (x[0], x[1]))
        chosen: list = []
        while left and len(chosen) < k:
            like = [max((len(c & s) / len(c | s) if c and s else 0.0 for _, _, s in chosen), default=0.0) for _, _, c in left]
            values = [lam * -s - (1 - lam) * x for (s, _, _), x in zip(left, like)]
            best = max(range(len(left)), key=lambda i: (values[i], -i))
            chosen.append(left.pop(best))
        return pd.DataFrame({"query": [pdf["query"].iloc[0]] * len(chosen), "id": [c[1] for c in chosen], "place": range(1, len(chosen) + 1)})

    return top.groupBy("query").applyInPandas(choose, "query string, id string, place long")
