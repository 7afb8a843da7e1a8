"""Similarity joins on term sets and term counts by exact prefix filters, and greedy duplicate removal.

Terms are ordered from rare to frequent over the whole corpus.  Two sets with a
Jaccard similarity of t share a term among the first |x| - ceil(t|x|) + 1 of
each; two count vectors with a cosine of t share one among the terms before the
rest's norm falls below t.  Only those prefixes are joined, so frequent terms
meet rarely.  A pair that meets must also agree in its parities: terms of odd
count turn over one of 128 bits, and two items differ in at least as many terms
as bits, which is bounded for alike ones.  This drops nearly all chance meetings
inside the join, and no alike pair.  What is left is verified exactly in whole
numbers.  A term in the prefix of more than ``SALT`` items is dealt to several
join keys, so that a hot term is no hot task.
"""

from __future__ import annotations

from collections import deque
from heapq import heapify, heappop, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.functions.text import cosine, counts_of
from anamnesis.session import cut, default_parallelism, discard, ship_package

#: Items with one prefix term on one side of a join key.
SALT = 4_000
#: Items with one prefix term in one block of a cosine join; blocks meet two by two.
BLOCK = 16_000
#: Items of a group whose pairs are all compared in one task.
SMALL_GROUP = 1_000
#: Buckets of a sketch of term counts.
BUCKETS = 1_024


def _ordered(items: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """id, v (struct df, term, tf; rare first), parities, and the columns ``by``, of items (id, terms array).

    Terms are 64-bit hashes of (by, term), so that items of different groups share none.
    """
    key = F.xxhash64(*by, "term") if by else F.xxhash64("term")
    flat = items.select("id", *by, F.explode("terms").alias("term")).select("id", key.alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = flat.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    bit = F.when(F.col("tf") % 2 == 1, F.pmod("term", F.lit(128)))
    half = lambda n: F.bit_xor(F.when(F.floor(bit / 64) == n, F.expr("shiftleft(1L, CAST(pmod(term, 128) % 64 AS INT))")).otherwise(F.lit(0).cast("bigint")))
    return flat.join(df, "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "term", "tf"))).alias("v"), half(0).alias("x0"), half(1).alias("x1"))


def _met(prefix: DataFrame, carried: list[str], differ: str) -> DataFrame:
    """id_a < id_b of the items that share a prefix term and differ in no more parities than ``differ`` allows."""
    n = prefix.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(f"n > {SALT}").select("term", F.expr(f"CAST(n DIV {SALT} AS INT)").alias("more"))
    salted = prefix.join(n, "term", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    cols = ["id", *carried, "x0", "x1"]
    a = salted.select("term", F.expr("CAST(pmod(xxhash64(id), more + 1) AS INT)").alias("salt"), *[F.col(c).alias(f"{c}_a") for c in cols])
    b = salted.select("term", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("salt"), *[F.col(c).alias(f"{c}_b") for c in cols])
    bits = "bit_count(x0_a ^ x0_b) + bit_count(x1_a ^ x1_b)"
    return a.join(b, ["term", "salt"]).where(f"id_a < id_b AND {bits} <= {differ}").select("id_a", "id_b").distinct()


def jaccard_pairs(items: DataFrame, num: int, den: int, strict: bool = False, by: list[str] = []) -> DataFrame:  # noqa: B006
    """id_a, id_b (id_a < id_b), shared, united of items (id, terms array, and ``by``: only items equal in these columns
    are compared) with Jaccard of at least (or above) num/den."""
    items = items.select("id", *by, F.array_distinct("terms").alias("terms"))
    v = cut(_ordered(items, by).withColumn("n", F.size("v")))
    prefix = v.select("id", "n", "x0", "x1", F.explode(F.expr(f"slice(v, 1, n - CAST(ceil(n * {num} / {den} - 1e-9) AS INT) + 1)")).alias("p")).select("id", "n", "x0", "x1", "p.term")
    # Sets of n_a and n_b terms that are alike differ in (1 - t) / (1 + t) of n_a + n_b terms at most.
    pairs = _met(prefix, ["n"], f"(n_a + n_b) * {den - num} / {den + num} + 1e-9 AND n_a * {den} >= n_b * {num} AND n_b * {den} >= n_a * {num}")
    side = lambda s: items.where(F.size("terms") > 0).select(F.col("id").alias(f"id_{s}"), F.col("terms").alias(f"t_{s}"))
    full = pairs.join(side("a"), "id_a").join(side("b"), "id_b").select("id_a", "id_b", F.size(F.array_intersect("t_a", "t_b")).alias("shared"), (F.size("t_a") + F.size("t_b")).alias("both"))
    full = full.select("id_a", "id_b", "shared", (F.col("both") - F.col("shared")).alias("united"))
    return full.where(f"shared * {den} {'>' if strict else '>='} united * {num}")


def _prefixes(v: DataFrame, num: int, den: int) -> DataFrame:
    """term, no, rest, norm, more, sketch: the rows of :func:`_ordered` (with ``no``) once per term of their prefix.

    ``rest`` is the share of the norm from the term on; two items whose first common term this is have a cosine of
    at most the root of their two shares' product.  ``sketch`` has an entry for every term, its bucket of 1,024 and its
    count (by at most 31 an entry); ``more`` is the number of further blocks a hot term is dealt to.
    """
    least = (num / den) ** 2 - 1e-9

    def rows(batches):
        for batch in batches:
            lists = batch.column("v")
            if not len(lists):
                continue
            flat, at = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            df, term, tf = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("df", "term", "tf"))
            row = np.repeat(np.arange(len(lists)), np.diff(at))
            upto = np.concatenate([[0], np.cumsum(tf * tf)])
            norm = (upto[at[1:]] - upto[at[:-1]])[row]
            rest = (upto[at[1:]][row] - upto[:-1]) / norm
            parts = (tf + 30) // 31
            entry = np.repeat(np.arange(len(tf)), parts)
            last = np.zeros(len(entry), bool)
            last[np.cumsum(parts) - 1] = True
            sketch = (term[entry] & (BUCKETS - 1)) * 32 + np.where(last, tf[entry] - 31 * (parts[entry] - 1), 31)
            where = np.concatenate([[0], np.cumsum(parts)])[at]
            keep = (rest >= least) & (df > 1)
            sketches = pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(sketch.astype(np.int16))).take(pa.array(row[keep]))
            no = batch.column("no").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (term[keep], no[row[keep]], rest[keep], norm[keep], (df[keep] // BLOCK).astype(np.int32))] + [sketches], ["term", "no", "rest", "norm", "more", "sketch"])

    return v.select("no", "v").mapInArrow(rows, "term long, no long, rest double, norm long, more int, sketch array<short>")


def _tables(batches, key: str, least_rows: int):
    """Tables of whole runs of ``key``, of batches that are sorted by it."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < least_rows or held[0].column(key)[0] == batch.column(key)[-1]:
            continue
        t = pa.Table.from_batches(held)
        k = t.column(key).combine_chunks()
        at = t.num_rows - 1 - int(np.argmin(np.asarray(pc.equal(k, k[-1]).to_numpy(zero_copy_only=False))[::-1]))
        yield t.slice(0, at + 1)
        held = t.slice(at + 1).to_batches()
        n = t.num_rows - at - 1
    if held:
        yield pa.Table.from_batches(held)


def _near(prefix: DataFrame, num: int, den: int) -> DataFrame:
    """no_a < no_b, without repeats, of all items whose cosine may be above num/den.

    Rows of a term lie by falling ``rest``, so that the partners an item may have are a run of them.  Of what meets,
    parities and then products of bucket sums, which are never below those of the terms, drop nearly all others.
    """
    least = (num / den) ** 2

    def pairs_of(t: pa.Table):
        term, no, rest, norm, block, own = (t.column(c).to_numpy() for c in ("key", "no", "rest", "norm", "block", "own"))
        new = np.concatenate([[True], term[1:] != term[:-1]])
        run = np.cumsum(new) - 1
        start = np.flatnonzero(new)[run]
        end = np.searchsorted(2.0 * run + 1 - rest, 2.0 * run + 1 - least / rest + 1e-8, "right")
        k = np.maximum(np.minimum(end, np.arange(len(run))) - start, 0)
        met = np.isin(run, run[k > 0])
        if not met.any():
            return
        # Only rows of runs in which something meets are kept, so places shift.
        lists = t.column("sketch").combine_chunks().filter(pa.array(met))
        shift = np.cumsum(met) - 1
        no, norm, block, own, k, start = no[met], norm[met].astype(float), block[met], own[met], k[met], shift[start[met]]
        at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        entry = lists.flatten().to_numpy().astype(np.int64)
        odd, sums = np.empty((len(no), BUCKETS // 64), np.uint64), np.empty((len(no), BUCKETS // 2), np.float32)
        for lo in range(0, len(no), 4_096):
            hi = min(lo + 4_096, len(no))
            e = entry[at[lo] : at[hi]]
            cell = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1])) * BUCKETS + (e >> 5)
            full = np.bincount(cell, e & 31, (hi - lo) * BUCKETS).reshape(hi - lo, BUCKETS)
            odd[lo:hi] = np.packbits(full.astype(np.int64) & 1 == 1, axis=1).view(np.uint64)
            sums[lo:hi] = full[:, : BUCKETS // 2] + full[:, BUCKETS // 2 :]
        upto = np.cumsum(k)
        lo = 0
        while lo < len(k):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 500_000, "right")))
            n = k[lo:hi]
            a = np.repeat(np.arange(lo, hi), n)
            b = start[a] + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            lo = hi
            fit = own[a] | (block[a] != block[b])
            a, b = a[fit], b[fit]
            # |a - b|^2 = |a|^2 + |b|^2 - 2ab is at least the number of parities that differ.
            most = norm[a] + norm[b] - 2 * num / den * np.sqrt(norm[a] * norm[b]) + 1e-6
            differ = np.zeros(len(a), np.int16)
            for words in (range(4), range(4, 8), range(8, BUCKETS // 64)):
                for w in words:
                    differ += np.bitwise_count(odd[a, w] ^ odd[b, w])
                fit = differ <= most
                a, b, most, differ = a[fit], b[fit], most[fit], differ[fit]
            for i in range(0, len(a), 8_192):
                x, y = a[i : i + 8_192], b[i : i + 8_192]
                dot = np.einsum("ij,ij->i", sums[x], sums[y]).astype(float) * (1 + 1e-5)
                fit = dot * dot > norm[x] * norm[y] * least
                if fit.any():
                    x, y = no[x[fit]], no[y[fit]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["no_a", "no_b"])

    def meet(batches):
        for t in _tables(batches, "key", 16_384):
            yield from pairs_of(t)

    block = F.expr("CAST(pmod(xxhash64(no), more + 1) AS INT)")
    dealt = prefix.withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, more)")))
    key = F.when(F.col("more") == 0, F.col("term")).otherwise(F.xxhash64("term", F.least("block", "other"), F.greatest("block", "other")))
    rows = dealt.select(key.alias("key"), "no", "rest", "norm", "block", (F.col("block") == F.col("other")).alias("own"), "sketch")
    parts = 4 * default_parallelism(prefix.sparkSession)
    return rows.repartition(parts, "key").sortWithinPartitions("key", F.desc("rest")).mapInArrow(meet, "no_a long, no_b long").distinct()


def cosine_pairs(items: DataFrame, num: int, den: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """id_a, id_b, dot of items (id, terms array, and ``by`` as in :func:`jaccard_pairs`) whose term counts have a cosine
    above num/den, compared in whole numbers."""
    ship_package(items.sparkSession)
    v = cut(_ordered(items, by).select("id", "v").withColumn("no", F.monotonically_increasing_id()))
    pairs = cut(_near(_prefixes(v, num, den), num, den))
    touched = pairs.select("no_a").union(pairs.select("no_b")).distinct().toDF("no")
    named = cut(v.select("no", "id").join(touched, "no"))
    discard(v)
    counted = cut(items.select("id", "terms").join(named, "id").select("no", "id", counts_of(F.col("terms")).alias("m")))
    norm = F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda s, x: s + x * x)
    side = lambda s: counted.select(F.col("no").alias(f"no_{s}"), F.col("id").alias(f"i_{s}"), F.col("m").alias(f"m_{s}"), norm.alias(f"norm_{s}"))
    full = pairs.join(side("a"), "no_a").join(side("b"), "no_b")
    full = full.withColumn("dot", F.expr("aggregate(map_entries(m_a), 0L, (s, e) -> s + e.value * coalesce(element_at(m_b, e.key), 0L))"))
    wide = "CAST({} AS DECIMAL(38,0))"
    full = full.where(f"{wide.format('dot')} * dot * {den * den} > {wide.format('norm_a')} * norm_b * {num * num}")
    return full.select(F.least("i_a", "i_b").alias("id_a"), F.greatest("i_a", "i_b").alias("id_b"), "dot")


def _greedy(near: dict, place: dict, score: dict) -> set:
    """What a pass in order of place removes: of two alike items the one with the lower score, the later one on ties."""
    gone: set = set()
    for i in sorted(place, key=place.get):
        if i in gone:
            continue
        for j in sorted((x for x in near[i] if place[x] > place[i] and x not in gone), key=place.get):
            if score[i] >= score[j]:
                gone.add(j)
            else:
                gone.add(i)
                break
    return gone


def greedy_removal(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Ids that a greedy pass removes: of two alike items the one with the lower score, the later one on ties.

    ``pairs``: grp, id_a, id_b; ``items``: grp, id, score, place.  The pass goes
    through each group in order of place; only items with a partner take part.
    """
    ship_package(items.sparkSession)
    own = items.select("grp", F.col("id").alias("id_a"), F.col("score").alias("s_a"), F.col("place").alias("p_a"))
    other = items.select("grp", F.col("id").alias("id_b"), F.col("score").alias("s_b"), F.col("place").alias("p_b"))
    edges = pairs.join(own, ["grp", "id_a"]).join(other, ["grp", "id_b"])

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        score, place, near = {}, {}, {}
        for r in pdf.itertuples():
            score[r.id_a], place[r.id_a], score[r.id_b], place[r.id_b] = r.s_a, r.p_a, r.s_b, r.p_b
            near.setdefault(r.id_a, set()).add(r.id_b)
            near.setdefault(r.id_b, set()).add(r.id_a)
        gone = _greedy(near, place, score)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]] * len(gone), "id": sorted(gone)})

    return edges.groupBy("grp").applyInPandas(resolve, "grp string, id string")


def alike_removed(items: DataFrame, num: int, den: int, least_terms: int) -> DataFrame:
    """Ids that a greedy pass over each group removes, of items (grp, id, terms, score, place, exempt).

    Exempt items and those with fewer terms than the least take no part; only items of one group
    are compared.  Groups of up to ``SMALL_GROUP`` items are worked off whole where they lie,
    larger ones by :func:`removed_among`.
    """
    taking = cut(items.where(~F.col("exempt") & (F.size("terms") >= least_terms)).select("grp", "id", "terms", "score", "place"))
    n = cut(taking.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
    gone = cut(_removed_within(taking.join(n.where(f"n BETWEEN 2 AND {SMALL_GROUP}").select("grp"), "grp"), num, den))
    many = n.where(f"n > {SMALL_GROUP}").select("grp")
    if many.isEmpty():
        discard(taking, n)
        return gone
    rest = removed_among(taking.join(many, "grp"), num, den)
    discard(taking, n)
    return gone.unionByName(rest)


def _greedy_by_class(no: list, score: list, near: dict) -> list[int]:
    """Places that the pass of :func:`_greedy` removes, of items in order of place that are alike to all of their class and
    of its near ones.

    The items of a class that are still to come lie in a queue.  An item walks the heads of the queues it is alike to, and
    every step of a walk removes an item, so that no pair of items is ever listed.
    """
    queues: dict = {}
    for i, c in enumerate(no):
        queues.setdefault(c, deque()).append(i)
    gone, out = bytearray(len(no)), []
    for i, c in enumerate(no):
        if gone[i]:
            continue
        queues[c].popleft()
        heads = [(queues[x][0], x) for x in (c, *near.get(c, ())) if queues[x]]
        heapify(heads)
        while heads:
            j, x = heads[0]
            if score[i] < score[j]:
                out.append(i)
                break
            gone[j] = 1
            out.append(j)
            queues[x].popleft()
            if queues[x]:
                heapreplace(heads, (queues[x][0], x))
            else:
                heappop(heads)
    return out


def removed_among(items: DataFrame, num: int, den: int, score: Column | None = None) -> DataFrame:
    """Ids that a greedy pass over each group removes, of items (grp, id, terms, place, and score or what it is made of).

    Items of a group with equal term counts are one class, and only classes are compared: a text that comes n times
    costs n rows and not n * n pairs.  Each component of alike classes is worked off in one task, as items in order and
    links of classes.  ``num`` is below ``den``; ``score`` is worked out for items with a partner only.
    """
    ship_package(items.sparkSession)
    ordered = F.array_sort("terms")
    keyed = items.where(F.size("terms") > 0).withColumn("key", F.struct(F.xxhash64("grp", ordered).alias("h1"), F.xxhash64(F.lit("second"), "grp", ordered).alias("h2")))
    classes = cut(keyed.groupBy("key").agg(F.first("grp").alias("grp"), F.first("terms").alias("terms"), F.count(F.lit(1)).alias("n")).withColumn("no", F.monotonically_increasing_id()))
    pairs = cut(cosine_pairs(classes.select(F.col("no").alias("id"), "grp", "terms"), num, den, ["grp"]).select("id_a", "id_b"))
    roots = components(pairs).toDF("no", "root")
    taking = cut(classes.select("key", "no", "n").join(roots, "no", "left").where("n > 1 OR root IS NOT NULL").select("key", "no", F.coalesce("root", "no").alias("root")))
    discard(classes)
    members = keyed.drop("terms", "grp").join(taking, "key").select("root", "no", "id", "place", (F.col("score") if score is None else score).alias("score"))
    links = pairs.unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))).groupBy(F.col("id_a").alias("no")).agg(F.collect_list("id_b").alias("near")).join(roots, "no")

    def removed(batches):
        for t in _tables(batches, "root", 8_192):
            root = t.column("root").to_numpy()
            border = np.flatnonzero(root[1:] != root[:-1]) + 1
            no, own, near, ids, gone = t.column("no").to_pylist(), t.column("score").to_pylist(), t.column("near"), t.column("id"), []
            item = near.is_null().to_numpy()
            for lo, hi in zip([0, *border.tolist()], [*border.tolist(), len(root)]):
                at = lo + int(np.count_nonzero(~item[lo:hi]))  # rows of classes come first
                linked = {no[k]: near[k].as_py() for k in range(lo, at)}
                gone += [at + k for k in _greedy_by_class(no[at:hi], own[at:hi], linked)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(gone, pa.int64())).combine_chunks()], ["id"])

    rows = members.unionByName(links, allowMissingColumns=True).repartition(default_parallelism(items.sparkSession), "root")
    gone = cut(rows.sortWithinPartitions("root", F.col("near").isNull(), "place").select("root", "no", "id", "score", "near").mapInArrow(removed, items.select("id").schema))
    discard(pairs, taking)
    return gone


def _alike(row: np.ndarray, code: np.ndarray, n: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of the items of one group, whose terms are (row, code), with a cosine above num/den."""
    cell, tf = np.unique(row * (int(code.max()) + 1) + code, return_counts=True)
    row, code = cell // (int(code.max()) + 1), cell % (int(code.max()) + 1)
    norm = np.bincount(row, tf * tf, n)
    _, col, df = np.unique(code, return_inverse=True, return_counts=True)
    common = df > 1
    col, row, tf = (np.cumsum(common) - 1)[col][common[col]], row[common[col]], tf[common[col]]
    dot = np.zeros((n, n))
    for lo in range(0, int(common.sum()), 4_096):
        part = (col >= lo) & (col < lo + 4_096)
        wide = np.zeros((n, min(4_096, int(common.sum()) - lo)))
        wide[row[part], col[part] - lo] = tf[part]
        dot += wide @ wide.T
    i, j = np.nonzero(np.triu(dot * dot * (den * den) > np.outer(norm, norm) * (num * num * (1 - 1e-9)), 1))
    exact = [int(d) ** 2 * den * den > int(x) * int(y) * num * num for d, x, y in zip(dot[i, j], norm[i], norm[j])]
    return i[exact], j[exact]


def _removed_within(items: DataFrame, num: int, den: int) -> DataFrame:
    """Ids that the greedy pass removes, of items (grp, id, terms, score, place) with small groups."""
    ship_package(items.sparkSession)

    def removed(batches):
        for t in _tables(batches, "grp", 8_192):
            t = t.combine_chunks()
            grp = t.column("grp").combine_chunks()
            border = np.flatnonzero(pc.not_equal(grp[1:], grp[:-1]).to_numpy(zero_copy_only=False)) + 1
            terms = t.column("terms").combine_chunks()
            at = np.asarray(terms.offsets) - terms.offsets[0].as_py()
            code = terms.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(terms)), np.diff(at))
            ids, place, score, gone = t.column("id"), t.column("place"), t.column("score"), []
            for lo, hi in zip([0, *border], [*border, len(terms)]):
                i, j = _alike(row[at[lo] : at[hi]] - lo, code[at[lo] : at[hi]], hi - lo, num, den)
                near: dict = {}
                for x, y in zip(i.tolist(), j.tolist()):
                    near.setdefault(x, set()).add(y)
                    near.setdefault(y, set()).add(x)
                gone += [lo + x for x in _greedy(near, {x: place[int(lo + x)].as_py() for x in near}, {x: score[int(lo + x)].as_py() for x in near})]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(gone, pa.int64())).combine_chunks()], ["id"])

    rows = items.select("grp", "id", "terms", "score", "place").repartition(default_parallelism(items.sparkSession), "grp").sortWithinPartitions("grp")
    return rows.mapInArrow(removed, items.select("id").schema)


def first_and_repeats(items: DataFrame, num: int, den: int) -> DataFrame:
    """id, grp, repeat_count of the items (grp, id, terms, place) that stay: an item that is alike (Jaccard above num/den)
    to one that stays counts as a repeat of the first such one of its group.

    Equal term sets are one class before they are compared: the later ones go where the first goes.
    Items without terms are like nothing.  grp must not be null, place is unique within grp.
    """
    ship_package(items.sparkSession)
    sets = items.withColumn("key", F.array_sort(F.array_distinct("terms")))
    bare = sets.where(F.size("key") == 0).select("id", "grp", F.lit(1).cast("bigint").alias("repeat_count"))
    classes = cut(sets.where(F.size("key") > 0).groupBy("grp", "key").agg(F.min(F.struct("place", "id")).alias("first"), F.count(F.lit(1)).alias("n")).select("grp", "first.id", "first.place", "n", F.col("key").alias("terms")))
    pairs = cut(jaccard_pairs(classes.select("id", "grp", "terms"), num, den, strict=True, by=["grp"]).select("id_a", "id_b"))
    side = lambda s: classes.select(F.col("id").alias(f"id_{s}"), F.col("place").alias(f"p_{s}"), F.col("n").alias(f"n_{s}"))
    edges = pairs.join(components(pairs).toDF("id_a", "root"), "id_a").join(side("a"), "id_a").join(side("b"), "id_b")

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        place, n, near = {}, {}, {}
        for r in pdf.itertuples():
            place[r.id_a], place[r.id_b], n[r.id_a], n[r.id_b] = r.p_a, r.p_b, r.n_a, r.n_b
            near.setdefault(r.id_a, []).append(r.id_b)
            near.setdefault(r.id_b, []).append(r.id_a)
        count: dict = {}
        for i in sorted(place, key=place.get):
            first = min((j for j in near[i] if j in count), key=place.get, default=i)
            count[first] = count.get(first, 0) + n[i]
        return pd.DataFrame({"id": list(place), "stays": [count.get(i, 0) for i in place]})

    told = edges.groupBy("root").applyInPandas(resolve, "id string, stays bigint")
    stay = classes.join(told, "id", "left").select("id", "grp", F.coalesce("stays", "n").alias("repeat_count")).where("repeat_count > 0")
    return stay.unionByName(bare)


def components(pairs: DataFrame) -> DataFrame:
    """id, root: the smallest id that each item is linked with, by rounds of halving distances (hash-to-min)."""
    edges = cut(pairs.select("id_a", "id_b").union(pairs.select("id_b", "id_a")).toDF("a", "b").distinct())
    held = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).toDF("id", "root"))
    label = held
    while True:
        near = edges.join(label.toDF("b", "r"), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r"))
        jump = label.toDF("root", "far")
        nxt = cut(label.join(near, "id").join(jump, "root").select("id", F.least("root", "r", "far").alias("new"), "root"))
        discard(held)
        held, label = nxt, nxt.select("id", F.col("new").alias("root"))
        if nxt.where("new < root").isEmpty():
            discard(edges)
            return label


def near_vectors(vectors: DataFrame, id_col: str, vec: str, least: float, bands: int = 24, bits: int = 8, seed: int = 11) -> DataFrame:
    """id_a < id_b, score of vectors with a cosine above ``least``, by bands of sides of random planes.

    Vectors that lie on the same side of all ``bits`` planes of a band meet and are
    compared exactly.  Two vectors agree in a plane with a chance of 1 - angle / pi:
    at a cosine of 0.85 a pair is missed with a chance of 0.004 (24 bands of 8).
    Vectors without length, null ones and null ids are like nothing.
    """
    import numpy as np

    ship_package(vectors.sparkSession)
    rows = vectors.where(F.col(vec).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))

    def keys(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            full = np.linalg.norm(m, axis=1) > 0
            planes = np.random.default_rng(seed).standard_normal((m.shape[1], bands * bits))
            side = (m @ planes > 0).reshape(len(m), bands, bits) @ (1 << np.arange(bits))
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[full].repeat(bands), "key": (np.arange(bands) * (1 << bits) + side[full]).ravel()})

    keyed = rows.mapInPandas(keys, "id long, key long")
    n = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(f"n > {SALT}").select("key", F.expr(f"CAST(n DIV {SALT} AS INT)").alias("more"))
    salted = keyed.join(n, "key", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    a = salted.select("key", F.expr("CAST(pmod(xxhash64(id), more + 1) AS INT)").alias("salt"), F.col("id").alias("id_a"))
    b = salted.select("key", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("salt"), F.col("id").alias("id_b"))
    met = a.join(b, ["key", "salt"]).where("id_a < id_b").select("id_a", "id_b").distinct()
    both = met.join(rows.toDF("id_a", "v_a"), "id_a").join(rows.toDF("id_b", "v_b"), "id_b")
    return both.select("id_a", "id_b", F.round(cosine(F.col("v_a"), F.col("v_b")), 5).alias("score")).where(F.col("score") > least)


def keep_first(df: DataFrame, key, order: list) -> DataFrame:
    """Exact duplicates by a normalised key: 1 for the row that is kept."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
