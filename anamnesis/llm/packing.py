"""Filling containers of fixed capacity by exact-complement hashing.

Sizes are whole token counts up to the capacity, so a corpus of any length is a
histogram of at most ``capacity`` entries.  The plan is made on this histogram:
for the largest size left, the gap to the capacity is looked up among sums of
one, two and three lengths that are still available, off an exact index of sums
of two; a combination that fills the gap exactly is taken as often as the counts
allow.  Where none exists
the largest length that fits is added and the new gap looked up again; what
never closes exactly is a best-fit residual.  Every step uses up at least one
length, so the plan has about as many entries as there are lengths.

Items are then numbered within their length and read their container off the
plan.  Scale: the plan is bounded by the capacity, not by the data (its bound is
checked); the numbering is done in range partitions with offsets, so a length
that holds a third of all items is spread like the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.session import cut, ship_package

#: Largest capacity whose histogram may be planned in one place.
MAX_CAPACITY = 1 << 20
MAX_BUDGETS = 64


class Stock:
    """The lengths that are left, with an index of the sums of two of them.

    ``ways[s]`` says how many pairs of different lengths that are left add up to
    s, exactly and at any time: it comes from one convolution, and a length that
    runs out takes its pairs with it.  Sums of three are looked up as one length
    and an indexed sum of two.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            self.counts[length] = n
        self.lengths = np.flatnonzero(self.counts)
        seen = (self.counts > 0).astype(np.float64)
        size = 1 << (2 * capacity + 1).bit_length()
        both = np.rint(np.fft.irfft(np.fft.rfft(seen, size) ** 2, size)[: capacity + 1]).astype(np.int64)
        doubles = np.zeros(capacity + 1, np.int64)
        own = self.lengths[2 * self.lengths <= capacity]
        doubles[2 * own] = 1
        self.ways = (both - doubles) // 2
        self.gone = 0

    def take(self, length: int, times: int = 1) -> None:
        self.counts[length] -= times
        if not self.counts[length]:
            upto = self.lengths[: np.searchsorted(self.lengths, self.capacity - length, "right")]
            upto = upto[self.counts[upto] > 0]
            self.ways[upto + length] -= 1
            self.gone += 1
            if self.gone * 8 > len(self.lengths):
                self.lengths, self.gone = self.lengths[self.counts[self.lengths] > 0], 0

    def largest(self, upto: int) -> int:
        """The largest length that is left and fits, or 0."""
        at = int(np.searchsorted(self.lengths, upto, "right"))
        while at > 0:
            block = self.lengths[max(0, at - 64) : at]
            live = np.flatnonzero(self.counts[block])
            if len(live):
                return int(block[live[-1]])
            at -= 64
        return 0

    def pair(self, gap: int) -> list[int] | None:
        if gap % 2 == 0 and self.counts[gap // 2] > 1:
            return [gap // 2] * 2
        if gap <= self.capacity and self.ways[gap] > 0:
            high = self.lengths[np.searchsorted(self.lengths, gap // 2, "right") : np.searchsorted(self.lengths, gap, "left")]
            for lo in range(len(high), 0, -256):
                block = high[max(0, lo - 256) : lo]
                fit = np.flatnonzero((self.counts[block] > 0) & (self.counts[gap - block] > 0))
                if len(fit):
                    return [int(block[fit[-1]]), int(gap - block[fit[-1]])]
        return None

    def complement(self, gap: int) -> list[int] | None:
        """One, two or three lengths that are left and add up to the gap, longest first."""
        if self.counts[gap] > 0:
            return [gap]
        if found := self.pair(gap):
            return found
        upto = self.lengths[: np.searchsorted(self.lengths, gap, "left")]
        for lo in range(len(upto), 0, -256):
            block = upto[max(0, lo - 256) : lo][::-1]
            rest = gap - block
            for a in block[(self.counts[block] > 0) & ((self.ways[rest] > 0) | (rest % 2 == 0) & (self.counts[rest // 2] > 1))]:
                if (found := self.pair(gap - int(a))) and self.counts[a] > found.count(int(a)):
                    return [int(a), *found]
        return None


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how often, lengths) of the containers that hold a histogram of lengths 1..capacity.

    Work grows with the square of the number of different lengths, in array steps.
    """
    stock = Stock(histogram, capacity)
    plan: list[tuple[int, list[int]]] = []
    while first := stock.largest(capacity):
        chosen = [first]
        stock.take(first)
        gap = capacity - first
        while gap > 0:
            if rest := stock.complement(gap):
                chosen += rest
                for x in rest:
                    stock.take(x)
                break
            fit = stock.largest(gap)
            if not fit:
                break
            chosen.append(fit)
            stock.take(fit)
            gap -= fit
        used = {x: chosen.count(x) for x in chosen}
        more = min(int(stock.counts[x]) // k for x, k in used.items())
        if more:
            for x, k in used.items():
                stock.take(x, more * k)
        plan.append((1 + more, chosen))
    return plan


def plan_ranks(plan: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each length the columns (first rank, first container, items a container), ordered by rank."""
    at: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    container = 0
    for times, chosen in plan:
        for x in dict.fromkeys(chosen):
            k = chosen.count(x)
            rows.setdefault(x, []).append((at.get(x, 0), container, k))
            at[x] = at.get(x, 0) + times * k
        container += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def _assign(ranks: dict[int, dict[int, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            capacity, length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("capacity", "n_tokens", "rank"))
            out = np.empty(len(rank), np.int64)
            order = np.lexsort((length, capacity))
            cap, ln = capacity[order], length[order]
            borders = np.flatnonzero(np.r_[True, (cap[1:] != cap[:-1]) | (ln[1:] != ln[:-1])]) if len(order) else []
            for lo, hi in zip(borders, [*borders[1:], len(order)]):
                rows, own = ranks[int(cap[lo])][int(ln[lo])], order[lo:hi]
                hit = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                out[own] = hit[:, 1] + (rank[own] - hit[:, 0]) // hit[:, 2]
            names = ["budget_name", "capacity", "doc_id", "part_no", "n_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(out)], [*names, "container_no"])

    return run


def fill_containers(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """budget_name, capacity, doc_id, part_no, n_tokens, container_no: a container of every budget for every item.

    ``sizes`` has doc_id and n_tokens, ``budgets`` budget_name and capacity.

    Defined cases: items of no or null size take no place and give no row; an
    item larger than the capacity is cut into full parts and a rest (part_no 0,
    1, ...), each part counting as an item, smaller items have part_no 0; rows
    repeated in ``sizes`` are items of their own; budgets with null or
    non-positive capacity give no rows, repeated budgets count once; no items,
    no rows.
    """
    spark = sizes.sparkSession
    ship_package(spark)
    wanted = budgets.where("capacity > 0").select("budget_name", F.col("capacity").cast("bigint").alias("capacity")).distinct().limit(MAX_BUDGETS + 1).collect()
    if len(wanted) > MAX_BUDGETS or any(r.capacity > MAX_CAPACITY for r in wanted):
        raise ValueError(f"at most {MAX_BUDGETS} budgets of at most {MAX_CAPACITY} tokens")
    budget = F.explode(F.from_json(F.lit("[" + ",".join(f'{{"capacity":{c}}}' for c in sorted({r.capacity for r in wanted})) + "]"), "array<struct<capacity bigint>>"))
    items = (
        sizes.where("n_tokens > 0")
        .select("doc_id", "n_tokens", budget.alias("b"))
        .selectExpr("doc_id", "b.capacity AS capacity", "n_tokens AS whole", "explode(sequence(0L, (n_tokens - 1) DIV b.capacity)) AS part_no")
        .selectExpr("doc_id", "capacity", "part_no", "least(capacity, whole - part_no * capacity) AS n_tokens")
    )
    items = cut(items.repartitionByRange("capacity", "n_tokens", "doc_id", "part_no").sortWithinPartitions("capacity", "n_tokens", "doc_id", "part_no").withColumn("chunk", F.spark_partition_id()))
    counts = cut(items.groupBy("capacity", "n_tokens", "chunk").agg(F.count(F.lit(1)).alias("n")))
    # At most `capacity` rows a budget, whatever the corpus holds.
    histogram: dict[int, dict[int, int]] = {r.capacity: {} for r in wanted}
    for r in counts.groupBy("capacity", "n_tokens").agg(F.sum("n").alias("n")).collect():
        histogram[r.capacity][r.n_tokens] = r.n
    ranks = {c: plan_ranks(plan_containers(h, c)) for c, h in histogram.items()}
    chain = Window.partitionBy("capacity", "n_tokens").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("capacity", "n_tokens", "chunk", F.coalesce(F.sum("n").over(chain), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("capacity", "n_tokens", "chunk").orderBy("doc_id", "part_no")
    numbered = items.withColumn("rn", F.row_number().over(inside)).join(offsets, ["capacity", "n_tokens", "chunk"])
    names = spark.createDataFrame([(r.budget_name, r.capacity) for r in wanted], "budget_name string, capacity bigint")
    numbered = numbered.join(F.broadcast(names), "capacity").select("budget_name", "capacity", "doc_id", "part_no", "n_tokens", (F.col("offset") + F.col("rn") - 1).alias("rank"))
    return numbered.mapInArrow(_assign(ranks), "budget_name string, capacity bigint, doc_id bigint, part_no bigint, n_tokens bigint, container_no bigint")


def container_report(filled: DataFrame) -> DataFrame:
    """Per budget: containers used, the least number possible by volume, and unused tokens."""
    return (
        filled.groupBy("budget_name", "capacity", "container_no").agg(F.sum("n_tokens").alias("used"))
        .groupBy("budget_name", "capacity")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
        .select("budget_name", "capacity", "containers", "tokens", "fullest", F.expr("(tokens + capacity - 1) DIV capacity").alias("least_containers"), F.expr("containers * capacity - tokens").alias("unused"))
    )
