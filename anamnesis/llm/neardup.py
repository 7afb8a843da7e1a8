"""Near-duplicate records by BagMinHash signatures, banding and exact verification.

A record is a bag of words (weight: how often a word counts).  Over the
discretised weight axis of every word runs a Poisson process whose points carry
a register; a bag takes the points below its weight, and each register keeps its
earliest point.  Two bags agree in a register with a probability equal to their
weighted Jaccard similarity.  The axis is split into octaves (0,1], (1,2],
(2,4], ...; an octave that a weight covers only in part is halved, its points
being dealt to the halves by their own hash, so heavy words cost logarithmic,
not linear, work.  Points are drawn in order of time up to a horizon by which a
bag of its size has nearly surely filled all registers; the few bags that have
not are drawn again with twice the horizon.

Bands of registers make the keys.  Keys go in packed columns by band (key bits,
number, mass, and the parities of the words dealt to 64 bits), 14 bytes a key
instead of a row.  Records that meet in a band are candidates if their masses and
parities allow the similarity: two bags differ in at least as many words as
parities, so no similar pair is dropped here.  Candidates are verified on the
exact bags.

Scale: exact copies (equal bags) are one class before signatures are made, so a
text that makes up a third of all rows is signed and compared once.  The shuffle
is 37 short keys a class (30 times more classes add a register to each key), the
number of key ranges follows the number of classes, and only candidate pairs
meet their words again.  A key that more than ``RUN`` classes share is cut, in
order of mass, into blocks of RUN; pairs of blocks whose masses allow the
similarity become rows of their own and are spread over all tasks, so a hot key
is no hot task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.operators.similarity import components
from anamnesis.session import cut, discard, ship_package

#: Chance that a pair exactly at the threshold meets in no band; pairs above it are missed less (at 0.75 instead of 0.7: 0.000001).
MISS = 0.00005
#: Bits of word parities that go along with every key, to drop pairs that meet by chance.
BITS = 64
#: Classes whose keys of one band are joined in one task; key bits beyond the range are 32, so chance meetings stay few at any size.
CLASSES_A_TASK = 100_000
#: The place of times that lie at the horizon of a :class:`Signer` or beyond.
LATE = (1 << 16) - 1
#: Words whose arrivals a worker keeps.
VOCABULARY = 1 << 15
#: Classes with one key that are worked off at once; longer runs are cut into blocks of so many.
RUN = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on whole arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _octave(words: np.ndarray, low: int, high: int, horizon: float, m: int, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, time, register) of the points of the level interval (low, high] that lie below each word's ``cover``.

    The process of the whole interval has rate m * (high - low).  A point of a
    word that covers the interval in part goes to the half its hash names, again
    and again until the half is covered or left out.
    """
    width = high - low
    rate = m * width
    most = max(8, int(rate * horizon + 6 * math.sqrt(rate * horizon) + 8))
    step = np.arange(most, dtype=np.uint64)
    seed = _mix(words + np.uint64((0x9E3779B97F4A7C15 * (high + 1)) % (1 << 64)))
    draw = _mix(seed[:, None] + step[None, :] * np.uint64(0x9E3779B97F4A7C15))
    time = np.cumsum(-np.log(_unit(draw)), axis=1) / rate
    at, nth = np.nonzero(time < horizon)
    times, draws = time[at, nth], draw[at, nth]
    lo, hi = np.full(len(at), low, np.int64), np.full(len(at), high, np.int64)
    keep = np.ones(len(at), bool)
    salt = 1
    while True:
        part = keep & (cover[at] < hi)
        if not part.any():
            break
        mid = (lo + hi) // 2
        upper = (_mix(draws ^ np.uint64(0xD1B54A32D192ED03 * salt % (1 << 64))) >> np.uint64(63)).astype(bool)
        lo, hi = np.where(part & upper, mid, lo), np.where(part & ~upper, mid, hi)
        keep &= cover[at] > lo
        salt += 1
    register = (_mix(draws + np.uint64(0xA0761D6478BD642F)) % np.uint64(m)).astype(np.int64)
    return at[keep], times[keep], register[keep]


def word_arrivals(words: np.ndarray, weights: np.ndarray, horizon: float, m: int) -> np.ndarray:
    """Earliest arrival of each register for each (word hash, whole weight), infinite beyond the horizon."""
    out = np.full((len(words), m), np.inf, np.float32)
    low, high = 0, 1
    while len(words) and low < weights.max():
        own = np.flatnonzero(weights > low)
        at, time, register = _octave(words[own], low, high, horizon, m, weights[own])
        np.minimum.at(out, (own[at], register), time.astype(np.float32))
        low, high = high, high * 2
    return out


class Signer:
    """Signatures of bags; the arrivals of words that were met before are kept (unit weights only)."""

    def __init__(self, m: int, least_mass: int):
        self.m, self.horizon = m, (math.log(m) + 7) / max(1, least_mass)
        self.index: dict[str, int] = {}
        self.hashes: list[int] = []
        self.table = np.empty((0, m), np.uint16)

    def _places(self, time: np.ndarray) -> np.ndarray:
        """Order of times as 16 bits, finer for early ones; LATE at the horizon and beyond."""
        return np.minimum(np.sqrt(np.minimum(time, self.horizon) / np.float32(self.horizon)) * np.float32(LATE), LATE).astype(np.uint16)

    def rows(self, words: list[str]) -> np.ndarray:
        """Table rows of words, made where they are new."""
        import xxhash

        index, fresh = self.index, []
        for w in words:
            if w not in index:
                index[w] = len(index)
                fresh.append(xxhash.xxh64_intdigest(w.encode()))
        if fresh:
            # In blocks, as a word draws some hundred points.
            made = np.concatenate([self._places(word_arrivals(np.array(fresh[i : i + 1024], np.uint64), np.ones(len(fresh[i : i + 1024]), np.int64), self.horizon, self.m)) for i in range(0, len(fresh), 1024)])
            self.hashes += fresh
            if len(index) > len(self.table):
                grown = np.empty((max(2 * len(self.table), len(index), 4096), self.m), np.uint16)
                grown[: len(index) - len(fresh)] = self.table[: len(index) - len(fresh)]
                self.table = grown
            self.table[len(index) - len(fresh) : len(index)] = made
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def sign(self, words: list[str], weights: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Signatures of bags given as runs of words and whole weights that end at ``ends``.

        Registers are 16-bit places of times; equal times have equal places, so no meeting is lost.  Times beyond the
        horizon stay times, which are larger numbers.
        """
        starts = np.r_[0, ends[:-1]].astype(np.int64)
        if len(self.index) > VOCABULARY:
            self.index.clear(), self.hashes.clear()
        rows = self.rows(words)
        out = np.empty((len(ends), self.m), np.uint32)
        heavy = np.flatnonzero(np.maximum.reduceat(weights, starts) > 1)
        # Bags by falling length, in blocks that stay in the cache: all first words, all second words, and so on.
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        for lo in range(0, len(order), 512):
            own = order[lo : lo + 512]
            least, longer = self.table[rows[starts[own]]], len(own)
            for k in range(1, size[own[0]]):
                while size[own[longer - 1]] <= k:
                    longer -= 1
                np.minimum(least[:longer], self.table[rows[starts[own[:longer]] + k]], out=least[:longer])
            out[own] = least
        all_hashes = np.array(self.hashes, np.uint64)
        for i in np.union1d(heavy, np.flatnonzero((out == LATE).any(axis=1))):
            own, horizon = slice(starts[i], ends[i]), self.horizon
            while True:
                time = word_arrivals(all_hashes[rows[own]], weights[own], horizon, self.m).min(axis=0)
                if not np.isinf(time).any():
                    break
                horizon *= 2
            place = self._places(time)
            out[i] = np.where(place < LATE, place, np.maximum(time, np.float32(1e-30)).view(np.uint32))
        return out

    def parities(self, words: list[str], weights: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """BITS bits of each bag; a word of odd weight turns over the bit that its hash names."""
        rows = self.rows(words)
        bit = (_mix(np.array(self.hashes, np.uint64) ^ np.uint64(0x8EBC6AF09C88C6E3)) % np.uint64(BITS))[rows]
        turned = np.zeros((len(bit), BITS // 64), np.uint64)
        turned[np.arange(len(bit)), (bit // np.uint64(64)).astype(np.int64)] = (weights & 1).astype(np.uint64) << (bit % np.uint64(64))
        return np.bitwise_xor.reduceat(turned, np.r_[0, ends[:-1]].astype(np.int64), axis=0)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of each signature."""
    bits = np.ascontiguousarray(signature).astype(np.uint64)
    banded = bits.reshape(len(bits), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), banded.shape[:2]).copy()
    for r in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + banded[:, :, r])
    return key


def band_shape(n_classes: int, least: float) -> tuple[int, int]:
    """(bands, rows) with a miss of MISS at the threshold; rows grow with the logarithm of the collection, so that
    meetings by chance stay in proportion to it."""
    rows = 4 + max(0, math.ceil(math.log(max(n_classes, 1) / 1e6, 30)))
    return math.ceil(math.log(MISS) / math.log(1 - least**rows)), rows


def too_far(bits_a: np.ndarray, bits_b: np.ndarray, mass: np.ndarray, least: float) -> np.ndarray:
    """Whether parities differ more often than bags of this similarity and sum of masses can: (1 - least) / (1 + least) of it."""
    return np.bitwise_count(bits_a ^ bits_b).sum(axis=1) * (1 + least) > mass * (1 - least) + 1e-9


def _pack(key: np.ndarray, no: np.ndarray, size: np.ndarray, bits: np.ndarray) -> bytes:
    """Columns of records in order of number: differences of numbers and sizes (compressed), 32 key bits, parities."""
    order = np.argsort(no, kind="stable")
    head = np.diff(no[order], prepend=0).astype("<i8").tobytes() + size[order].astype("<i4").tobytes()
    packed = zstandard.ZstdCompressor(level=1).compress(head)
    return len(order).to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed + (key[order] >> np.uint64(32)).astype("<u4").tobytes() + bits[order].astype("<u8").tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, k = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    head = zstandard.ZstdDecompressor().decompress(blob[8 : 8 + k])
    key = np.frombuffer(blob, "<u4", n, 8 + k)
    return key, np.cumsum(np.frombuffer(head[: 8 * n], "<i8")), np.frombuffer(head[8 * n :], "<i4"), np.frombuffer(blob[8 + k + 4 * n :], "<u8").reshape(n, -1)


def _sign(bands: int, rows: int, ranges: int, least_mass: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands * rows, least_mass)
        tbl, no, words, weights, ends = [], [], [], [], []

        def flush():
            number, end, weight = np.array(no, np.int64), np.array(ends, np.int64), np.array(weights, np.int64)
            mass = np.add.reduceat(weight, np.r_[0, end[:-1]])
            keys = band_keys(signer.sign(words, weight, end), bands, rows)
            bits = signer.parities(words, weight, end)  # of words that are known by now
            tables, out = np.array(tbl), []
            for t in np.unique(tables):
                own = np.flatnonzero(tables == t)
                for b in range(bands):
                    part = keys[own, b] % np.uint64(ranges)
                    for p in np.unique(part):
                        hit = own[part == p] if ranges > 1 else own
                        out.append((f"{t}/{b}/{p}", str(t), _pack(keys[hit, b], number[hit], mass[hit], bits[hit])))
            for x in (tbl, no, words, weights, ends):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.binary()))], ["part", "tbl", "packed"])

        for batch in batches:
            for t, n, bag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                items = bag.split(" ")
                if "*" in bag:
                    pairs = [i.partition("*") for i in items]
                    items = [p[0] for p in pairs]
                    weights.extend(int(p[2] or 1) for p in pairs)
                else:
                    weights.extend([1] * len(items))
                words.extend(items)
                tbl.append(t), no.append(n), ends.append(len(words))
                if len(no) >= 16384 or len(words) >= 1 << 20:
                    yield flush()
        if no:
            yield flush()

    return run


def _block(no: np.ndarray, mass: np.ndarray, bits: np.ndarray) -> bytes:
    return len(no).to_bytes(4, "little") + no.astype("<i8").tobytes() + mass.astype("<i8").tobytes() + bits.astype("<u8").tobytes()


def _unblock(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    return np.frombuffer(blob, "<i8", n, 4), np.frombuffer(blob, "<i8", n, 4 + 8 * n), np.frombuffer(blob[4 + 16 * n :], "<u8").reshape(n, -1)


_CANDIDATES = "tbl string, no_a bigint, no_b bigint, block_a binary, block_b binary"


def _rows(tbl: str, a: np.ndarray, b: np.ndarray, blocks: list[tuple[bytes, bytes]] = ()) -> pa.RecordBatch:
    n, k = len(a), len(blocks)
    none = pa.nulls(k, pa.int64())
    cols = [pa.array([tbl] * (n + k), pa.string()), pa.concat_arrays([pa.array(np.minimum(a, b), pa.int64()), none]), pa.concat_arrays([pa.array(np.maximum(a, b), pa.int64()), none])]
    cols += [pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([x[i] for x in blocks], pa.binary())]) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(cols, ["tbl", "no_a", "no_b", "block_a", "block_b"])


def _collide(least: float, run: int):
    """Candidate pairs of one part (equal keys, masses and parities that allow the similarity), and pairs of blocks of
    runs that are longer than ``run``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tbl, loaded = None, []
        for batch in batches:
            for t, blob in zip(batch.column("tbl").to_pylist(), batch.column("packed").to_pylist()):
                tbl = t
                loaded.append(_unpack(blob))
        key, no, mass, bits = (np.concatenate(x) for x in zip(*loaded))
        loaded.clear()
        order = np.lexsort((no, mass, key))
        key, no, mass, bits = key[order], no[order], mass[order].astype(np.int64), bits[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        single = np.ones(len(key), bool)
        for lo, hi in zip(starts[ends - starts > run], ends[ends - starts > run]):
            single[lo:hi] = False
            cuts = [(i, min(i + run, hi)) for i in range(lo, hi, run)]
            packed = [_block(no[i:j], mass[i:j], bits[i:j]) for i, j in cuts]
            for x, (_, j) in enumerate(cuts):
                for y in range(x, len(cuts)):
                    if mass[cuts[y][0]] * least > mass[j - 1] + 1e-9:
                        break
                    yield _rows(tbl, no[:0], no[:0], [(packed[x], packed[y] if y > x else b"")])
        # Partners at distance 1, 2, ... in order of key and mass, as long as key and mass allow: no square of a run is held.
        at, step = np.flatnonzero(single), 1
        while len(at):
            at = at[at + step < len(key)]
            at = at[(key[at] == key[at + step]) & (mass[at + step] * least <= mass[at] + 1e-9)]
            near = at[~too_far(bits[at], bits[at + step], mass[at] + mass[at + step], least)]
            if len(near):
                yield _rows(tbl, no[near], no[near + step])
            step += 1

    return work


def _cross(least: float):
    """Candidate pairs of pairs of blocks (an empty second block: the first with itself)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tbl, first, second in zip(*(batch.column(c).to_pylist() for c in ("tbl", "block_a", "block_b"))):
                no_a, mass_a, bits_a = _unblock(first)
                no_b, mass_b, bits_b = _unblock(second or first)
                for i in range(len(no_a)):
                    own = slice(0 if second else i + 1, int(np.searchsorted(mass_b, mass_a[i] / least + 1e-9, "right")))
                    ok = (mass_b[own] >= mass_a[i] * least - 1e-9) & ~too_far(bits_a[i], bits_b[own], mass_a[i] + mass_b[own], least)
                    if ok.any():
                        yield _rows(tbl, np.full(int(ok.sum()), no_a[i]), no_b[own][ok])

    return work


def candidate_pairs(bags: DataFrame, n_classes: int, least: float, least_mass: int = 1, shape: tuple[int, int] | None = None, ranges: int | None = None, run: int = RUN) -> DataFrame:
    """Distinct (tbl, no_a, no_b) whose signatures agree in a band.

    ``bags``: tbl, no (a number that is unique within tbl) and bag: words joined
    by blanks, ``word*k`` for weight k; ``least_mass``: the least sum of weights;
    ``shape``: bands and rows (by default of :func:`band_shape`); ``ranges``: parts
    of the keys of a band (by default one for CLASSES_A_TASK classes).
    """
    ship_package(bags.sparkSession)
    ranges = ranges or max(1, -(-n_classes // CLASSES_A_TASK))
    bands, rows = shape or band_shape(n_classes, least)
    keys = bags.select("tbl", F.col("no").cast("bigint").alias("no"), "bag").mapInArrow(_sign(bands, rows, ranges, least_mass), "part string, tbl string, packed binary")
    collide = _collide(least, run)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One partition holds several parts; rows come sorted by part.
        now, rows_ = None, []
        for batch in batches:
            parts = batch.column("part").to_pylist()
            at = 0
            while at < len(parts):
                end = at
                while end < len(parts) and parts[end] == parts[at]:
                    end += 1
                if parts[at] != now and rows_:
                    yield from collide(iter(rows_))
                    rows_ = []
                now = parts[at]
                rows_.append(batch.slice(at, end - at))
                at = end
        if rows_:
            yield from collide(iter(rows_))

    met = cut(keys.repartition("part").sortWithinPartitions("part").mapInArrow(part, _CANDIDATES))
    pairs, blocks = met.where("no_a IS NOT NULL"), met.where("block_a IS NOT NULL")
    n_blocks = blocks.count()
    if n_blocks:
        pairs = pairs.unionByName(blocks.repartition(n_blocks).mapInArrow(_cross(least), _CANDIDATES))
    distinct = cut(pairs.select("tbl", "no_a", "no_b").distinct())
    discard(met)
    return distinct


def _word_sets(least_words: int):
    find = re.compile("[A-Za-z0-9]+").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for text in batch.column(3).to_pylist():
                words = set(find(text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text))) if text else ()
                bags.append(" ".join(sorted(words)) if len(words) >= least_words else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bags, pa.string())], ["tbl", "id", "no", "bag"])

    return run


def word_sets(records: DataFrame, least_words: int) -> DataFrame:
    """tbl, id, no, bag of records (tbl, id, no, content): the distinct maximal runs of ASCII letters and digits in
    lower case, sorted and joined by blanks; null where there are fewer than ``least_words``."""
    ship_package(records.sparkSession)
    return records.select("tbl", "id", "no", "content").mapInArrow(_word_sets(least_words), "tbl string, id string, no bigint, bag string")


def bag_class(bag: Column) -> Column:
    """128-bit identity of a word set, made from the row alone."""
    return F.struct(F.xxhash64(bag).alias("h1"), F.xxhash64(F.lit("second"), bag).alias("h2"))


def similar_classes(records: DataFrame, wanted: DataFrame | None = None, least_words: int = 12, numerator: int = 7, denominator: int = 10, **banding) -> DataFrame:
    """tbl, class_a, class_b of different word sets that share at least numerator/denominator of their words.

    ``records``: tbl, cls and bag (null: too short); ``wanted``: tbl and cls of the
    sets that count (by default all).  Similarity is compared in whole numbers, so
    exactly the threshold counts.  ``banding``: shape, ranges and run of
    :func:`candidate_pairs`.  Joins are by sorting at every size, so that small
    collections show what large ones cost.
    """
    classes = records.where("bag IS NOT NULL").groupBy("tbl", "cls").agg(F.first("bag").alias("bag"))
    if wanted is not None:
        classes = classes.join(wanted.select("tbl", "cls").distinct().hint("merge"), ["tbl", "cls"], "left_semi")
    classes = cut(classes.select("tbl", "bag", F.monotonically_increasing_id().alias("no")))
    pairs = candidate_pairs(classes, classes.count(), numerator / denominator, least_words, **banding)
    side = lambda s: classes.select("tbl", F.col("no").alias(f"no_{s}"), F.col("bag").alias(f"bag_{s}")).hint("merge")
    both = pairs.join(side("a"), ["tbl", "no_a"]).join(side("b"), ["tbl", "no_b"]).withColumns({"w_a": F.split("bag_a", " "), "w_b": F.split("bag_b", " ")})
    both = both.withColumn("shared", F.size(F.array_intersect("w_a", "w_b"))).where(F.col("shared") * denominator >= (F.size("w_a") + F.size("w_b") - F.col("shared")) * numerator)
    alike = cut(both.select("tbl", bag_class(F.col("bag_a")).alias("class_a"), bag_class(F.col("bag_b")).alias("class_b")))
    discard(classes, pairs)
    return alike


def members_and_links(messages: DataFrame, notes: DataFrame, **banding) -> tuple[DataFrame, DataFrame]:
    """members (tbl, id, cls) and the links of their classes (tbl, class_a, class_b).

    Word sets are made once, in one scan; only those of last deliveries are signed.
    """
    pick = lambda df, name, key: df.where(f"{key} IS NOT NULL").select(F.lit(name).alias("tbl"), F.col(key).alias("id"), F.col("ingest_no").cast("bigint").alias("no"), "content")
    sets = word_sets(pick(messages, "messages", "message_id").unionByName(pick(notes, "notes", "note_id")), 12)
    bags = cut(sets.withColumn("cls", F.when(F.col("bag").isNotNull(), bag_class(F.col("bag")))))
    last = bags.where("tbl = 'messages'").groupBy("tbl", "id").agg(F.max(F.struct("no", "cls")).alias("m")).select("tbl", "id", "m.cls")
    members = cut(last.unionByName(bags.where("tbl = 'notes'").select("tbl", "id", "cls").distinct()).where("cls IS NOT NULL"))
    alike = similar_classes(bags, members, **banding)
    discard(bags)
    return members, alike


def near_duplicates(messages: DataFrame, notes: DataFrame, **banding) -> DataFrame:
    """tbl, id_a, id_b (id_a < id_b) of all near-duplicate messages (last deliveries) and notes (any of their texts).

    Defined cases: rows without id are left out; null and short contents (fewer
    than 12 distinct words) pair with nothing; a message whose last delivery is
    short pairs with nothing; repeated rows count once; empty tables give no
    rows; further columns are ignored.
    """
    members, alike = members_and_links(messages, notes, **banding)
    left = members.select("tbl", F.col("cls").alias("class_a"), F.col("id").alias("x"))
    right = members.select("tbl", F.col("cls").alias("class_b"), F.col("id").alias("y"))
    across = alike.join(left.hint("merge"), ["tbl", "class_a"]).join(right.hint("merge"), ["tbl", "class_b"]).select("tbl", "x", "y")
    shared = members.groupBy("tbl", "cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tbl", F.col("cls").alias("class_a"))
    copies = left.join(shared, ["tbl", "class_a"], "left_semi")
    within = copies.join(copies.select("tbl", "class_a", F.col("x").alias("y")), ["tbl", "class_a"]).select("tbl", "x", "y")
    return (
        across.unionByName(within).where("x <> y")
        .select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        .distinct()
    )


def near_duplicate_groups(messages: DataFrame, notes: DataFrame, **banding) -> DataFrame:
    """tbl, id, class_id, group_id, copies, links: one row per record and text, nothing expanded to pairs.

    class_id: the smallest id with this set of words; copies: how many records
    have it; links: how many other sets of words are alike; group_id: the smallest
    class_id of all that are linked with it over any number of steps.  Cases as
    for :func:`near_duplicates`; a note has a row for each of its texts.
    """
    members, alike = members_and_links(messages, notes, **banding)
    classes = cut(members.groupBy("tbl", "cls").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")))
    name = lambda c: F.concat_ws(" ", "tbl", F.hex(F.col(f"{c}.h1")), F.hex(F.col(f"{c}.h2")))
    linked = components(alike.select(name("class_a").alias("id_a"), name("class_b").alias("id_b")))
    degree = alike.select("tbl", F.col("class_a").alias("cls")).union(alike.select("tbl", "class_b")).groupBy("tbl", "cls").agg(F.count(F.lit(1)).alias("links"))
    rooted = cut(classes.join(degree, ["tbl", "cls"], "left").withColumn("id", name("cls")).join(linked, "id", "left").select("tbl", "cls", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root")))
    first = rooted.groupBy("tbl", "root").agg(F.min("class_id").alias("group_id"))
    return members.join(rooted.join(first, ["tbl", "root"]), ["tbl", "cls"]).select("tbl", "id", "class_id", "group_id", "copies", "links")
