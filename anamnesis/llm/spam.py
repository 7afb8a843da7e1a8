"""Keyword-stuffed pages and link lists: bagged decision trees on content and link features, smoothed by host.

1. One scan measures each page: repetition, function words, separators, links,
   number columns, marks (``FEATURES``).  No feature is itself a share of spam.
2. Five weak labellers look at the lines of the page (link lists, stuffed words,
   tag lists; sentences, structure).  Each abstains unless its kind makes up
   ``SURE`` of the visible characters or more; mixed and unusual pages stay
   unlabelled, and a page on which labellers disagree does too.
3. A bounded sample of labelled pages (``SAMPLE`` rows a label), and pages put
   together from a spam page and another (``MIXED`` times; the label is the kind
   of most characters), train bagged trees.
4. The trees decide every page; a weak label counts as evidence that a clear vote
   overrules.  The result is taken as odds and multiplied, on doubtful pages, by the odds of the host's spam rate against the overall rate; the
   rate is shrunk by a prior whose weight is measured from how much hosts differ
   beyond chance.

Scale: features are made in one Arrow scan without a shuffle; the trees are a
few kilobytes of numpy; host rates are one partial aggregation, and a host that
holds a third of all pages is one row of it.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.session import cut, ship_package

#: Most labelled pages of each label that train the trees.
SAMPLE = 8_000
#: Most pages that are put together of labelled ones for training, as labellers leave mixed pages out; of how many of each kind.
MIXED = 2_000
PARTS = ((1, 1), (1, 3), (3, 1), (1, 6))
TREES, DEPTH, LEAF = 40, 8, 3
#: Share of the visible characters from which a weak labeller speaks.
SURE = 0.8
#: What a weak label multiplies the odds of the trees by (or divides, if it is none): votes beyond 0.25 and 0.75 overrule it.
LABEL_ODDS = 3
#: Most that a host can multiply the odds of a page by: only votes between 0.2 and 0.8 can turn over.
HOST_ODDS = 4
#: Most pages that the overall rate counts for against a host's own, used where hosts differ by chance only.
PRIOR = 1_000

#: Words that hold sentences together (English, Spanish, German, French).
GLUE = frozenset(
    "the a an to and that it we you they whether he she i which was were be been are of as by with from this these those not no or but so if when where what who how does do did can could would should may must will has have had its their our my your than then into because before after while there nobody each every only both "
    "el la los las un una de del que y en por para con se es son fue nadie según no hace más lo al su quién si o pero como sin sobre entre cuando donde porque desde hasta también ya muy esta este esto está están ha han era ser hay nos les sus primero luego antes después "
    "der die das ein eine einen einem einer dem den des und ist sind war waren nicht mit von zu zum zur im in auf für wird werden wurde wurden wer hat haben aus bei noch seit wie nach ob weil wenn dass als auch aber oder um über unter gegen vor durch er sie es wir ihr ihre sich so nur schon sehr bitte diese dieser dieses alle aller kein keine "
    "le les une et est sont pas dans pour sur au aux qui que ne il elle nous vous ils des du ce cette ces son sa ses avec sans par plus mais ou où comme si".split()
)
#: Characters that hold Chinese sentences together.
HAN_GLUE = frozenset("的了已经请把为我们不从到只能之前否则因用以后会是在也")

URL = re.compile(r"(?:h(?:tt|xx)ps?://|www\.)[^\s)\]>\"'|]+|\b[a-z0-9][a-z0-9\-]*(?:\.[a-z0-9\-]+)+/[^\s)\]>\"'|]*", re.I)
_LINKED = re.compile(r"\[([^\]]*)\]\(([^)\s]*)\)|<a [^>]*>(.*?)</a>", re.I)
_LOG = re.compile(r"^\W*\d{4}-\d\d-\d\d[T ]\d\d|^\W*(?:INFO|WARN|ERROR|DEBUG)\b")
_TALK = re.compile(r"^\W*(?:user|assistant|system|tool|human|ai|bot|q|a|用户|助手)\W*[:：>]", re.I)
_CODE = re.compile(r"^\s*(?:def |class |import |from \w+ import|return\b|for .*:$|if .*:$|else:|elif |try:|except|while .*:$|with .*:$|@\w|#include|function |const |let |var |(?:public|private|protected) (?:static|final|abstract|async|class|interface|enum|void|[\w<>\[\]]+ \w+\s*[({=;])|\}|\{|//|\$ |>>> |SELECT |INSERT )|[;{}]\s*$|^\s*[\w.]+\((?!\d+\)\W+\S)[^()]*(?:\([^()]*\)[^()]*)*\)\s*$|^\s*\w+(?:\[\w*\])? ?[+\-*]?= ?\S")
_DATA = re.compile(r"^\s*[\[\]{}\"]|^\s*\"?[\w\-]+\"?\s*: ?\S+\s*,?$|^\s*---")
_SETTING = re.compile(r"^\W*`[^`]+`|^\s*[\w.\-]+ ?= ?\S+\s*$")
_CELLS = re.compile(r"\s*[\t|,;]\s*")
_SPLIT = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n")
_ITEM = re.compile(r"[\n\t,;|/·•*!?.。！？，、；›»]+")
_TOKEN = re.compile(r"[^\W_]+")
_HAN_TOKEN = re.compile(r"[一-鿿]{1,2}|[^\W_一-鿿]+")
_NUMBER = re.compile(r"[\d.,%:\-+ ]*\d[\d.,%:\-+ ]*")
_MARKS = list(b"(){}[]=<>_`\"#:")
_RULE = set("|-: +=")
_BLANK = list(b" \t\r\n\x0b\x0c")

FEATURES = ["distinct", "pairs", "top_share", "packed", "glue_share", "dry", "item_words", "item_repeats", "separators", "link_chars", "link_words", "links", "digits", "marks", "capitals", "columns", "stops", "indent", "han", "size"]


def _tokens(text: str) -> list[str]:
    return (_TOKEN if text.isascii() else _HAN_TOKEN).findall(text.lower())


def _held(tokens: list[str], plain: bool) -> list[bool]:
    """Which tokens hold sentences together; plain: all of them are ASCII."""
    if plain:
        return list(map(GLUE.__contains__, tokens))
    return [t in GLUE or not (t.isascii() or HAN_GLUE.isdisjoint(t)) for t in tokens]


def _shown(text: str) -> int:
    return len(text) - text.count(" ") - text.count("\t") - text.count("\u00a0")


def number_column_lines(lines: list[str]) -> set[int]:
    """Indexes of the lines that are rows of a table: three cells or more, a number among them, and the same kinds of
    cells (number or not) in the same order as at least a third of such lines, or the head of these."""
    kinds: dict[tuple, list[int]] = {}
    widths: dict[int, list[int]] = {}
    for i, line in enumerate(lines):
        separators = line.count(",") + line.count("\t") + line.count("|") + line.count(";")
        if separators < 2 or len(line) > 60 * (separators + 1):
            continue
        cells = _CELLS.split(line.strip().strip("|"))
        if len(cells) >= 3:
            kind = tuple(_NUMBER.fullmatch(c) is not None for c in cells)
            widths.setdefault(len(cells), []).append(i)
            if any(kind) and max(map(len, cells)) <= 60:
                kinds.setdefault(kind, []).append(i)
    rows = set()
    for kind, own in kinds.items():
        alike = widths[len(kind)]
        if len(own) >= 2 and 3 * len(own) >= len(alike):
            rows.update(own)
            rows.update(i for i in alike if i + 1 in own or i + 2 in own)
    return rows


def measure_page(text: str | None) -> tuple[list[float], int | None]:
    """The feature values (in the order of FEATURES) and the weak label of a page: 1 spam, 0 none, or no label.

    A blank page has only zeros and no label.
    """
    text = (text or "").replace("\ufeff", "").replace("\u200b", "")
    if not text or text.isspace():
        return [0.0] * len(FEATURES), None
    plain = text.isascii()
    raw = text.encode("utf-8", "replace")
    per_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    seen = max(1, len(text) - int(per_byte[_BLANK].sum()))
    lines = [x for x in text.splitlines() if x.strip()]
    table = number_column_lines(lines)
    tokens: list[str] = []
    items: list[str] = []
    url_chars = n_urls = n_links = 0
    sentences = structure = linked = tags = 0
    fenced = False
    pieces: list[tuple[int, int, int]] = []
    for i, line in enumerate(lines):
        size, bare, rest, urls = _shown(line), line.strip(), line, []
        if "/" in line or "www." in line.lower():
            urls = URL.findall(line)
            if urls:
                rest = URL.sub(" ", _LINKED.sub(lambda m: " " + (m[1] or m[3] or "") + " \n", line))
                n_urls += len(urls)
                url_chars += sum(map(len, urls))
        items += _ITEM.split(rest)
        fence = bare.startswith("```")
        fenced ^= fence
        if fenced or fence or i in table or _LOG.match(bare) or _TALK.match(bare) or set(bare[:80]) <= _RULE:
            structure += size
            tokens += _tokens(rest)
            continue
        if urls:
            own = _tokens(rest)
            if len(own) <= 7 * len(urls):
                n_links += len(urls)
                linked += size
                tokens += own
                continue
        if _DATA.match(bare) or _SETTING.match(bare) or (bare.count(",") < 4 or "(" in bare) and _CODE.search(line):
            structure += size
            tokens += _tokens(rest)
            continue
        for piece in _SPLIT.split(rest):
            own = _tokens(piece)
            pieces.append((len(tokens), len(tokens) + len(own), _shown(piece)))
            tokens += own
        sentences += sum(map(len, urls))

    n = max(1, len(tokens))
    counts = Counter(tokens)
    hold = _held(tokens, plain)
    held = np.flatnonzero(hold)
    # Words that lie in stretches of eight or more without a word that holds sentences together.
    gaps = np.diff(np.concatenate(([-1], held, [len(tokens)]))) - 1
    own = dict(zip(tokens, hold))
    loose_counts = [k for t, k in counts.items() if not own[t]]
    items = [s for s in map(str.strip, items) if s]
    digits, marks = int(per_byte[48:58].sum()), int(per_byte[_MARKS].sum())
    features = [
        len(counts) / n,
        len(set(zip(tokens, tokens[1:]))) / n,
        sum(heapq.nlargest(8, loose_counts)) / n,
        len(zlib.compress(raw, 1)) / len(raw),
        len(held) / n,
        int(gaps[gaps >= 8].sum()) / n,
        math.log1p(len(tokens) / max(1, len(items))),
        1 - len({s.lower() for s in items}) / max(1, len(items)),
        len(items) / seen * 10,
        url_chars / seen,
        math.log1p(len(tokens) / n_urls) if n_urls else 9.0,
        math.log1p(n_urls),
        digits / seen,
        marks / seen,
        int(per_byte[65:91].sum()) / seen,
        sum(_shown(lines[i]) for i in table) / seen,
        (text.count(". ") + text.count(".\n") + text.count("。") + text.endswith(".")) / n,
        sum(x[0] in " \t" for x in lines) / len(lines),
        0.0 if plain else int(per_byte[0xE4:0xEA].sum()) / seen,
        math.log1p(len(text)),
    ]

    keys = {t for t, k in counts.items() if k >= 4 and k >= 0.05 * n and not own[t]}
    stuffed = held_keys = 0
    inside: Counter[str] = Counter()
    for lo, hi, shown in pieces:
        holds = sum(hold[lo:hi]) >= max(1, 0.08 * (hi - lo))
        if keys and hi > lo and 2 * sum(map(keys.__contains__, tokens[lo:hi])) >= hi - lo:
            stuffed += shown
            inside.update(tokens[lo:hi])
            held_keys += holds * shown
        elif holds:
            sentences += shown
        else:
            tags += shown
    if stuffed and len(inside) >= 0.33 * inside.total():
        # Many different words beside the keys: sentences about one topic where words hold them together, tags otherwise.
        sentences += held_keys
        tags += stuffed - held_keys
        stuffed = 0
    total = max(1, sentences + structure + linked + stuffed + tags)
    says = set()
    if n_links >= 3 and linked >= SURE * total or stuffed >= SURE * total or tags >= SURE * total and len(counts) >= 12:
        says.add(1)
    if sentences >= SURE * total or structure >= SURE * total or sentences + structure >= 0.95 * total:
        says.add(0)
    return features, says.pop() if len(says) == 1 else None


def grow_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 7) -> list[np.ndarray]:
    """Bagged decision trees: each on a bootstrap of the rows, each split among a random half of the features.

    A tree is an array of (feature, threshold, left, right, value) rows; feature
    -1 marks a leaf.  The bootstrap is balanced between the two labels.
    """
    rng = np.random.default_rng(seed)
    grid = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 64))) for f in range(x.shape[1])]
    by_label = [np.flatnonzero(y == v) for v in (0, 1)]
    size = max(1, max(map(len, by_label)))
    forest = []
    for _ in range(trees):
        rows = np.concatenate([rng.choice(own, size) for own in by_label if len(own)])
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            rate = float(y[rows].mean())
            nodes.append([-1, 0, -1, -1, rate])
            if level == depth or rate in (0.0, 1.0) or len(rows) < 2 * leaf:
                return at
            best = (rate * (1 - rate) * len(rows) - 1e-9, -1, 0.0)
            for f in rng.permutation(x.shape[1])[: max(1, (x.shape[1] + 1) // 2)]:
                if len(grid[f]) < 2:
                    continue
                bins = np.searchsorted(grid[f], x[rows, f], "left")
                n = np.bincount(bins, minlength=len(grid[f]) + 1).cumsum()[:-1]
                k = np.bincount(bins, y[rows], minlength=len(grid[f]) + 1).cumsum()[:-1]
                nr, kr = len(rows) - n, y[rows].sum() - k
                ok = (n >= leaf) & (nr >= leaf)
                if not ok.any():
                    continue
                impurity = np.full(len(n), np.inf)
                impurity[ok] = k[ok] * (1 - k[ok] / n[ok]) + kr[ok] * (1 - kr[ok] / nr[ok])
                i = int(impurity.argmin())
                if impurity[i] < best[0]:
                    # Between the last value on the left and the first on the right.
                    v = x[rows, f]
                    best = (impurity[i], int(f), float((v[v <= grid[f][i]].max() + v[v > grid[f][i]].min()) / 2))
            if best[1] < 0:
                return at
            go = x[rows, best[1]] <= best[2]
            nodes[at][:2] = [best[1], best[2]]
            nodes[at][2] = grow(rows[go], level + 1)
            nodes[at][3] = grow(rows[~go], level + 1)
            return at

        grow(rows, 0)
        forest.append(np.array(nodes))
    return forest


def vote(forest: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Mean of the trees' leaf rates."""
    total = np.zeros(len(x))
    for tree in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            feature = tree[at, 0].astype(np.int64)
            inner = feature >= 0
            if not inner.any():
                break
            left = x[np.arange(len(x)), np.maximum(feature, 0)] <= tree[at, 1]
            at = np.where(inner, np.where(left, tree[at, 2], tree[at, 3]).astype(np.int64), at)
        total += tree[at, 4]
    return total / max(1, len(forest))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [measure_page(t) for t in batch.column(2).to_pylist()]
        values = np.array([m[0] for m in made], np.float64).reshape(-1, len(FEATURES))
        label = pa.array([m[1] for m in made], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), label, *(pa.array(values[:, i]) for i in range(len(FEATURES)))], ["doc_id", "host", "label", *FEATURES])


def _vote(forest: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(batch.schema.get_field_index(f)).to_numpy() for f in FEATURES])
            votes = np.where(x[:, FEATURES.index("size")] > 0, vote(forest, x), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(votes)], ["doc_id", "host", "label", "vote"])

    return run


def measure_pages(documents: DataFrame) -> DataFrame:
    """doc_id, host, weak label (or null) and the features of every page."""
    ship_package(documents.sparkSession)
    columns = ", ".join(f"{f} double" for f in FEATURES)
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("host"), F.col("text")).mapInArrow(_measure, f"doc_id bigint, host string, label int, {columns}")


def put_together(spam: list[str], other: list[str], number: int) -> tuple[list[float], int | None]:
    """Features of one page made of several, and the kind of most characters; no label between 0.4 and 0.6 of them."""
    share = sum(map(len, spam)) / max(1, sum(map(len, spam + other)))
    label = None if 0.4 < share < 0.6 else int(share > 0.5)
    return measure_page("\n".join(spam + other if number % 2 else other + spam))[0], label


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [put_together(a, b, n) for n, a, b in zip(*(c.to_pylist() for c in batch.columns))]
        values = np.array([m[0] for m in made], np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([pa.array([m[1] for m in made], pa.int32()), *(pa.array(values[:, i]) for i in range(len(FEATURES)))], ["label", *FEATURES])


def train(pages: DataFrame, documents: DataFrame) -> list[np.ndarray]:
    """The forest of a bounded sample of the labelled pages and of mixed ones; one leaf where only one label is there."""
    spark, sample, chosen = pages.sparkSession, [], []
    for value in (0, 1):
        own = pages.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "label", *FEATURES).limit(SAMPLE).collect()
        sample += [tuple(r)[1:] for r in own]
        chosen.append([r[0] for r in own if r[0] is not None][:MIXED])
    rows = np.array(sample, np.float64).reshape(-1, len(FEATURES) + 1)
    if len(set(rows[:, 0])) < 2:  # nothing to tell apart
        return [np.array([[-1, 0, -1, -1, float(rows[0, 0]) if len(rows) else 0.0]])]
    size = max(map(len, chosen)) if all(chosen) else 0
    if size:
        numbered = [(ids[(n + 7 * k) % len(ids)], kind, n, k) for kind, ids in enumerate(chosen) for n in range(size) for k in range(PARTS[n % len(PARTS)][1 - kind])]
        places = F.broadcast(spark.createDataFrame(numbered, "page bigint, kind int, number bigint, place int"))
        texts = documents.select(F.col("doc_id").cast("bigint").alias("page"), "text").join(places, "page").where("text IS NOT NULL")
        # A doc_id may be repeated: one of its texts is taken.
        texts = texts.groupBy("number", "kind", "place").agg(F.max("text").alias("text"))
        part = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "text")))), lambda x: x["text"])
        pairs = texts.groupBy("number").agg(part(1).alias("spam"), part(0).alias("other")).where("size(spam) > 0 AND size(other) > 0")
        columns = ", ".join(f"{f} double" for f in FEATURES)
        mixed = pairs.repartition(max(1, size // 100)).mapInArrow(_put_together, f"label int, {columns}").where("label IS NOT NULL").collect()
        rows = np.concatenate([rows, np.array([tuple(r) for r in mixed], np.float64).reshape(-1, len(FEATURES) + 1)])
    return grow_trees(rows[:, 1:], rows[:, 0])


def smooth_by_host(votes: DataFrame) -> DataFrame:
    """votes (doc_id, host, vote and more) with score: the vote, of doubtful pages moved by the spam rate of their host.

    A page is doubtful if a factor of HOST_ODDS could turn its odds over.  The
    host's rate leaves the page itself out and is shrunk to the overall rate by
    a prior of k pages, k = (1 - r) / r from the correlation r of pages within
    hosts (analysis of variance), at most PRIOR.
    Pages without host keep their vote.
    """
    hosts = cut(votes.where("host IS NOT NULL").groupBy("host").agg(F.sum("vote").alias("host_sum"), F.count(F.lit(1)).alias("host_n")))
    a = hosts.agg(F.sum("host_sum").alias("s"), F.sum("host_n").alias("n"), F.sum(F.col("host_n") * F.col("host_n")).alias("nn"), F.count(F.lit(1)).alias("h"), F.sum(F.col("host_sum") * F.col("host_sum") / F.col("host_n")).alias("ss")).first()
    rate = a.s / a.n if a.n else 0.0
    within = 0.0
    if a.h and a.h > 1 and 0 < rate < 1:
        chance = rate * (1 - rate)
        spread = (a.n - a.nn / a.n) - (a.h - 1)
        within = (a.ss - a.n * rate * rate - (a.h - 1) * chance) / (chance * spread) if spread > 0 else 0.0
    within = min(max(within, 1 / (1 + PRIOR)), 0.999)
    prior = (1 - within) / within
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    low = 1 / (1 + HOST_ODDS)
    doubtful = (F.col("vote") > low) & (F.col("vote") < 1 - low)
    own = (F.col("host_sum") - F.col("vote") + prior * rate) / (F.col("host_n") - 1 + prior)
    own = F.least(F.greatest(own, F.lit(1e-6)), F.lit(1 - 1e-6))
    factor = F.least(F.greatest(own / (1 - own) / (rate / (1 - rate)), F.lit(1 / HOST_ODDS)), F.lit(float(HOST_ODDS)))
    odds = F.col("vote") / (1 - F.col("vote")) * factor
    moved = votes.where(doubtful & F.col("host").isNotNull()).join(hosts, "host").withColumn("score", odds / (1 + odds)).select(*votes.columns, "score")
    return votes.where(~doubtful | F.col("host").isNull()).withColumn("score", F.col("vote")).unionByName(moved)


def score_pages(documents: DataFrame) -> DataFrame:
    """doc_id, host, label (weak, or null), trees (their vote), vote (with the label), score (smoothed by host)."""
    pages = cut(measure_pages(documents))
    votes = pages.mapInArrow(_vote(train(pages, documents)), "doc_id bigint, host string, label int, vote double").withColumnRenamed("vote", "trees")
    factor = F.when(F.col("label") == 1, float(LABEL_ODDS)).when(F.col("label") == 0, 1 / LABEL_ODDS).otherwise(1.0)
    odds = F.col("trees") * factor
    return smooth_by_host(cut(votes.withColumn("vote", odds / (odds + 1 - F.col("trees")))))


def find_spam_pages(documents: DataFrame) -> DataFrame:
    """doc_id of the pages that are keywords, link lists or tags for more than half.

    Defined cases: null, empty and blank texts are no case; repeated doc_ids are
    given once; null doc_ids and null hosts are allowed (a null doc_id is no
    case); no rows, no cases; further columns are ignored.
    """
    return score_pages(documents).where("score > 0.5 AND doc_id IS NOT NULL").select("doc_id").distinct()
