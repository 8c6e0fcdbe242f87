"""Benchmark decontamination: rare word-pair seeds, then Smith-Waterman alignment.

An item's starts are its words but the last; a start's pairs are its word with
the next and with the one after.  A text holds such a pair if the two words
are neighbours or one word apart.  An alignment that scores ``least`` of a
perfect one may lack at most (1 - least) of the item's starts, however its
words are changed: a gap between two equal words that no pair bridges costs
two, as much as an equal word gives.  So of any floor((1 - least) m) + n starts
of an item of m words it holds n or more, all near one diagonal.  The rarest
starts (by their pairs' count in the whole corpus) are the seeds; where a
document holds n of them, the words around are aligned with the item, and the
alignment's score as a share of a perfect one says whether the passage is a
copy, edited or not.

The benchmark is processed in blocks of bounded size; each block is sent to
all executors and the corpus is read against it, so documents are never
shuffled and no document, seed or item gathers in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .rows import row_key
from .words import U

#: Words that a pair reaches ahead, and the seeds that an alignment must hold (fewer in short items).
REACH, HOLD = 2, 3
#: Seed hits of several texts looked at together.
HITS = 1 << 20
#: Characters of benchmark text in a block.
BLOCK_CHARS = 4 << 20
#: Alignment: an equal word, another word, a skipped word.
MATCH, OTHER, SKIP = 2, -1, -1


def _pairs(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all pairs of near words and the index of their first word; none crosses a row's end."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes, places = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for d in range(1, REACH + 1):
        at = np.flatnonzero(row[d:] == row[:-d])
        hashes.append(words.join_hashes(h[at], h[at + d]))
        places.append(at)
    return np.concatenate(hashes), np.concatenate(places)


def _singles(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return words.join_hashes(h), np.arange(len(h))


_KINDS = {"pair": _pairs, "word": _singles}


class _Known:
    """Membership in a fixed set of hashes; a table of the low bits answers most."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.mask = U((1 << max(16, min(24, int(len(self.sorted)).bit_length() + 6))) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[(self.sorted & self.mask).astype(np.int64)] = True

    def where(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known hashes, and their index in ``sorted``."""
        maybe = np.flatnonzero(self.table[(hashes & self.mask).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), max(len(self.sorted) - 1, 0))
        hit = self.sorted[at] == hashes[maybe] if len(self.sorted) else np.zeros(0, bool)
        return maybe[hit], at[hit]


class Items:
    """A block of benchmark items: their words, pairs and (once counts are known) seeds."""

    def __init__(self, ids: list, texts: list[str], least: float = 0.5):
        h, first = words.hashed(pa.array(texts, pa.string()), words.ALNUM)
        self.ids, self.least = ids, least
        self.words = [h[first[i]:first[i + 1]] for i in range(len(ids))]
        self.size = np.diff(first)
        #: starts that an alignment may lack; a hair more, so that rounding loses none
        self.lack = np.floor((1 - least) * self.size + 1e-9).astype(np.int64)
        #: words by which an alignment's diagonals may differ
        self.slack = np.maximum(4, np.ceil(2 * (1 - least) * self.size).astype(np.int64))
        # without a pair that must be there (one word, or a low ``least``) every word is a seed
        single = (self.size == 1) | ((self.size > 2) & (self.lack > self.size - 2))
        self.need = np.where(single | (self.size == 2), 1, np.minimum(HOLD, self.size - 1 - self.lack))
        self.grams = {}  # kind: hash, item and start of each
        for kind, of in _KINDS.items():
            x, at = of(h, first)
            item = np.searchsorted(first, at, "right") - 1
            mine = single[item] == (kind == "word")
            self.grams[kind] = x[mine], item[mine], (at - first[item])[mine]
        self.known = {kind: _Known(x) for kind, (x, _, _) in self.grams.items()}
        self.seeds: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def choose(self, counts: dict[str, np.ndarray]) -> None:
        """Seeds are an item's rarest starts, as many as it may lack and ``need`` more.

        ``counts`` has a count for each known hash.  Starts that occur nowhere
        are among them but need no look-up.
        """
        for kind, (x, item, start) in self.grams.items():
            times = counts[kind][np.searchsorted(self.known[kind].sorted, x)] if len(x) else np.zeros(0, np.int64)
            if kind == "pair":
                place = np.concatenate([[0], np.cumsum(self.size)])[item] + start
                total = np.bincount(place, times, minlength=int(self.size.sum()) + 1)[place]
                # the rank of each start among those of its item, of equals the first
                starts, slot = np.unique(place, return_inverse=True)
                of, rarity = np.zeros(len(starts), np.int64), np.zeros(len(starts))
                of[slot], rarity[slot] = item, total
                order = np.lexsort((starts, rarity, of))
                rank = np.empty(len(starts), np.int64)
                rank[order] = np.arange(len(starts)) - np.searchsorted(of[order], of[order], "left")
                chosen = (rank[slot] < self.lack[item] + self.need[item]) & (times > 0)
            else:
                chosen = times > 0
            x, item, start = x[chosen], item[chosen], start[chosen]
            order = np.argsort(x, kind="stable")
            self.known[kind] = _Known(x)
            bounds = np.append(np.searchsorted(x[order], self.known[kind].sorted), len(x))
            self.seeds[kind] = bounds, item[order], start[order]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the text's place (end) that reaches it."""
    best, place = 0, 0
    last = np.zeros(len(text) + 1, np.int64)
    ramp = np.arange(len(text) + 1)
    for w in item:
        here = np.maximum(0, last + SKIP)
        here[1:] = np.maximum(here[1:], last[:-1] + np.where(text == w, MATCH, OTHER))
        # skips along the text: each costs one, so a running maximum of score + place
        here = np.maximum(here, np.maximum.accumulate(here - SKIP * ramp) + SKIP * ramp)
        here[0] = 0
        k = int(here.argmax())
        if here[k] > best:
            best, place = int(here[k]), k
        last = here
    return best, place


def _spots(items: Items, h: np.ndarray, first: np.ndarray):
    """(row, item, diagonals) where ``need`` seeds of an item or more lie within its slack, by row and item."""
    found = []  # row, item, diagonal
    for kind, (bounds, item, start) in items.seeds.items():
        if not len(item):
            continue
        x, at = _KINDS[kind](h, first)
        hit, which = items.known[kind].where(x)
        found.append((at[hit], kind, which))
    if not found:
        return
    place = np.concatenate([f[0] for f in found])
    many = np.concatenate([np.diff(items.seeds[kind][0])[which] for _, kind, which in found])
    begin = np.concatenate([items.seeds[kind][0][which] for _, kind, which in found])
    kinds = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    order = np.argsort(place, kind="stable")
    place, many, begin, kinds = place[order], many[order], begin[order], kinds[order]
    row = np.searchsorted(first, place, "right") - 1
    # whole rows, of about HITS hits together
    total = np.concatenate([[0], np.cumsum(many)])
    ends = np.flatnonzero(np.append(row[1:] != row[:-1], True)) + 1 if len(row) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(place):
        k = max(np.searchsorted(total[ends], total[lo] + HITS, "right") - 1, np.searchsorted(ends, lo, "right"))
        hi = int(ends[k])
        n = many[lo:hi]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(begin[lo:hi], n) + inside
        of = np.repeat(kinds[lo:hi], n)
        item, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k, (_, kind, _) in enumerate(found):
            item[of == k] = items.seeds[kind][1][at[of == k]]
            start[of == k] = items.seeds[kind][2][at[of == k]]
        r = np.repeat(row[lo:hi], n)
        base = int(row[lo])
        pair = (r - base) * len(items.ids) + item
        low = int(items.size.max())
        span = int(np.diff(first[base:int(r[-1]) + 2]).max()) + low + int(items.slack.max()) + 1
        key = np.sort(pair * span + np.repeat(place[lo:hi], n) - first[r] - start + low)
        pair = key // span
        item = pair % len(items.ids)
        near = np.searchsorted(key, key + items.slack[item], "right") - np.arange(len(key))
        full = np.flatnonzero(near >= items.need[item])
        cuts = np.flatnonzero(np.diff(pair[full], prepend=-1)) if len(full) else full
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(full)]):
            p = int(pair[full[a]])
            yield base + p // len(items.ids), p % len(items.ids), (key[full[a:b]] - p * span - low).tolist()
        lo = hi


def _found(items: Items, h: np.ndarray, first: np.ndarray, least: float):
    """(row, item index, score, word start, word end) of each row and item with an alignment."""
    for r, i, starts in _spots(items, h, first):
        item = items.words[i]
        m, slack = len(item), int(items.slack[i])
        whole = h[first[r]:first[r + 1]]
        lo = hi = None
        best = (0.0, 0, 0)
        # windows that overlap are aligned as one
        for s in [*starts, None]:
            if s is not None and hi is not None and s - slack <= hi:
                hi = max(hi, s + m + slack)
                continue
            if hi is not None:
                a = max(lo, 0)
                text = whole[a:hi]
                # no alignment can match more words than the two share
                if np.isin(text, item).sum() >= least * m:
                    score, end = align(item, text)
                    best = max(best, (score / (MATCH * m), a, a + end))
            if s is not None:
                lo, hi = s - slack, s + m + slack
        if best[0] >= least:
            yield r, i, best


def _blocks(benchmark: DataFrame):
    """The benchmark in blocks of bounded size, as lists of (item_id, text), in a stable order."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    many = max(1, math.ceil(size / BLOCK_CHARS))
    for k in range(many):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(many)) == k).orderBy("item_id", "text").collect()
        if part:
            yield [r[0] for r in part], [r[1] for r in part]


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, start, end): documents that hold a copy of an item.

    ``score`` is the alignment's score as a share of a perfect one; every row
    and item with ``least`` or more is given, the best place of each, with its
    word bounds (one word alone is no copy of an item of two).  Items and texts
    without words give none; repeated rows of docs are each reported, repeated
    items each under their id; empty tables give none.  Other columns are
    ignored.
    """
    return _scan(docs, benchmark, least, "doc_id")


def _scan(docs: DataFrame, benchmark: DataFrame, least: float, key: str) -> DataFrame:
    """What ``contaminated`` gives, with column ``key`` of docs for doc_id."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType),
                           T.StructField("item_id", benchmark.schema["item_id"].dataType),
                           T.StructField("score", T.DoubleType()), T.StructField("start", T.LongType()),
                           T.StructField("end", T.LongType())])
    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[
        benchmark.schema["item_id"].dataType.simpleString()]
    source = docs.select(key, "text")
    out = spark.createDataFrame([], schema)
    for ids, texts in _blocks(benchmark):
        items = Items(ids, texts, least)
        sent = spark.sparkContext.broadcast(items)

        def count(batches, sent=sent):
            known = sent.value.known
            totals = {kind: np.zeros(len(k.sorted), np.int64) for kind, k in known.items() if len(k.sorted)}
            for b in words.slices(batches, "text"):
                h, first = words.hashed(b.column("text"), words.ALNUM)
                for kind in totals:
                    k = known[kind]
                    totals[kind] += np.bincount(k.where(_KINDS[kind](h, first)[0])[1], minlength=len(k.sorted))
            for kind, total in totals.items():
                at = np.flatnonzero(total)
                yield pa.record_batch([pa.array([kind] * len(at), pa.string()),
                                       pa.array(known[kind].sorted[at].view(np.int64)), pa.array(total[at])],
                                      names=["kind", "gram", "times"])

        counted = source.select("text").mapInArrow(count, "kind string, gram long, times long")
        rows = counted.groupBy("kind", "gram").agg(F.sum("times").alias("times")).toArrow()  # of the block's own pairs
        kinds, gram = np.array(rows["kind"].to_pylist(), object), rows["gram"].to_numpy().view(U)
        counts = {}
        for kind, k in items.known.items():
            counts[kind] = np.zeros(len(k.sorted), np.int64)
            counts[kind][np.searchsorted(k.sorted, gram[kinds == kind])] = rows["times"].to_numpy()[kinds == kind]
        items.choose(counts)
        seeded = spark.sparkContext.broadcast(items)

        def scan(batches, seeded=seeded):
            items = seeded.value
            for b in words.slices(batches, "text"):
                h, first = words.hashed(b.column("text"), words.ALNUM)
                rows = [(r, items.ids[i], *best) for r, i, best in _found(items, h, first, least)]
                if rows:
                    r, item, score, start, end = zip(*rows)
                    yield pa.record_batch([b.column(key).take(pa.array(r)), pa.array(item, item_type),
                                           pa.array(score), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                                          names=schema.names)

        out = out.union(source.mapInArrow(scan, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the rows whose text holds a copy of an item; other texts under the same doc_id stay."""
    keyed = docs.withColumn("_row", row_key())
    bad = _scan(keyed, benchmark, least, "_row").select(F.col("_row").alias("_bad")).distinct()
    return keyed.join(bad, F.col("_row") == F.col("_bad"), "left_anti").select(*docs.columns)
