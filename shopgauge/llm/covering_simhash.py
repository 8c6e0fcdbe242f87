"""SimHash near-duplicates with covering locality-sensitive hashing.

A text's fingerprint has a bit for each position that is set in more than
half of its shingles' 64-bit hashes.  Fingerprints within ``radius`` bits are
found without missing any pair: every bit position gets a random vector over
GF(2) of radius + 1 bits, and each of the 2^(radius+1) - 1 nonzero vectors w
keeps the positions whose vector has an odd product with w.  For any radius
positions some w keeps none of them, so two fingerprints that differ only
there agree under that mask and meet in that table.

A bucket of one table is never gathered whole: its fingerprints are dealt
into blocks of bounded size, and pairs of blocks are compared in separate
tasks, each giving a spanning forest of the links it finds instead of all of
them.  Components of the forests are those of the full link set.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_and_reload
from . import words
from .components import components
from .rows import row_key
from .xxh import xxh64

#: Fingerprints compared at once in one task.
BLOCK = 2048


def _bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i:i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprints(column: pa.Array, shingle: int = 4) -> np.ndarray:
    """The 64-bit fingerprint of each text of an Arrow column."""
    raw, offs = words.text_buffers(column)
    starts, ends, first = words.spans(raw, offs, words.SPACED[0])
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    # the words of all texts, each followed by one space
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(to[-1], 32, np.uint8)
    inside = np.repeat(starts - to[:-1], size + 1) + np.arange(to[-1])
    gaps = np.zeros(to[-1], bool)
    gaps[to[1:] - 1] = True
    joined[~gaps] = lower[raw[inside[~gaps]]]
    # shingle i of a text covers words i .. i + k - 1, or all of them in a short text
    n = np.diff(first)
    many = np.maximum(n - shingle + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(n)), many)
    head = first[:-1][row] + np.arange(bounds[-1]) - bounds[row]
    tail = np.minimum(head + shingle, first[1:][row])
    h = xxh64(joined, to[head], to[tail] - 1) if len(head) else np.zeros(0, np.uint64)
    out = np.zeros(len(n), np.uint64)
    for i in np.flatnonzero(many):
        part = h[bounds[i]:bounds[i + 1]]
        out[i] = np.packbits(_bits(part) * 2 > len(part), bitorder="little").view("<u8")[0]
    return out


def fingerprint_table(docs: DataFrame, shingle: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and fp, the fingerprint's 64 bits as a bigint, for every row of docs."""
    def run(batches):
        words.take_turn("simhash")
        for b in words.slices(batches, "text", 1 << 20):
            fp = fingerprints(b.column("text"), shingle).view(np.int64)
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(fp)], names=[*keep, "fp"])

    schema = T.StructType([docs.schema[c] for c in keep]).add("fp", T.LongType())
    return docs.select(*keep, "text").mapInArrow(run, schema)


def masks(radius: int, seed: int = 8) -> list[int]:
    """The covering masks of 64-bit values: 2^(radius+1) - 1 of them, as signed integers."""
    if radius == 0:
        return [-1]
    m = np.random.default_rng(seed).integers(1, 2 ** (radius + 1), 64)
    out = []
    for w in range(1, 2 ** (radius + 1)):
        odd = np.array([bin(int(x) & w).count("1") & 1 for x in m], np.uint8)
        out.append(int(np.packbits(odd, bitorder="little").view("<i8")[0]))
    return out


def _forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between a and b (within a, where same)."""
    nodes = a if same else np.concatenate([a, b])
    rank = {}
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    shift = 0 if same else len(a)
    ua, ub = a.view(np.uint64), b.view(np.uint64)
    for i in range(len(a)):
        lo = i + 1 if same else 0
        for j in (np.flatnonzero(np.bitwise_count(ua[i] ^ ub[lo:]) <= radius) + lo + shift).tolist():
            x, y = root(i), root(j)
            if x != y:
                if rank.get(x, 0) < rank.get(y, 0):
                    x, y = y, x
                parent[y] = x
                rank[x] = rank.get(x, 0) + 1
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect what the full link set connects.

    ``prints`` has one row per distinct fp.  Every link lies within a
    component of the result and no link is longer than ``radius`` bits.
    """
    table = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                for k, m in enumerate(masks(radius))])).alias("x")
    rows = prints.select("fp", table).select("fp", "x.t", "x.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    # never broadcast: Spark sizes both sides as the fingerprints' file, without the explode's fan-out
    rows = rows.hint("merge").join(sizes, ["t", "key"])
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    pairs = (rows.select("t", "key", "fp", block.alias("mine"), other)
             .select("t", "key", "fp", "mine", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j")))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        fp, mine = pdf["fp"].to_numpy(), pdf["mine"].to_numpy()
        if i == j:
            found = _forest(np.sort(fp), np.sort(fp), radius, True)
        else:
            found = _forest(np.sort(fp[mine == i]), np.sort(fp[mine == j]), radius, False)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return pairs.groupBy("t", "key", "i", "j").applyInPandas(compare, "a long, b long")


def _labelled(prints: DataFrame, radius: int, least) -> DataFrame:
    """(fp, component, least): each distinct fingerprint, its group's, and the smallest ``least`` of its rows."""
    distinct = prints.groupBy("fp").agg(F.min(least).alias("least"))
    found = components(links(distinct.select("fp"), radius))
    return distinct.join(found, distinct.fp == found.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``radius`` bits.  Null and empty texts have fingerprint zero and link as
    any other; equal rows stay equal rows; a null doc_id joins its group but
    never names it unless the whole group has null ids; an empty table gives
    none.  Other columns of docs are not read.
    """
    prints = write_and_reload(fingerprint_table(docs, shingle), "simhash")
    labelled = _labelled(prints, radius, F.col("doc_id"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = labelled.join(smallest, "component").select("fp", "component_id")
    # every fp has a component; an outer join cannot broadcast the rows of prints, whose file hides repeats
    return prints.join(by_print, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest doc_id (null is the largest).

    Of several texts under that doc_id in one group the one with the smallest
    hash stays, and one row of those equal in both.  Groups of different texts
    each keep a row, also where they share a doc_id or have none.  Columns are
    those of docs.
    """
    keyed = docs.withColumn("_row", row_key())
    prints = write_and_reload(fingerprint_table(keyed, shingle, ("doc_id", "_row")), "simhash")
    labelled = _labelled(prints, radius, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    first = labelled.groupBy("component").agg(F.min("least")["_row"].alias("_keep"))
    copies = prints.groupBy(F.col("_row").alias("_keep")).agg(F.count(F.lit(1)).alias("_copies"))
    # never broadcast: Spark takes the 64 characters of a row's hash for 20
    first = write_and_reload(first.hint("merge").join(copies, "_keep").select("_keep", "_copies"), "simhash-keep")
    # the ids are hashed, so texts pass the join once and are not sorted; only rows that repeat are grouped
    kept = keyed.join(first.hint("shuffle_hash"), F.col("_row") == F.col("_keep"))
    if first.where("_copies > 1").isEmpty():
        return kept.select(*docs.columns)
    kept = write_and_reload(kept.drop("_keep"), "simhash-kept")
    once = kept.where("_copies = 1")
    return once.unionByName(kept.where("_copies > 1").dropDuplicates(["_row"])).select(*docs.columns)
