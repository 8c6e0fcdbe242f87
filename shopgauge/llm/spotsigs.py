"""SpotSigs fingerprints and the near-duplicate join over them.

A spot is a common word (an anchor); its signature is the anchor with the
chain of content words that follow it.  A text's fingerprint is the set of
its signatures.  Sets are partitioned by their size so that sets whose sizes
alone rule out the wanted Jaccard likeness never meet, and within partitions
an index of the rarest signatures of each set finds the pairs to compare.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_and_reload
from . import words
from .components import components
from .words import U

# fixed values: anchors, the commonest function words of the languages at hand
ANCHORS = ("the a an is was are be this der die das ist ein eine von le la les un une est que el los las y con").split()
# fixed values: words that are no content words, beside the anchors
STOP = ("of and to in it for on as with by at from that he or und den dem des mit zu im auf für nicht als et en de du "
        "des dans qui par pour sur au aux se del al por para").split()
#: Content words in a chain, and the step between them.
CHAIN, STEP = 3, 1
#: A text with fewer than one anchor to so many words takes every word for one.
SPARSE = 20


def _set_of(names) -> np.ndarray:
    return np.sort(np.array([words.hash_of(w) for w in set(names)], U))


_ANCHOR, _STOP = _set_of(ANCHORS), _set_of([*ANCHORS, *STOP])


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    # a table of the low bits first: nearly every word is in neither list
    table = np.zeros(1 << 16, bool)
    table[(among & U(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(values & U(0xFFFF)).astype(np.int64)])
    out = np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values[maybe]), len(among) - 1)
    out[maybe] = among[at] == values[maybe]
    return out


def signatures(column: pa.Array) -> list[np.ndarray]:
    """The fingerprint of each text: its distinct signatures, rising.

    A text with few anchors for its length (``SPARSE``), or none, takes every word for one, so
    that a few borrowed words don't stand for a long text in another language
    and only texts without words (and nulls) have an empty fingerprint.  A
    chain cut short by the end of the text counts as it is.
    """
    h, first = words.hashed(column, words.ALNUM)
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    content = ~_member(h, _STOP)
    anchor = _member(h, _ANCHOR)
    enough = words.group_sums(anchor, first) * SPARSE >= np.maximum(np.diff(first), 1)
    anchor |= ~enough[row] if len(row) else False
    after = np.concatenate([[0], np.cumsum(content)])
    chain, chain_row = h[content], row[content]
    at = np.flatnonzero(anchor)
    parts = [h[at]]
    for k in range(CHAIN):
        pos = after[at + 1] + k * STEP
        inside = pos < len(chain)
        pos = np.minimum(pos, max(len(chain) - 1, 0))
        if len(chain):
            inside &= chain_row[pos] == row[at]
            parts.append(np.where(inside, chain[pos], U(0)))
        else:
            parts.append(np.zeros(len(at), U))
    sigs = words.join_hashes(*parts) if len(at) else np.zeros(0, U)
    keys, bounds, _ = words.distinct_per_row(sigs, np.searchsorted(row[at], np.arange(n + 1)))
    return [keys[bounds[i]:bounds[i + 1]] for i in range(n)]


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two fingerprints; 0 where their sizes alone put it under ``least``."""
    if not len(a) and not len(b):
        return 1.0
    small, large = sorted((len(a), len(b)))
    if not small or small < least * large:
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)


def text_form(sigs: np.ndarray) -> str:
    """A fingerprint as text: 16 hex digits for each signature, rising."""
    return sigs.astype(">u8").tobytes().hex()


# ---- each text, its edited copy and the text after it ----------------------------

def _compare(ids, texts, nexts):
    """Columns for texts and the texts after them."""
    edited = []
    for t, n in zip(texts, nexts):
        half = len(t) // 2
        edited.append(t[:len(t) - half] + n[:half])
    own = signatures(pa.array(texts, pa.string()))
    changed = signatures(pa.array(edited, pa.string()))
    following = signatures(pa.array(nexts, pa.string()))
    return pa.record_batch([
        ids, pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array([text_form(s) for s in own]), pa.array([text_form(s) for s in changed]),
        pa.array([likeness(a, b) for a, b in zip(own, changed)]),
        pa.array([likeness(a, b) for a, b in zip(own, following)])],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _walk(batches):
    """Rows sorted by bucket and place; the last of a bucket is followed by its guard rows."""
    bucket, ids, texts, guard = None, None, [], False
    id_type = None

    def emit(nexts):
        return _compare(pa.array(ids, id_type), texts, nexts)

    for b in words.slices(batches, "text", 1 << 20):
        id_type = b.schema.field("doc_id").type
        for bk, i, t, g in zip(*(b.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "guard"))):
            t = t or ""
            if bk != bucket:
                bucket, ids, texts, guard = bk, [], [], False
            if guard:
                continue
            if g:
                if texts:
                    yield emit([*texts[1:], t])
                ids, texts, guard = [], [], True
                continue
            ids.append(i)
            texts.append(t)
            if len(texts) > 1 and sum(map(len, texts)) > words.SLICE:
                last_id, last = ids.pop(), texts.pop()
                yield emit([*texts[1:], last])
                ids, texts = [last_id], [last]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited copy, and their likeness.

    Documents stand by descending doc_id (null last, equal ids by the
    SHA-256 of the text); the last is followed by the first, and a lone one by
    itself.  The edited copy has the last floor(n_chars / 2) code points
    replaced by the first as many of the next text.  Null texts are empty;
    equal rows each have their row; an empty table has none.

    doc_id is a number.  The order is cut into buckets of about equal count at its quantiles;
    each bucket also gets a copy of the row after its last (its guard), so
    that texts are shuffled once and no task needs its neighbour.  Rows of
    one doc_id share a bucket.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    many = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.select(F.percentile_approx("doc_id", [k / many for k in range(1, many)], 10 * many)).first()[0] or []
    bucket = _bucket(docs, sorted({float(c) for c in cuts}))
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).transform(bucket)
    heads = ids.transform(bucket).groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()
    # the first row of each bucket guards the one before it, and the very first the last: as many rows as buckets
    kind = T.StructType([T.StructField("head", docs.schema["doc_id"].dataType), T.StructField("to", T.IntegerType())])
    before = spark.createDataFrame([(h["head"], heads[k - 1]["bucket"]) for k, h in enumerate(heads)], kind)
    guards = placed.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("head"))).select(
        "doc_id", "text", F.col("to").alias("bucket"), F.lit(True).alias("guard"))
    rows = placed.select("doc_id", "text", "bucket", F.lit(False).alias("guard")).union(guards)
    dealt = rows.repartition("bucket").sortWithinPartitions(
        "bucket", "guard", F.col("doc_id").desc_nulls_last(), F.sha2(F.col("text").cast("binary"), 256))
    return dealt.select("bucket", "guard", "doc_id", "text").mapInArrow(_walk, _schema(docs))


def _bucket(docs: DataFrame, cuts: list[float]):
    """Adds ``bucket``: rising as doc_id falls, nulls last.  Rows of one doc_id share a bucket."""
    place = F.col("doc_id").cast("double")

    def add(rows: DataFrame) -> DataFrame:
        splits = [-math.inf, *cuts, math.inf] if cuts else [-math.inf, 0.0, math.inf]
        rows = rows.withColumn("_place", place)
        cut = Bucketizer(splits=splits, inputCol="_place", outputCol="_cut", handleInvalid="keep").transform(rows)
        return cut.withColumn("bucket", F.when(place.isNull(), F.lit(len(splits))).otherwise(
            F.lit(len(splits)) - F.col("_cut")).cast("int")).drop("_place", "_cut")

    return add


def _schema(docs: DataFrame) -> T.StructType:
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_chars", T.LongType())])
    for c in ("edited_sha256", "fingerprint", "edited_fingerprint"):
        out = out.add(c, T.StringType())
    return out.add("near_edited", T.DoubleType()).add("near_next", T.DoubleType())


# ---- near-duplicate join -----------------------------------------------------------

def fingerprint_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, sigs, class): each row's signatures as an array of bigint, and the SHA-256 of the set."""
    def run(batches):
        for b in words.slices(batches, "text", 1 << 20):
            sets = signatures(b.column("text"))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, U)]).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(offsets, flat),
                                   pa.array([hashlib.sha256(s.tobytes()).hexdigest() for s in sets])],
                                  names=["doc_id", "sigs", "class"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           T.StructField("sigs", T.ArrayType(T.LongType())), T.StructField("class", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def length_partition(size: Column, least: float) -> Column:
    """Partitions of set sizes: sets of likeness ``least`` or more lie in one or in two adjoining ones."""
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(least)) + F.lit(1e-9)).cast("int")


def near_duplicates(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of the near-duplicate join at Jaccard likeness ``least`` or more.

    members: doc_id, class (equal fingerprints) and component_id (smallest
    doc_id of those connected), one row for each row of docs.  pairs: (a, b,
    likeness) for all linked pairs of classes, a < b.  Empty fingerprints are
    one class without pairs.
    """
    sets = write_and_reload(fingerprint_sets(docs), "spotsigs")
    classes = sets.groupBy("class").agg(F.min("doc_id").alias("least"), F.first("sigs").alias("sigs"))
    classes = write_and_reload(classes.withColumn("size", F.size("sigs")).where("size > 0"), "spotsigs")
    # in any one order of signatures, two such sets share one among the first size - ceil(least * size) + 1
    count = classes.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("n"))
    ranked = (classes.select("class", "size", F.explode("sigs").alias("sig")).join(count, "sig")
              .groupBy("class", "size").agg(F.sort_array(F.collect_list(F.struct("n", "sig"))).alias("order")))
    head = F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1
    part = length_partition(F.col("size"), least)
    index = ranked.select("class", "size", part.alias("part"),
                          F.explode(F.slice("order", F.lit(1), head.cast("int"))).alias("x")).select(
        "class", "size", "part", F.col("x.sig").alias("sig"), F.col("x.n").alias("n")).where("n > 1")
    left = index.select(F.col("class").alias("a"), F.col("size").alias("sa"),
                        F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("part").alias("pa"), "sig")
    right = index.select(F.col("class").alias("b"), F.col("size").alias("sb"), "part", "sig")
    close = (F.least("sa", "sb") >= F.greatest("sa", "sb") * least - 1e-9)
    once = (F.col("pa") < F.col("part")) | (F.col("a") < F.col("b"))
    pairs = left.join(right, ["part", "sig"]).where(close & once).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = classes.select(F.col("class").alias("a"), F.col("sigs").alias("x"))
    two = classes.select(F.col("class").alias("b"), F.col("sigs").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    pairs = (pairs.join(one, "a").join(two, "b")
             .select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("likeness"))
             .where(F.col("likeness") >= least - 1e-12))
    pairs = write_and_reload(pairs, "spotsigs")
    found = components(pairs.select("a", "b"))
    by_class = sets.groupBy("class").agg(F.min("doc_id").alias("least")).join(
        found, F.col("class") == F.col("node"), "left").withColumn("component", F.coalesce("component", "class"))
    smallest = by_class.groupBy("component").agg(F.min("least").alias("component_id"))
    names = by_class.join(smallest, "component").select("class", "component_id")
    return sets.select("doc_id", "class").join(names, "class"), pairs
