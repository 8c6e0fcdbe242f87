"""Toxicity scores from a factorization machine over hashed terms.

A text's features are the hashes of its distinct words and of the beginnings
of its longer words.  The score is the sigmoid of a bias, a weight for each
feature and the inner products of the features' factor vectors, pair by pair:
a pair of terms can count for more (or less) than its parts.  The sum over all
pairs is linear in the number of features, since it is half the difference
between the squared sum and the sum of squares of each factor.

The model has a fixed size.  It is fitted on a bounded sample of the labelled
rows, and every text is scored in its own task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_and_reload
from . import words
from .words import U

#: Labelled rows that the model is fitted on, at most; picked by the hash of their doc_id.
SAMPLE = 20_000
#: Bytes of their terms (four for each) at most.
SAMPLE_BYTES = 1 << 28
#: Hash buckets are 2^BITS; factors of each bucket.
BITS, FACTORS = 18, 4
#: Beginnings of words that are terms too, in bytes.
PREFIXES = (5, 6, 7)


@dataclass
class Model:
    bias: float
    weight: np.ndarray    # (2^BITS,)
    factor: np.ndarray    # (2^BITS, FACTORS)

    def raw(self, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The score before the sigmoid of each row of terms."""
        linear = words.group_sums(self.weight[terms], first)
        pairs = np.zeros(len(first) - 1)
        for f in range(self.factor.shape[1]):
            v = self.factor[terms, f].astype(np.float64)
            pairs += words.group_sums(v, first) ** 2 - words.group_sums(v * v, first)
        return self.bias + linear + pairs / 2


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text, and the bounds of the texts."""
    raw, offs = words.text_buffers(column)
    keep, values = words.ALNUM
    starts, ends, first = words.spans(raw, offs, keep)
    found = [words.hash_spans(raw, values, starts, ends)]
    rows = [np.repeat(np.arange(len(first) - 1), np.diff(first))]
    for n in PREFIXES:
        longer = ends - starts > n
        s = starts[longer]
        found.append(words.mix(words.hash_spans(raw, values, s, s + n) + U(n)))
        rows.append(rows[0][longer])
    key = (np.concatenate(rows).astype(U) << U(BITS)) | (np.concatenate(found) >> U(64 - BITS))
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    row = (key >> U(BITS)).astype(np.int64)
    return (key & U((1 << BITS) - 1)).astype(np.int32), np.searchsorted(row, np.arange(len(first)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 6, rate: float = 0.3, batch: int = 64,
        sparse: float = 8.0, decay: float = 1e-3, weigh: float = 5.0, seed: int = 7) -> Model:
    """A factorization machine for log loss, over small batches in a fixed order.

    Weights follow the regularised leader with an L1 term (``sparse``), so
    terms without steady evidence keep weight zero; factors take AdaGrad steps
    where their term has a weight.  Rows of label 1 count ``weigh`` times.  Terms of fewer than three rows have no
    weight.  Without rows of both labels the score is the share of label 1 for
    every text.
    """
    size = 1 << BITS
    y = np.asarray(labels, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, FACTORS), np.float32))
    if not len(y) or y.min() == y.max():
        return model
    seen = np.bincount(np.concatenate([*rows, np.zeros(0, np.int32)]), minlength=size)
    used = seen >= 3
    rng = np.random.default_rng(seed)
    start = rng.normal(0, 0.01, (size, FACTORS))
    z, n, gv, gb = np.zeros(size), np.zeros(size), np.full((size, FACTORS), 1e-3), 1.0
    rows = [r[used[r]] for r in rows]
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            some = order[lo:lo + batch]
            t = np.concatenate([rows[i] for i in some])
            first = np.concatenate([[0], np.cumsum([len(rows[i]) for i in some])])
            row = np.repeat(np.arange(len(some)), np.diff(first))
            error = sigmoid(model.raw(t, first)) - y[some]
            error = np.where(y[some] > 0, weigh, 1.0) * error
            gb += error.sum() ** 2
            model.bias -= rate * error.sum() / np.sqrt(gb)
            u, slot = np.unique(t, return_inverse=True)
            e = error[row]
            g = np.bincount(slot, e, len(u))
            more = n[u] + g * g
            z[u] += g - (np.sqrt(more) - np.sqrt(n[u])) / rate * model.weight[u]
            n[u] = more
            model.weight[u] = np.where(np.abs(z[u]) <= sparse, 0.0,
                                       -(z[u] - np.sign(z[u]) * sparse) / ((1 + np.sqrt(n[u])) / rate + 1))
            fresh = u[(model.weight[u] != 0) & (model.factor[u, 0] == 0)]
            model.factor[fresh] = start[fresh]
            live = model.weight[u] != 0
            for f in range(FACTORS):
                v = model.factor[t, f].astype(float)
                g = np.bincount(slot, e * (words.group_sums(v, first)[row] - v), len(u)) + decay * model.factor[u, f]
                gv[u, f] += g * g
                model.factor[u, f] = np.where(live, model.factor[u, f] - 0.02 * g / np.sqrt(gv[u, f]), 0)
    model.factor = model.factor.astype(np.float32)
    return model


def learn(docs: DataFrame, labels: DataFrame, held_out: int = 5, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits the model on labelled documents whose crc32(doc_id as text) mod ``held_out`` is not 0.

    Of more than ``sample`` such label rows those with the smallest hash of
    doc_id are taken, so the sample does not depend on order or partitions.
    Rows with a null label or doc_id are left out.  Of several texts under a
    doc_id the one whose terms sort first counts, once.  The sample ends, in
    the same order, where its terms take ``most_bytes``.
    """
    kept = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    kept = kept.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out != 0)
    some = kept.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)

    def run(batches):
        for b in words.slices(batches, "text"):
            t, first = terms(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), b.column("toxic"),
                                   pa.array([t[first[i]:first[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())],
                                  names=["doc_id", "toxic", "terms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # ``some`` is at most ``sample`` rows of two numbers; copies of a document combine before they are moved
    found = (docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic")
             .mapInArrow(run, f"doc_id {kind}, toxic int, terms binary")
             .groupBy("doc_id", "toxic").agg(F.min("terms").alias("terms")))
    found = write_and_reload(found, "toxicity-sample")
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").rowsBetween(Window.unboundedPreceding, 0)
    fits = (found.select("doc_id", "toxic", F.length("terms").alias("size"))  # at most ``sample`` rows
            .withColumn("upto", F.sum("size").over(upto)).where(F.col("upto") <= most_bytes))
    rows = found.join(F.broadcast(fits.select("doc_id", "toxic")), ["doc_id", "toxic"]).toPandas()
    rows = rows.sort_values(["doc_id", "toxic"], kind="stable")
    return fit([np.frombuffer(x, np.int32) for x in rows["terms"]], rows["toxic"].to_numpy(float))


def score(docs: DataFrame, model: Model, held_out: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Null and empty texts have no terms and get the model's bias; repeated rows
    are each scored; an empty table gives none; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in words.slices(batches, "text"):
            t, first = terms(b.column("text"))
            s = sigmoid(sent.value.raw(t, first))
            yield pa.record_batch([b.column("doc_id"), b.column("held"), pa.array(s),
                                   pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % held_out == 0
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])
    return docs.select("doc_id", "text", held.alias("held")).mapInArrow(run, schema)
