"""Scores texts with a deleted-interpolation bigram model learned from the same table.

A token's probability mixes the maximum-likelihood estimates of its bigram
and of its word with the uniform one; the mixture weights depend on how often
the context was seen (a bucket for each power of two) and are learned by
expectation-maximisation on counts held out from the estimates.

All counting and looking up is a shuffle between blocks of documents and
ranges of the key space:

1. documents are packed into blocks, written once to the shared folder;
2. each block sends its distinct word and bigram keys, with their training
   counts, to the parts of the key space they hash to.  A frequent key is one
   entry of each block, however often it occurs;
3. each part sums the counts over all blocks and answers every block with
   the totals of the keys it sent;
4. each block meets its answers and scores its documents.

Parts grow in number with the input, so a part and a block have a bounded size.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_and_reload
from . import words
from .words import U

#: Bytes of text in a block of documents, unless one text is longer.
BLOCK_BYTES = 4 << 20
#: Bytes of text for each part of the key space.
PART_BYTES = 8 << 20
#: Steps of a power of two in the held-out histogram.
GRID = 4
_END, _START = U(0xE4D0F7E27), U(0x57A27)
_BIGRAM = U(1) << U(62)
_ZSTD = pa.Codec("zstd", compression_level=1)
_BLOCK_COLS = "block string, em long, n_bytes long, docs binary"
_CELL_COLS = "part long, block string, em boolean, n long, keys binary, counts binary"
_ANSWER_COLS = "block string, part long, n long, counts binary, n_tokens long, n_words long, em_tokens long, em_words long"


# ---- packing ----------------------------------------------------------------

def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, bytes of equal weight together, compressed."""
    wide = values.astype("<u8" if values.dtype.itemsize == 8 else "<u4")
    planes = wide.view(np.uint8).reshape(len(wide), -1).T.tobytes()
    return len(planes).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def _unpack(raw: bytes, width: int) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(_ZSTD.decompress(raw[8:], size, asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel()


def _block(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _open(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_all().combine_chunks().to_batches()[0]


def _pack_blocks(batches):
    """Documents in blocks; those whose counts are held out have blocks of their own."""
    held: dict[bool, list] = {True: [], False: []}
    size = {True: 0, False: 0}

    def flush(em):
        table = pa.Table.from_batches(held[em]).combine_chunks().to_batches()[0]
        row = [uuid.uuid4().hex], [int(em)], [size[em]], [_block(table)]
        held[em], size[em] = [], 0
        return pa.record_batch([pa.array(x) for x in row], names=["block", "em", "n_bytes", "docs"])

    for batch in words.slices(batches, "text"):
        fold = batch.column("fold").to_numpy(zero_copy_only=False)
        for em in (True, False):
            part = batch.filter(pa.array((fold == 1) == em))
            if part.num_rows:
                held[em].append(part)
                size[em] += len(words.text_buffers(part.column("text"))[0])
                if size[em] >= BLOCK_BYTES:
                    yield flush(em)
    for em in (True, False):
        if held[em]:
            yield flush(em)


# ---- keys -------------------------------------------------------------------

def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a block (words, then one end for each text), text bounds, and each token's context."""
    h, first = words.hashed(batch.column("text"))
    n = len(first) - 1
    bounds = first + np.arange(n + 1)
    tokens = np.empty(len(h) + n, U)
    ends = bounds[1:] - 1
    mask = np.ones(len(tokens), bool)
    mask[ends] = False
    tokens[mask] = h
    tokens[ends] = _END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = _START
    return tokens, bounds, before


def _keys(tokens, before) -> tuple[np.ndarray, np.ndarray]:
    word = words.mix(tokens) >> U(2)
    pair = (words.join_hashes(before, tokens) >> U(2)) | _BIGRAM
    return word, pair


def _distinct(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order and the sum of their weights."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(weight[order], dtype=np.int64)])
    return k[at], np.diff(total[np.append(at, len(k))])


def _by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts rising keys by part, and the bounds of the parts."""
    part = (keys % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _send(parts: int):
    def run(batches):
        for batch in batches:
            for block, em, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "em", "docs"))):
                docs = _open(raw)
                tokens, bounds, before = _tokens(docs)
                fold = docs.column("fold").to_numpy(zero_copy_only=False)
                train = np.repeat((fold != 0).astype(np.int64), np.diff(bounds))
                word, pair = _keys(tokens, before)
                keys, counts = _distinct(np.concatenate([word, pair]), np.concatenate([train, train]))
                order, at = _by_part(keys, parts)
                keys, counts = keys[order] // U(parts), counts[order].astype(np.uint32)
                rows = [(p, block, em, int(at[p + 1] - at[p]), _pack(np.diff(keys[at[p]:at[p + 1]], prepend=U(0))),
                         _pack(counts[at[p]:at[p + 1]])) for p in range(parts) if at[p + 1] > at[p]]
                yield pa.record_batch([pa.array(c) for c in zip(*rows)],
                                      names=["part", "block", "em", "n", "keys", "counts"])
    return run


def _answer(parts: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        sizes = pdf["n"].to_numpy()
        keys = np.concatenate([np.cumsum(_unpack(x, 8), dtype=U) for x in pdf["keys"]])
        counts = np.concatenate([_unpack(x, 4) for x in pdf["counts"]]).astype(np.int64)
        em = np.repeat(pdf["em"].to_numpy(bool), sizes)
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        at = np.flatnonzero(new)
        total = np.add.reduceat(counts[order], at)
        kept = np.add.reduceat(np.where(em[order], 0, counts[order]), at)
        slot = np.empty(len(k), np.int64)
        slot[order] = np.cumsum(new) - 1
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        rows = []
        for i, (block, held) in enumerate(zip(pdf["block"], pdf["em"])):
            mine = slot[bounds[i]:bounds[i + 1]]
            got = np.concatenate([total[mine], kept[mine]]) if held else total[mine]
            rows.append((block, part, len(mine), _pack(got.astype(np.uint64)), 0, 0, 0, 0))
        is_word = (k[at] * U(parts) + U(part)) < _BIGRAM
        rows.append((None, part, 0, None, int(total[is_word].sum()), int((total[is_word] > 0).sum()),
                     int(kept[is_word].sum()), int((kept[is_word] > 0).sum())))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _ANSWER_COLS.split(", ")])
    return run


def _looked_up(docs: pa.RecordBatch, answers: pd.DataFrame, parts: int, held: bool):
    """Bounds of the texts, and for each token the counts of its word, context and bigram."""
    tokens, bounds, before = _tokens(docs)
    word, pair = _keys(tokens, before)
    keys = np.sort(np.concatenate([word, pair]))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    order, at = _by_part(keys, parts)
    values = np.zeros(len(keys), np.int64)
    for p, n, raw in zip(answers["part"], answers["n"], answers["counts"]):
        if n != at[p + 1] - at[p]:
            raise ValueError("a block and its answers differ")
        got = _unpack(raw, 8)
        values[order[at[p]:at[p + 1]]] = got[n:] if held else got[:n]
    starts = words.mix(np.array([_END])) >> U(2)
    # a text's first token follows the start, which occurs as often as the end
    of_context = words.mix(np.where(before == _START, _END, before)) >> U(2)
    assert starts[0] == word[bounds[1] - 1]
    take = lambda k: values[np.searchsorted(keys, k)]
    return bounds, take(word), take(of_context), take(pair)


# ---- the mixture --------------------------------------------------------------

def _bucket(context: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(context + 1.0)).astype(np.int64)


def _estimates(word, context, pair, n_tokens: int, n_words: int):
    bigram = pair / np.maximum(context, 1)
    unigram = word / max(n_tokens, 1)
    return bigram, unigram, 1.0 / (n_words + 1)


def _held_out(parts: int, n_tokens: int, n_words: int):
    """A block's held-out tokens, counted on a grid of bucket and rounded estimates."""
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        found = []
        for raw in blocks["docs"]:
            _, w, c, p = _looked_up(_open(raw), answers, parts, True)
            two, one, _ = _estimates(w, c, p, n_tokens, n_words)
            with np.errstate(divide="ignore"):
                q = [np.where(x > 0, np.rint(-GRID * np.log2(x)), -1).astype(np.int64) for x in (two, one)]
            cells, n = np.unique(np.stack([_bucket(c), *q]), axis=1, return_counts=True)
            found.append(pd.DataFrame({"bucket": cells[0], "q2": cells[1], "q1": cells[2], "n": n}))
        return pd.concat(found) if found else pd.DataFrame(columns=["bucket", "q2", "q1", "n"], dtype="int64")
    return run


def learn_weights(cells: np.ndarray, floor: float, rounds: int = 40) -> np.ndarray:
    """Weights (bigram, word, uniform) for each of 64 buckets, by expectation-maximisation.

    ``cells`` has rows (bucket, q2, q1, n).  A bucket's weights are drawn
    towards those of all buckets by the weight of ten tokens, so buckets with
    nothing held out take the common ones.
    """
    weights = np.tile([0.4, 0.4, 0.2], (64, 1))
    if not len(cells):
        return weights
    bucket, n = cells[:, 0], cells[:, 3].astype(float)
    p = np.stack([np.where(q >= 0, 2.0 ** (-q / GRID), 0.0) for q in (cells[:, 1], cells[:, 2])]
                 + [np.full(len(cells), floor)], axis=1)
    for _ in range(rounds):
        part = weights[bucket] * p
        part *= (n / part.sum(axis=1))[:, None]
        mass = np.stack([np.bincount(bucket, part[:, k], 64) for k in range(3)], axis=1)
        common = mass.sum(axis=0) / mass.sum()
        weights = (mass + 10 * common) / (mass.sum(axis=1, keepdims=True) + 10)
        weights = np.maximum(weights, 1e-9)
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


def _scores(parts: int, n_tokens: int, n_words: int, weights: np.ndarray, smooth: float):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        found = []
        for raw in blocks["docs"]:
            docs = _open(raw)
            bounds, w, c, p = _looked_up(docs, answers, parts, False)
            two, one, rest = _estimates(w, c, p, n_tokens, n_words)
            mix = weights[_bucket(c)]
            logs = np.log10(mix[:, 0] * two + mix[:, 1] * one + mix[:, 2] * rest)
            base = np.log10((w + smooth) / (n_tokens + smooth * (n_words + 1)))
            found.append(pd.DataFrame({
                "doc_id": docs.column("doc_id").to_pandas(), "held_out": docs.column("fold").to_numpy() == 0,
                "n_tokens": np.diff(bounds), "n_known": words.group_sums(w > 0, bounds).astype(np.int64),
                "train_tokens": n_tokens, "base_score": np.add.reduceat(base, bounds[:-1]),
                "score": np.add.reduceat(logs, bounds[:-1])}))
        return pd.concat(found)
    return run


def score(docs: DataFrame, smooth: float = 0.1) -> DataFrame:
    """One row for each row of docs (doc_id, text): the model's log10 probability of the text.

    Rows whose crc32(doc_id as text) mod 10 is 0 are scored only; the
    model's estimates come from all others, and its weights from estimates
    without remainder 1 and the counts of remainder 1.  Tokens are the words
    and one end; null texts are empty; a null doc_id counts as empty text and
    stays null; repeated rows are all counted and all scored; an empty table
    gives no row; without training text every token has probability one.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (add-``smooth`` word model) and score.
    """
    spark = docs.sparkSession
    id_sql = docs.schema["doc_id"].dataType.simpleString()
    fold = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10).cast("int")
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), fold.alias("fold"))
    blocks = write_and_reload(source.mapInArrow(_pack_blocks, _BLOCK_COLS), "lm-blocks", ["em"])
    blocks = blocks.withColumn("em", F.col("em").cast("int") == 1)
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))

    cells = blocks.select("block", "em", "docs").mapInArrow(_send(parts), _CELL_COLS)
    answers = write_and_reload(cells.groupBy("part").applyInPandas(_answer(parts), _ANSWER_COLS), "lm-counts")
    n_tokens, n_words, em_tokens, em_words = (int(x or 0) for x in answers.where("block is null").agg(
        *(F.sum(c) for c in ("n_tokens", "n_words", "em_tokens", "em_words"))).first())
    replies = answers.where("block is not null").select("block", "part", "n", "counts")

    def meet(some: DataFrame, fn, schema: str) -> DataFrame:
        return (some.select("block", "docs").groupBy("block").cogroup(
            replies.join(some.select("block"), "block", "left_semi").groupBy("block")).applyInPandas(fn, schema))

    grid = meet(blocks.where("em"), _held_out(parts, em_tokens, em_words), "bucket long, q2 long, q1 long, n long")
    cells = np.array([tuple(r) for r in grid.groupBy("bucket", "q2", "q1").agg(F.sum("n")).collect()],
                     dtype=np.int64).reshape(-1, 4)
    weights = learn_weights(cells, 1.0 / (em_words + 1))
    out = ("doc_id " + id_sql + ", held_out boolean, n_tokens long, n_known long, train_tokens long, "
           "base_score double, score double")
    return (blocks.select("block", "docs").groupBy("block").cogroup(replies.groupBy("block"))
            .applyInPandas(_scores(parts, n_tokens, n_words, weights, smooth), out))
