"""Byte-level BPE with a hierarchical-bitmap rank queue.

Waiting pairs of a pre-token lie in a bucket for each merge rank, as the
positions of their left symbols in a linked list.  A two-level bitmap over
the ranks tells the lowest non-empty bucket by find-first-set, so the next
merge costs a few bit operations however long the pre-token is.  Positions of
one bucket leave it from the left; an entry whose pair has changed since is
stale and skipped.  Only a pair that neither neighbour precedes waits: the
next merge always is one of these, and most others go before their turn.
"""

from __future__ import annotations

import base64
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import words

#: Space-separated chunks, and pre-tokens within them, that a Python worker remembers (twice that for a while).
REMEMBER = 300_000
#: Ids decoded at once, unless one text has more.
DECODE_IDS = 500_000
#: Rank of a pair that is no symbol, above all ranks.
NONE = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 symbol and its rank to a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Merges one byte string at a time by rising rank, leftmost first.

    ``low`` has a bit for each rank, 256 to a word, and ``top`` (held while a
    string is merged) a bit for each word that is not zero; both are empty
    between strings.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.low = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        # what every string asks for: the bit of a word, the id of a byte, the rank of a pair of bytes
        self.bits = [1 << k for k in range(max(256, len(self.low)))]
        self.one = [ranks.get(bytes([a])) for a in range(256)]
        self.two = [[ranks.get(bytes([a, b]), NONE) for b in range(256)] for a in range(256)]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        low, bits, two, top, buckets = self.low, self.bits, self.two, 0, {}
        n = len(piece)
        end = [*range(1, n + 1)]  # symbol at i is piece[i:end[i]]; the next one starts at end[i]
        before = [*range(-1, n)]
        ids = [self.one[a] for a in piece]  # id of the symbol at i
        pair = [two[a][b] for a, b in zip(piece, piece[1:])]  # rank of the pair that now starts at i
        pair += [NONE, NONE]  # pair[-1] is the neighbour of the first
        # a bucket is a position, or a heap of two or more
        prior = NONE
        for i in range(n - 1):
            rank = pair[i]
            if prior > rank <= pair[i + 1]:
                if rank in buckets:
                    self._push(buckets, rank, i)
                else:
                    buckets[rank] = i
                    word = rank >> 8
                    low[word] |= bits[rank & 255]
                    top |= bits[word]
            prior = rank
        while top:
            # find first set, twice: the lowest rank that has pairs
            word = (top & -top).bit_length() - 1
            held = low[word]
            bit = held & -held
            rank = word << 8 | bit.bit_length() - 1
            i = buckets[rank]
            if type(i) is int:
                del buckets[rank]
                low[word] = held = held ^ bit
                if not held:
                    top ^= bits[word]
            else:
                bucket, i = i, heappop(i)
                if len(bucket) == 1:
                    buckets[rank] = bucket[0]
            if pair[i] != rank:
                continue  # stale: one of the two symbols has grown or gone
            j, left = end[i], before[i]
            end[i] = stop = end[j]
            ids[i] = rank
            was, pair[j] = pair[j], NONE
            before[stop] = i
            pair[i] = after = get(piece[i:end[stop]], NONE) if stop < n else NONE
            # of the two changed pairs and their neighbours, those that now wait and did not before
            new = newer = -1
            prior = NONE
            if left >= 0:
                old, far = pair[left], before[left]
                pair[left] = prior = get(piece[left:stop], NONE)
                if pair[far] > prior <= after:
                    new = left
                elif old < pair[far] <= prior and pair[before[far]] > pair[far]:
                    new = far
            if stop < n:
                if prior > after <= pair[stop]:
                    newer = i
                elif was <= pair[stop] < after and pair[stop] <= pair[end[stop]]:
                    newer = stop
            for i in (new, newer):
                if i >= 0:
                    rank = pair[i]
                    if rank in buckets:
                        self._push(buckets, rank, i)
                    else:
                        buckets[rank] = i
                        word = rank >> 8
                        low[word] |= bits[rank & 255]
                        top |= bits[word]
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = end[i]
        return out

    @staticmethod
    def _push(buckets: dict, rank: int, at: int) -> None:
        bucket = buckets[rank]
        if type(bucket) is int:
            buckets[rank] = [bucket, at] if bucket < at else [at, bucket]
        else:
            heappush(bucket, at)


class _Memory(dict):
    """Remembered results, the older half forgotten when full; this changes no result."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= REMEMBER:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


class Encoder:
    """Encodes texts to packed 32-bit ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.queue = RankQueue(ranks)
        self.find = regex.compile(pattern).findall
        self.pieces = _Memory(lambda t: array("i", self.queue.encode(t.encode())).tobytes())
        self.chunks: dict[str, bytes | None] = {}  # None: white space at an end, so spaces do not part pre-tokens there
        self.older = self.chunks

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def _learn(self, wanted: set[str]) -> None:
        """Puts all wanted chunks into ``chunks``; the pattern runs once over all that are new."""
        if len(self.chunks) + len(wanted) > REMEMBER:
            self.older, self.chunks = self.chunks, {}
        have, older, new = self.chunks, self.older, []
        for c in wanted:  # not `wanted - have.keys()`, which walks all of `have`
            if c in have:
                continue
            if c in older:
                have[c] = older[c]
            elif not c or c[0].isspace() or c[-1].isspace():
                have[c] = None
            else:
                new.append(c)
        if not new:
            return
        found = self.find(" " + " ".join(new))
        starts = [i for i, t in enumerate(found) if t[0] == " "]
        starts.append(len(found))
        encode, piece, split = self.queue.encode, self.pieces, []
        for c, i, j in zip(new, starts, starts[1:]):
            if j == i + 1:
                have[c] = array("i", encode(found[i].encode())).tobytes()
            else:
                split.append((c, i, j))
        for c, i, j in split:  # the first pre-token often is a chunk of its own elsewhere
            head = found[i]
            word = head[1:]
            first = have.get(word) or older.get(word)
            if first is None:
                if word and not word[-1].isspace():
                    first = have[word] = array("i", encode(head.encode())).tobytes()
                else:
                    first = piece[head]
            have[c] = first + b"".join([piece[t] for t in found[i + 1:j]])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text.  Where every space is alone it opens the pre-token after it, so the
        chunks between spaces are encoded apart, and each kind of them once."""
        parts = [t.split(" ") for t in texts]
        wanted: set[str] = set()
        for p in parts:
            wanted.update(p)
        self._learn(wanted | {"."})
        get, out = self.chunks.__getitem__, []
        for text, p in zip(texts, parts):
            first, last = p[0], p[-1]
            if len(p) == 1 or first == "" or first[-1].isspace():
                out.append(self._whole(text))
                continue
            p[0] = p[-1] = "."
            ids = [*map(get, p)]
            ids[0] = self._whole(first)
            # white space before the end of a text parts nothing
            ids[-1] = None if last == "" or last[0].isspace() else self._whole(" " + last) if last[-1].isspace() else get(last)
            try:
                out.append(b"".join(ids))
            except TypeError:  # a None among them
                out.append(self._whole(text))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_of(path: str, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary; what it remembers lasts from task to task."""
    words.take_turn("bpe", forget)
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


_SYMBOLS: dict[str, list[bytes]] = {}


def forget() -> None:
    _ENCODERS.clear()
    _SYMBOLS.clear()


def symbols_of(path: str) -> list[bytes]:
    """The bytes of each id of a vocabulary, read once by a worker."""
    words.take_turn("bpe", forget)
    if path not in _SYMBOLS:
        ranks = read_ranks(path)
        out = [b""] * (max(ranks.values(), default=0) + 1)
        for raw, rank in ranks.items():
            out[rank] = raw
        _SYMBOLS[path] = out
    return _SYMBOLS[path]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with a column ``ids`` (array of int) in place of ``text``; null texts are empty.

    ``path`` names a rank file that every executor can read, ``pattern`` the
    regular expression whose matches are encoded apart.  Special tokens are
    ordinary text.  Other columns stay as they are, equal rows too; an empty
    table gives an empty one.  A column named ``ids`` in docs is replaced.
    """
    keep = [c for c in docs.columns if c not in ("text", "ids")]

    def run(batches):
        encoder = encoder_of(path, pattern)
        for b in words.slices(batches, "text", 1 << 20):
            got = encoder.encode_all([t or "" for t in b.column("text").to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(got), "<i4"))
            yield pa.record_batch([*(b.column(c) for c in keep), ids], names=[*keep, "ids"])

    schema = T.StructType([docs.schema[c] for c in keep]).add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(*keep, "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column ``decoded``: the bytes of ``ids`` (null ids: null)."""
    keep = [c for c in encoded.columns if c != "decoded"]

    def run(batches):
        symbols = symbols_of(path)
        joined = np.frombuffer(b"".join(symbols), np.uint8)
        size = np.array([len(s) for s in symbols], np.int64)
        begin = np.cumsum(size) - size
        for batch in batches:
            lens = pa.compute.fill_null(batch.column("ids").value_lengths(), 0).to_numpy(zero_copy_only=False)
            ends, i = np.cumsum(lens, dtype=np.int64), 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, ends[i] - lens[i] + DECODE_IDS, "right")))
                b, i = batch.slice(i, j - i), j
                ids = b.column("ids")
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                each = size[flat]
                at = np.concatenate([[0], np.cumsum(each)])
                raw = joined[np.repeat(begin[flat] - at[:-1], each) + np.arange(at[-1])]
                rows = pa.compute.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False)
                offsets = at[np.concatenate([[0], np.cumsum(rows)])].astype(np.int32)
                out = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                if ids.null_count:
                    out = pa.compute.if_else(ids.is_valid(), out, pa.scalar(None, pa.binary()))
                yield pa.record_batch([*(b.column(c) for c in keep), out], names=[*keep, "decoded"])

    schema = T.StructType([encoded.schema[c] for c in keep]).add("decoded", T.BinaryType())
    return encoded.select(*keep).mapInArrow(run, schema)
