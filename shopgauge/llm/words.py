"""Words of an Arrow text column as 64-bit hashes, computed a column at a time.

A word is a maximal run of bytes that are not separators.  Its hash is a
polynomial over random byte values, read off one running sum per block of
text, so no Python string is made for a word.  Texts are lower-cased in A-Z
only.  Nulls count as empty texts and have no words.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text hashed at a time (fits the caches).
BLOCK = 1 << 18
#: Bytes of text that one slice of an Arrow batch holds, unless one text is longer.
SLICE = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _table(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    keep = np.ones(256, bool)
    keep[list(separators)] = False
    values = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.int64).astype(U)
    values[65:91] = values[97:123]
    return keep, values


_HELD: dict[str, Callable[[], None]] = {}


def take_turn(owner: str, drop: Callable[[], None] | None = None) -> None:
    """Said where a task of an operator begins: what other operators remember in this worker is dropped.

    Workers outlive their tasks; without this a worker of a pipeline would
    hold the memories of all stages that it has run.
    """
    others = [_HELD.pop(name) for name in [*_HELD] if name != owner]
    for forget in others:
        forget()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if drop:
        _HELD[owner] = drop


#: Words between ASCII white space, punctuation kept.
SPACED = _table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Runs of ASCII letters, digits and any non-ASCII bytes.
ALNUM = _table(bytes(b for b in range(128) if not chr(b).isalnum()))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, U)
    down = np.full(n, pow(_BASE, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(BLOCK + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def join_hashes(*parts: np.ndarray) -> np.ndarray:
    """An order-dependent hash of several columns of hashes."""
    out = np.zeros(len(parts[0]), U)
    for p in parts:
        out = mix(out * U(0xD6E8FEB86659FD93) + p + U(1))
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        width = np.int64
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def spans(buf: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = keep[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _hash_block(buf, values, s, e) -> np.ndarray:
    a, n = s[0], int(e[-1] - s[0])
    up, down = (_UP, _DOWN) if n <= BLOCK else _powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(values[buf[a:a + n]] * up[:n], out=total[1:])
    return mix((total[e - a] - total[s - a]) * down[s - a])


def hash_spans(buf, values, starts, ends) -> np.ndarray:
    """The hash of each byte span; spans are in order and do not overlap."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        out[i:j] = _hash_block(buf, values, starts[i:j], ends[i:j])
        i = j
    return out


def hashed(column: pa.Array, table=SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): row i of the column has the words hashes[first[i]:first[i+1]]."""
    buf, offs = text_buffers(column)
    starts, ends, first = spans(buf, offs, table[0])
    return hash_spans(buf, table[1], starts, ends), first


def hash_of(word: str) -> int:
    """The hash of one word, as ``hashed`` gives it."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hash_spans(raw, SPACED[1], np.array([0]), np.array([len(raw)]))[0]) if len(raw) else 0


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text (a longer text is alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(text_buffers(batch.column(column))[1])
        ends = np.cumsum(sizes)
        i = 0
        while i < batch.num_rows:
            base = ends[i] - sizes[i]
            j = max(i + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(i, j - i)
            i = j


def group_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of values[first[i]:first[i+1]] for each i (0 for empty groups)."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def distinct_per_row(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each row in rising order, their row bounds and their counts."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(k)))
    return k[at], np.searchsorted(r[at], np.arange(len(first))), counts
