"""XXH64 of many byte spans of one buffer at once (the public algorithm, on columns)."""

from __future__ import annotations

import numpy as np

U = np.uint64
# fixed values of the algorithm
P1, P2, P3, P4, P5 = (U(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x, r):
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc, lane):
    return _rot(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """The hash of data[starts[i]:ends[i]] for each i; spans may overlap."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lane8 = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    lane4 = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    size = (ends - starts).astype(U)
    s = U(seed)
    with np.errstate(over="ignore"):
        acc = np.full(len(starts), s + P5, U)
    at = starts.astype(np.int64).copy()
    long = np.flatnonzero(size >= 32)
    if len(long):
        with np.errstate(over="ignore"):
            v = [np.full(len(long), x, U) for x in (s + P1 + P2, s + P2, s, s - P1)]
        p, stop = at[long], ends[long]
        live = np.arange(len(long))
        while len(live):
            for k in range(4):
                v[k][live] = _round(v[k][live], lane8[p[live] + 8 * k])
            p[live] += 32
            live = live[p[live] + 32 <= stop[live]]
        h = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
        for k in range(4):
            h = (h ^ _round(U(0), v[k])) * P1 + P4
        acc[long] = h
        at[long] = p
    acc += size
    live = np.flatnonzero(at + 8 <= ends)
    while len(live):
        acc[live] = _rot(acc[live] ^ _round(U(0), lane8[at[live]]), 27) * P1 + P4
        at[live] += 8
        live = live[at[live] + 8 <= ends[live]]
    live = np.flatnonzero(at + 4 <= ends)
    acc[live] = _rot(acc[live] ^ (lane4[at[live]].astype(U) * P1), 23) * P2 + P3
    at[live] += 4
    live = np.flatnonzero(at < ends)
    while len(live):
        acc[live] = _rot(acc[live] ^ (padded[at[live]].astype(U) * P5), 11) * P1
        at[live] += 1
        live = live[at[live] < ends[live]]
    acc ^= acc >> U(33)
    acc *= P2
    acc ^= acc >> U(29)
    acc *= P3
    return acc ^ (acc >> U(32))
