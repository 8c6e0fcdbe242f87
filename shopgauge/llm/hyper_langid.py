"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from the letter itself.
An n-gram's vector binds its letters' vectors, each rotated by its place, by
multiplying them; a text's vector bundles (adds) those of its n-grams, and a
language's prototype bundles its texts.  A text has the language whose
prototype is nearest by cosine.

Learning sends one vector for each language from each task, summed by
dimension, so what meets in one place is languages x dimensions, whatever the
corpus.

Cosines of 512 dimensions have a noise of 1/sqrt(512) about the true ones, so
a low one does not say whether a text is in a learned language at all.  For
that, n-grams also have one signed place each in a vector of 2^16 (noise
1/256): a text whose cosine is below ``SURE`` is unknown unless the one with
some language's profile in that space exceeds a level that rises with the
text's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .words import U

#: Dimensions of all vectors, and letters in an n-gram.
DIMENSIONS, N = 512, 3
#: N-gram vectors a worker remembers.
REMEMBER = 60_000
#: Places of a profile (a power of two), and the cosine of the prototypes from which a text needs no look at them.
PLACES_BITS, SURE = 16, 0.25
#: Cosines with profiles that unlearned texts reach: of no length, and of MANY n-grams or more.
NOISE, FOREIGN, MANY = 0.02, 0.1, 400
_GAP = np.uint32(0)


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return table


class Space:
    """The vectors of letters and n-grams (made on demand, always the same)."""

    def __init__(self):
        self.letter = _letters()
        self.known = np.zeros(0, U)
        self.rows = np.zeros((0, DIMENSIONS), np.int8)

    def letters(self, codes: np.ndarray) -> np.ndarray:
        """A row of +1 and -1 for each code point: the bits of hashes of it."""
        seeds = words.mix(codes.astype(U) + U(0x9E37))[:, None] + np.arange(DIMENSIONS // 64, dtype=U)[None, :] * U(0x9E3779B97F4A7C15)
        bits = np.unpackbits(words.mix(seeds).view(np.uint8), axis=1)
        return bits.astype(np.int8) * 2 - 1

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of distinct n-grams in rising order."""
        at = np.searchsorted(self.known, grams)
        at = np.minimum(at, max(len(self.known) - 1, 0))
        new = grams[self.known[at] != grams] if len(self.known) else grams
        if len(new):
            if len(self.known) + len(new) > REMEMBER:
                self.known, self.rows, new = np.zeros(0, U), np.zeros((0, DIMENSIONS), np.int8), grams
            made = np.ones((len(new), DIMENSIONS), np.int8)
            for k in range(N):
                code = (new >> U(21 * (N - 1 - k))) & U(0x1FFFFF)
                kinds, slot = np.unique(code, return_inverse=True)
                made *= np.roll(self.letters(kinds), N - 1 - k, axis=1)[slot]
            keys = np.concatenate([self.known, new])
            order = np.argsort(keys, kind="stable")
            self.known, self.rows = keys[order], np.concatenate([self.rows, made])[order]
            at = np.searchsorted(self.known, grams)
        return self.rows[at]

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(n-grams, their row bounds, counts, whether a row has a letter).

        Letters are lower case; what lies between letters is one gap, also
        before the first and after the last.
        """
        low = [t.lower() for t in texts]
        code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in low])
        is_letter = self.letter[code]
        symbol = np.where(is_letter, code, _GAP)
        row = np.repeat(np.arange(len(low)), np.diff(ends, prepend=0))
        # each text's letters, a gap before each run of them and one after the last
        opens = is_letter & ~np.concatenate([[False], is_letter[:-1]])
        closes = np.zeros(len(code), bool)
        closes[ends - 1] = True
        times = is_letter.astype(np.int64) + opens
        times[closes] = 1
        seq = np.repeat(symbol, times)
        seq_row = np.repeat(row, times)
        first_of_two = np.cumsum(times) - times
        seq[first_of_two[opens]] = _GAP
        has = np.bincount(row[is_letter], minlength=len(low)) > 0
        s = seq.astype(U)
        if len(s) < N:
            return np.zeros(0, U), np.zeros(len(low) + 1, np.int64), np.zeros(0, np.int64), has
        key = np.zeros(len(s) - N + 1, U)
        for k in range(N):
            key = (key << U(21)) | s[k:len(s) - N + 1 + k]
        inside = seq_row[:len(key)] == seq_row[N - 1:]
        keys, starts = key[inside], np.searchsorted(seq_row[:len(key)][inside], np.arange(len(low) + 1))
        return *_count(keys, starts), has


def _count(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each row with counts: as indices of the batch's keys, sorted with their row."""
    kinds, slot = np.unique(keys, return_inverse=True)
    width = max(len(kinds), 1)
    pair = np.repeat(np.arange(len(first) - 1), np.diff(first)) * width + slot
    pair.sort()
    new = np.concatenate([[True], pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return (kinds[pair[at] % width], np.searchsorted(pair[at], np.arange(len(first)) * width),
            np.diff(np.append(at, len(pair))))


_SPACE: list[Space] = []


def space() -> Space:
    words.take_turn("langid", _SPACE.clear)
    if not _SPACE:
        _SPACE.append(Space())
    return _SPACE[0]


def _matrix(grams, bounds, counts):
    """Distinct n-grams of a batch, and the count of each in each row."""
    kinds, slot = np.unique(grams, return_inverse=True)
    table = np.zeros((len(bounds) - 1, len(kinds)), np.float32)
    table[np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), slot] = counts
    return kinds, table


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of some texts and whether each has a letter."""
    grams, bounds, counts, has = space().grams(texts)
    kinds, table = _matrix(grams, bounds, counts)
    return table @ space().vectors(kinds).astype(np.float32), has


def _placed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, unit values, row bounds, number of n-grams): the texts' n-grams in the space of profiles."""
    grams, bounds, counts, _ = space().grams(texts)
    h = words.mix(grams.astype(U) + U(0x51ED))
    value = np.where(h & U(1), 1.0, -1.0) * counts
    size = np.sqrt(words.group_sums(value ** 2, bounds))
    value /= np.repeat(np.maximum(size, 1e-9), np.diff(bounds))
    return (h >> U(64 - PLACES_BITS)).astype(np.int64), value, bounds, words.group_sums(counts, bounds)


def profiles(docs: DataFrame) -> np.ndarray:
    """A row for each language of docs (``text`` and ``lang``, nulls left out): its texts' n-grams, at unit length.

    Each task sends at most 2^16 numbers for a language, summed by place.
    """
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in words.slices(batches, "text", 1 << 19):
            at, value, bounds, _ = _placed(b.column("text").to_pylist())
            lang = np.array(b.column("lang").to_pylist(), object)
            row = np.repeat(np.arange(len(lang)), np.diff(bounds))
            whole = np.rint(value * 2 ** 20).astype(np.int64)
            for name in set(lang):
                if name not in sums:
                    sums[name] = np.zeros(1 << PLACES_BITS, np.int64)
                mine = (lang == name)[row]
                np.add.at(sums[name], at[mine], whole[mine])
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                   pa.array(total[at])], names=["lang", "place", "value"])

    rows = (docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
            .mapInArrow(run, "lang string, place int, value long")
            .groupBy("lang", "place").agg(F.sum("value").alias("value")).toArrow())
    names, which = np.unique(np.array(rows["lang"].to_pylist(), str), return_inverse=True)
    out = np.zeros((len(names), 1 << PLACES_BITS))
    out[which, rows["place"].to_numpy()] = rows["value"].to_numpy()
    return (out / np.maximum(np.sqrt((out ** 2).sum(axis=1)), 1e-9)[:, None]).astype(np.float32)


def familiar(texts: list[str], known: np.ndarray) -> np.ndarray:
    """Whether each text is nearer to one of the profiles than unlearned texts of its length are."""
    at, value, bounds, many = _placed(texts)
    best = np.zeros(len(texts))
    for profile in known:
        best = np.maximum(best, words.group_sums(profile[at] * value, bounds))
    return best > NOISE + (FOREIGN - NOISE) * np.minimum(1, many / MANY)


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """The prototype of each language: the sum of the unit vectors of its texts, at unit length.

    ``docs`` has ``text`` and ``lang``; rows with either null are left out, and
    so are texts without a letter.  The number of languages, not of rows, sets
    the size of the result.
    """
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in words.slices(batches, "text", 1 << 19):
            v, has = bundles(b.column("text").to_pylist())
            size = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
            unit = np.rint(v / np.maximum(size, 1e-9)[:, None] * 2 ** 20).astype(np.int64)
            lang = np.array(b.column("lang").to_pylist(), object)
            for name in set(lang[has & (size > 0)]):
                sums[name] = sums.get(name, 0) + unit[has & (lang == name)].sum(axis=0)
        if sums:
            n = len(sums)
            yield pa.record_batch([
                pa.array([k for k in sums for _ in range(DIMENSIONS)]),
                pa.array(np.tile(np.arange(DIMENSIONS, dtype=np.int32), n)),
                pa.array(np.concatenate(list(sums.values())))], names=["lang", "place", "value"])

    # whole numbers, so that the sums do not depend on the order of tasks
    rows = (docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
            .mapInArrow(run, "lang string, place int, value long")
            .groupBy("lang", "place").agg(F.sum("value").alias("value")).toPandas())
    out = {}
    for name, part in rows.groupby("lang"):
        v = np.zeros(DIMENSIONS)
        v[part["place"]] = part["value"]
        size = np.sqrt((v ** 2).sum())
        if size:
            out[name] = v / size
    return dict(sorted(out.items()))


def predict(docs: DataFrame, learned: dict[str, np.ndarray], keep: list[str] | None = None,
            known: np.ndarray | None = None) -> DataFrame:
    """The columns ``keep`` of docs with ``lang_pred`` and ``score``, for each row.

    ``lang_pred`` is the language of the nearest prototype (of equals the
    first by name), ``score`` its cosine, not less than 0.  A null text and one
    without a letter is ``und`` with score 0, as is every text where nothing was
    learned.  With profiles (``known``), so is a text that is not ``familiar``.
    Repeated rows are alike; an empty table gives an empty one.
    """
    keep = [c for c in (keep or ["doc_id"]) if c not in ("lang_pred", "score")]
    text = "text" if "text" in keep else "_text"  # sent once, also where it is kept
    source = docs.select(*keep) if text == "text" else docs.select(*keep, F.col("text").alias("_text"))
    names = np.array([*learned, "und"], object)
    sent = docs.sparkSession.sparkContext.broadcast(
        (np.array(list(learned.values()), np.float32).reshape(-1, DIMENSIONS), known))

    def run(batches):
        protos, known = sent.value
        for b in words.slices(batches, text, 1 << 19):
            texts = [t or "" for t in b.column(text).to_pylist()]
            v, has = bundles(texts)
            best, score = np.full(len(v), len(protos)), np.zeros(len(v))
            if len(protos):
                cosine = (v @ protos.T) / np.maximum(np.sqrt((v ** 2).sum(axis=1)), 1e-9)[:, None]
                best = np.where(has, cosine.argmax(axis=1), len(protos))
                score = np.where(has, np.clip(cosine.max(axis=1), 0, 1), 0.0)
                doubt = np.flatnonzero(has & (score < SURE)) if known is not None else []
                if len(doubt):
                    gone = doubt[~familiar([texts[i] for i in doubt], known)]
                    best[gone], score[gone] = len(protos), 0.0
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(names[best], pa.string()),
                                   pa.array(score.astype(np.float64))], names=[*keep, "lang_pred", "score"])

    schema = T.StructType([docs.schema[c] for c in keep]).add("lang_pred", T.StringType()).add("score", T.DoubleType())
    return source.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: those whose crc32(doc_id as text) mod 3 is not 1."""
    return docs.where(~is_held_out())


def is_held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
