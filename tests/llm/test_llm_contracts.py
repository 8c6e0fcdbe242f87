"""The operators' queries against brute force over whole small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
import xxhash

from shopgauge.llm import queries as Q

DIR = "/root/testdata/sf0.001"


def crc(i) -> int:
    return zlib.crc32(b"" if i is None else str(i).encode())


def sha(t) -> str:
    return hashlib.sha256(t.encode() if isinstance(t, str) else t).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def words_of(t):
    return (t or "").encode().lower().split()


def result(spark, name):
    rows = Q.QUERIES[name](spark, DIR).collect()
    key = rows[0].__fields__[0]
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_secret_scans(spark, docs):
    got = result(spark, "op1_secret_scans")
    assert got.keys() == docs.keys()
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    seen = 0
    for i, d in docs.items():
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(d.text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", d.text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", d.text) if len(m[0]) >= 16]
        n = Counter(s[2] for s in spans)
        text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (n["assign"], n["access"], n["hex"])
        assert got[i].base_sha256 == sha(text)
        seen += len(spans)
    assert seen


def test_lm_scoring(spark, docs):
    got = result(spark, "op3_lm_scoring")
    counts, tokens = Counter(), {i: [*words_of(d.text), None] for i, d in docs.items()}
    pairs, kept, kept_pairs = Counter(), Counter(), Counter()
    for i, t in tokens.items():
        if crc(i) % 10 != 0:
            counts.update(t)
            pairs.update(zip([0, *t], t))
            if crc(i) % 10 != 1:
                kept.update(t)
                kept_pairs.update(zip([0, *t], t))
    n, v = sum(counts.values()), len(counts)

    def estimates(prev, w, one, two):
        context = one[None] if prev == 0 else one[prev]
        return context, (two[prev, w] / context if context else 0), one[w] / sum_of[id(one)], 1 / (len(one) + 1)

    sum_of = {id(counts): n, id(kept): sum(kept.values())}
    from shopgauge.llm import deleted_interpolation as M
    import numpy as np
    cells = Counter()
    bucket = lambda c: math.ceil(math.log2(c + 1))
    grid = lambda x: -1 if x <= 0 else int(np.rint(-M.GRID * np.log2(x)))
    for i, t in tokens.items():
        if crc(i) % 10 == 1:
            for prev, w in zip([0, *t], t):
                c, two, one, _ = estimates(prev, w, kept, kept_pairs)
                cells[bucket(c), grid(two), grid(one)] += 1
    weights = M.learn_weights(np.array(sorted((*k, m) for k, m in cells.items())), 1 / (len(kept) + 1))
    assert np.allclose(weights.sum(axis=1), 1)
    for i, t in tokens.items():
        r = got[i]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        score = 0
        for prev, w in zip([0, *t], t):
            c, *p = estimates(prev, w, counts, pairs)
            score += math.log10(float(np.dot(weights[bucket(c)], p)))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            crc(i) % 10 == 0, len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, score, rel_tol=1e-6)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_document_fingerprints(spark, docs):
    got = result(spark, "op4_document_fingerprints")
    order = sorted(docs, reverse=True)
    assert got.keys() == docs.keys()
    for k, i in enumerate(order):
        t, nxt = docs[i].text, docs[order[(k + 1) % len(order)]].text
        half = len(t) // 2
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == sha(t[:len(t) - half] + nxt[:half])
        split = lambda h: {h[j:j + 16] for j in range(0, len(h), 16)}
        a, b, c = (split(x) for x in (got[i].fingerprint, got[i].edited_fingerprint,
                                      got[order[(k + 1) % len(order)]].fingerprint))
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert math.isclose(got[i].near_edited, near(a, b)) and math.isclose(got[i].near_next, near(a, c))
    by_text = defaultdict(set)
    for i, d in docs.items():
        by_text[d.text].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert sum(r.near_edited for r in got.values()) > 4 * sum(r.near_next for r in got.values())


def test_decontamination_finds_exact_copies(spark, docs):
    rows = Q.op5_decontamination(spark, DIR).collect()
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    flat = lambda t: " " + " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())) + " "
    wanted = {(i, k) for i, d in docs.items() for k, t in items.items() if flat(t) in flat(d.text)}
    assert wanted
    assert {(r.doc_id, r.item_id) for r in rows if r.score == 1.0} == wanted


def test_byte_bpe(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = result(spark, "op6_byte_bpe")
    for i, d in docs.items():
        ids = own.encode_ordinary(d.text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == sha(" ".join(map(str, ids)))
        assert got[i].decoded_sha256 == sha(d.text)


def fingerprint(t):
    w = words_of(t)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 4]), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def linked(prints):
    """Smallest key reachable over links of at most 4 bits, by comparing all."""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(prints)
    for a in keys:
        for b in keys:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in keys}


def test_simhash(spark, docs):
    got = result(spark, "op8_simhash")
    prints = {i: fingerprint(d.text) for i, d in docs.items()}
    wanted = linked(prints)
    assert len(set(wanted.values())) < len(wanted)
    for i in docs:
        assert got[i].fingerprint == f"{prints[i]:016x}"
        assert got[i].component_id == wanted[i]


def test_toxicity(spark, docs):
    # the smallest tables have too few labels to learn from
    where = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in Q.op7_toxicity(spark, where).collect()}
    labels = spark.read.parquet(f"{where}/labels.parquet").collect()
    held = [(got[r.doc_id], r.toxic) for r in labels if crc(r.doc_id) % 5 == 0]
    assert all(g.held_out for g, _ in held) and all(0 <= g.score <= 1 for g, _ in held)
    assert all(g.predicted == (g.score >= 0.5) for g, _ in held)
    pos = [g.score for g, y in held if y]
    neg = [g.score for g, y in held if not y]
    assert sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg) > 0.97
    assert sum(g.predicted == y for g, y in held) / len(held) > 0.95


def test_language_id(spark):
    where = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.op9_language_id(spark, where).collect()}
    docs = spark.read.parquet(f"{where}/documents.parquet").collect()
    assert got.keys() == {d.doc_id for d in docs}
    held = [d for d in docs if crc(d.doc_id) % 3 == 1]
    assert all(got[d.doc_id].held_out == (crc(d.doc_id) % 3 == 1) for d in docs)
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) / len(held) > 0.97


def test_warc(spark):
    got = result(spark, "op10_warc")
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    assert got.keys() == pages.keys()
    for i, raw in pages.items():
        r = got[i]
        assert r.payload_bytes == len(raw)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        own = first[raw] == i
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", first[raw]))


def test_pipeline(spark, docs):
    import corpus_pipeline as P
    final = {r.doc_id: r for r in P.run(spark, DIR).collect()}
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    least = linked({i: fingerprint(d.text) for i, d in docs.items() if any(c.isalpha() for c in d.text)})
    flat = lambda t: " " + " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())) + " "
    leaks = {i for i, d in docs.items() if any(flat(t) in flat(d.text) for t in items)}
    wanted = {i for i in least if least[i] == i} - leaks
    assert final.keys() == wanted
    assert all(r.round_trip for r in final.values())
    scanned = P.secret_scans(spark, spark.read.parquet(f"{DIR}/documents.parquet"), DIR).collect()
    changed = {r.doc_id for r in scanned if r.text != docs[r.doc_id].text}
    with_secret = {i for i, r in result(spark, "op1_secret_scans").items() if r.spans}
    assert changed == with_secret and len(scanned) == len(docs)
    assert all(len(r.text) == len(docs[r.doc_id].text) for r in scanned)
