"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import random
import tempfile

import numpy as np
import public_tokenizers as tok
import pytest
from pyspark.sql import functions as F

from shopgauge.llm import (byte_bpe, components, covering_simhash, decontamination, deleted_interpolation, hyper_langid,
                           license_rules, secret_ledger, spotsigs, toxicity_fm, warc_chunks, words)

PATH = tok.path("byte_bpe_50k.tiktoken")
LONG = " ".join(random.Random(3).choice("the of an idiot house tree runs blue".split()) for _ in range(60_000))
ROWS = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "The cat is a cat on the mat.", "en", None),
        (3, "The cat is a cat on the mat.", "en", None), (4, LONG, "en", "x"), (None, "no id here", None, "x"),
        (None, "no id here", None, "x"), (5, " \t\n ", "en", "x"), (6, "x" * 30_000, "en", "x"),
        (7, "12345 !!! 678", "en", "x"), (8, "straße ünder ſ token=abcdef0123456789abc", "de", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    names = "doc_id long, text string, lang string, source string"
    extra = {c: F.lit("clash") for c in ("ids", "score", "fp", "blob", "found", "component", "held_out", "row", "n_chars",
                                         "bucket", "start", "fold", "_place")}
    return spark.createDataFrame(ROWS, names).withColumns(extra)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_secrets(spark, docs, none):
    folder = tempfile.mkdtemp(dir="/tmp") + "/ledger"
    assert secret_ledger.scan(none, folder + "0", path_col="doc_id").count() == 0
    base = secret_ledger.RULES[:2]
    ledger = secret_ledger.scan(docs, folder, base, path_col="doc_id")
    assert ledger.count() == len({t or "" for _, t, *_ in ROWS})
    assert secret_ledger.unseen(docs, ledger, base, "doc_id").count() == 0
    # a new rule version and a new text: only those pairs are scanned
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(9, "AKIA" + "Q" * 20)], "doc_id long, text string"))
    todo = secret_ledger.unseen(more, ledger, secret_ledger.RULES[:3], "doc_id")
    assert {tuple(r.missing) for r in todo.collect()} == {("hex@1",), ("assign@1", "access@1", "hex@1")}
    ledger = secret_ledger.scan(more, folder, secret_ledger.RULES[:3], path_col="doc_id")
    found = secret_ledger.by_path(more, ledger).collect()
    assert len(found) == len(ROWS) + 1
    kinds = {r.doc_id: [s.kind for s in r.found] for r in found}
    assert kinds[8] == ["assign", "hex"] and kinds[9] == ["access"] and kinds[1] == []
    red = {r.doc_id: r.text for r in secret_ledger.redact(docs, ledger).collect()}
    assert red[8] == "straße ünder ſ " + "*" * 25 and red[1] is None and len(red[4]) == len(LONG)


def test_licences(spark, docs, none):
    assert license_rules.recognise(none).count() == 0
    assert license_rules.recognise(docs).count() == len(ROWS)
    text = ("Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the "
            "License. You may obtain a copy of the License at http://x\nReleased under the MIT License.\nAll rights reserved.")
    r = license_rules.recognise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.sentence_ids == ["ApacheLine", "ApacheUse", "MITLine", "Reserved"]
    assert r.licences == ["Apache-2.0", "MIT"] and r.unmatched == ["Reserved"]


def test_licence_sentences_end_alike_in_sql(spark):
    """Sentences and identifiers against plain loops and the query's SQL, on runs of marks, lines, comments, items and nulls."""
    import re

    import duckdb

    rng = random.Random(8)
    known = [s for many in license_rules.SENTENCES.values() for s in many]
    bits = [". ", "...", "!\n", ";\t", "\r\n", "\n", "\n\n", "\n \n", " ", "x", "\n// ", "\n # ", "\n * ", "\n2. ", "\n (b) ", "\n/* "]
    texts = [None, "", "." * 30_000 + "x", "\n" * 30_000 + "x", "\n-" * 30_000, *(
        "".join(rng.choice([*known, *(s.replace(" ", "\n", 3) for s in rng.sample(known, 9)), *bits * 4])
                for _ in range(rng.randint(1, 30))) for _ in range(400))]

    def plain(text):
        """Sentences of a text, each a list of normalised lines."""
        found, held = [], []
        for line in text.lower().split("\n"):
            line = re.sub(r"^[ \t\r]*(//+|/\*+|\*+/|\*+|#+|--+|%+|>+)(?=[ \t\r]|$)", "", line)
            item = re.match(r"[ \t\r]*(\Z|\(?([0-9]{1,2}|[a-z])[.)][ \t]+)", line)
            if item:
                found.append(held)
                held, line = [], line[item.end():]
            pieces = re.split(r"[.!?;]+(?=[ \t\r]|$)", line)
            for k, piece in enumerate(pieces):
                held.append(license_rules.normal(piece))
                if k < len(pieces) - 1:
                    found.append(held)
                    held = []
        return [w for w in ([x for x in s if x] for s in [*found, held]) if w]

    def ids(text):
        by = {license_rules.normal(s): key for key, many in license_rules.SENTENCES.items() for s in many}
        got = []
        for lines in plain(text):
            at = 0
            while at < len(lines):
                ends = [e for e in range(len(lines), at, -1) if " ".join(lines[at:e]) in by]
                got += [by[" ".join(lines[at:ends[0]])]] if ends else []
                at = ends[0] if ends else at + 1
        return got

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_rules.recognise(df).collect()}
    assert [got[i].n_sentences for i in range(len(texts))] == [len(plain(t or "")) for t in texts]
    assert [got[i].sentence_ids for i in range(len(texts))] == [ids(t or "") for t in texts]
    import pyarrow as pa
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())}))
    from shopgauge.llm.oracle import ORACLES
    rows = con.execute(ORACLES["op2_license_scans"]).fetchall()
    assert {r[0]: r[1:] for r in rows} == {i: (r.n_sentences, *(",".join(x) for x in (r.sentence_ids, r.licences, r.unmatched)))
                                           for i, r in got.items()}
    assert any(r.licences for r in got.values()) and any(r.unmatched for r in got.values())


def test_lm(docs, none):
    assert deleted_interpolation.score(none).count() == 0
    rows = deleted_interpolation.score(docs).collect()
    assert len(rows) == len(ROWS) and all(np.isfinite([r.score, r.base_score]).all() for r in rows)
    n = {r.doc_id: r.n_tokens for r in rows}
    assert n[1] == n[2] == n[5] == 1 and n[4] == 60_001 and n[6] == 2


def test_fingerprints(docs, none):
    assert spotsigs.compare_with_next(none).count() == 0
    rows = spotsigs.compare_with_next(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.fingerprint for r in by[1]] == [""] and by[1][0].near_edited == 1.0
    assert len({r.fingerprint for r in by[3]}) == 1 and 1.0 in {r.near_next for r in by[3]}
    members, pairs = spotsigs.near_duplicates(docs.select("doc_id", "text"))
    assert members.count() == len(ROWS)
    own = {r.doc_id: r.component_id for r in members.collect()}
    assert own[3] == 3 and pairs.count() == 0


def test_spotsigs_join_finds_all_links(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[rng.choice(["the", "a", rng.choice(vocabulary)]) for _ in range(120)] for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(6):
            t = list(b)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" the ".join([" ".join(t[:60]), " ".join(t[60:])]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import pyarrow as pa
    sets = [set(s.tolist()) for s in spotsigs.signatures(pa.array(texts))]
    close = {(a, b) for a in range(len(sets)) for b in range(a) if sets[a] != sets[b]
             and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    members, pairs = spotsigs.near_duplicates(df)
    assert pairs.count() == len({frozenset((frozenset(sets[a]), frozenset(sets[b]))) for a, b in close}) > 0
    root = list(range(len(sets)))
    for a, b in sorted(close) + [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] == sets[b]]:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = [new if r == old else r for r in root]
    assert {r.doc_id: r.component_id for r in members.collect()} == dict(enumerate(root))


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, "cat is a cat on the mat"), (2, None), (3, ""), (4, "two words"), (5, "x"),
                                   (6, "cat is a cat on the mat")], "item_id long, text string")
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    got = sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect())
    assert got == [(3, 1), (3, 1), (3, 6), (3, 6)]
    assert decontamination.clean(docs, bench).count() == len(ROWS) - 2


def test_decontamination_finds_edited_copies(spark):
    rng = random.Random(11)
    vocabulary = [f"v{k}" for k in range(4000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 50))] for _ in range(20)]
    docs, wanted = [], set()
    for k in range(100):
        body = [rng.choice(vocabulary) for _ in range(200)]
        if k < 60:
            copy = [w if rng.random() > 0.15 else rng.choice(vocabulary) for w in items[k % 20]]
            body[50:50] = copy
            same = sum(a == b for a, b in zip(copy, items[k % 20]))
            if same >= 0.8 * len(copy):
                wanted.add((k, k % 20))
        docs.append((k, " ".join(body)))
    got = decontamination.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert wanted and wanted <= found and all(d < 60 and d % 20 == i for d, i in found)


def test_bpe(docs, none):
    assert byte_bpe.encode(none, PATH, tok.PATTERN).count() == 0
    enc = byte_bpe.encode(docs, PATH, tok.PATTERN)
    rows = byte_bpe.decode(enc, PATH).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for _, t, *_ in ROWS)
    assert rows[0].score == "clash" and "text" not in enc.columns


def test_rank_queue_on_long_pre_tokens():
    import tiktoken
    ranks = byte_bpe.read_ranks(PATH)
    own = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    queue, rng = byte_bpe.RankQueue(ranks), random.Random(2)
    for text in ["a" * 4999, "ab" * 2500, "".join(rng.choice("abcdeth") for _ in range(20_000)), "é" * 999]:
        assert queue.encode(text.encode()) == own.encode_ordinary(text)
        assert not any(queue.low)


def test_bpe_queue_is_exact_for_any_order_of_ranks():
    rng = random.Random(5)

    def plain(ranks, piece):
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while piece not in ranks:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [ranks[piece]]

    for _ in range(300):
        letters = bytes(rng.sample(range(256), 3))
        more = {bytes(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(0, 40))}
        symbols = [bytes([a]) for a in range(256)] + rng.sample(sorted(more), len(more))  # longer ones also before their parts
        ranks = dict(zip(symbols, rng.sample(range(3000), len(symbols))))
        queue = byte_bpe.RankQueue(ranks)
        for _ in range(8):
            piece = bytes(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            assert queue.encode(piece) == plain(ranks, piece)
        assert not any(queue.low)


def test_bpe_encodes_a_pre_token_once_and_queues_few_pairs(monkeypatch):
    encoder = byte_bpe.Encoder(byte_bpe.read_ranks(PATH), tok.PATTERN)
    seen, plain = [], encoder.queue.encode
    monkeypatch.setattr(encoder.queue, "encode", lambda piece: seen.append(piece) or plain(piece))
    texts = ["a theaheq, b", "a theaheq b", "a theaheq. b", "a (theaheq b"]
    want = [byte_bpe.Encoder(byte_bpe.read_ranks(PATH), tok.PATTERN)._whole(t) for t in texts]
    assert [encoder.encode(t) for t in texts] == want
    assert seen.count(b" theaheq") == 1

    class Ranks(dict):  # rank of a run of one letter: all its pairs are equal, so only the first waits
        asked = 0

        def get(self, *key):
            Ranks.asked += 1
            return super().get(*key)

    queue = byte_bpe.RankQueue(Ranks({bytes([a]): a for a in range(256)} | {b"xx": 300}))
    Ranks.asked = 0
    assert queue.encode(b"x" * 9) == [300] * 4 + [ord("x")]
    assert Ranks.asked < 20  # 8 pairs and 5 symbols were asked for besides


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2 if i < 5 else None) for i in range(1, 9)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity_fm.learn(docs, labels)
    assert toxicity_fm.score(none, model).count() == 0
    rows = toxicity_fm.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    empty = toxicity_fm.learn(none, labels.limit(0))
    assert all(r.score == 0.5 for r in toxicity_fm.score(docs, empty).collect())


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(4000):  # toxic only where both terms meet
        a, b = rng.random(2) < 0.5
        rows.append(np.array([*([1] if a else []), *([2] if b else []), int(rng.integers(10, 60))], np.int32))
        labels.append(int(a and b))
    model = toxicity_fm.fit(rows, np.array(labels), rounds=20, sparse=0.1)
    score = lambda *t: toxicity_fm.sigmoid(model.raw(np.array(t, np.int32), np.array([0, len(t)])))[0]
    assert score(1, 2) > 0.5 > max(score(1), score(2), score(11))


def test_simhash(docs, none):
    assert covering_simhash.near_duplicates(none).count() == 0
    rows = covering_simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    zero = {r.doc_id for r in rows if r.fp == 0}
    assert zero == {1, 2, 5} and {r.component_id for r in rows if r.fp == 0} == {1}
    kept = covering_simhash.keep_one(docs).collect()
    assert len([r for r in kept if r.doc_id == 3]) == 1 and kept[0].score == "clash"


@pytest.mark.parametrize("block", [8, 2048])
def test_covering_tables_lose_no_link(spark, block, monkeypatch):
    monkeypatch.setattr(covering_simhash, "BLOCK", block)
    rng = random.Random(7)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
    signed = [p - 2**64 if p >= 2**63 else p for p in sorted(prints)]
    links = covering_simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4)
    got = {r.node: r.component for r in components.components(links).collect()}
    root = {p: p for p in signed}
    for a in signed:
        for b in signed:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 4 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    assert {p: got.get(p, p) for p in signed} == root


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 200: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language(docs, none):
    assert hyper_langid.prototypes(none) == {} and hyper_langid.predict(none, {}).count() == 0
    learned = hyper_langid.prototypes(docs)
    assert list(learned) == ["de", "en"]
    rows = {r.doc_id: r for r in hyper_langid.predict(docs, learned).collect()}
    assert {i for i, r in rows.items() if r.lang_pred == "und"} == {1, 2, 5, 7}
    assert rows[4].lang_pred == "en" and rows[8].lang_pred == "de" and rows[7].score == 0


def test_warc(spark):
    html = "<p>é</p>" * 900
    rows = [(1, "http://a", html), (2, None, html), (3, "u\r\nWARC/1.1", None), (4, "u", ""), (5, "u", "x\r\n\r\nWARC/1.1"),
            (5, "u", "x\r\n\r\nWARC/1.1"), (None, "u", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = warc_chunks.new_folder(spark)
    files = warc_chunks.write(pages, folder)
    chunks = warc_chunks.read_chunks(files, folder, 1000)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= 1000
    assert chunks.where("record_id = '1'").count() == 9
    got = sorted((str(r.record_id), r.payload_bytes, r.type, r.refers_to) for r in warc_chunks.records(chunks).collect())
    n = len(html.encode())
    assert got == sorted([("1", n, "response", None), ("2", n, "revisit", "1"), ("3", 0, "response", None),
                          ("4", 0, "revisit", "3"), ("5", 13, "response", None), ("5", 13, "response", None),
                          ("None", 5, "response", None)])
    assert warc_chunks.write(pages.limit(0), folder).count() == 0


def test_hashes_are_of_words(spark):
    import pyarrow as pa
    texts = ["A b\tA", None, "", "  ", "ab c", "a" * 700_000 + " b", "é x y"]
    h, first = words.hashed(pa.array(texts))
    assert np.diff(first).tolist() == [3, 0, 0, 0, 2, 2, 2]
    assert h[0] == h[2] == words.hash_of("a") and h[1] == words.hash_of("b") == h[6]
    assert h[0] != h[3] and h[5] == words.hash_of("a" * 700_000)


def _decontaminated(spark, items, docs, **more):
    got = decontamination.contaminated(
        spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string"), **more).collect()
    return {(r.doc_id, r.item_id): r.score for r in got}


@pytest.mark.parametrize("exact", [False, True])
def test_decontamination_finds_evenly_edited_copies(spark, exact):
    item = [f"i{k}" for k in range(40)]
    around = [f"r{k}" for k in range(100)]
    docs = {n: [*around, *(f"e{k}" if k % n == n - 1 else w for k, w in enumerate(item)), *around] for n in (3, 4, 5)}
    docs[9] = [*around, *(x for k, w in enumerate(item) for x in (w, f"e{k}"))]  # a word put in after each
    if exact:
        docs[1] = [*around, *item]
    got = _decontaminated(spark, {0: item}, docs)
    assert got.keys() == {(d, 0) for d in docs} and 0.69 < got[5, 0] < 0.72 and got[4, 0] > 0.62


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_decontamination_finds_what_aligning_everything_finds(spark, least):
    import pyarrow as pa
    rng = random.Random(4)
    vocabulary = [f"w{min(int(rng.expovariate(0.05)), 400)}" for _ in range(2000)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))] for i in range(25)}
    items = {i: t for i, t in items.items() if len(t) != 2}
    docs = {}
    for d in range(80):
        copy = []
        for w in items[rng.choice(list(items))]:
            copy += rng.choices([[w], [rng.choice(vocabulary)], [], [w, rng.choice(vocabulary)]], [4, 1, 1, 1])[0]
        docs[d] = [rng.choice(vocabulary) for _ in range(60)] + copy + [rng.choice(vocabulary) for _ in range(30)]
    hashed = lambda t: words.hashed(pa.array([" ".join(t)]), words.ALNUM)[0]
    wanted = {(d, i): decontamination.align(hashed(t), hashed(text))[0] / (2 * len(t))
              for d, text in docs.items() for i, t in items.items()}
    assert _decontaminated(spark, items, docs, least=least) == {k: s for k, s in wanted.items() if s >= least}


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    """A third of the rows has no id, others share one: every group of texts keeps one row, every clean row stays."""
    rng = random.Random(9)
    text = lambda: " ".join(f"u{rng.randrange(10_000)}" for _ in range(60))
    item, named, twice = text(), text(), text()
    nameless = [text() for _ in range(6)]
    rows = [(None, t) for t in nameless] + [(None, nameless[0]), (None, named), (1, named), (2, twice), (2, twice),
            (2, text()), (2, item), (None, item), (3, None), (None, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int")
    kept = [(r.doc_id, r.text) for r in covering_simhash.keep_one(docs).collect()]
    groups = {t: i for i, t in sorted(rows, key=lambda r: (r[0] is not None, -(r[0] or 0)))}
    assert sorted(kept, key=str) == sorted(((i, t) for t, i in groups.items()), key=str)
    clean = decontamination.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.n for r in clean.collect()) == [k for k, (_, t) in enumerate(rows) if t != item]
    assert covering_simhash.keep_one(docs.limit(0)).count() == 0 and clean.columns == docs.columns


def test_pipeline_rejects_unlearned_languages(spark):
    """Scripts that were never learned and long gibberish go, clean texts stay, also short ones."""
    import corpus_pipeline
    rows = [(r.doc_id, r.text, r.lang) for r in
            spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()]
    rng = random.Random(6)
    alphabets = ["αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщыьэюя", "".join(map(chr, range(0x4E00, 0x5000))),
                 "abcdefghijklmnopqrstuvwxyz"]
    text = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 9))) for _ in range(n))
    foreign = [text(a, n) for a in alphabets[:3] for n in (20, 100, 400) for _ in range(10)]
    foreign += [text(alphabets[3], 200) for _ in range(30)]
    short = ["The cat is on the mat.", "The end of the day.", "La casa de la madre.", "Die Frau und der Mann.", "the", "and"]
    # held out, so that none of them is learned
    ids = (i for i in range(10_000_000, 11_000_000) if __import__("zlib").crc32(str(i).encode()) % 3 == 1)
    added = {next(ids): t for t in [*foreign, *short]}
    docs = spark.createDataFrame([*rows, *((i, t, "en") for i, t in added.items())], "doc_id long, text string, lang string")
    docs = docs.withColumns({"source": F.lit("x"), "n_chars": F.length("text").cast("long")})
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert {i for i, t, _ in rows if any(c.isalpha() for c in t or "")} <= kept
    assert {added[i] for i in kept if i in added} == set(short)


def test_licence_notices_as_they_are_written(spark):
    """The MIT, BSD, GPL, LGPL, AGPL and Apache notices: a paragraph to a line, wrapped, and in comments."""
    import textwrap

    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
           "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
           "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
           "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
           "substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
           "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
           "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.")
    bsd = ("1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
           "following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list "
           "of conditions and the following disclaimer in the documentation and/or other materials provided with the "
           "distribution.\n")
    name = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
            "promote products derived from this software without specific prior written permission.\n")
    gpl = ("This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General "
           "Public License as published by the Free Software Foundation{} either version {} of the License, or (at your "
           "option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT "
           "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY.")
    apache = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
              "compliance with the License. You may obtain a copy of the License at\n\n http://www.apache.org/licenses/")
    lgpl = gpl.replace("program", "library").replace("General", "Lesser General")
    agpl = gpl.replace("General", "Affero General")
    wanted = {mit: "MIT", bsd: "BSD-2-Clause", bsd + name: "BSD-3-Clause", gpl.format(":", ",", 3): "GPL-3.0",
              gpl.format(";", ";", 2): "GPL-2.0", apache: "Apache-2.0", lgpl.format(";", ";", 2.1): "LGPL-2.1",
              lgpl.format(":", ",", 3): "LGPL-3.0", agpl.format(":", ",", 3): "AGPL-3.0"}
    wrapped = ["\n".join(textwrap.fill(x, 60) for x in t.split("\n")) for t in wanted]
    texts = [*wanted, *wrapped, *("Some text\n" + t for t in wrapped)]
    for open_, mark, close in (("", "# ", ""), ("/*\n", " * ", "\n */"), ("", "// ", ""), ("<!--\n", "  ", "\n-->")):
        texts += [open_ + textwrap.indent(t, mark, lambda line: True) + close + "\nint main() {}" for t in wrapped]
    texts += ["// SPDX-License-Identifier: LGPL-2.1-or-later\nint x;", "a line without an end\nLicensed under CC BY 4.0"]
    # a rule needs neighbours: a sentence between breaks it
    texts.append(mit.replace("\n\nThe above", "\n\nBut not today.\n\nThe above"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.unmatched) for r in license_rules.recognise(df).collect()}
    named = [([x], []) for x in wanted.values()]
    assert [got[i] for i in range(len(texts))] == [*named * 7, (["LGPL-2.1"], []), (["CC-BY-4.0"], []),
                                                   ([], ["MITGrant", "MITNotice", "AsIs"])]


def test_few_anchors_do_not_stand_for_a_long_text():
    import pyarrow as pa
    foreign = [f"slovo{k}" for k in range(400)]
    one = foreign[:200] + ["la"] + foreign[200:]
    short, long_, plain = spotsigs.signatures(pa.array(["la casa blanca", " ".join(one), " ".join(foreign)]))
    assert len(short) == 1 and len(long_) == len(one)
    # another text with the same borrowed word and its followers differs nearly everywhere
    other = [f"rec{k}" for k in range(200)] + ["la"] + foreign[200:203] + [f"rec{k}" for k in range(200, 397)]
    assert spotsigs.likeness(long_, spotsigs.signatures(pa.array([" ".join(other)]))[0]) < 0.05
    assert spotsigs.likeness(long_, plain) > 0.95


def test_lm_totals_beyond_32_bits_come_back():
    import pandas as pd
    pack = deleted_interpolation._pack
    big = np.array([4_000_000_000], np.uint32)
    cells = pd.DataFrame([{"part": 0, "block": f"b{k}", "em": False, "n": 1, "keys": pack(np.array([5], np.uint64)),
                           "counts": pack(big)} for k in range(3)])
    got = deleted_interpolation._answer(1)(cells)
    totals = [int(deleted_interpolation._unpack(x, 8)[0]) for x in got["counts"] if x is not None]
    assert totals == [12_000_000_000] * 3 and got["n_tokens"].sum() == 12_000_000_000


def test_warc_sql_spells_the_digests(spark):
    """The query's SQL against Python's digests, with equal payloads, nulls and empty ones."""
    import base64
    import hashlib

    import duckdb
    import pyarrow as pa

    from shopgauge.llm.oracle import ORACLES
    html = [None, "", "é" * 3000, "a", "a", "", "x" * 100_000, "a"]
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": list(range(8, 0, -1)), "url": [None] * 8, "html": pa.array(html, pa.string())}))
    got = {r[0]: r[1:] for r in con.execute(ORACLES["op10_warc"]).fetchall()}
    first = {}
    for i, t in zip(range(8, 0, -1), html):
        first[t or ""] = i
    for i, t in zip(range(8, 0, -1), html):
        raw, of = (t or "").encode(), first[t or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert got[i] == (len(raw), digest, *(("response", None) if of == i else ("revisit", of)))


def test_repeated_rows_are_one_of_the_ledger_and_columns_may_clash(spark):
    rows = [(1, "token=abcdef0123456789abc")] * 5 + [(None, "token=abcdef0123456789abc")] * 3
    rows = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = tempfile.mkdtemp(dir="/tmp") + "/ledger"
    assert secret_ledger.scan(rows, folder, path_col="doc_id").count() == 1
    ledger = secret_ledger.read_ledger(spark, folder)
    clash = rows.withColumns({c: F.lit("clash") for c in ("found", "blob", "_found", "_blob", "_path", "rules")})
    found = secret_ledger.by_path(clash, ledger).collect()
    assert len(found) == 8 and all(r.found[0].kind == "assign" and r._found == "clash" for r in found)
    red = secret_ledger.redact(clash, ledger).collect()
    assert {r.text for r in red} == {"*" * 25} and {r.found for r in red} == {"clash"}


def test_toxicity_learns_each_labelled_document_once(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity_fm, "fit", lambda rows, y, **k: seen.update(n=len(rows), size=sum(len(r) for r in rows)))
    docs = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    more = spark.createDataFrame([(i, "some words here") for i in range(100, 140)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (3, 1), *[(i, 0) for i in range(100, 140)]], "doc_id long, toxic int")
    toxicity_fm.learn(docs.union(more), labels, held_out=10**9)
    whole = seen["n"]
    assert whole == 41
    toxicity_fm.learn(docs.union(more), labels, held_out=10**9, most_bytes=4 * seen["size"] // 2)
    assert 15 <= seen["n"] < whole and seen["size"] > 0


def _plans(monkeypatch):
    """The plans of the tables that covering_simhash writes from now on, by name."""
    plans, write = {}, covering_simhash.write_and_reload

    def note(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(covering_simhash, "write_and_reload", note)
    return plans


def test_simhash_buckets_and_row_hashes_are_not_broadcast(spark, monkeypatch):
    plans = _plans(monkeypatch)
    # a file far below the broadcast threshold, as Spark also takes it for after the explode by 31 masks
    prints = covering_simhash.write_and_reload(spark.range(2000).select(F.xxhash64("id").alias("fp")), "prints")
    plan = covering_simhash.links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    rows = [(i, f"{i} the cat sat on mat {i * i}") for i in range(40)] * 2
    kept = covering_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == len({r.doc_id for r in kept}) and kept
    assert "SortMergeJoin [_keep#" in plans["simhash-keep"] and "BroadcastHashJoin [_keep#" not in plans["simhash-keep"]


def test_simhash_rows_that_repeat_are_not_broadcast(spark):
    # few values, so the table of fingerprints is small on disk however many rows it has
    docs = spark.range(100_000, numPartitions=4).select(
        (F.col("id") % 5).alias("doc_id"), F.concat(F.lit("the cat number "), (F.col("id") % 3).cast("string")).alias("text"))
    found = covering_simhash.near_duplicates(docs)
    rows = found.collect()
    assert len(rows) == 100_000 and len(set(rows)) == 15 and all(r.component_id is not None for r in rows)
    # the plan as it ran, the join of the rows first
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [fp#" in line]
    assert joins and "BuildLeft" not in joins[0]
