"""Merkle manifest, prefix trie and chat formatting: brute force over a small table, SQL, and edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopgauge.llm import chat_grammar as C
from shopgauge.llm import merkle_climb as M
from shopgauge.llm import prefix_trie as P
from shopgauge.llm import queries as Q
from shopgauge.llm import ranks

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_prefix_trie", "op13_chat_formatting"])
def test_query_equals_sql(spark, name):
    import compare

    df = Q.QUERIES[name](spark, DIR)
    cur = compare.duck(DIR).execute(Q.ORACLES[name])
    rows = cur.fetchall()
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert compare.digest([tuple(r) for r in df.collect()], df.columns) == compare.digest(rows, [d[0] for d in cur.description])


@pytest.fixture
def apart(spark):
    """Small partitions stay apart, so groups cross the borders of tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


# ---- positions ------------------------------------------------------------
def test_numbered(spark, apart):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(40)}", rng.choice([None, *range(30)])) for _ in range(3000)]
    rows, segments = ranks.numbered(spark.createDataFrame(rows, "g string, v int").repartition(7), "g", [F.col("v")], "t")
    got = rows.join(segments, ["_task", "g"]).select("g", "v", (F.col("_at") + F.col("_shift")).alias("p"), "_size").collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append((r.p, r.v))
        assert r._size == sum(x.g == r.g for x in got) if r.p == 0 else True
    for some in by.values():
        some.sort()
        assert [p for p, _ in some] == list(range(len(some)))
        values = [-1 if v is None else v for _, v in some]
        assert values == sorted(values)
    assert segments.where("g = 'hot'").count() > 1  # spread over tasks
    numbers = ranks.group_numbers(segments, "g").collect()
    assert [r.g for r in sorted(numbers, key=lambda r: r._number)] == sorted(by)


# ---- Merkle ---------------------------------------------------------------
def merkle_expected(rows, cut):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = defaultdict(list)
    for r in rows:
        leaf = sha("".join(field(r[c]) for c in COLUMNS))
        start = sha("".join(field(cut(r) if c == "text" else r[c]) for c in COLUMNS))
        trees[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, start, r["doc_id"]))

    def levels(hashes):
        out = [hashes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def path(tree, pos):
        for level in tree[:-1]:
            first = pos // 3 * 3
            yield "".join(level[first:pos]), "".join(level[pos + 1:first + 3])
            pos //= 3
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = [levels([x[2] for x in sorted(trees[s])]) for s in names]
    top = levels([t[-1][0] for t in built])
    out = Counter()
    for k, s in enumerate(names):
        for pos, (_, _, leaf, start, doc_id) in enumerate(sorted(trees[s])):
            steps = [*path(built[k], pos), *path(top, k)]
            folded = start
            for a, b in steps:
                folded = sha(a + folded + b)
            out[doc_id, leaf, built[k][-1][0], top[-1][0], "".join(a + b for a, b in steps), folded, folded == top[-1][0]] += 1
    return out


def cut_text(r):
    even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
    return r["text"].replace("\n", "") if even and r["text"] is not None else r["text"]


@pytest.mark.parametrize("bound", [0, 10, 10**6])
def test_merkle_against_brute_force(spark, apart, bound):
    rng = random.Random(2)
    sources = ["hot"] * 2300 + [f"s{k}" for k in range(90)] * 2 + [None] * 4 + ["é", "zz"]
    rows = [(i, f"line\n{i}" if rng.random() < 0.9 else None, rng.choice(["en", None, ""]), s, rng.choice([None, i]))
            for i, s in enumerate(sources)]
    rows += [rows[5]] * 30 + [(None, "no\nid", "en", "hot", 1), (None, None, None, None, None), (7, "tie\n", "x", "hot", 1),
                              (9999, "long \n" * 200_000, "en", "hot", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("clash") for c in ("tree", "leaf", "pos", "_task", "id", "hash", "root")})
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    changed = {"text": F.coalesce(cut, F.col("text"))}
    got = M.climb(M.build(M.leaves(docs, COLUMNS, "doc_id", "source", changed), bound=bound)).collect()
    expected = merkle_expected([dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r)) for r in rows], cut_text)
    assert Counter(tuple(r) for r in got) == expected
    assert {r.verified for r in got} == {True, False}


def test_merkle_small_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    manifest = M.build(M.leaves(none, COLUMNS, "doc_id", "source"))
    assert manifest.root is None and M.climb(manifest).count() == 0
    one = M.build(M.leaves(spark.createDataFrame([(1, "t", None, "s", 2)], none.schema), COLUMNS, "doc_id", "source"))
    r = M.climb(one).first()
    assert r.leaf == r.subroot == r.root == r.folded_root == sha("1:11:s-1:21:t") and r.proof == "" and r.verified


# ---- trie -------------------------------------------------------------------
def trie_expected(rows, family, most):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    members = defaultdict(list)
    length = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        seq = own.get(c - c % family, [])[:h] + own[c][h:]
        length[c] = len(seq)
        for k in range(len(seq) + 1):
            members[tuple(seq[:k])].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for k in range(len(n) + 1):
            leaves[n[:k]] += not children[n]
            saved[n[:k]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
    return Counter((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n],
                    sha(",".join(map(str, sorted(c for c in m if length[c] == len(n)))))) for n, m in members.items())


def trie_rows(df):
    return Counter(tuple(r)[:8] for r in df.collect())


@pytest.mark.parametrize("walk", [3, 10**6])
def test_trie_against_brute_force(spark, apart, walk):
    rng = random.Random(3)
    rows = []
    for c in range(90):
        if c % 10 == 0:
            continue  # absent bases
        for t in range(rng.randrange(1, 14)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None])))
    rows += [(200 + c, 0, "user", "hot start") for c in range(60)]  # a turn many begin with, and equal conversations
    rows += [(77, None, "user", "null turn"), (77, None, "user", "null turn"), (77, 3, "user", "tie"), (None, 1, "user", "x")]
    rows += [(500, t, "user", str(t % 3)) for t in range(400)]  # one very long conversation
    rows += [(501, 0, "user", "long " * 100_000)]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    convs = convs.withColumns({c: F.lit("clash") for c in ("conv", "depth", "said", "bytes", "no", "at", "h", "k0")})
    for most in (9, 1):
        tree = P.trie(*P.branched(convs, 5, most), walk=walk)
        assert trie_rows(tree) == trie_expected(rows, 5, most)
    places = tree.select(F.explode(F.array("tour_enter", "tour_leave")).alias("p")).collect()
    assert sorted(r.p for r in places) == list(range(2 * tree.count()))
    told = P.with_texts(tree, convs)
    assert told.count() == tree.count()
    assert told.where("depth = 0 AND last_text IS NOT NULL").count() == 0
    assert told.where("last_text = 'hot start'").first().n_convs == 60


def test_trie_small_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert P.trie(*P.branched(spark.createDataFrame([], schema))).count() == 0
    assert P.trie(*P.branched(spark.createDataFrame([(None, 1, "user", "x")], schema))).count() == 0
    # 12's head has 4 turns of an absent conversation: it is turnless
    h = zlib.crc32(b"12") % 9
    rows = [(12, t, "user", "x") for t in range(h)]
    assert h and trie_rows(P.trie(*P.branched(spark.createDataFrame(rows, schema)))) == trie_expected(rows, 5, 9)


def test_list_ranks(spark):
    order = list(range(500))
    random.Random(4).shuffle(order)
    links = [(x, order[i - 1] if i else None, order[i + 1] if i < 499 else None) for i, x in enumerate(order)]
    got = P.list_ranks(spark.createDataFrame(links, "id long, pred long, next long"), walk=5).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == order
    assert P.list_ranks(spark.createDataFrame([], "id long, pred long, next long")).count() == 0


def test_long_digests_are_chunked(spark, apart):
    ends = spark.range(30_000).select(F.lit(b"k").alias("key"), F.col("id").alias("conv")).repartition(5)
    r = P.end_digests(ends).collect()
    assert len(r) == 1 and r[0].ends_sha256 == sha(",".join(map(str, range(30_000))))


# ---- chat ---------------------------------------------------------------------
PIECES = st.lists(st.sampled_from(["\\", "### ", "###", " ", "</turn>", "</turn", ">", ": ", ":", "\n", "é", "a", "\\\\"])).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_grammar_round_trip(turns):
    text = "".join(C.render(*t) for t in turns)
    parsed = list(C.parse(text))
    assert [p[:2] for p in parsed] == turns
    assert [C.unescaped(text[s:e], C._TEXT) for *_, s, e in parsed] == [t for _, t in turns]


def test_only_conflicts_are_escaped():
    assert C.render("user", "plain \\ # text") == "### user:\nplain \\ # text\n</turn>\n"
    assert C.render("user", "\\### A </turn>") == "### user:\n\\\\### A \\</turn>\n</turn>\n"
    for broken in ("x", "### user\na\n</turn>\n", "### user:\na</turn>\n", "### user:\na", "### u:\n### a\n</turn>\n"):
        with pytest.raises(C.NotInGrammar):
            list(C.parse(broken))


def chat_expected(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, v in by.items():
        v.sort()
        loss = "".join(t for *_, role, t in v if role == "assistant")
        out[c] = (len(v), sha("".join(f"{r}\n{t}\n" for *_, r, t in v)), len(loss), sha(loss))
    return out


def test_chat_against_brute_force(spark, apart):
    bad = "\\### Assistant: </turn> ok"
    rows = [(c, t, "assistant" if t % 2 else "user", f"turn {t} {bad * (t % 3)}") for c in range(40) for t in range(c % 9 + 1)]
    rows += [(100, t, "assistant", "x" * 700) for t in range(300)]  # a conversation of many parts and tasks
    rows += [(101, None, None, None), (101, 1, "a: b\\", "\\"), (101, 2, "### ", ""), (101, 3, "assistant", "\U0001f600" * 50_000)]
    rows += [(102, 0, "assistant", "same")] * 5 + [(None, t, "assistant", "no id") for t in range(3)]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    convs = convs.withColumns({c: F.lit("clash") for c in ("part", "mask", "n_turns", "_text", "_tie")}).repartition(6)
    expected = chat_expected(rows)
    chars = None
    for most, hold, dealt in ((C.PART, C.HOLD, True), (500, 2, True), (500, 1, False)):
        parts = C.format_turns(convs, most=most)
        got = {r.conv_id: tuple(r)[1:] for r in C.read_back(parts, dealt, hold).collect()}
        assert {c: v[:4] for c, v in got.items()} == expected
        assert chars in (None, {c: v[4] for c, v in got.items()})
        chars = {c: v[4] for c, v in got.items()}
    # the mask covers each trained text once, nothing else
    for p in C.format_turns(convs).collect():
        said = [t for role, t, *_ in C.parse(p.text) if role == "assistant"]
        assert [C.unescaped(p.text[s.start:s.end], C._TEXT) for s in p.mask] == said
    assert C.read_back(C.format_turns(convs.limit(0)), dealt=True).count() == 0


def test_mask_is_checked(spark):
    parts = spark.createDataFrame([(1, 0, C.render("assistant", "abc"), [(2, 3)])], C.PARTS)
    with pytest.raises(Exception, match="no turn's text"):
        C.read_back(parts).collect()
