"""Prefix trie of conversations, with subtree sums by the Euler-tour technique.

1. A node is a distinct sequence of first turns.  Its key is the sum of the
   hashes of (depth, turn) along it, 128 bits in four limbs: sums run on over
   task borders, so a conversation of any length is never gathered.
2. Nodes are numbered so that siblings have neighbouring numbers
   (``ranks.numbered`` by parent).  Node v has an enter arc 2v and an exit arc
   2v + 1; the arc before and the arc after each follow from the numbers.
3. List ranking: in each round arcs whose random priority is below both
   neighbours' leave the list (a third of them, never two neighbours) and their
   neighbours are linked; when few are left one task walks them; then rounds
   are undone, the last first, each arc taking its place before its successor.
   A round moves each remaining arc once, so all rounds together move about
   four times the list.
4. Arcs in tour order carry leaf counts and savings; prefix sums in blocks of
   positions give a subtree as the difference between its exit and its enter.

No step groups by anything that can be hot but by partial aggregates: a turn
that starts a third of the conversations, a node with very many children, and
a conversation with very many turns are spread over tasks.  Digests of the
conversations that end at a node take their ids in order from chunks.

* Rows without a conv_id belong to no conversation and are ignored.  Null
  roles and texts are empty, rows of equal turn are ordered by their content,
  repeated rows are turns of their own.
* An empty table has no conversation and no node, not even a root.
* Only conv_id, turn, role and text are read; further columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_and_reload
from .ranks import in_order, numbered

LIMBS = [f"k{i}" for i in range(4)]
_32 = 1 << 32
#: monotonically_increasing_id counts within a task up to this.
_TASK_ROWS = 1 << 33
ROOT_KEY = bytes(16)
EMPTY_DIGEST = hashlib.sha256().hexdigest()
#: Arcs that one task walks.
WALK = 50_000
#: Positions whose prefix sums one window makes.
POSITIONS = 1 << 15
#: Conversation ids in a chunk of a digest's input.
IDS = 4096


# ---- sequences ------------------------------------------------------------
def words(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def said() -> Column:
    """The digest of a turn's role and text."""
    role = words("role")
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, words("text")), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, said, bytes): a digest of role and text, and the text's UTF-8 bytes."""
    return (conversations.where(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("bigint").alias("conv"), "turn", said().alias("said"),
                    F.octet_length(words("text")).cast("bigint").alias("bytes")))


def branched(conversations: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(steps, convs) of conversations rebuilt on the head of their family's first.

    Conversation c has the first h turns of conversation c - c % family (all
    if it has fewer, none if it is absent) and then its own after its first h,
    where h = crc32 of its decimal id, modulo ``most`` (1: h is 0, so every
    conversation stays as it is).
    steps: (conv, depth from 1, said, bytes, _part); convs: (conv, length).
    """
    rows, segments = numbered(turns(conversations), "conv", [F.col("turn"), F.col("said")], "trie-turns")
    heads_len = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    sizes = segments.where("_before = 0").select("conv", F.col("_size").alias("size"), heads_len.alias("h"))
    found = rows.join(segments.select("_task", "conv", "_shift"), ["_task", "conv"]).withColumn("at", F.col("_at") + F.col("_shift"))
    heads = (found.where(F.col("at") < most - 1).groupBy(F.col("conv").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("at", "said", "bytes"))).alias("head")))  # at most most - 1 turns
    based = sizes.withColumn("base", F.expr(f"conv - conv % {family}")).join(heads, "base", "left")
    based = write_and_reload(based.select(
        "conv", "h", "size", F.expr("slice(coalesce(head, array()), 1, cast(h as int))").alias("head")), "trie-heads")
    taken = F.size("head").cast("bigint")
    convs = based.select("conv", (taken + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length"))
    first = (based.select("conv", F.posexplode("head").alias("i", "t"))
             .select("conv", (F.col("i") + 1).cast("bigint").alias("depth"), "t.said", "t.bytes", F.lit(-1).alias("_part")))
    places = segments.join(based.select("conv", "h", taken.alias("taken")), "conv").select("_task", "conv", "_shift", "h", "taken")
    own = (rows.join(places, ["_task", "conv"]).withColumn("at", F.col("_at") + F.col("_shift")).where("at >= h")
           .select("conv", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("depth"), "said", "bytes",
                   F.col("_task").alias("_part")))
    return first.unionByName(own), convs


# ---- nodes ----------------------------------------------------------------
def _key(limbs: list[Column]) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(c), 8, "0") for c in limbs]))


def members(steps: DataFrame) -> DataFrame:
    """(conv, depth, key, parent, bytes, said): the node of each step.  ``_part`` rises with depth in a conversation."""
    mixed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("said")), 256)
    rows = steps.withColumn("_mix", mixed)
    for i, k in enumerate(LIMBS):
        rows = rows.withColumn(k, F.conv(F.substring("_mix", 8 * i + 1, 8), 16, 10).cast("bigint"))
    here = Window.partitionBy("_part", "conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_part", "conv").agg(*[F.sum(k).alias(k) for k in LIMBS])
    before = before.select("_part", "conv", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_{k}") for k in LIMBS])
    rows = rows.select("_part", "conv", "depth", "said", "bytes", *LIMBS, *[F.sum(k).over(here).alias(f"s{k}") for k in LIMBS])
    rows = rows.join(before, ["_part", "conv"])
    total = [(F.col(f"s{k}") + F.col(f"_{k}")) % _32 for k in LIMBS]
    parent = [(t - F.col(k) + _32) % _32 for t, k in zip(total, LIMBS)]
    return rows.select("conv", "depth", "said", "bytes", _key(total).alias("key"), _key(parent).alias("parent"))


def _dense(rows: DataFrame) -> DataFrame:
    """(_task, _base): what makes a row's place in its task a number over all rows, from 0."""
    per = rows.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    return per.select("_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))


def _in_task(at: str) -> Column:
    return F.col(at) % F.lit(_TASK_ROWS)


def nodes(found: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes, numbered (``no``, the root 0) with their places among their siblings and their children's numbers."""
    inner = found.groupBy("key").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                     F.max("depth").alias("depth"), F.max("bytes").alias("bytes"),
                                     F.max("parent").alias("parent"), F.max("said").alias("said"))
    rows, segments = numbered(inner, "parent", [F.col("conv_id")], "trie-nodes")
    base = _dense(rows)  # one row for each task of the sort
    segments = segments.join(base, "_task")
    ranges = (segments.where("_before = 0")
              .select("parent", (F.col("_base") + _in_task("_first") + 1).alias("first_child"), F.col("_size").alias("n_children")))
    rows = rows.join(base, "_task").withColumn("no", F.col("_base") + _in_task("_at") + 1).drop("_base")
    root = (convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
            .select(F.lit(ROOT_KEY).alias("key"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("depth"),
                    F.lit(0).cast("bigint").alias("bytes"), F.lit(None).cast("binary").alias("parent"),
                    F.lit(None).cast("binary").alias("said"), F.lit(None).cast("int").alias("_task"),
                    F.lit(None).cast("bigint").alias("_at"), F.lit(0).cast("bigint").alias("no")))
    ranges = ranges.withColumnRenamed("parent", "key")
    every = write_and_reload(rows.unionByName(root).join(ranges, "key", "left"), "trie-ranged")
    up = every.where("n_children > 0").select(F.col("key").alias("parent"), F.col("no").alias("up"),
                                              F.col("conv_id").alias("parent_conv_id"))
    # a parent's row goes to the tasks that have its children, and there to them
    up = segments.select("_task", "parent", "_shift", "_size").join(up, "parent")
    every = every.join(up, ["_task", "parent"], "left")
    place = F.col("_at") + F.col("_shift")
    return write_and_reload(every.select(
        "no", "key", "conv_id", "depth", "n_convs", "bytes", "said", "parent_conv_id", "up", "first_child",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), (place == 0).alias("is_first"),
        (place == F.col("_size") - 1).alias("is_last")), "trie-numbered")


# ---- the tour -------------------------------------------------------------
def arcs(numbered_nodes: DataFrame) -> DataFrame:
    """(id, pred, next): the Euler tour as a linked list."""
    no, up, first, leaf = F.col("no"), F.col("up"), F.col("first_child"), F.col("n_children") == 0
    enter = numbered_nodes.select(
        (2 * no).alias("id"),
        F.when(up.isNull(), None).when(F.col("is_first"), 2 * up).otherwise(2 * no - 1).alias("pred"),
        F.when(leaf, 2 * no + 1).otherwise(2 * first).alias("next"))
    leave = numbered_nodes.select(
        (2 * no + 1).alias("id"),
        F.when(leaf, 2 * no).otherwise(2 * (first + F.col("n_children") - 1) + 1).alias("pred"),
        F.when(up.isNull(), None).when(F.col("is_last"), 2 * up + 1).otherwise(2 * no + 2).alias("next"))
    return enter.unionAll(leave)


def _leaves_list(k: int) -> Column:
    """Whether an arc leaves the list in round k: never the ends, never two neighbours."""
    mine, before, after = (F.xxhash64(F.col(c), F.lit(k)) for c in ("id", "pred", "next"))
    inside = F.col("pred").isNotNull() & F.col("next").isNotNull()
    return F.coalesce(inside & (mine < before) & (mine < after), F.lit(False))


def _contracted(arcs_: DataFrame, k: int) -> DataFrame:
    gone = _leaves_list(k)
    empty = F.lit(None).cast("bigint")
    keeps = F.struct("id", "pred", "next", empty.alias("new_pred"), empty.alias("new_next"), "w")
    to_pred = F.struct(F.col("pred").alias("id"), empty.alias("pred"), empty.alias("next"), empty.alias("new_pred"),
                       F.col("next").alias("new_next"), F.col("w"))
    to_next = F.struct(F.col("next").alias("id"), empty.alias("pred"), empty.alias("next"),
                       F.col("pred").alias("new_pred"), empty.alias("new_next"), F.lit(0).cast("bigint").alias("w"))
    told = arcs_.select(F.explode(F.when(gone, F.array(to_pred, to_next)).otherwise(F.array(keeps))).alias("m")).select("m.*")
    return told.groupBy("id").agg(F.coalesce(F.max("new_pred"), F.max("pred")).alias("pred"),
                                  F.coalesce(F.max("new_next"), F.max("next")).alias("next"), F.sum("w").alias("w"))


def _walk(found):
    """Places of the arcs of one short list."""
    import pandas as pd

    after = dict(zip(found["id"].tolist(), zip(found["next"].tolist(), found["w"].tolist())))
    at, place, ids, places = int(found["id"][found["pred"] < 0].iloc[0]), 0, [], []
    while at >= 0:
        ids.append(at)
        places.append(place)
        at, w = after[at]
        place += w
    return pd.DataFrame({"id": ids, "place": places})


def list_ranks(links: DataFrame, walk: int = WALK) -> DataFrame:
    """(id, place from 0) of each element of one linked list (id, pred, next); the ends have nulls.  An empty list has none."""
    rounds = [write_and_reload(links.withColumn("w", F.lit(1).cast("bigint")), "tour")]
    while rounds[-1].count() > walk:
        rounds.append(write_and_reload(_contracted(rounds[-1], len(rounds)), "tour"))
    few = rounds[-1].select(F.lit("all").alias("list"), "id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("pred", "next")], "w")
    places = few.groupBy("list").applyInPandas(_walk, "id bigint, place bigint")
    for k in reversed(range(1, len(rounds))):
        gone = rounds[k - 1].where(_leaves_list(k)).select("id", F.col("next").alias("_next"), "w")
        places = write_and_reload(places, "tour-places")
        back = gone.join(places.select(F.col("id").alias("_next"), "place"), "_next")
        places = places.unionByName(back.select("id", (F.col("place") - F.col("w")).alias("place")))
    return write_and_reload(places, "tour-places")


def _before(sums: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, columns): totals of all earlier keys, by windows of at most POSITIONS rows below one over their totals."""
    group = F.expr(f"{key} div {POSITIONS}")
    rows = sums.withColumn("_group", group)
    tops = rows.groupBy("_group").agg(*[F.sum(c).alias(c) for c in columns])
    over = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # 1 row for 2^30 positions
    tops = tops.select("_group", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"_{c}") for c in columns])
    here = Window.partitionBy("_group").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(key, "_group", *[F.coalesce(F.sum(c).over(here), F.lit(0)).alias(c) for c in columns])
    return rows.join(tops, "_group").select(key, *[(F.col(c) + F.col(f"_{c}")).alias(f"_{c}") for c in columns])


def subtree_sums(places: DataFrame, weights: DataFrame) -> DataFrame:
    """(no, enter, leave, n_leaves, saved): prefix sums at a node's exit less those before its enter.

    weights: (no, leaf, save) of each node itself, counted at its enter arc.
    """
    tour = places.groupBy(F.expr("id div 2").alias("no")).agg(F.min("place").alias("enter"), F.max("place").alias("leave"))
    rows = tour.join(weights, "no")
    zero = F.lit(0).cast("bigint")
    both = F.array(F.struct(F.col("enter").alias("place"), "leaf", "save", F.lit(True).alias("is_enter")),
                   F.struct(F.col("leave").alias("place"), zero.alias("leaf"), zero.alias("save"), F.lit(False).alias("is_enter")))
    rows = rows.select("no", F.explode(both).alias("a")).select("no", "a.*")
    rows = write_and_reload(rows.withColumn("block", F.expr(f"place div {POSITIONS}")), "tour-arcs")
    here = Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("block").agg(F.sum("leaf").alias("leaf"), F.sum("save").alias("save"))
    rows = rows.select("*", F.sum("leaf").over(here).alias("s_leaf"), F.sum("save").over(here).alias("s_save"))
    rows = rows.join(_before(totals, "block", ["leaf", "save"]), "block")

    def difference(c: str) -> Column:
        run = F.col(f"s_{c}") + F.col(f"_{c}")
        return F.sum(F.when(F.col("is_enter"), F.col(c) - run).otherwise(run))
    return rows.groupBy("no").agg(F.min("place").alias("enter"), F.max("place").alias("leave"),
                                  difference("leaf").alias("n_leaves"), difference("save").alias("saved"))


# ---- conversations that end at a node ---------------------------------------
def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[bytes, list[int]]]:
    """(key, ids) of runs of at most ``most`` equal neighbouring keys."""
    key, ids = None, []
    for batch in batches:
        for k, i in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist()):
            if ids and (k != key or len(ids) == most):
                yield key, ids
                ids = []
            key = k
            ids.append(i)
    if ids:
        yield key, ids


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for key, ids in _runs(batches, IDS):
        rows.append({"key": key, "conv": ids[0], "ids": ",".join(map(str, ids))})
        if len(rows) == 256:
            yield pa.RecordBatch.from_pylist(rows, _CHUNK)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _CHUNK)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, run, rows = None, None, []
    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k == key:
                run.update(b",")
            else:
                if run:
                    rows.append({"key": key, "ends_sha256": run.hexdigest()})
                key, run = k, hashlib.sha256()
            run.update(ids.encode())
        if len(rows) > 4096:
            yield pa.RecordBatch.from_pylist(rows, _DIGEST)
            rows = []
    if run:
        rows.append({"key": key, "ends_sha256": run.hexdigest()})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _DIGEST)


_CHUNK = pa.schema([("key", pa.binary()), ("conv", pa.int64()), ("ids", pa.string())])
_DIGEST = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) over the ids of (key, conv), ascending and comma-joined; bounded memory for any number."""
    chunks = in_order(ends.select("key", "conv"), [F.col("key"), F.col("conv")]).mapInArrow(
        _id_chunks, "key binary, conv bigint, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "conv").mapInArrow(_digests, "key binary, ends_sha256 string")


def trie(steps: DataFrame, convs: DataFrame, walk: int = WALK) -> DataFrame:
    """A row for each node; see the module.  ``said`` is its last turn's digest, enter and leave its places in the tour."""
    found = write_and_reload(members(steps), "trie-members")
    tree = nodes(found, convs)
    save = (F.col("n_convs") - 1) * F.col("bytes")
    weights = tree.select("no", (F.col("n_children") == 0).cast("bigint").alias("leaf"), save.alias("save"))
    sums = subtree_sums(list_ranks(arcs(tree), walk), weights)
    ends = (found.join(convs, "conv").where("depth = length").select("key", "conv")
            .unionByName(convs.where("length = 0").select(F.lit(ROOT_KEY).alias("key"), "conv")))
    return (tree.join(sums, "no").join(end_digests(ends), "key", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    F.col("saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(EMPTY_DIGEST)).alias("ends_sha256"),
                    F.col("enter").alias("tour_enter"), F.col("leave").alias("tour_leave"), "said"))


def with_texts(tree: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes with the role and text of their last turn (nulls at the root)."""
    rows = conversations.select(said().alias("said"), *[words(c).alias(f"last_{c}") for c in ("role", "text")])
    rows = rows.groupBy("said").agg(F.first("last_role").alias("last_role"), F.first("last_text").alias("last_text"))
    return tree.join(rows, "said", "left")

