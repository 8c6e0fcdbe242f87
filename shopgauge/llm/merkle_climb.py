"""Merkle manifest of a table, verified by a recursive query that climbs from every leaf.

Building: each row is a leaf, each tree (a source) takes runs of ``FANOUT``
nodes up to one node, and the trees' tops form one more tree.  ``RUNG`` levels
are built at a time: a block of FANOUT^RUNG (729)
neighbours is one bounded group.
A block's nodes are stored as rows with the hashes of their siblings in each
of the block's levels and a link to the node over the block.

Climbing: ``WITH RECURSIVE`` starts with every leaf's (perhaps tampered) hash;
a step joins a climber to the node row that its link names, appends the
siblings to its proof and folds them into its hash.  A step takes RUNG levels,
as Spark writes all climbers anew in each step: level by level, proofs of
0.5 million documents would be moved some 14 times, which is over three times
the size of their texts.  Node rows of rungs with at most ``BROADCAST_NODES``
are broadcast (no shuffle, and no hot key near the root); in rungs beyond that
a node has few climbers compared with the rows, so those join by shuffle.

Hashes are kept as 32 bytes and enter digests as lowercase hex.

* Null fields are hashed as ``-``; rows with a null tree value form the first
  tree.  Rows of equal id are ordered by their hashes, equal rows are leaves
  of their own.
* An empty table has no leaf and no root (None).
* Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_and_reload
from .ranks import group_numbers, numbered

FANOUT = 3
RUNG = 6
BLOCK = FANOUT ** RUNG
#: Node rows (some 350 bytes each) that are broadcast.
BROADCAST_NODES = 100_000
#: The tree over all trees.
TOP = -1


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in fields]), 256))


def hex_of(value: str | Column) -> Column:
    return F.lower(F.hex(value))


def leaves(rows: DataFrame, columns: list[str], id_col: str, tree_col: str,
           changed: dict[str, Column] | None = None) -> DataFrame:
    """(id, tree, leaf, start): each row's leaf hash and the one that its climb starts with.

    ``changed`` has other values of some columns, as a tamperer would leave them.
    """
    now = {c: F.col(f"`{c}`") for c in columns}
    return rows.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.concat(F.lit("+"), F.col(f"`{tree_col}`").cast("string")), F.lit("")).alias("tree"),
        digest(list(now.values())).alias("leaf"), digest(list((now | (changed or {})).values())).alias("start"))


@dataclass
class Manifest:
    """``leaf_rows``: climbers at their start.  ``nodes``: node rows above the lowest rung."""

    leaf_rows: DataFrame
    nodes: DataFrame
    root: str | None
    source_low: int  #: rungs 1..source_low of the trees are joined by shuffle
    top_low: int  #: rungs below this one of the top tree are joined by shuffle


def _up(level: str) -> str:
    """The level over an array of hashes."""
    run = f"slice({level}, {FANOUT} * i + 1, {FANOUT})"
    joined = f"array_join(transform({run}, h -> lower(hex(h))), '')"
    return f"transform(sequence(0, (size({level}) - 1) div {FANOUT}), i -> unhex(sha2({joined}, 256)))"


def _siblings(level: int) -> str:
    """The run's others at one level for the member with index j of the block."""
    a, at = f"l{level}", f"(j div {FANOUT ** level})"
    first = f"({at} div {FANOUT} * {FANOUT})"
    glue = "X'', (all, h) -> all || h"
    return (f"struct(aggregate(slice({a}, {first} + 1, {at} - {first}), {glue}) AS left, "
            f"aggregate(slice({a}, {at} + 2, {first} + {FANOUT} - 1 - {at}), {glue}) AS right)")


def _blocks(level: DataFrame, name: str) -> DataFrame:
    """Blocks of a level (tree, pos, hash, n, more): members with their paths, and the hash over them.

    ``n`` is the number of the tree's nodes at this level; ``more`` is carried along.
    """
    found = (level.groupBy("tree", F.expr(f"pos div {BLOCK}").alias("block"))
             .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "hash", "more"))).alias("members")))
    found = found.withColumn("l0", F.expr("transform(members, m -> m.hash)"))
    for k in range(RUNG):
        found = found.withColumn(f"l{k + 1}", F.expr(_up(f"l{k}")))
    height = F.lit(RUNG)
    for k in reversed(range(RUNG)):
        height = F.when(F.col("n") <= FANOUT ** k, F.lit(k)).otherwise(height)
    paths = f"transform(sequence(0, size(members) - 1), j -> slice(array({', '.join(map(_siblings, range(RUNG)))}), 1, height))"
    found = found.withColumn("height", height).withColumn("paths", F.expr(paths))
    return write_and_reload(found.select(
        "tree", "block", "n", "members", "paths",
        F.expr(f"get(CASE height {' '.join(f'WHEN {k} THEN l{k}' for k in range(RUNG + 1))} END, 0)").alias("over")), name)


def _member_rows(blocks: DataFrame, rung: int) -> DataFrame:
    """A row for each member, linked to the node over its block."""
    last = F.col("n") <= BLOCK
    in_top = F.col("tree") == TOP
    rows = blocks.select("*", F.explode(F.arrays_zip("members", "paths")).alias("m"))
    return rows.select(
        "tree", F.lit(rung).cast("long").alias("rung"), F.col("m.members.pos").alias("pos"),
        F.col("m.members.hash").alias("hash"), F.col("m.members.more").alias("more"), F.col("m.paths").alias("path"),
        F.when(~last, F.col("tree")).when(~in_top, F.lit(TOP).cast("long")).alias("up_tree"),
        F.when(~last, F.lit(rung + 1).cast("long")).when(~in_top, F.lit(0).cast("long")).alias("up_rung"),
        F.when(~last, F.col("block")).when(~in_top, F.col("tree")).alias("up_pos"))


def _rungs(level: DataFrame, most: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All rungs of trees of at most ``most`` leaves, and the trees' tops (tree, hash)."""
    rungs, tops = [], None
    while True:
        blocks = _blocks(level, f"{name}-{len(rungs)}")
        rungs.append(blocks)
        done = blocks.where(F.col("n") <= BLOCK).select("tree", F.col("over").alias("hash"))
        tops = done if tops is None else tops.unionAll(done)
        if most <= BLOCK:
            return rungs, tops
        most = -(-most // BLOCK)
        level = blocks.where(F.col("n") > BLOCK).select(
            "tree", F.col("block").alias("pos"), F.col("over").alias("hash"),
            F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.lit(None).cast("string").alias("more"))


def _low(rungs: list[DataFrame], first: int, bound: int) -> int:
    """How many rungs from ``first`` on have more than ``bound`` nodes."""
    return sum((blocks.agg(F.sum(F.size("members"))).first()[0] or 0) > bound for blocks in rungs[first:])


def build(found: DataFrame, bound: int = BROADCAST_NODES) -> Manifest:
    """The manifest over ``leaves``: ordered by id in trees, trees ordered by their name."""
    rows, segments = numbered(found, "tree", [F.col("id"), F.col("leaf"), F.col("start")], "merkle-leaves")
    numbers = group_numbers(segments, "tree")
    places = write_and_reload(segments.join(numbers, "tree").select("_task", "tree", "_number", "_shift", "_size"),
                              "merkle-places")
    trees, most = places.agg(F.coalesce(F.max("_number") + 1, F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
    level = rows.join(places, ["_task", "tree"]).select(
        F.col("_number").cast("long").alias("tree"), (F.col("_at") + F.col("_shift")).alias("pos"),
        F.col("leaf").alias("hash"), F.col("_size").alias("n"), F.struct("id", "start").alias("more"))
    rungs, tops = _rungs(level, most, "merkle-rung")
    level = tops.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "hash",
                        F.lit(trees).cast("long").alias("n"), F.lit(None).cast("string").alias("more"))
    over, top = _rungs(level, trees, "merkle-top")
    root = top.select(hex_of("hash")).first()
    start = _member_rows(rungs[0], 0)
    nodes = [_member_rows(b, k) for k, b in enumerate(rungs) if k] + [_member_rows(b, k) for k, b in enumerate(over)]
    nodes = [b.drop("more") for b in nodes]
    table = nodes[0]
    for more in nodes[1:]:
        table = table.unionAll(more)
    return Manifest(start, table, root[0] if root else None, _low(rungs, 1, bound), _low(over, 0, bound))


def _fold(path: str, start: str) -> str:
    return (f"aggregate({path}, {start}, (h, s) -> "
            "unhex(sha2(concat(lower(hex(s.left)), lower(hex(h)), lower(hex(s.right))), 256)))")


def _joined(path: str) -> str:
    return f"aggregate({path}, X'', (all, s) -> all || s.left || s.right)"


def _ascend(climbers: DataFrame, nodes: DataFrame, here: str, broadcast: bool, result: str = "*") -> DataFrame:
    """Climbs while the next node is among ``here`` (a condition on tree and rung); ``result`` of it is written."""
    spark = climbers.sparkSession
    hint = "/*+ BROADCAST(n) */" if broadcast else ""
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")  # all climbers climb
    try:
        found = spark.sql(f"""
            WITH RECURSIVE climb AS (
                SELECT id, leaf, tree, rung, pos, folded, proof, subroot FROM {{climbers}}
                UNION ALL
                SELECT {hint} c.id, c.leaf, n.up_tree, n.up_rung, n.up_pos, {_fold('n.path', 'c.folded')},
                       c.proof || {_joined('n.path')},
                       CASE WHEN n.tree = {TOP} AND n.rung = 0 THEN n.hash ELSE c.subroot END
                FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.rung = n.rung AND c.pos = n.pos)
            SELECT {result} FROM climb WHERE tree IS NULL OR NOT ({here})""", climbers=climbers, nodes=nodes.where(here))
        return write_and_reload(found, "merkle-climb")
    finally:
        if before is None:
            spark.conf.unset(limit)
        else:
            spark.conf.set(limit, before)


def climb(m: Manifest, whole_proof: bool = True) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root, verified) for each leaf; hashes and proof in hex.

    ``proof`` has the siblings from the lowest level to the root (its SHA-256
    as ``proof_sha256`` if not ``whole_proof``, which writes far less);
    ``folded_root`` is what they give together with the row's ``start``.
    """
    climbers = m.leaf_rows.select(
        F.col("more.id").alias("id"), F.col("hash").alias("leaf"), F.col("up_tree").alias("tree"),
        F.col("up_rung").alias("rung"), F.col("up_pos").alias("pos"), F.expr(_fold("path", "more.start")).alias("folded"),
        F.expr(_joined("path")).alias("proof"), F.lit(None).cast("binary").alias("subroot"))
    s, t = f"tree >= 0 AND rung <= {m.source_low}", f"tree = {TOP} AND rung < {m.top_low}"
    if m.source_low:
        climbers = _ascend(climbers, m.nodes, s, broadcast=False)
    if m.top_low:
        climbers = _ascend(climbers, m.nodes, f"tree >= 0 AND rung > {m.source_low}", broadcast=True)
        climbers = _ascend(climbers, m.nodes, t, broadcast=False)
    proof = "lower(hex(proof)) AS proof" if whole_proof else "sha2(lower(hex(proof)), 256) AS proof_sha256"
    found = _ascend(climbers, m.nodes, f"NOT ({s}) AND NOT ({t})", broadcast=True, result=f"id, leaf, subroot, {proof}, folded")
    root = F.lit(m.root)
    return found.select("id", hex_of("leaf").alias("leaf"), hex_of("subroot").alias("subroot"), root.alias("root"),
                        proof.split()[-1], hex_of("folded").alias("folded_root"), (hex_of("folded") == root).alias("verified"))
