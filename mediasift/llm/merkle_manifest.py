"""Merkle manifest of a table: a root over all rows, and for every row the proof that it belongs to that root.

Rows are leaves of one tree per group; the roots of the groups' trees are leaves of a top tree. Eight consecutive nodes
of a level become one node above them.

* The order of a group's leaves is global: one range exchange of digests (no texts), then places by counting.
* A level is one aggregation of at most eight members per key, so no group is hot however large its tree is.
* Proofs are made by pointer jumping. A node holds a pointer to an ancestor and the segment of siblings on the way there.
  A round joins the nodes with those their pointers name: pointers then reach twice as far and segments are concatenated,
  so a tree of height h takes about log2(h) rounds. At distance d a node has at most 8^d descendants at the leaves and is
  one of few; where there are few enough for Spark to see that the written table is small, it is broadcast by size.

Digests are carried as 32 bytes and hashed as lowercase hex text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import Scratch, range_sorted

FANOUT = 8
PATH = "array<struct<left:binary,right:binary>>"
TOP = -1  # number of the top tree; the groups' trees are 0, 1, ... in the order of their groups


def sha256_hex(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated strings."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (hex) of the fields: ``-`` for a null, else the count of UTF-8 bytes, ``:`` and the value (integers in decimal).

    The count makes the concatenation unambiguous: moving a character from one field to the next changes the digest.
    """
    texts = [f.cast("string") for f in fields]
    return sha256_hex(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) gives with the siblings of its ``path``: an array of ``left, right`` (bytes), lowest level first."""
    return F.aggregate(path, leaf, lambda digest, level: sha256_hex(hex_text(level["left"]), digest, hex_text(level["right"])))


def path_digest(path: Column) -> Column:
    """SHA-256 (hex) of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda level: hex_text(F.concat(level["left"], level["right"]))), "").cast("binary"), 256)


@dataclass
class Manifest:
    """``runs``: rows ``tree, level, pos, n, members`` of one table per level (first the trees of a single leaf);
    ``trees``: ``tree, level, group, n, subroot`` (bytes); ``root``: hex, None for an empty table; ``height``: that of the
    highest group tree; ``rows``: the leaves in order; ``carried``: the names of further columns.
    """

    scratch: Scratch
    runs: list[DataFrame]
    trees: DataFrame | None
    root: str | None
    height: int
    rows: DataFrame
    carried: list[str]


def _level(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """Runs of eight consecutive nodes ``tree, level, pos, n, digest`` as nodes of the next level with their members."""
    member = F.struct("pos", "digest", *carried)
    runs = nodes.groupBy("tree", F.shiftright("pos", 3).alias("up")).agg(
        F.min("level").alias("level"), F.min("n").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))
    return runs.select("tree", (F.col("level") + 1).alias("level"), F.col("up").alias("pos"), F.ceil(F.col("n") / FANOUT).alias("n"), "members")


def _raised(runs: DataFrame) -> DataFrame:
    digest = F.unhex(F.sha2(F.array_join(F.transform("members", lambda m: hex_text(m["digest"])), "").cast("binary"), 256))
    return runs.select("tree", "level", "pos", "n", digest.alias("digest"))


def _grow(scratch: Scratch, nodes: DataFrame, most: int, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Levels above ``nodes`` until every tree is one node; also those last nodes. ``most``: nodes of the largest tree."""
    levels, tops = [], []
    while most > 1:
        tops.append(nodes.where("n = 1").select("tree", "level", "pos", "digest"))
        levels.append(scratch.write(_level(nodes.where("n > 1"), carried)))
        nodes, most, carried = _raised(levels[-1]), -(-most // FANOUT), []
    last = nodes.select("tree", "level", "pos", "digest")
    for t in tops:
        last = last.unionAll(t)
    return levels, last


def build(docs: DataFrame, group: Column, order: Column, leaf: Column, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``: ``leaf`` is hex, ``group`` a string (null is a group of its own), ``order`` sorts a group.

    Groups are ordered null first, then by UTF-8 bytes. Rows of equal order are sorted by their leaf, rows that repeat
    wholly are leaves each. ``carry`` names further columns of the rows to keep with the leaves. Other columns are not
    read, whatever their names. An empty table has no root.
    """
    scratch, carry = Scratch(docs.sparkSession), carry or {}
    leaves = docs.select(group.alias("group"), order.alias("order"), F.unhex(leaf).alias("digest"), *[c.alias(f"c_{n}") for n, c in carry.items()])
    leaves = scratch.write(leaves.withColumn("salt", F.monotonically_increasing_id()))
    placed = scratch.write(range_sorted(leaves, ["group", "order", "digest", "salt"]).drop("salt"))
    scratch.drop(leaves)
    # One row per partition and group: where the group's rows of this partition begin, in the group.
    stretches = placed.groupBy("_part", "group").agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    sizes = scratch.write(stretches.groupBy("group").agg(F.sum("rows").alias("n")))
    trees = _numbered(scratch, sizes)
    stretches = scratch.write(stretches.alias("s").join(trees.alias("t"), F.col("s.group").eqNullSafe(F.col("t.group"))).select("_part", "s.group", "first", "before", "tree", "n"))
    same = (F.col("p._part") == F.col("s._part")) & F.col("p.group").eqNullSafe(F.col("s.group"))
    nodes = placed.alias("p").join(stretches.alias("s"), same).select(
        "tree", F.lit(0).alias("level"), (F.col("_row") - F.col("first") + F.col("before")).alias("pos"), "n", "digest", "order", *[f"c_{n}" for n in carry])
    largest, count = sizes.agg(F.max("n"), F.count(F.lit(1))).first()
    if not count:
        return Manifest(scratch, [], None, None, 0, placed, list(carry))
    # A tree of one leaf has no run; its leaf is kept as a run of one that is no hash, so that it carries its columns too.
    alone = F.struct("pos", "digest", "order", *[f"c_{n}" for n in carry])
    single = scratch.write(nodes.where("n = 1").select("tree", F.lit(0).alias("level"), "pos", "n", F.array(alone).alias("members")))
    levels, subroots = _grow(scratch, nodes, largest, ["order", *[f"c_{n}" for n in carry]])
    subroots = scratch.write(subroots.join(trees, "tree").select("tree", "level", "group", "n", F.col("digest").alias("subroot")))
    height = len(levels)
    tops = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(height).alias("level"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("n"), F.col("subroot").alias("digest"))
    upper, last = _grow(scratch, tops, count, [])
    root = last.select(hex_text(F.col("digest"))).first()[0]
    return Manifest(scratch, [single, *levels, *upper], subroots, root, height, placed, list(carry))


def _numbered(scratch: Scratch, groups: DataFrame) -> DataFrame:
    """``tree, group, n``: the groups, however many they are, numbered in order."""
    placed = scratch.write(range_sorted(groups, ["group"]))
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = parts.select("_part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    return scratch.write(placed.join(offsets, "_part").select((F.col("before") + F.col("_row")).alias("tree"), "group", "n"))


def _members(runs: DataFrame, hashed: bool) -> DataFrame:
    """The members of runs as nodes, each with the pointer to its run and the segment of siblings up to it.

    A run that is not ``hashed`` is the single leaf of its tree itself, at the same level and with no siblings.
    """
    digests = F.transform("members", lambda m: m["digest"])
    exploded = runs.select("tree", "level", "pos", digests.alias("digests"), F.posexplode("members").alias("at", "m"))
    segment = F.struct(_joined(F.slice("digests", 1, F.col("at"))).alias("left"), _joined(F.slice("digests", F.col("at") + 2, FANOUT)).alias("right"))
    path = F.array(segment) if hashed else F.array()
    up = F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("pos").alias("up_pos")
    return exploded.select("tree", (F.col("level") - int(hashed)).alias("level"), F.col("m.pos").alias("pos"), "m", *up, path.cast(PATH).alias("path"))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda joined, d: F.concat(joined, d))


def proofs(m: Manifest) -> DataFrame:
    """``order, leaf, group, subroot, path`` (leaf and subroot as hex) and the carried columns, for every leaf.

    ``path`` leads from the leaf through its group's root to the root; :func:`fold` and :func:`path_digest` read it.
    """
    own = [F.col(f"c_{n}").alias(n) for n in m.carried]
    if m.root is None:
        nothing = F.lit(None).cast("string").alias("subroot"), F.array().cast(PATH).alias("path")
        return m.rows.select("order", hex_text(F.col("digest")).alias("leaf"), "group", *nothing, *own)
    single, levels, upper = m.runs[0], m.runs[1 : 1 + m.height], m.runs[1 + m.height :]
    keys, pointer, kept = ["tree", "level", "pos"], ["up_tree", "up_level", "up_pos"], ["tree", "digest", "order", *[f"c_{n}" for n in m.carried]]
    bottom = [_members(single, False)] + [_members(runs, True) for runs in levels[:1]]
    leaves = _union([part.select("tree", "m.*", *pointer, "path").select(*kept, *pointer, "path") for part in bottom])
    # A group's root points to the member of the top tree that it is.
    to_top = F.lit(TOP).cast("long").alias("up_tree"), F.lit(m.height).alias("up_level"), F.col("tree").alias("up_pos")
    bridge = m.trees.select("tree", "level", F.lit(0).cast("long").alias("pos"), *to_top, F.array().cast(PATH).alias("path"))
    inner = _union([bridge, *[_members(runs, True).select(*keys, *pointer, "path") for runs in [*levels[1:], *upper]]])
    reached = f"up_tree = {TOP} AND up_level = {m.height + len(upper)} AND up_pos = 0"
    steps = max(m.height, 1) + 1 + len(upper)  # from the lowest leaf to the root
    done, distance = [], 1
    while distance < steps:
        # Only nodes that high are pointed at from this distance; the roots of trees of one leaf are as low as leaves.
        ancestors = m.scratch.write(inner.where(f"tree = {TOP} OR level >= {distance} OR level = 0"))
        done.append(leaves.where(reached))
        leaves = _jump(leaves.where(f"NOT ({reached})"), ancestors, kept)
        if 2 * distance < steps:
            leaves = m.scratch.write(leaves)
            inner = _jump(ancestors.where(f"NOT ({reached})"), ancestors, keys).unionAll(ancestors.where(reached).select(*keys, *pointer, "path"))
        distance *= 2
    named = m.trees.select("tree", "group", hex_text(F.col("subroot")).alias("subroot"))
    return _union([*done[1:], leaves]).join(named, "tree").select("order", hex_text(F.col("digest")).alias("leaf"), "group", "subroot", "path", *own)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def _jump(nodes: DataFrame, ancestors: DataFrame, kept: list[str]) -> DataFrame:
    """Nodes whose pointers go as far again as those of the nodes they name, with both segments."""
    far = ancestors.select(F.col("tree").alias("a_tree"), F.col("level").alias("a_level"), F.col("pos").alias("a_pos"),
                           F.col("up_tree").alias("f_tree"), F.col("up_level").alias("f_level"), F.col("up_pos").alias("f_pos"), F.col("path").alias("f_path"))
    on = (F.col("up_tree") == F.col("a_tree")) & (F.col("up_level") == F.col("a_level")) & (F.col("up_pos") == F.col("a_pos"))
    joined = nodes.join(far, on)
    return joined.select(*[F.col(k) for k in kept], F.col("f_tree").alias("up_tree"), F.col("f_level").alias("up_level"), F.col("f_pos").alias("up_pos"),
                         F.concat("path", "f_path").alias("path"))
