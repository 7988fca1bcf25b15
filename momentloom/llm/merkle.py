"""A Merkle manifest of a dataset: leaf digests, one tree per group, proofs by pointer jumping.

Leaves are numbered inside their group by a range partitioning and a small table of offsets.
Blocks of consecutive nodes are hashed together up to BLOCK_LEVELS levels at a time, so a tree of
any size takes few jobs. Every node first holds the segment to its parent: the sibling there.
Self-joins then put the segment of the ancestor behind a node's own, which doubles the distance
each time, until every leaf reaches the root. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from momentloom.session import stage

#: Levels of a tree hashed in one job: a block has 2 ** BLOCK_LEVELS nodes at its lowest level.
BLOCK_LEVELS = 8
#: Bytes of a step of a segment: a mark (sibling to the left, to the right, or none) and the digest.
STEP = 33
_LEFT, _RIGHT, _NONE = b"l", b"r", b"o"
_NODE = ["tree", "level", "idx"]


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 (binary) of the values as UTF-8: each its byte count, a colon and itself; a null is ``-``."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return _hash(F.concat(*parts))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with idx (from 0 inside ``group``, by ``order``, nulls first) and n, the group's size.

    The rows are range-partitioned by (group, order) and sorted; their ids then rise with them, and
    a table with a row per (group, partition) says where each begins. No task holds a group. Rows
    equal in all of these are spread too; which of them comes first is open. The result is staged.
    """
    names = rows.columns
    keys = [group, *order, "_tie"]
    spread = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stage(spread.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    along = W.partitionBy(group).orderBy("_part")
    parts = parts.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                         F.sum("_n").over(W.partitionBy(group)).alias("n"))
    return placed.join(parts, [group, "_part"]).select(*names, (F.col("_at") - F.col("_first") + F.col("_before")).alias("idx"), "n")


def depth_of(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves: the bits of n - 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _blocks(nodes: DataFrame, base: int) -> DataFrame:
    """tree, depth, block, payload (of the block's nodes in order) and levels: the digests of level
    ``base`` to ``base`` + BLOCK_LEVELS over the block. ``nodes``: tree, depth, idx, digest, payload."""
    rows = nodes.groupBy("tree", "depth", F.shiftright("idx", BLOCK_LEVELS).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "digest", "payload"))).alias("_rows"))
    kind = "array<array<binary>>"

    def above(level: Column) -> Column:
        pair = lambda i: _hash(F.concat(_hex(F.get(level, 2 * i)), F.coalesce(_hex(F.get(level, 2 * i + 1)), F.lit(""))))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), pair)

    first = F.array(F.transform("_rows", lambda r: r["digest"])).cast(kind)
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(BLOCK_LEVELS)), first,
                         lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))).cast(kind))
    return rows.select("tree", "depth", "block", F.transform("_rows", lambda r: r["payload"]).alias("payload"), levels.alias("levels"))


def _first_step(level: Column, i: Column) -> Column:
    """Mark and sibling of node ``i`` of a block's level."""
    beside = F.get(level, F.when(i % 2 == 0, i + 1).otherwise(i - 1))
    side = F.when(i % 2 == 1, F.lit(_LEFT)).otherwise(F.lit(_RIGHT))
    return F.coalesce(F.concat(side, beside), F.concat(F.lit(_NONE), F.lit(bytes(32))))


def _nodes_of(blocks: DataFrame, base: int) -> DataFrame:
    """tree, depth, level, idx, digest, step of every node of the blocks but the leaves; step is null
    at the block's top, whose sibling lies elsewhere, and at the subroot."""
    by_level = blocks.select("tree", "depth", "block", F.posexplode("levels").alias("_k", "_level"))
    rows = by_level.select("tree", "depth", (F.col("_k") + base).alias("level"), "block", "_k",
                           F.inline(F.transform("_level", lambda d, i: F.struct(i.alias("_i"), d.alias("digest"), _first_step(F.col("_level"), i).alias("step")))))
    idx = F.expr(f"shiftleft(block, {BLOCK_LEVELS} - _k)") + F.col("_i")
    step = F.when((F.col("_k") < BLOCK_LEVELS) & (F.col("level") < F.col("depth")), F.col("step"))
    return rows.filter("level <= depth").select("tree", "depth", "level", idx.alias("idx"), "digest", step.alias("step"))


class Forest:
    """The trees over ``leaves``: tree (string, not null), idx, n, digest, payload (a struct)."""

    def __init__(self, leaves: DataFrame):
        nodes = leaves.select("tree", depth_of(F.col("n")).alias("depth"), "idx", "digest", "payload")
        self.steps: list[DataFrame] = []
        self.depth = base = 0
        while True:
            blocks = stage(_blocks(nodes, base), "merkle-blocks")
            if not base:
                self.blocks = blocks
                self.depth = blocks.agg(F.max("depth")).first()[0] or 0
            made = _nodes_of(blocks, base)
            self.steps.append(made)
            base += BLOCK_LEVELS
            if base >= self.depth:
                break
            nodes = made.filter((F.col("level") == base) & (F.col("depth") > base)).select("tree", "depth", "idx", "digest", F.lit(None).cast("struct<x:int>").alias("payload"))

    def subroots(self) -> DataFrame:
        """tree, digest of the node that remains."""
        found = [s.filter("level = depth").select("tree", "digest") for s in self.steps]
        return _union(found)

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """The payload of each leaf with path (the steps to the root), subroot and root.

        ``above``: tree, path and root of the subroots in the tree over them; without it a subroot
        is the root.
        """
        ends = self.subroots()
        if above is None:
            ends = ends.select("tree", F.lit(b"").alias("path"), F.struct(F.col("digest").alias("subroot"), F.col("digest").alias("root")).alias("end"))
        else:
            ends = ends.join(above, "tree").select("tree", "path", F.struct(F.col("digest").alias("subroot"), "root").alias("end"))
        ends = stage(ends, "merkle-ends")
        nodes = _union([s.filter(F.col("step").isNotNull()) for s in self.steps])
        no_end = F.lit(None).cast(ends.schema["end"].dataType)
        tops = _union([s.filter("level = depth").select("tree", "level", "idx") for s in self.steps]).join(ends, "tree")
        known = nodes.filter("level > 0").select(*_NODE, F.col("step").alias("path"), no_end.alias("end")).unionByName(tops.filter("level > 0").select(*_NODE, "path", "end"))
        far = stage(known, "merkle-far")
        rows = self.blocks.select("tree", "depth", "block", F.element_at("levels", 1).alias("_level"), "payload")
        rows = rows.select("tree", "depth", "block", F.inline(F.transform("payload", lambda p, i: F.struct(
            i.alias("_i"), p.alias("payload"), _first_step(F.col("_level"), i).alias("step")))))
        rows = rows.select("tree", (F.expr(f"shiftleft(block, {BLOCK_LEVELS})") + F.col("_i")).alias("idx"), "payload", "depth", "step")
        leaves = rows.filter("depth > 0").select("tree", F.lit(0).alias("level"), "idx", "payload", F.col("step").alias("path"), no_end.alias("end"))
        alone = rows.filter("depth = 0").join(ends, "tree").select("payload", "path", "end")
        reach = 1
        while reach <= self.depth:
            at = F.col("level") % (2 * reach)
            leaves = _jump(leaves, far.filter(F.col("level") == reach), reach)
            if 2 * reach <= self.depth:
                far = stage(_jump(far.filter(at == 0), far.filter(at == reach), reach), "merkle-far")
            reach *= 2
        return leaves.select("payload", "path", "end").unionByName(alone).select("payload.*", "path", "end.subroot", "end.root")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _jump(rows: DataFrame, ancestors: DataFrame, reach: int) -> DataFrame:
    """``rows``, which have come ``reach`` levels far, go on by the segments of their ancestors there,
    to where those have come. Rows that have ended find none and stay."""
    up = ancestors.select(F.col("tree").alias("_tree"), F.col("level").alias("_level"), F.col("idx").alias("_idx"), F.col("path").alias("_path"), F.col("end").alias("_end"))
    meets = (F.col("tree") == F.col("_tree")) & (F.col("level") + reach == F.col("_level")) & (F.shiftright("idx", reach) == F.col("_idx"))
    out = rows.join(up, meets, "left")
    path = F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("path", "_path"))
    return out.select(*[c for c in rows.columns if c not in ("path", "end")], path.alias("path"), F.coalesce("end", "_end").alias("end"))


def prove(rows: DataFrame, group: str, order: list[str], leaf: str) -> DataFrame:
    """``rows`` with path, subroot and root (binary) of their ``leaf`` digest (binary).

    Rows with equal ``group`` make a tree in the order of ``order`` and leaf (nulls first); a run of
    two nodes, or a last one alone, becomes the digest of their digests in hexadecimal. The trees'
    roots, by group (null first, then bytewise), make the tree of the root. A tree of one leaf is
    that leaf. Rows without rows to follow give an empty result. Rows equal in group, order and leaf
    have places of their own. Columns of ``rows`` must not be called tree, idx, n, path, subroot or root.
    """
    names = rows.columns
    keyed = rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    placed = numbered(keyed, "tree", [*order, leaf])
    trees = Forest(placed.select("tree", "idx", "n", F.col(leaf).alias("digest"), F.struct(*names).alias("payload")))
    tops = trees.subroots().select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest")
    placed = numbered(tops, "all", ["name"])
    top = Forest(placed.select(F.col("all").alias("tree"), "idx", "n", "digest", F.struct("name").alias("payload")))
    return trees.paths(top.paths().select(F.col("name").alias("tree"), "path", "root"))


def _steps(path: Column) -> Column:
    return F.floor(F.octet_length(path) / STEP).cast("int")


def _step(path: Column, k: Column) -> tuple[Column, Column]:
    """Mark and sibling (hexadecimal, empty if there is none) of step ``k`` from 1."""
    mark = F.substring(path, (k - 1) * STEP + 1, F.lit(1))
    sibling = _hex(F.substring(path, (k - 1) * STEP + 2, F.lit(STEP - 1)))
    return mark, F.when(mark == F.lit(_NONE), "").otherwise(sibling)


def fold(leaf: Column, path: Column) -> Column:
    """The root (binary) that ``leaf`` leads to along ``path``."""
    def up(digest, k):
        mark, sibling = _step(path, k)
        own = _hex(digest)
        return F.when(k > _steps(path), digest).otherwise(
            _hash(F.when(mark == F.lit(_LEFT), F.concat(sibling, own)).otherwise(F.concat(own, sibling))))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(_steps(path), F.lit(1))), leaf, up)


def siblings(path: Column) -> Column:
    """The siblings of a path in order, hexadecimal, as one text."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(_steps(path), F.lit(1))), lambda k: F.when(k > _steps(path), "").otherwise(_step(path, k)[1]))
    return F.array_join(each, "")
