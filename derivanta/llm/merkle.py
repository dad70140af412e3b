"""A Merkle manifest of a dataset: a tree of rows for each group, and one tree over the groups' roots.

Every level is one window: its partitions are the runs of consecutive nodes (group, place div
fanout), and the ordered list over the run's whole frame gives both the parent's preimage
and each node's siblings. One row of each run goes on as a node of the next level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.numbering import numbered
from .common import Scratch

FANOUT = 16
_SIDES = "struct<before:string,after:string>"


def sha(text: Column) -> Column:
    """Lowercase hex digest of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """- for null, else the number of UTF-8 bytes, a colon and the value, so that no two rows read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return sha(F.concat(*[field(v) for v in values]))


def runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """nodes (group, place, hash, n and more) with up (the parent's place), above (its digest) and sides: the
    siblings' digests before and after the node, null if it is alone in its group."""
    nth = F.col("place") % fanout
    frame = Window.partitionBy("group", "up").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = nodes.withColumn("up", F.floor(F.col("place") / fanout)).withColumn("_run", F.collect_list("hash").over(frame))
    before = F.array_join(F.slice("_run", F.lit(1), nth.cast("int")), "")
    after = F.array_join(F.slice("_run", (nth + 2).cast("int"), F.lit(fanout)), "")
    sides = F.when(F.col("n") > 1, F.struct(before.alias("before"), after.alias("after")))
    return listed.withColumn("sides", sides).withColumn("above", sha(F.array_join("_run", ""))).drop("_run")


class Forest:
    """Trees over written nodes (group, place, hash, n and more). levels[k] holds the nodes of level k; a group
    whose level k is one node has its root there, and no nodes above."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, fanout: int = FANOUT):
        self.fanout, self.levels = fanout, [nodes]
        most = nodes.agg(F.max("n")).first()[0] or 0
        while most > 1:
            made = runs(self.levels[-1].select("group", "place", "hash", "n").where("n > 1"), fanout)
            # A run's nodes agree on the parent: the first of them stands for it.
            parents = made.where(F.col("place") % fanout == 0).select("group", F.col("up").alias("place"), F.col("above").alias("hash"), F.ceil(F.col("n") / fanout).alias("n"))
            self.levels.append(scratch.save(parents, f"level-{len(self.levels)}"))
            most = -(-most // fanout)

    def roots(self) -> DataFrame:
        """group, root and height, the level at which it lies."""
        each = [t.where("n = 1").select("group", F.col("hash").alias("root"), F.lit(k).alias("height")) for k, t in enumerate(self.levels)]
        return reduce(DataFrame.unionByName, each)

    def with_paths(self, over: DataFrame, scratch: Scratch) -> DataFrame:
        """The nodes of level 0 with path, their sides from level to level up to the root and then over's
        path, and over's other columns. over: group, height, path and more, one row a group.

        From the top down, each level's nodes put their sides before the path of their parent; the
        nodes of level 1 are written, as all leaves meet them.
        """
        more = [c for c in over.columns if c not in ("group", "height", "path")]
        roots_at = lambda k: over.where(F.col("height") == k).select("group", F.lit(0).cast("long").alias("up"), F.col("path").alias("rest"), *more)
        above = roots_at(len(self.levels) - 1)
        for k in range(len(self.levels) - 2, -1, -1):
            nodes = self.levels[k]
            if k == 0:
                above = scratch.save(above.unionByName(roots_at(0)), "paths")
            made = runs(nodes if k == 0 else nodes.where("n > 1"), self.fanout).join(above, ["group", "up"])
            path = F.when(F.col("sides").isNull(), F.col("rest")).otherwise(F.concat(F.array("sides"), "rest"))
            if k == 0:
                return made.select(*nodes.columns, path.alias("path"), *more)
            # A root at this level is no run's node: it joins here, for the nodes under it.
            above = made.select("group", F.col("place").alias("up"), path.alias("rest"), *more).unionByName(roots_at(k))
        # All groups have a single node.
        return self.levels[0].join(above.withColumnRenamed("rest", "path").drop("up"), "group")


def manifest(leaves: DataFrame, group: str, order: list[str], leaf: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """The columns of leaves, and subroot, root and siblings: an array of (before, after), the digests on
    both sides of the node's own in its run, from the leaf's level up to the root. A level
    in which the node is alone in its tree has no entry.

    leaves holds a digest per row (column leaf). Rows of a group (null is one, before all others)
    ascend by order, nulls first, ties by their digest; every fanout consecutive nodes, fewer
    in the last run, become the digest of their digests, until one is left: subroot. The
    subroots, by group, make the root in the same way. An empty table gives no rows. Columns of
    leaves may not be named subroot, root or siblings; any other name may occur.

    Rows are dealt by ranges and by runs, never by group, so that one group may hold most rows.
    Digests move, texts don't; a leaf meets the path of its parent, which is written once for all its leaves.
    """
    if clash := {"subroot", "root", "siblings"} & {c.lower() for c in leaves.columns}:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    scratch = Scratch(leaves.sparkSession, "merkle")
    carried = F.struct(*[F.col(f"`{c}`") for c in leaves.columns]).alias("row")
    own = scratch.save(leaves.select(field(F.col(f"`{group}`")).alias("group"), F.col(f"`{group}`").alias("name"), *[F.col(f"`{c}`").alias(f"by{i}") for i, c in enumerate(order)], F.col(f"`{leaf}`").alias("hash"), carried), "leaves")
    nodes = scratch.save(numbered(own, "group", [*[f"by{i}" for i in range(len(order))], "hash"], scratch).select("group", "place", "hash", "n", "name", "row"), "nodes")
    trees = Forest(nodes, scratch, fanout)
    names = nodes.where("place = 0").select(F.col("group").alias("part"), "name")
    subroots = trees.roots().withColumnsRenamed({"group": "part", "root": "subroot", "height": "high"}).join(names, "part").withColumn("group", F.lit(""))
    tops = scratch.save(numbered(scratch.save(subroots, "subroots"), "group", ["name"], scratch).withColumn("hash", F.col("subroot")), "tops")
    top = Forest(tops, scratch, fanout)
    none = F.array().cast(f"array<{_SIDES}>").alias("path")
    over = top.with_paths(top.roots().select("group", "height", none, "root"), scratch)
    over = scratch.save(over.select(F.col("part").alias("group"), F.col("high").alias("height"), "path", "subroot", "root"), "over")
    return trees.with_paths(over, scratch).select("row.*", "subroot", "root", F.col("path").alias("siblings"))


def proof_hash(siblings: Column) -> Column:
    """Digest of the siblings' digests, level by level up to the root, left to right."""
    return sha(F.array_join(F.transform(siblings, lambda s: F.concat(s["before"], s["after"])), ""))


def fold(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf gives with these siblings."""
    return F.aggregate(siblings, leaf, lambda acc, s: sha(F.concat(s["before"], acc, s["after"])))
