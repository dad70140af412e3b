"""What several operators share: names that don't clash and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, shared_dir  # noqa: F401


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores added until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(a, b) links of long nodes -> (node, component): component is the smallest node
    reachable. Nodes without a link to another node are left out; links with a null end or
    to the node itself say nothing. No links: no rows.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which take a number
    of rounds logarithmic in the longest path. Each step is one aggregation, with partial
    sums on the map side so that a hub's links meet as one row a task, and one join that
    AQE may split; each round is written out, so lost executors cost one round at most.
    """
    a, b = F.col("a"), F.col("b")
    edge = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edge = scratch.save(edge, "edges")
    mark = _mark(edge)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = edge.select("u", "v").unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        new = scratch.save(small, "edges")
        scratch.drop(edge)
        edge, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edge.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edge: DataFrame) -> tuple:
    """A count and an order-free sum of hashes: equal when the links are."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edge.agg(F.count("*"), F.sum(h)).first())
