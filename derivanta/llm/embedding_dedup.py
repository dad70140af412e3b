"""Embedding near-duplicates by an exact metric range join over pivot cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components
from .vectors import cosines, matrix, unit, usable_vectors

#: Rows a side of one join task, and of one array operation in it.
BLOCK, TILE = 2048, 256
#: Distinct vectors looked at to choose pivots; this bounds the sample, not the join.
SAMPLE = 2048
#: What moving a copy of a vector costs, in comparisons of two vectors.
MOVE = 1000


def spread_out(sample: np.ndarray, most: int) -> np.ndarray:
    """Indexes of up to most rows, each the farthest from those before it."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(most, len(sample)):
        i = int(near.argmin())
        if near[i] > 1 - 1e-9:
            break
        chosen.append(i)
        near = np.maximum(near, sample @ sample[i])
    return np.array(chosen)


def cells(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit row, and whether the row is to be copied to each cell.

    A row y within radius of x and at home in cell j is at least as near to pivot j as to x's own
    pivot i. The triangle inequality then gives d(x, j) <= d(x, i) + 2 radius, and, for unit
    vectors, x.(i - j) <= radius |i - j|. x is copied to the cells that meet both.
    """
    dots = x @ pivots.T
    home = dots.argmax(axis=1)
    best = dots[np.arange(len(x)), home][:, None]
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    d = np.sqrt(np.maximum(2 - 2 * dots, 0))
    near = d[np.arange(len(x)), home][:, None]
    return home, (d <= near + 2 * radius + 1e-6) & (best - dots <= radius * apart + 1e-6)


def choose_pivots(sample: np.ndarray, n: float, radius: float, most: int = 512) -> np.ndarray:
    """As many pivots as make comparisons and copies cheapest for n vectors of one label, by the
    copies that the sample would need. Only the cost depends on this, never the result."""
    order = spread_out(sample, min(most, max(1, int(n // 500))))
    best, least, k = 1, n * n + MOVE * n, 2
    while k <= len(order):
        copies = cells(sample, sample[order[:k]], radius)[1].sum(axis=1).mean()
        cost = n * n * copies / k + MOVE * n * copies
        if cost < least:
            best, least = k, cost
        k *= 2
    return sample[order[:best]]


def _roots(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lowers labels over links (i, j) until each component has one label, its least."""
    while True:
        m = np.minimum(lab[i], lab[j])
        if (lab[i] == m).all() and (lab[j] == m).all():
            return
        np.minimum.at(lab, i, m)
        np.minimum.at(lab, j, m)


def _join(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    dim = int(pdf["dim"].iloc[0])
    v = matrix(pdf["v"], dim)
    u = unit(v).astype(np.float32)
    rep, mult = pdf["rep"].to_numpy(), pdf["mult"].to_numpy()
    homes, others = np.flatnonzero(pdf["home"].to_numpy()), np.flatnonzero(~pdf["home"].to_numpy())
    margin = max(1e-5, dim * 2.4e-7)
    lab = rep.copy()
    links, edges = np.zeros(len(homes), np.int64), []
    for at in range(0, len(homes), TILE):
        tile = homes[at : at + TILE]
        score = u[tile] @ u[others].T
        i, j = np.nonzero(score >= cosine - margin)
        close = score[i, j] <= cosine + margin
        i, j = tile[i], others[j]
        good = rep[i] != rep[j]
        ask = np.flatnonzero(close & good)
        good[ask] = cosines(v[i[ask]], v[j[ask]]) >= cosine
        i, j = i[good], j[good]
        links[at : at + TILE] += np.bincount(np.searchsorted(tile, i), weights=mult[j], minlength=len(tile)).astype(np.int64)
        before = lab.copy()
        _roots(lab, i, j)
        changed = np.flatnonzero(lab != before)
        edges.append(np.stack([rep[changed], lab[changed]], axis=1))
    some = np.flatnonzero(links)
    pairs = np.concatenate([np.stack([rep[homes[some]], rep[homes[some]]], axis=1), *edges])
    counts = np.concatenate([links[some], np.zeros(len(pairs) - len(some), np.int64)])
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "links": counts})


def embedding_links(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links (other rows of the same label with a cosine of at least
    the threshold, between 0 and 1) and component_id (least vec_id reachable over links).

    Rows with a null label or id, or whose vector is null, empty, zero or holds null or
    non-finite components, are linked with nothing: n_links 0, component_id their vec_id. Vectors of
    different length aren't linked. Repeated rows count each. Other columns are ignored.

    Equal vectors of a label form a class with a number of its own, which one row stands for from
    there on; rows of one id in several classes count each, and link these. Copies count
    as links but are never paired. Each class goes to its nearest pivot's cell and, as a copy,
    to those that a vector within the radius may be at home in; each cell joins by itself,
    in tasks of at most BLOCK rows a side, so no cell, label or hot vector makes a task large. A
    task gives back, for a vector, the sum of its links and, for components, at most a
    spanning forest of each tile.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    radius = float(np.sqrt(2 - 2 * cosine))
    key = ["label", "h1", "h2"]
    usable = scratch.save(usable_vectors(vectors, id_col, vec_col, label_col).where("id is not null and label is not null"), "vectors")
    classes = scratch.save(usable.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("mult")).withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = scratch.save(usable.join(classes, key).where("id = rep").dropDuplicates(["node"]).select(F.col("node").alias("rep"), "label", "dim", "mult", "v"), "reps")
    sample = reps.select("dim", "v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toPandas()
    dim = int(sample["dim"].mode().iloc[0]) if len(sample) else 0
    per_label = reps.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum(F.col("n").cast("double") ** 2), F.sum("n")).first()
    pivots = choose_pivots(unit(matrix(sample["v"][sample["dim"] == dim], dim)), per_label[0] / per_label[1], radius) if dim else None

    def place(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                rows = b.take(pa.array(at))
                if d == dim:
                    home, copied = cells(unit(matrix(rows.column(4).to_pylist(), dim)), pivots, radius)
                else:
                    home, copied = np.zeros(len(at), np.int64), np.ones((len(at), 1), bool)
                i, j = np.nonzero(copied)
                for which, cell, is_home in ((np.arange(len(at)), home, True), (i, j, False)):
                    yield pa.RecordBatch.from_arrays([*rows.take(pa.array(which)).columns, pa.array(cell.astype(np.int32)), pa.array(np.full(len(which), is_home))], names=[*rows.schema.names, "cell", "home"])

    placed = scratch.save(reps.mapInArrow(place, "rep long, label string, dim int, mult long, v binary, cell int, home boolean"), "placed")
    cell = ["label", "dim", "cell"]
    size = placed.groupBy(*cell).agg(F.ceil(F.count_if("home") / F.lit(BLOCK)).cast("int").alias("hb"), F.ceil(F.count_if(~F.col("home")) / F.lit(BLOCK)).cast("int").alias("ob"))
    own = placed.join(size.where("hb > 0"), cell)
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("hb")).otherwise(F.col("ob"))).cast("int")
    own = own.withColumn("mine", mine).withColumn("each", F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("ob")).otherwise(F.col("hb")) - 1)))
    own = own.select(*cell, F.when(F.col("home"), F.col("mine")).otherwise(F.col("each")).alias("x"), F.when(F.col("home"), F.col("each")).otherwise(F.col("mine")).alias("y"), "rep", "mult", "v", "home")
    found = scratch.save(own.groupBy(*cell, "x", "y").applyInPandas(lambda pdf: _join(pdf, cosine), "a long, b long, links long"), "found")
    # From here on ids: the classes' least ones, and those whose rows are in several classes.
    low = classes.select("node", "rep")
    edges = found.where("a <> b").select("a", "b").join(low.select(F.col("node").alias("a"), F.col("rep").alias("x")), "a").join(low.select(F.col("node").alias("b"), F.col("rep").alias("y")), "b")
    owned = usable.select("id", *key).join(classes, key).select("id", "node", "rep")
    several = owned.groupBy("id").agg(F.min("node").alias("p"), F.max("node").alias("q")).where("p < q").select("id")
    edges = edges.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(owned.join(several, "id").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    component = connected_components(edges, scratch)
    links = found.groupBy("a").agg(F.sum("links").alias("others"))
    known = classes.join(links, classes.node == links.a, "left").join(component, classes.rep == component.node, "left")
    known = scratch.save(known.select(*key, (F.col("mult") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")
    scratch.drop(classes, reps, placed, found)
    usable = usable.drop("v")
    linked = usable.select("id", *key).join(known, key).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    alone = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.lit(1).alias("one")).groupBy("vec_id").agg(F.count("one").alias("rows"))
    alone = alone.join(usable.groupBy(F.col("id").alias("i")).agg(F.count("*").alias("has")), F.col("vec_id") == F.col("i"), "left")
    missing = F.col("rows") - F.coalesce("has", F.lit(0))
    alone = alone.where(missing > 0).select(F.explode(F.sequence(F.lit(1).cast("long"), missing)).alias("_k"), "vec_id").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)
