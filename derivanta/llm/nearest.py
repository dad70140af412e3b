"""Nearest neighbours by cosine: a block matrix join over int8 tiles with error bounds."""

from __future__ import annotations

from heapq import nsmallest

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch
from .vectors import cosines, matrix, unit, usable_vectors

#: Rows of a block of queries and of one of candidates; a tile is TILE of those queries.
QUERIES, CANDIDATES, TILE = 2048, 16384, 128
#: Blocks of candidates whose results meet in one merge of a level, for about ASKED queries.
FAN, ASKED = 64, 512


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit rows, the scale of each, the length of the coded row and of its error."""
    scale = np.abs(u).max(axis=1) / 127
    code = np.rint(u / scale[:, None]).astype(np.int8)
    coded = code * scale[:, None]
    return code, scale, np.sqrt((coded * coded).sum(axis=1)), np.sqrt(((u - coded) ** 2).sum(axis=1))


def _block(qs: pd.DataFrame, cs: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of one block of candidates for each query of one block."""
    if qs.empty or cs.empty:
        return pd.DataFrame({"part": [], "h1": [], "h2": [], "id": [], "score": []}).astype({"part": "int32", "h1": "int64", "h2": "int64", "id": "int64"})
    dim = int(qs["dim"].iloc[0])
    q, c, ids = matrix(qs["v"], dim), matrix(cs["v"], dim), cs["id"].to_numpy()
    qc, qscale, qlong, qerr = quantised(unit(q))
    cc, cscale, clong, cerr = quantised(unit(c))
    exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # integers that the type holds exactly
    right = cc.astype(exact).T
    out = []
    for at in range(0, len(q), TILE):
        s = slice(at, at + TILE)
        dots = (qc[s].astype(exact) @ right) * (qscale[s][:, None] * cscale[None, :])
        error = qerr[s][:, None] * clong[None, :] + qlong[s][:, None] * cerr[None, :] + qerr[s][:, None] * cerr[None, :] + 1e-9
        low = dots - error
        least = np.partition(low, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(dots), -2.0)
        for i in range(len(dots)):
            survivors = np.flatnonzero(dots[i] + error[i] >= least[i])
            score = cosines(np.broadcast_to(q[at + i], (len(survivors), dim)), c[survivors])
            best = nsmallest(k, zip((-score).tolist(), ids[survivors].tolist(), strict=True))
            out += [(at + i, x, -y) for y, x in best]
    at = [x[0] for x in out]
    return pd.DataFrame({"part": np.full(len(at), qs["y"].iloc[0], np.int32), "h1": qs["h1"].to_numpy()[at], "h2": qs["h2"].to_numpy()[at], "id": [x[1] for x in out], "score": [x[2] for x in out]})


def _merge(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of some blocks for each query of a bucket."""
    bucket, part, out = pdf["bucket"].iloc[0], pdf["part"].iloc[0], []
    for (h1, h2), g in pdf.groupby(["h1", "h2"]):
        best = nsmallest(k, zip((-g["score"]).tolist(), g["id"].tolist(), strict=True))
        out += [(bucket, part, h1, h2, x, -y) for y, x in best]
    return pd.DataFrame(out, columns=["bucket", "part", "h1", "h2", "id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors of largest cosine, other than the query's
    own id, ties to the smaller id; all of them if fewer. Exact: a candidate is passed
    over only where its error bound shows k others ahead of it.

    queries has the same columns as vectors. Vectors that are null, empty, zero or hold null or non-finite
    components, rows with null ids, and candidates of another length than the query
    take no part; repeated rows of one id count once a distinct vector. Other columns are ignored.

    Of equal vectors only the k + 1 of smallest id can be among the nearest, so a group of copies
    counts as that many candidates; equal queries are searched once, for k + 1 neighbours,
    of which each drops its own id. Blocks of queries meet blocks of candidates in
    tasks of fixed size; what leaves a task is k + 1 rows a query, and these are merged by levels: a
    task of a level gets those of FAN blocks for about ASKED queries, however many blocks there are.
    """
    scratch = Scratch(vectors.sparkSession, "nearest")
    all_rows = usable_vectors(vectors, id_col, vec_col).where("id is not null").dropDuplicates(["id", "h1", "h2"])
    order = Window.partitionBy("h1", "h2").orderBy("id")
    candidates = scratch.save(all_rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("id", "dim", "h1", "h2", "v"), "candidates")
    asked = scratch.save(usable_vectors(queries, id_col, vec_col).where("id is not null").dropDuplicates(["id", "h1", "h2"]).drop("label"), "queries")
    distinct = asked.groupBy("h1", "h2").agg(F.min("id").alias("id"))
    distinct = asked.join(distinct, ["h1", "h2", "id"])
    sizes = {side: {r["dim"]: r["n"] for r in t.groupBy("dim").agg(F.count("*").alias("n")).collect()} for side, t in (("q", distinct), ("c", candidates))}
    counts = [(d, -(-n // QUERIES), -(-sizes["c"].get(d, 0) // CANDIDATES)) for d, n in sizes["q"].items() if sizes["c"].get(d)]
    blocks = vectors.sparkSession.createDataFrame(counts, "dim int, nq int, nc int")
    mine = lambda n: F.pmod(F.xxhash64("h1", "h2", "id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = distinct.join(blocks, "dim").withColumn("x", mine("nq")).withColumn("y", each("nc")).drop("nq", "nc", "id")
    right = candidates.join(blocks, "dim").withColumn("y", mine("nc")).withColumn("x", each("nq")).drop("nq", "nc", "h1", "h2")
    row = "part int, h1 long, h2 long, id long, score double"
    tiles = left.groupBy("dim", "x", "y").cogroup(right.groupBy("dim", "x", "y")).applyInPandas(lambda a, b: _block(a, b, k + 1), row)
    buckets = sum(sizes["q"].values()) // ASKED + 1
    merged = tiles.withColumn("bucket", F.pmod(F.xxhash64("h1", "h2"), F.lit(buckets)))
    parts = max([n for _, _, n in counts], default=1)
    while True:
        merged = merged.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("bucket", "part").applyInPandas(lambda p: _merge(p, k + 1), f"bucket long, {row}")
        parts = -(-parts // FAN)
        if parts == 1:
            break
    found = asked.select(F.col("id").alias("query_id"), "h1", "h2").join(merged, ["h1", "h2"]).where("query_id <> id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
