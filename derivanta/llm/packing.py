"""Packing documents into sequences by a linear grouping scheme over the histogram of lengths.

Lengths are integers of at most the capacity, so the whole plan follows from one count per length:
a few thousand numbers, however many documents there are. The plan says which places exist
for each length; each document takes the place of its rank among those of its length.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .arrow_text import slices, texts
from .chunk_tokens import cached_library_codec
from .common import Scratch


def cut_pieces(docs: DataFrame, tokenizer: str, pattern: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", added: bool = True) -> DataFrame:
    """doc_id, piece (from 0), start, length, ids (binary, little-endian unsigned 32-bit).

    A document is its tokens and the end id. One longer than the capacity is cut into pieces of
    exactly that length, but for the first, which takes what is left over. Null and empty
    texts hold the end id only; null ids and repeated rows stay; other columns are ignored.
    added: strings of the file's added tokens in a text are these tokens (see library_codec).
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    last = array("I", [end_id]).tobytes()

    def run(batches) -> Iterator[pa.RecordBatch]:
        codec = cached_library_codec(tokenizer, pattern, added)
        for b in slices(batches, 1):
            row, piece, start, ids = [], [], [], []
            for i, t in enumerate(texts(b, 1)):
                all_ids = codec.encode(t) + last
                n = len(all_ids) // 4
                first = (n - 1) % capacity + 1
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    ids.append(all_ids[4 * at : 4 * (at + capacity if k else first)])
            length = [len(x) // 4 for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary")


def _fill(room: int, sizes: list[int], left: list[int]) -> list[int]:
    """Indexes (with repeats) of sizes, each used at most left times, that fill room best; larger
    sizes are tried first."""
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    via = np.full(room + 1, -1, np.int64)
    for i, s in enumerate(sizes):
        if s > room or not left[i]:
            continue
        fresh = reach
        for _ in range(min(left[i], room // s)):
            moved = np.zeros_like(reach)
            moved[s:] = fresh[:-s]
            fresh = moved & ~reach
            if not fresh.any():
                break
            via[fresh] = i
            reach = reach | fresh
        if reach[room]:
            break
    at = int(np.flatnonzero(reach)[-1])
    used = []
    while at:
        used.append(int(via[at]))
        at -= sizes[used[-1]]
    return used


def plan_sequences(counts: dict[int, int], capacity: int, groups: int = 256, small: int | None = None) -> list[tuple[list[int], int]]:
    """(lengths in one sequence, number of such sequences) for counts documents of each length.

    1. Lengths over small (a third of the capacity unless given), in falling order, form groups of
       equal cardinality; each is rounded up to its group's largest.
    2. Configurations of these few sizes: for the largest left, the sizes that fill the rest
       of a sequence best, used as often as all of them last.
    3. The documents' own lengths take the places of their group.
    4. Small ones, in falling order, go where they leave least room, or into new sequences; they fill
       what the rounding left over as well.
    """
    small = capacity // 3 if small is None else small
    plan: list[tuple[list[int], int]] = []
    large = sorted((n for n, c in counts.items() if n > small and c), reverse=True)
    share = -(-sum(counts[n] for n in large) // groups)
    sizes, left, members = [], [], []
    for n in large:
        c = counts[n]
        while c:
            if not sizes or left[-1] == share:
                sizes.append(n)
                left.append(0)
                members.append([])
            take = min(c, share - left[-1])
            left[-1] += take
            members[-1].append([n, take])
            c -= take
    g = 0
    while g < len(sizes):
        if not left[g]:
            g += 1
            continue
        left[g] -= 1
        config = [g, *_fill(capacity - sizes[g], sizes, left)]
        left[g] += 1
        times = min(left[i] // config.count(i) for i in set(config))
        for i in config:
            left[i] -= times
        # The runs of equal lengths that fill each place of the configuration, cut to match.
        runs = []
        for i in config:
            need, own = times, []
            while need:
                n, c = members[i][0]
                take = min(need, c)
                own.append([n, take])
                members[i][0][1] -= take
                if take == c:
                    members[i].pop(0)
                need -= take
            runs.append(own)
        while runs[0]:
            m = min(r[0][1] for r in runs)
            plan.append(([r[0][0] for r in runs], m))
            for r in runs:
                r[0][1] -= m
                if not r[0][1]:
                    r.pop(0)
    by_room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for lengths, m in plan:
        by_room[capacity - sum(lengths)].append((lengths, m))
    rooms = sorted(by_room)
    for n in sorted((n for n, c in counts.items() if n <= small and c), reverse=True):
        c = counts[n]
        while c:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each = capacity // n
                full, rest = divmod(c, each)
                made = [([n] * each, full)] * bool(full) + [([n] * rest, 1)] * bool(rest)
                c = 0
            else:
                room = rooms[at]
                lengths, m = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
                take = min(c, m)
                made = [([*lengths, n], take)] + [(lengths, m - take)] * (m > take)
                c -= take
            for lengths, m in made:
                room = capacity - sum(lengths)
                if not by_room.get(room):
                    insort(rooms, room)
                by_room[room].append((lengths, m))
    return [x for r in sorted(by_room) for x in by_room[r]]


def places(plan: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset): a document of rank r takes the
    row with the last first rank <= r, sequence first sequence + r - first rank."""
    rank: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for lengths, m in plan:
        at = 0
        for n in lengths:
            out[n].append((rank[n], sequence, at))
            rank[n] += m
            at += n
        sequence += m
    return {n: np.array(x, np.int64) for n, x in out.items()}


def pack(pieces: DataFrame, capacity: int, groups: int = 256, length_col: str = "length", id_cols: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """All columns of pieces, sequence_id (from 0) and offset (the place in the sequence, without gaps).

    Lengths are integers from 1 to capacity; a null or another length fails the job. Repeated rows
    are packed as often as they come; ties in length go by a hash of the row. Input columns named
    sequence_id or offset are replaced; any other name may occur. No pieces: no rows.
    Pieces are written once to the shared folder. The histogram (at most capacity rows)
    goes to the driver, and the places (a few thousand rows) to the tasks. Ranks come from
    counts per length and hash bucket, so a length that many documents share is spread out.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    n = F.col(f"`{length_col}`").cast("long")
    fine = F.when(n.between(1, capacity), n).otherwise(F.raise_error(F.lit("a length is null or outside 1 to the capacity")).cast("long"))
    saved = scratch.save(pieces.select(row.alias("row"), fine.alias("n"), F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias("h")), "pieces")
    counts = {r["n"]: r["c"] for r in saved.groupBy("n").agg(F.count("*").alias("c")).collect()}
    where = places(plan_sequences(counts, capacity, groups))
    buckets = max(256, sum(counts.values()) // 250_000)
    dealt = saved.withColumn("b", F.pmod("h", F.lit(buckets)).cast("int"))
    base = dealt.groupBy("n", "b").agg(F.count("*").alias("c"))
    before = Window.partitionBy("n").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("n", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("n", "b").orderBy("h", *[F.col("row")[c] for c in id_cols])
    ranked = dealt.withColumn("r", F.row_number().over(order)).join(base, ["n", "b"])
    ranked = ranked.select("row", "n", (F.col("base") + F.col("r") - 1).alias("r"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pdf = pd.DataFrame({"n": b.column(1).to_numpy(), "r": b.column(2).to_numpy()})
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for n, at in pdf.groupby("n").indices.items():
                rows, r = where[n], pdf["r"].to_numpy()[at]
                k = np.searchsorted(rows[:, 0], r, side="right") - 1
                sequence[at], offset[at] = rows[k, 1] + r - rows[k, 0], rows[k, 2]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sequence), pa.array(offset)], names=["row", "sequence_id", "offset"])

    placed = ranked.mapInArrow(run, T.StructType([saved.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    return placed.select(*[F.col("row")[c].alias(c) for c in names], "sequence_id", "offset")
