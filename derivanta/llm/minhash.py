"""Near-duplicates by HyperMinHash: compressed registers, banding, estimates, exact verification."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow_text import raw_bytes, slices
from .common import Scratch, connected_components

#: Registers of a document, and those in a band. At similarity 0.8 a pair shares none of the 40
#: bands with probability (1 - 0.8 ** 5) ** 40, about 1e-7.
REGISTERS, ROWS = 200, 5
MANTISSA = 10
#: A pair goes to verification if its estimate is at most this far below the threshold: five standard
#: deviations, measured at 0.8 as 0.034 at most for sets of over SMALL shingles. Smaller sets go there at once.
SLACK, SMALL = 0.17, 32
#: Members a side of a block, and the size of a key from which centres come before the comparison in full.
BLOCK, LARGE = 512, 64
#: Centres against which a member of large keys is verified first.
STARS = 3
_WINDOW, _PAIRS = 1 << 20, 1 << 14


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: For an empty register, in which order it looks for a filled one to copy.
_ORDER = _mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(1)).reshape(REGISTERS, REGISTERS).argsort(axis=1)
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_INSIDE = np.array([c != 0x20 and not 0x09 <= c <= 0x0D for c in range(256)])
#: A word's hash is the sum, over its bytes, of a number for the byte times one for its place.
_LONG = 256
_BYTE = np.where(_INSIDE, _mix(np.arange(1, 257, dtype=np.uint64)), np.uint64(0))
_PLACE = _mix(np.arange(1000, 1000 + _LONG, dtype=np.uint64)) | np.uint64(1)


def word_hashes(raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and its 64-bit hash, A-Z lower-cased; words are runs of anything but ASCII
    white space, and end where a text (raw[bounds[i] : bounds[i + 1]]) ends."""
    raw = raw.lower()
    found, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while at < len(raw):
        gap = _GAP.search(raw, at + _WINDOW) if at + _WINDOW < len(raw) else None
        end = gap.start() if gap else len(raw)
        part = np.frombuffer(raw, np.uint8, end - at, at)
        inside = _INSIDE[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, end)] - at
        first[edges] = inside[edges]
        start = np.flatnonzero(first)
        if len(start):
            place = np.arange(start[0], len(part)) - np.repeat(start, np.diff(start, append=len(part)))
            h = np.add.reduceat(_BYTE[part[start[0] :]] * _PLACE[np.minimum(place, _LONG - 1)], start - start[0])
            size = np.add.reduceat(inside[start[0] :], start - start[0], dtype=np.int64)
            for i in np.flatnonzero(size > _LONG):
                h[i] = xxhash.xxh3_64_intdigest(part[start[i] : start[i] + size[i]].tobytes())
            found.append(start + at)
            hashes.append(_mix(h + size.astype(np.uint64)))
        at = end
    return np.concatenate(found), np.concatenate(hashes)


def shingle_sets(raw: bytes, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles, one text after the other, and the bounds
    between texts. A text of fewer words than a shingle is one as a whole; one without words has none."""
    start, h = word_hashes(raw, bounds)
    at = np.searchsorted(start, bounds)
    n = np.diff(at)
    whole = np.ones(len(h), bool)
    for k in range(1, words):
        last = at[1:] - k
        whole[last[last >= at[:-1]]] = False
    grow = lambda out, more: _mix(out * np.uint64(0x9E3779B97F4A7C15) + more)
    i = np.flatnonzero(whole)
    values, owner = np.full(len(i), words, np.uint64), np.repeat(np.arange(len(n)), np.maximum(n - words + 1, 0))
    for k in range(words):
        values = grow(values, h[i + k])
    short = [(values, owner)]
    for c in range(1, words):
        who = np.flatnonzero(n == c)
        one = np.full(len(who), c, np.uint64)
        for k in range(c):
            one = grow(one, h[at[who] + k])
        short.append((one, who))
    if any(len(x) for x, _ in short[1:]):
        values, owner = (np.concatenate(x) for x in zip(*short, strict=True))
        order = owner.argsort(kind="stable")
        values, owner = values[order], owner[order]
    ends = np.searchsorted(owner, np.arange(len(n) + 1))
    for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(n) + 1))


def registers(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """uint16 registers, a row a set, of sorted distinct hashes; zeros for an empty set. A hash's top
    decides the register; the least rest is kept as its count of leading zeros and the bits after the first one."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    top = ((values >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate([[True], (top[1:] != top[:-1]) | (owner[1:] != owner[:-1])])) if len(values) else np.empty(0, np.int64)
    which = top[at].astype(np.int64)
    # Within a register the hashes run evenly over an interval: the rest, as a fraction of it.
    rest = np.minimum(np.maximum(values[at].astype(np.float64) * (REGISTERS / 2.0**64) - which, 2.0**-50), 1 - 2.0**-53)
    part, power = np.frexp(rest)
    out, filled = np.zeros((len(bounds) - 1, REGISTERS), np.uint16), np.zeros((len(bounds) - 1, REGISTERS), bool)
    out[owner[at], which] = ((-power).astype(np.int64) << MANTISSA) | ((part * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    filled[owner[at], which] = True
    some = filled.sum(axis=1)
    for i in np.flatnonzero((some > 0) & (some < REGISTERS)):
        empty = np.flatnonzero(~filled[i])
        order = _ORDER[empty]
        out[i, empty] = out[i, order[np.arange(len(empty)), filled[i][order].argmax(axis=1)]]
    return out


def chances(n: np.ndarray) -> np.ndarray:
    """For sets of these sizes, how likely a register has each count of leading zeros."""
    load = (np.maximum(n, 1) / REGISTERS)[:, None] * 0.5 ** np.arange(41)[None, :]
    return np.exp(-load[:, 1:]) - np.exp(-load[:, :-1])


def similarity(same: np.ndarray, chance_a: np.ndarray, chance_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from the share of equal registers, corrected for registers that
    are equal by chance: those of two independent sets of these sizes (see chances)."""
    chance = (chance_a * chance_b).sum(axis=1) / (1 << MANTISSA)
    return (same - chance) / (1 - chance)


def sketches(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, f1, f2 (a 128-bit hash of the whole set), regs (binary) and h (a hash of the
    text as it stands); nulls for f1, f2 and regs where there are no words."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, _WINDOW):
            values, bounds = shingle_sets(*raw_bytes(b.column(1)), words)
            n = np.diff(bounds)
            none = n == 0
            digest = b"".join([xxhash.xxh3_128_digest(values[i:j].tobytes()) for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)])
            f = np.frombuffer(digest, np.int64).reshape(-1, 2)
            regs = pa.array([None if e else r.tobytes() for e, r in zip(none.tolist(), registers(values, bounds), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f[:, 0], mask=none), pa.array(f[:, 1], mask=none), regs, b.column(2)], names=["doc_id", "n_shingles", "f1", "f2", "regs", "h"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_shingles long, f1 long, f2 long, regs binary, h long")


def _groups(batches, keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first keys columns -> tables of whole groups, a few thousand rows or one group at a time."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        change = np.zeros(b.num_rows, bool)
        for i in range(keys):
            x = b.column(i).to_numpy()
            change[1:] |= x[1:] != x[:-1]
            change[0] |= bool(held) and held[-1].column(i)[-1].as_py() != x[0]
        cut = np.flatnonzero(change)
        if not len(cut):
            held.append(t)
            continue
        if held or cut[0]:
            yield pa.concat_tables([*held, t.slice(0, cut[0])])
        if cut[-1] > cut[0]:
            yield t.slice(cut[0], cut[-1] - cut[0])
        held = [t.slice(cut[-1])]
    if held:
        yield pa.concat_tables(held)


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    change = np.ones(len(columns[0]), bool)
    change[1:] = False
    for x in columns:
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def _pairs(starts: np.ndarray, band: np.ndarray, side: np.ndarray, label: np.ndarray, n: np.ndarray, regs: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows in units that begin at starts: (i, j, estimate) of pairs within a unit that have different
    labels, sizes that allow the similarity, and a likely estimate. side: -1 in units of one block, else
    0 or 1 by the row's block. A pair that shares several bands comes out in the first one only."""
    rows = len(label)
    ends = np.repeat(np.append(starts[1:], rows), np.diff(starts, append=rows))
    chance = chances(n)
    more = ends - np.arange(rows) - 1
    before = np.concatenate([[0], np.cumsum(more)])
    row = 0
    while row < rows:
        to = max(row + 1, int(np.searchsorted(before, before[row] + _PAIRS, side="right")) - 1)
        i = np.repeat(np.arange(row, to), more[row:to])
        j = i + 1 + np.arange(len(i)) - (before[i] - before[row])
        row = to
        fine = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((side[i] < 0) | (side[i] != side[j]))
        i, j = i[fine], j[fine]
        same = regs[i] == regs[j]
        estimate = similarity(same.mean(axis=1), chance[i], chance[j])
        fine = np.flatnonzero((estimate >= percent / 100 - SLACK) | (np.minimum(n[i], n[j]) <= SMALL))
        shared = same[fine].reshape(len(fine), REGISTERS // ROWS, ROWS).all(axis=2)
        fine = fine[shared.any(axis=1) & (shared.argmax(axis=1) == band[i[fine]])]
        if len(fine):
            yield i[fine], j[fine], estimate[fine]


def _likely(units: DataFrame, percent: int) -> DataFrame:
    """(key, x, y, right, rep, label, n, regs) -> (key, x, y, a, b, la, lb, estimate) of _pairs."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            t = t.combine_chunks().to_batches()[0]
            key, x, y, right, rep, label, n = (t.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            regs = np.frombuffer(raw_bytes(t.column(7))[0], np.uint16).reshape(-1, REGISTERS)
            for i, j, estimate in _pairs(_starts([key, x, y]), key & 63, np.where(x == y, -1, right), label, n, regs, percent):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key[i], x[i], y[i], rep[i], rep[j], label[i], label[j], estimate)], names=["key", "x", "y", "a", "b", "la", "lb", "estimate"])

    return units.select("key", "x", "y", "right", "rep", "label", "n", "regs").mapInArrow(run, "key long, x int, y int, a long, b long, la long, lb long, estimate double")


def _linked(units: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, x, y, right, rep, label, text) -> (a, b): both steps in one task, for units of large keys. Their
    likely pairs are not written, only those links that join labels."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            t = t.combine_chunks().to_batches()[0]
            key, x, y, right, rep, label = (t.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            starts = _starts([key, x, y])
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                own = slice(at, end)
                if (label[own] == label[at]).all():
                    continue
                values, bounds = shingle_sets(*raw_bytes(t.column(6).slice(at, end - at)), words)
                side = np.where(x[own] == y[own], -1, right[own])
                found = [*_pairs(np.zeros(1, np.int64), key[own] & 63, side, label[own], np.diff(bounds), registers(values, bounds), percent)]
                if not found:
                    continue
                i, j, estimate = (np.concatenate(v) for v in zip(*found, strict=True))
                best = np.argsort(-estimate, kind="stable")
                labels, sets, out = Labels(), [values[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)], []
                names = label[own].tolist()
                for p, q in zip(i[best].tolist(), j[best].tolist(), strict=True):
                    la, lb = labels.of(names[p]), labels.of(names[q])
                    if la != lb and similar(sets[p], sets[q], percent):
                        labels.up[la] = lb
                        out.append((p, q))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(rep[own][[v[k] for v in out]]) for k in range(2)], names=["a", "b"])

    return units.select("key", "x", "y", "right", "rep", "label", "text").mapInArrow(run, "a long, b long")


class Labels:
    """Labels that links have joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def of(self, v: int) -> int:
        while (up := self.up.get(v, v)) != v:
            self.up[v] = self.up.get(up, up)
            v = up
        return v


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have intersection / union of at least percent / 100."""
    if not len(p) or not len(q):
        return False
    both = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def _verified(pairs: DataFrame, bodies: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """Rows of _likely -> (a, b) whose whole sets are similar enough, as many as join the labels of a unit.

    A unit's texts come once each, then its pairs, the likeliest first; a pair whose labels
    earlier pairs of the unit have joined says nothing new and is passed over.
    """
    unit = ["key", "x", "y"]
    nodes = pairs.select(*unit, "a").unionByName(pairs.select(*unit, F.col("b").alias("a"))).distinct()
    nodes = nodes.join(bodies.select(F.col("rep").alias("a"), "text"), "a").select(*unit, F.lit(0).alias("kind"), "a", *[F.lit(None).cast(t).alias(c) for c, t in (("b", "long"), ("la", "long"), ("lb", "long"), ("estimate", "double"))], "text")
    rows = nodes.unionByName(pairs.select(*unit, F.lit(1).alias("kind"), "a", "b", "la", "lb", "estimate", F.lit(None).cast("string").alias("text")))
    rows = rows.repartition(parts, *unit).sortWithinPartitions(*unit, "kind", F.desc("estimate"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        last, sets, labels = None, {}, Labels()
        for b in slices(batches, 9, _WINDOW):
            columns = [b.column(i).to_pylist() for i in range(8)]
            texts = [i for i, k in enumerate(columns[3]) if not k]
            values, bounds = shingle_sets(*raw_bytes(b.column(9).take(pa.array(texts, pa.int64()))), words)
            out, at = [], 0
            for *own, kind, i, j, la, lb in zip(*columns, strict=True):
                if own != last:
                    last, sets, labels = own, {}, Labels()
                if not kind:
                    sets[i] = values[bounds[at] : bounds[at + 1]].copy()
                    at += 1
                    continue
                la, lb = labels.of(la), labels.of(lb)
                if la != lb and similar(sets[i], sets[j], percent):
                    labels.up[la] = lb
                    out.append((i, j))
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in out], pa.int64()) for k in range(2)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles and component_id, the least doc_id reachable over
    links, itself included. Two texts are linked if their sets of distinct shingles (see
    shingle_sets) have intersection / union of at least percent / 100, by the whole sets.

    Texts without words, null and empty ones are linked with nothing and are a component by
    themselves; rows with a null id are too (component null). Rows of equal id and different
    texts count as one document that has all their links; ids may be of any type that
    has an order. Other columns are ignored, whatever their names. No rows: no rows.

    1. Texts of equal sets form a class with a number of its own; the text of least id stands for it
       (before the shuffle already, a row a task and class), so copies cost nothing from here
       on. Classes that share a doc_id are linked.
    2. Band keys of the classes' registers; keys of one class drop out.
    3. Keys of more than LARGE classes: each offers one member as its centre, and a member is verified
       against the STARS centres with which it shares most keys. Linked members get one label,
       so a large group of near copies costs a few pairs a member.
    4. All keys: members in blocks, two blocks at a time; pairs of different labels with a likely
       estimate, each in one key, are verified on the whole sets, the likeliest first, as far as
       they join labels. In large keys both happen in one task, which gets the texts and gives back
       links that join labels; in the others the registers come first, and the texts of
       likely pairs only. So no link between components is passed over, and neither a key's
       members nor its pairs ever come together.
    5. Components of all links, once.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketch = scratch.save(sketches(docs, words, id_col, text_col), "sketches")
    full = sketch.where("f1 is not null and doc_id is not null")
    first = F.row_number().over(Window.partitionBy("f1", "f2").orderBy("doc_id", "h"))
    classes = full.withColumn("k", first).where("k = 1").select("f1", "f2", F.col("n_shingles").alias("n"), "regs", F.col("doc_id").alias("low"), F.col("h").alias("low_h"))
    classes = scratch.save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    ends = [f(c).alias(f.__name__ + c) for c in ("f1", "f2") for f in (F.min, F.max)]
    several = full.groupBy("doc_id").agg(*ends).where("minf1 <> maxf1 or minf2 <> maxf2").select("doc_id")
    owned = full.join(several, "doc_id").select("doc_id", "f1", "f2").distinct().join(classes, ["f1", "f2"]).select("doc_id", "rep")
    links = [scratch.save(owned.join(owned.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a < rep").select("a", F.col("rep").alias("b")), "owned")]

    bands = REGISTERS // ROWS
    band = lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))).bitwiseAND(F.lit(-64)).bitwiseOR(i.cast("long"))
    banded = classes.select("rep", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band)).alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.save(banded.join(shared, "key"), "members")
    ids = members.select("rep").distinct().join(classes, "rep").select("rep", "low", "low_h")
    slim = docs.select(F.col(f"`{id_col}`").alias("low"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("low_h", F.xxhash64("text"))
    bodies = scratch.save(slim.join(ids, ["low", "low_h"]).select("rep", "text").dropDuplicates(["rep"]), "texts")

    large = members.where(F.col("size") > LARGE)
    label = None
    if not large.isEmpty():
        found = scratch.save(_verified(_centres(large, percent), bodies, words, percent, parts), "links")
        links.append(found)
        label = scratch.save(_labels(large.select("rep").distinct(), found), "labels")
    rest = members.where(F.col("size") <= LARGE).withColumn("label", F.col("rep"))
    if label is not None:
        held = large.join(label, "rep")
        open_keys = held.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        units = _units(held.join(open_keys, "key")).join(bodies, "rep")
        links.append(scratch.save(_linked(units.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y"), words, percent), "links"))
        rest = rest.drop("label").join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    likely = scratch.save(_likely(_units(rest).join(classes.select("rep", "regs"), "rep").repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y"), percent), "likely")
    links.append(scratch.save(_verified(likely, bodies, words, percent, parts), "links"))
    scratch.drop(likely, bodies, members, *([] if label is None else [label]))
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    component = connected_components(edges, scratch)
    least = classes.join(component, classes.rep == component.node).select("f1", "f2", "low", "component")
    least = least.join(least.groupBy("component").agg(F.min("low").alias("comp")), "component").select("f1", "f2", "comp")
    # Of a class by itself the least id is its own one.
    known = scratch.save(classes.select("f1", "f2", "low").join(least, ["f1", "f2"], "left").select("f1", "f2", F.coalesce("comp", "low").alias("comp")), "known")
    scratch.drop(classes, *links)
    out = sketch.select("doc_id", "n_shingles", "f1", "f2").join(known, ["f1", "f2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))


def _centres(large: DataFrame, percent: int) -> DataFrame:
    """(key, rep, n) -> pairs of a member and the STARS centres with which it shares most keys, in units of about
    BLOCK members of one centre. A key's centre is its least member."""
    centre = large.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("m")).select("key", F.col("m.rep").alias("c"), F.col("m.n").alias("cn"))
    fits = F.least("n", "cn") * 100 >= F.greatest("n", "cn") * percent
    met = large.join(centre, "key").where((F.col("rep") != F.col("c")) & fits).groupBy("rep", "c").agg(F.count("*").alias("keys"))
    # A member has at most as many centres as there are bands.
    best = met.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("keys", "c")), asc=False).alias("m"))
    best = best.select("rep", F.explode(F.slice("m", 1, STARS)).alias("m")).select("rep", "m.*")
    size = best.groupBy("c").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    x = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    return best.join(size, "c").select(F.col("c").alias("key"), x.alias("x"), F.lit(0).alias("y"), F.col("rep").alias("a"), F.col("c").alias("b"), F.col("rep").alias("la"), F.col("c").alias("lb"), F.col("keys").cast("double").alias("estimate"))


def _labels(reps: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, label): each takes the least one it is linked with, if less, and what that one takes, four steps
    up. Labels never join what no links join; what they leave apart is compared in full later."""
    up = links.groupBy(F.greatest("a", "b").alias("rep")).agg(F.min(F.least("a", "b")).alias("up"))
    for _ in range(2):
        above = up.select(F.col("rep").alias("up"), F.col("up").alias("higher"))
        up = up.join(above, "up", "left").select("rep", F.coalesce("higher", "up").alias("up"))
    return reps.join(up, "rep", "left").select("rep", F.coalesce("up", "rep").alias("label"))


def _units(rest: DataFrame) -> DataFrame:
    """Members of keys, dealt to blocks by hash: one row for each unit (key, x, y) of two blocks, or of
    one, in which a member is compared; right says that it is in the second block."""
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    own = rest.withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int"))
    units = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return units.select("key", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), (F.col("i") > F.col("j")).alias("right"), "rep", "label", "n")
