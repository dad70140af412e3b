import hashlib
import random

import pytest
from derivanta.llm import merkle
from pyspark.sql import functions as F

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
FIELD = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_tree(hashes, fanout):
    """The root, and for each node its siblings by level."""
    sides, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // fanout * fanout : p // fanout * fanout + fanout]
            sides[i].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
        level, at = [H(*level[i : i + fanout]) for i in range(0, len(level), fanout)], [p // fanout for p in at]
    return level[0], sides


def plain(rows, fanout):
    leaf = {r: H(*map(FIELD, r)) for r in rows}
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf[r])):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([leaf[r] for r in groups[s]], fanout) for s in names}
    root, tops = plain_tree([trees[s][0] for s in names], fanout)
    return sorted((str(r[0]), leaf[r], trees[s][0], root, tuple(trees[s][1][i] + tops[k])) for k, s in enumerate(names) for i, r in enumerate(groups[s]))


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_equals_a_plain_tree(spark, fanout):
    random.seed(fanout)
    sizes = {"hot": 90, None: 17, "": 16, "é": 1, "z": 33, "Z": 2} | {f"s{i}": 1 for i in range(20)}
    rows = [(None if random.random() < 0.03 else random.randrange(10**6), s, random.choice(["", None, "a\nb", "ü" * 50])) for s, n in sizes.items() for _ in range(n)]
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    # Columns of any other name come through.
    leaves = docs.withColumn("leaf", merkle.leaf_hash(*[F.col(c) for c in docs.columns])).withColumnsRenamed({"text": "hash"}).withColumn("group", F.lit(1)).withColumn("place", F.lit("x")).withColumn("n", F.lit(2))
    got = merkle.manifest(leaves, "source", ["doc_id"], fanout=fanout).withColumn("folded", merkle.fold(F.col("leaf"), F.col("siblings"))).withColumn("proof", merkle.proof_hash(F.col("siblings")))
    found = got.collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, tuple((x.before, x.after) for x in r.siblings)) for r in found) == plain(rows, fanout)
    assert all(r.folded == r.root for r in found)
    assert all(r.proof == H(*[x.before + x.after for x in r.siblings]) for r in found)


def test_tampering_shows(spark):
    docs = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.lit("a")).alias("s"))
    made = merkle.manifest(docs.withColumn("leaf", merkle.leaf_hash(F.col("id"))), "s", ["id"])
    forged = made.withColumn("ok", merkle.fold(F.when(F.col("id") % 7 == 0, merkle.leaf_hash(F.col("id") + 1)).otherwise(F.col("leaf")), F.col("siblings")) == F.col("root"))
    assert {r.id for r in forged.where("not ok").collect()} == {i for i in range(500) if i % 7 == 0}


@pytest.mark.parametrize("n", [0, 1])
def test_no_row_and_one_row(spark, n):
    """A lone leaf is its source's root and the whole one; its proof is the digest of nothing."""
    docs = spark.range(n).withColumn("s", F.lit(None).cast("string")).withColumn("leaf", merkle.leaf_hash(F.col("id")))
    rows = merkle.manifest(docs, "s", ["id"]).collect()
    assert len(rows) == n and all(r.leaf == r.subroot == r.root and r.siblings == [] for r in rows)


def test_repeated_rows_and_long_texts(spark):
    """Equal rows are leaves of their own, one after the other; a text may be very long."""
    rows = [(1, "a", "x" * 3_000_000), (1, "a", "x" * 3_000_000), (1, "a", "y"), (0, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = merkle.manifest(docs.withColumn("leaf", merkle.leaf_hash(*[F.col(c) for c in docs.columns])).drop("text"), "source", ["doc_id"]).collect()
    leaves = sorted((H(*map(FIELD, r)) for r in rows[:3]))
    first = H(*map(FIELD, rows[3]))
    assert {r.root for r in got} == {H(first, *leaves)} and len(got) == 4


def test_names_that_clash(spark):
    with pytest.raises(ValueError, match="rename"):
        merkle.manifest(spark.range(1).withColumn("leaf", F.lit("x")).withColumn("Root", F.lit(1)), "id", ["id"])
