"""Linear grouping: lengths are rounded up within groups of equal cardinality, and few sequences are lost by it."""

import collections
import random

from derivanta.llm.packing import pack, places, plan_sequences

CAPACITY = 2048


def lengths(n, seed=3):
    r = random.Random(seed)
    return collections.Counter(min(CAPACITY, 1 + int(r.lognormvariate(6, 1.2))) for _ in range(n))


def check(counts, plan):
    assert all(0 < sum(ls) <= CAPACITY and m > 0 for ls, m in plan)
    used = collections.Counter()
    for ls, m in plan:
        for n in ls:
            used[n] += m
    assert used == +collections.Counter(counts)


def test_sequences_near_the_bound():
    for n in (3_000, 30_000):
        counts = lengths(n)
        plan = plan_sequences(counts, CAPACITY)
        check(counts, plan)
        bound = -(-sum(k * v for k, v in counts.items()) // CAPACITY)
        assert sum(m for _, m in plan) <= 1.005 * bound + 1


def test_lengths_are_rounded():
    # Two groups of two documents each: 1000 and 1010 count as 1010, 1030 and 1040 as 1040, so that no pair
    # of the larger group fits 2,048 with a small one, though 1000 + 1040 would.
    counts = {1000: 1, 1010: 1, 1030: 1, 1040: 1}
    plan = plan_sequences(counts, CAPACITY, groups=2, small=8)
    check(counts, plan)
    assert sorted(sorted(ls) for ls, _ in plan) == [[1000, 1010], [1030], [1040]]
    assert sum(m for _, m in plan_sequences(counts, CAPACITY, groups=4, small=8)) == 2


def test_places_do_not_overlap():
    counts = lengths(2_000)
    plan = plan_sequences(counts, CAPACITY)
    seen = collections.defaultdict(list)
    for n, rows in places(plan).items():
        ends = [*rows[1:, 0], counts[n]]
        for (rank, sequence, offset), end in zip(rows, ends, strict=True):
            for r in range(rank, end):
                seen[sequence + r - rank].append((offset, n))
    assert sorted(seen) == list(range(sum(m for _, m in plan)))
    for x in seen.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n


def test_clashing_names_and_repeats(spark):
    rows = [(1, 0, 5, 9, 9, 9), (1, 0, 5, 9, 9, 9), (None, 0, 10, 1, 2, 3), (2, 0, 3, None, 1, 2)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, n long, row long, offset long")
    got = pack(pieces, 10)
    assert got.columns == ["doc_id", "piece", "length", "n", "row", "sequence_id", "offset"]
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(sum(n for _, n in x) for x in by.values()) == [3, 10, 10]
    assert pack(pieces.limit(0), 10).count() == 0
